"""Queries of the extension surfaces: plugin sources, SQL names and the table function."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyweft.functions import sql
from storyweft.functions.lineage import shared_folder
from storyweft.plans.forecasts import _F, _FIT, _ROUND, _STEPS, _T
from storyweft.plans.registry import query
from storyweft.plans.series import _R
from storyweft.plans.texts import _clean
from storyweft.sources import archives
from storyweft.sources.tables import Tables


@query("u2_page_archive", "SELECT page_id, url, md5(html) AS digest FROM pages")
def _(t: Tables):
    """All pages written as an archive of JSON lines, and read back by the plugin."""
    folder = shared_folder(t.spark, "page-archive")
    t.raw("pages").select("page_id", "url", "html").write.option("compression", "gzip").json(folder)
    archives.register(t.spark)
    return t.spark.read.format("page_archive").load(folder).select("page_id", "url", F.md5("html").alias("digest"))


@query("u3_sql_names", f"SELECT doc_id, md5({_clean('text')}) AS cleaned, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS short, CASE doc_id % 3 WHEN 0 THEN '2024-03-04T00:00:00' WHEN 1 THEN 'soon' END AS day, CAST(least(5.0, doc_id) AS DOUBLE) AS held FROM documents")
def _(t: Tables):
    sql.register(t.spark)
    t.raw("documents").createOrReplaceTempView("u3_documents")
    return t.spark.sql("SELECT doc_id, md5(clean_text(text)) AS cleaned, truncated(text, 20) AS short, normalize_date(CASE doc_id % 3 WHEN 0 THEN '03/04/2024' WHEN 1 THEN 'soon' ELSE '' END) AS day, clamp(doc_id, 0, 5) AS held FROM u3_documents")


def _forecast(t: Tables, method: str):
    sql.register(t.spark)
    t.daily.createOrReplaceTempView("u6_daily")
    return _R(t.spark.sql(f"SELECT * FROM forecast(TABLE(u6_daily) PARTITION BY narrative_id ORDER BY (day), '{method}', 7)"), *_F)


@query("u6_forecast_linear", f"WITH {_FIT}, {_STEPS}, f AS (SELECT narrative_id, step, intercept + slope * (points - 1 + step) AS yhat, {_T}[CAST(points - 2 AS INT)] * sqrt(greatest(0.0, syy * (1 - r2)) / (points - 2)) * sqrt(1 + 1 / points + power(points - 1 + step - mx, 2) / sxx) AS half FROM fit CROSS JOIN steps), g AS (SELECT narrative_id, step, yhat, yhat - half AS lower, yhat + half AS upper FROM f) SELECT {_ROUND} FROM g")
def _(t: Tables):
    return _forecast(t, "linear")


@query("u6_forecast_simple", f"WITH {_STEPS}, m AS (SELECT narrative_id, AVG(n) AS mean, STDDEV_SAMP(n) AS sd, (arg_max(n, day) - arg_min(n, day)) / 6 AS slope FROM series WHERE i >= len - 7 GROUP BY 1), f AS (SELECT narrative_id, step, greatest(0.0, mean + slope * step) AS yhat, sd FROM m CROSS JOIN steps), g AS (SELECT narrative_id, step, yhat, greatest(0.0, yhat - 1.96 * sd) AS lower, yhat + 1.96 * sd AS upper FROM f) SELECT {_ROUND} FROM g")
def _(t: Tables):
    return _forecast(t, "simple")
