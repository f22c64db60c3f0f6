"""Names for SQL: text functions that Catalyst inlines, and a forecaster as a table function."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from storyweft.functions.text import DATE_FORMATS, ENGLISH_MARKERS, PUNCTUATION

_MARKS = PUNCTUATION.replace("\\", "\\\\").replace("'", "\\'")
_DATES = ", ".join("try_to_timestamp(t, '" + f.replace("'", "\\'") + "')" for f in DATE_FORMATS)
_MARKERS = ", ".join(f"'{m}'" for m in ENGLISH_MARKERS)

#: Name, arguments, result and body of each text function; each is what the column function of the same name computes.
FUNCTIONS = (
    ("clean_text", "t STRING", "STRING", f"trim(regexp_replace(translate(regexp_replace(regexp_replace(lower(coalesce(t, '')), '(?U)https?://\\\\S+|www\\\\.\\\\S+', ''), '<[^\\\\n]*?>', ''), '{_MARKS}', ''), '(?U)[\\\\s\\\\x1c-\\\\x1f]+', ' '))"),
    ("clean_text_light", "t STRING", "STRING", "trim(regexp_replace(regexp_replace(regexp_replace(t, 'https?://[^ ]+', ''), '<[^>]*>', ' '), '\\\\s+', ' '))"),
    ("url_domain", "url STRING", "STRING", "regexp_replace(try_parse_url(url, 'HOST'), '^www\\\\.', '')"),
    ("truncated", "t STRING, most INT", "STRING", "CASE WHEN length(t) > most THEN concat(substring(t, 1, most), '...') ELSE t END"),
    ("normalize_date", "t STRING", "STRING", f"CASE WHEN t <> '' THEN coalesce(date_format(coalesce({_DATES}), \"yyyy-MM-dd'T'HH:mm:ss\"), t) END"),
    ("detect_language", "t STRING", "STRING", f"CASE WHEN size(array_intersect(split(clean_text(t), ' '), array({_MARKERS}))) > 3 THEN 'en' ELSE 'unknown' END"),
    ("time_decay", "weight DOUBLE, days DOUBLE, rate DOUBLE", "DOUBLE", "weight * exp(-rate * days)"),
    ("sigmoid", "x DOUBLE", "DOUBLE", "1 / (1 + exp(-x))"),
    ("clamp", "x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "greatest(low, least(high, x))"),
    ("meta_get", "meta STRING, path STRING, otherwise STRING", "STRING", "coalesce(get_json_object(meta, path), otherwise)"),
)


class Forecast:
    """Handler of the table function: a partition is a series, given in the order of its days; it ends in its forecast's rows.

    ``linear`` is a least-squares line with a t interval (three points at least), ``simple`` the mean of the last seven points plus their slope.
    """

    def __init__(self):
        self.key, self.values, self.method, self.horizon = None, [], "linear", 0

    def eval(self, row, method: str, horizon: int):
        self.key, self.method, self.horizon = row["narrative_id"], method, horizon
        self.values.append((row["day"], float(row["n"])))

    def terminate(self):
        y = [v for _, v in sorted(self.values)]
        if self.method not in ("linear", "simple"):
            raise ValueError(f"no method {self.method}")
        for step in range(1, self.horizon + 1):
            made = self._line(y, step) if self.method == "linear" else self._simple(y[-7:], step)
            if made:
                yield self.key, step, *made

    @staticmethod
    def _line(y: list[float], step: int) -> tuple[float, float, float] | None:
        from storyweft.operators.forecast import NORMAL, T_CRITICAL

        n = len(y)
        if n < 3:
            return None
        mx, my = (n - 1) / 2, sum(y) / n
        sxx = sum((i - mx) ** 2 for i in range(n))
        slope = sum((i - mx) * (v - my) for i, v in enumerate(y)) / sxx
        rest = sum((v - my - slope * (i - mx)) ** 2 for i, v in enumerate(y))
        x = n - 1 + step
        t = T_CRITICAL[n - 3] if n - 2 <= len(T_CRITICAL) else NORMAL
        half = t * math.sqrt(rest / (n - 2)) * math.sqrt(1 + 1 / n + (x - mx) ** 2 / sxx)
        yhat = my + slope * (x - mx)
        return yhat, yhat - half, yhat + half

    @staticmethod
    def _simple(y: list[float], step: int) -> tuple[float, float, float]:
        from storyweft.operators.forecast import NORMAL

        n, mean = len(y), sum(y) / len(y)
        sd = math.sqrt(sum((v - mean) ** 2 for v in y) / (n - 1)) if n > 1 else 0.0
        yhat = max(0.0, mean + ((y[-1] - y[0]) / (n - 1) if n > 1 else 0.0) * step)
        return yhat, max(0.0, yhat - NORMAL * sd), yhat + NORMAL * sd


def register(spark: SparkSession) -> list[str]:
    """Create all names as temporary functions of a session: ``SELECT clean_text(text)``,
    ``SELECT * FROM forecast(TABLE(daily) PARTITION BY narrative_id ORDER BY (day), 'linear', 7)``.
    """
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("forecast", udtf(Forecast, returnType="narrative_id bigint, step int, yhat double, lower double, upper double"))
    return [f[0] for f in FUNCTIONS] + ["forecast"]
