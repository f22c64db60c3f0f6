"""Queries of the window operators (counts, growth, smoothing, anomalies, change points)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from storyweft.functions.numbers import rounded
from storyweft.operators import series as S
from storyweft.plans.registry import query
from storyweft.sources.tables import AS_OF, DIMENSIONS, Tables


def _R(df, *names):
    """The named columns rounded to six digits."""
    own = lambda c, kind: rounded(F.col(c)) if kind == "double" else F.round(c, 6)
    return df.select(*(own(c, kind).alias(c) if c in names else F.col(c) for c, kind in df.dtypes))


def long_scores(t: Tables):
    """Snapshots as one row per dimension: narrative_id, day, dimension, score."""
    return t.snapshots.unpivot(["narrative_id", "day"], list(DIMENSIONS), "dimension", "score").filter("score is not null")


@query("a1_daily_counts", "SELECT narrative_id, day, n FROM daily", dates="day")
def _(t: Tables):
    return t.daily


@query("w1_growth", """WITH c AS (SELECT narrative_id, day, n, SUM(n) OVER w AS cumulative FROM daily WINDOW w AS (PARTITION BY narrative_id ORDER BY day)), p AS (SELECT *, LAG(cumulative) OVER (PARTITION BY narrative_id ORDER BY day) AS before FROM c) SELECT narrative_id, day, n, CAST(cumulative AS BIGINT) AS cumulative, ROUND(CASE WHEN COALESCE(before, 0) <> 0 THEN (cumulative - before) / before ELSE 0.0 END, 6) AS rate FROM p""", dates="day")
def _(t: Tables):
    return _R(S.growth_rate(t.daily), "rate")


@query("w1_growth_summary", """WITH c AS (SELECT *, SUM(n) OVER (PARTITION BY narrative_id ORDER BY day) AS cum FROM series), p AS (SELECT *, LAG(cum) OVER (PARTITION BY narrative_id ORDER BY day) AS before FROM c), r AS (SELECT *, CASE WHEN COALESCE(before, 0) <> 0 THEN (cum - before) / before ELSE 0.0 END AS rate FROM p), g AS (SELECT narrative_id, AVG(rate) AS m, MAX(cum) AS total, MAX(len) AS len, AVG(rate) FILTER (WHERE i < 7) AS early, AVG(rate) FILTER (WHERE i >= len - 7) AS late FROM r GROUP BY 1) SELECT narrative_id, ROUND(m, 6) AS mean_rate, CAST(total AS BIGINT) AS total, CASE WHEN len < 14 THEN 'stable' WHEN late > early * 1.1 THEN 'accelerating' WHEN late < early * 0.9 THEN 'decelerating' ELSE 'stable' END AS trend FROM g""")
def _(t: Tables):
    return _R(S.growth_summary(t.daily), "mean_rate")


@query("w2_trending", f"""WITH c AS (SELECT narrative_id, COUNT(*) FILTER (WHERE date_diff('day', CAST(detected_at AS DATE), DATE '{AS_OF}') BETWEEN 1 AND 10) AS current, COUNT(*) FILTER (WHERE date_diff('day', CAST(detected_at AS DATE), DATE '{AS_OF}') BETWEEN 11 AND 20) AS previous FROM instances GROUP BY 1), g AS (SELECT *, CASE WHEN previous > 0 THEN (current - previous) / previous WHEN current > 0 THEN 1.0 ELSE 0.0 END AS growth FROM c WHERE current + previous > 0) SELECT narrative_id, current, previous, ROUND(growth, 6) AS growth FROM g ORDER BY g.growth DESC, current DESC, narrative_id LIMIT 20""")
def _(t: Tables):
    return _R(S.trending(t.instances, AS_OF, 10, 20), "growth")


@query("w3_smooth_mean", "SELECT narrative_id, day, n, ROUND(AVG(n) OVER (PARTITION BY narrative_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM daily", dates="day")
def _(t: Tables):
    return _R(S.smooth_mean(t.daily, 7), "smooth")


@query("w4_smooth_exponential", """WITH RECURSIVE e AS (SELECT narrative_id, i, day, CAST(n AS DOUBLE) AS s FROM series WHERE i = 0 UNION ALL SELECT x.narrative_id, x.i, x.day, x.n * 0.25 + e.s * 0.75 FROM e JOIN series x ON x.narrative_id = e.narrative_id AND x.i = e.i + 1) SELECT narrative_id, day, ROUND(s, 6) AS smooth FROM e""", dates="day")
def _(t: Tables):
    return _R(S.smooth_exponential(t.daily, 7), "smooth")


_GAUSS = [math.exp(-((k - 3) ** 2) / (2 * 1.75**2)) for k in range(7)]


@query("w5_smooth_gaussian", "SELECT narrative_id, day, n, ROUND(" + " + ".join(f"COALESCE({'LAG' if k <= 3 else 'LEAD'}(n, {abs(3 - k)}) OVER w, 0) * {w / sum(_GAUSS)!r}" for k, w in enumerate(_GAUSS)) + ", 6) AS smooth FROM daily WINDOW w AS (PARTITION BY narrative_id ORDER BY day)", dates="day")
def _(t: Tables):
    return _R(S.smooth_gaussian(t.daily, 7), "smooth")


@query("w6_rolling_anomaly", """WITH f AS (SELECT narrative_id, day, n, COUNT(*) OVER w - 1 AS m, SUM(n) OVER w - n AS s, SUM(n * n) OVER w - n * n AS q FROM daily WINDOW w AS (PARTITION BY narrative_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), g AS (SELECT *, s / m AS mean, sqrt(greatest(0.0, round(q / m - (s / m) * (s / m), 9))) AS sd FROM f), z AS (SELECT narrative_id, day, n, CASE WHEN m >= 3 AND sd > 0 THEN abs(n - mean) / sd ELSE 0.0 END AS z FROM g) SELECT narrative_id, day, n, ROUND(z, 6) AS z, z > 2.5 AS is_anomaly FROM z""", dates="day")
def _(t: Tables):
    return _R(S.rolling_anomaly(t.daily, 7, 2.5), "z")


_SCORES = """s AS (SELECT narrative_id, day, i, len, AVG(n) OVER b AS before, AVG(n) OVER a AS after, VAR_POP(n) OVER b AS vb, VAR_POP(n) OVER a AS va FROM series WINDOW b AS (PARTITION BY narrative_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY narrative_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), t AS (SELECT narrative_id, day, i, before, after, CASE WHEN vb + va > 0 THEN abs(after - before) / sqrt((vb + va) / 5) ELSE 0.0 END AS score FROM s WHERE i >= 5 AND i <= len - 5)"""


@query("w7_change_scores", f"WITH {_SCORES} SELECT narrative_id, day, ROUND(score, 6) AS score FROM t", dates="day")
def _(t: Tables):
    return _R(S.change_scores(t.daily, 5).select("narrative_id", "day", "score"), "score")


_KEPT = "h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY narrative_id ORDER BY i) AS k FROM t WHERE score > 2), g AS (SELECT narrative_id, k, i AS last, TRUE AS kept FROM h WHERE k = 1 UNION ALL SELECT h.narrative_id, h.k, CASE WHEN h.i - g.last >= 5 THEN h.i ELSE g.last END, h.i - g.last >= 5 FROM g JOIN h ON h.narrative_id = g.narrative_id AND h.k = g.k + 1)"


@query("w7_change_points", f"""WITH RECURSIVE {_SCORES}, {_KEPT} SELECT h.narrative_id, h.day, ROUND(h.score, 6) AS score, CASE WHEN after > before THEN 'increase' ELSE 'decrease' END AS direction, ROUND(CASE WHEN before <> 0 THEN (after - before) / before * 100 ELSE 0.0 END, 6) AS change_pct FROM h JOIN g ON g.narrative_id = h.narrative_id AND g.k = h.k WHERE g.kept""", dates="day")
def _(t: Tables):
    return _R(S.change_points(t.daily, 5, 2.0), "score", "change_pct")


@query("t28_step_segments", f"WITH RECURSIVE {_SCORES}, {_KEPT}, p AS (SELECT h.narrative_id, h.day FROM h JOIN g ON g.narrative_id = h.narrative_id AND g.k = h.k WHERE g.kept), l AS (SELECT *, LEAD(day) OVER (PARTITION BY narrative_id ORDER BY day) AS next FROM p) SELECT l.narrative_id, 'step' AS kind, l.day AS first_day, date_diff('day', l.day, COALESCE(next, e.day + 1)) AS days FROM l JOIN (SELECT narrative_id, MAX(day) AS day FROM daily GROUP BY 1) e ON e.narrative_id = l.narrative_id", dates="first_day")
def _(t: Tables):
    return S.step_segments(t.daily, 5, 2.0)


@query("w8_piecewise_trend", """WITH w AS (SELECT unnest(range(0, 21, 5)) AS w), f AS (SELECT narrative_id, w, regr_slope(n, i - w) AS slope, regr_r2(n, i - w) AS r2 FROM series, w WHERE i >= w AND i < w + 10 GROUP BY 1, 2), g AS (SELECT narrative_id, w, ROUND(COALESCE(slope, 0.0), 9) AS slope, r2 FROM f) SELECT narrative_id, w, ROUND(slope, 6) AS slope, COALESCE(sign(slope) * sign(LAG(slope) OVER (PARTITION BY narrative_id ORDER BY w)) < 0, FALSE) AS turns FROM g""")
def _(t: Tables):
    return _R(S.piecewise_trend(t.daily, 10).drop("r2"), "slope")


@query("w9_w10_acceleration", """WITH d AS (SELECT *, n - LAG(n) OVER (PARTITION BY narrative_id ORDER BY day) AS d, i >= 15 AS late FROM series) SELECT narrative_id, ROUND(COALESCE(regr_slope(n, i) FILTER (WHERE late), 0.0) - COALESCE(regr_slope(n, i) FILTER (WHERE NOT late), 0.0), 6) AS by_halves, ROUND(COALESCE(regr_slope(d, i), 0.0), 6) AS by_differences FROM d GROUP BY 1""")
def _(t: Tables):
    return _R(S.acceleration(t.daily), "by_halves", "by_differences")


@query("w11_recent_change", "WITH b AS (SELECT *, LAG(n, 2) OVER (PARTITION BY narrative_id ORDER BY day) AS back FROM series) SELECT narrative_id, COALESCE((n - back) / 2, 0.0) AS recent_rate FROM b WHERE i = len - 1")
def _(t: Tables):
    return S.recent_change(t.daily)


_ENDS = "e AS (SELECT narrative_id, dimension, arg_min(score, day) AS first, arg_max(score, day) AS last, COUNT(*) AS points FROM scores GROUP BY 1, 2)"


@query("w12_first_last_change", f"WITH {_ENDS} SELECT narrative_id, dimension, first, last, points, ROUND((last - first) / first * 100, 6) AS change_pct FROM e WHERE points > 1 AND first <> 0 AND abs((last - first) / first * 100) >= 20")
def _(t: Tables):
    return _R(S.first_last_change(long_scores(t), 20), "change_pct")


@query("w13_lag_correlation", """WITH p AS (SELECT a.narrative_id AS a, b.narrative_id AS b, a.day, a.n AS ya, b.n AS yb, a.i FROM series a JOIN series b ON b.narrative_id = a.narrative_id + 1 AND b.day = a.day), l AS (SELECT unnest(range(-7, 8)) AS lag), c AS (SELECT p.a, p.b, lag, ROUND(COALESCE(CASE WHEN isnan(corr(p.ya, q.yb)) THEN 0.0 ELSE corr(p.ya, q.yb) END, 0.0), 6) AS r FROM p CROSS JOIN l JOIN p q ON q.a = p.a AND q.i = p.i + lag GROUP BY 1, 2, 3), o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY a, b ORDER BY abs(r) DESC, lag) AS k FROM c) SELECT a, b, CAST(lag AS INT) AS lag, r, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'none' END AS strength FROM o WHERE k = 1""")
def _(t: Tables):
    a = t.daily.select(F.col("narrative_id").alias("a"), "day", F.col("n").alias("ya"))
    b = t.daily.select((F.col("narrative_id") - 1).alias("a"), F.col("narrative_id").alias("b"), "day", F.col("n").alias("yb"))
    return S.lag_correlation(a.join(b, ["a", "day"]), 7)


@query("w14_autocorrelation", """WITH d AS (SELECT narrative_id, day, n - LAG(n) OVER (PARTITION BY narrative_id ORDER BY day) AS d FROM daily), e AS (SELECT narrative_id, ROW_NUMBER() OVER (PARTITION BY narrative_id ORDER BY day) AS i, d - AVG(d) OVER (PARTITION BY narrative_id) AS e FROM d WHERE d IS NOT NULL), l AS (SELECT unnest(range(1, 11)) AS lag), z AS (SELECT narrative_id, SUM(e * e) AS z FROM e GROUP BY 1), s AS (SELECT x.narrative_id, lag, SUM(x.e * y.e) AS s FROM e x CROSS JOIN l JOIN e y ON y.narrative_id = x.narrative_id AND y.i = x.i - lag GROUP BY 1, 2) SELECT s.narrative_id, CAST(lag AS INT) AS lag, ROUND(CASE WHEN z <> 0 THEN s / z ELSE 0.0 END, 6) AS acf FROM s JOIN z USING (narrative_id)""")
def _(t: Tables):
    return _R(S.autocorrelation(t.daily, 10), "acf")


@query("w15_sessions", """WITH g AS (SELECT *, CASE WHEN epoch_us(detected_at) - LAG(epoch_us(detected_at)) OVER w < 21600000000 THEN 0 ELSE 1 END AS starts FROM instances WINDOW w AS (PARTITION BY narrative_id ORDER BY detected_at, instance_id)), s AS (SELECT *, SUM(starts) OVER (PARTITION BY narrative_id ORDER BY detected_at, instance_id) AS session FROM g) SELECT narrative_id, CAST(session AS BIGINT) AS session, COUNT(*) AS items, MIN(detected_at) AS first_at, MAX(detected_at) AS last_at FROM s GROUP BY 1, 2 HAVING COUNT(*) >= 3""", dates="first_at last_at")
def _(t: Tables):
    return S.sessions(t.instances, 6, 3)


@query("w18_reliability_trend", """WITH m AS (SELECT source_id, date_trunc('week', CAST(day AS TIMESTAMP)) AS week, AVG(100 - LEAST(100, 5 * n)) AS score FROM (SELECT source_id, CAST(detected_at AS DATE) AS day, COUNT(*) AS n FROM misinfo_events GROUP BY 1, 2) GROUP BY 1, 2), r AS (SELECT *, LAG(score) OVER (PARTITION BY source_id ORDER BY week) AS before, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY week DESC) AS k FROM m) SELECT source_id, ROUND(score, 6) AS score, CASE WHEN score > before * 1.05 THEN 'improving' WHEN score < before * 0.95 THEN 'declining' ELSE 'stable' END AS trend FROM r WHERE k = 1""")
def _(t: Tables):
    from storyweft.operators.reliability import reliability_history, reliability_trend

    return _R(reliability_trend(reliability_history(t.misinfo_events)), "score")


@query("w19_ewma", "SELECT narrative_id, ROUND(SUM(n * power(0.75, len - 1 - i)) / SUM(power(0.75, len - 1 - i)), 6) AS ewma FROM series GROUP BY 1")
def _(t: Tables):
    return _R(S.ewma(t.daily, 7), "ewma")


@query("w20_temporal_pattern", """WITH g AS (SELECT narrative_id, AVG(n) AS mean, COALESCE(STDDEV_SAMP(n), 0) AS sd, AVG(n) FILTER (WHERE i < 15) AS early, AVG(n) FILTER (WHERE i >= 15) AS later FROM series GROUP BY 1), h AS (SELECT narrative_id, CASE WHEN mean > 0 THEN 1 - LEAST(1.0, sd / mean) ELSE 0.0 END AS c, CASE WHEN early <> 0 THEN (later - early) / early ELSE 0.0 END AS g FROM g) SELECT narrative_id, ROUND(c, 6) AS consistency, ROUND(g, 6) AS growth, ROUND(c * 0.5 + GREATEST(0.0, LEAST(1.0, g)) * 0.5, 6) AS score FROM h""")
def _(t: Tables):
    return _R(S.temporal_pattern(t.daily), "consistency", "growth", "score")


@query("t5_decompose", """WITH a AS (SELECT *, i % 7 AS phase, CASE WHEN i >= 3 AND i < len - 3 THEN AVG(n) OVER (PARTITION BY narrative_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend FROM series), b AS (SELECT *, AVG(n - trend) OVER (PARTITION BY narrative_id, phase) AS mean FROM a), l AS (SELECT narrative_id, AVG(m) AS level FROM (SELECT narrative_id, phase, MIN(mean) AS m FROM b GROUP BY 1, 2) GROUP BY 1) SELECT narrative_id, day, ROUND(trend, 6) AS trend, ROUND(mean - level, 6) AS seasonal, ROUND(n - trend - (mean - level), 6) AS residual FROM b JOIN l USING (narrative_id)""", dates="day")
def _(t: Tables):
    return _R(S.decompose(t.daily, 7), "trend", "seasonal", "residual")


@query("t17_global_anomaly", """WITH z AS (SELECT narrative_id, day, n, CASE WHEN STDDEV_POP(n) OVER w > 0 THEN abs(n - AVG(n) OVER w) / STDDEV_POP(n) OVER w ELSE 0.0 END AS z FROM daily WINDOW w AS (PARTITION BY narrative_id)) SELECT narrative_id, day, n, ROUND(z, 6) AS z, z > 2.5 AS is_anomaly FROM z""", dates="day")
def _(t: Tables):
    return _R(S.global_anomaly(t.daily, 2.5), "z")


_SEGMENTS = "m AS (SELECT narrative_id, day, n > ROUND(AVG(n) OVER (PARTITION BY narrative_id) + 2 * STDDEV_POP(n) OVER (PARTITION BY narrative_id), 9) AS spike, n > LAG(n) OVER (PARTITION BY narrative_id ORDER BY day) AS growth, n < LAG(n) OVER (PARTITION BY narrative_id ORDER BY day) AS decay, n = 0 AS quiet FROM daily), l AS (SELECT narrative_id, day, kind FROM m UNPIVOT (here FOR kind IN (spike, growth, decay, quiet)) WHERE here), r AS (SELECT *, day - CAST(ROW_NUMBER() OVER (PARTITION BY narrative_id, kind ORDER BY day) AS INT) AS run FROM l), seg AS (SELECT narrative_id, kind, MIN(day) AS first_day, COUNT(*) AS days FROM r GROUP BY narrative_id, kind, run HAVING kind = 'spike' OR COUNT(*) >= 3)"


@query("t28_detect_patterns", f"WITH {_SEGMENTS}, g AS (SELECT *, date_diff('day', LAG(first_day) OVER (PARTITION BY narrative_id, kind ORDER BY first_day), first_day) AS gap FROM seg) SELECT narrative_id, kind, COUNT(*) AS occurrences, ROUND(AVG(days), 6) AS mean_days, ROUND(AVG(gap), 6) AS avg_interval FROM g GROUP BY 1, 2")
def _(t: Tables):
    return _R(S.pattern_table(S.detect_patterns(t.daily)), "mean_days", "avg_interval")
