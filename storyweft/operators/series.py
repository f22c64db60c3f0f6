"""Window operators over series: one row per (key, day), all keys at once.

Every operator partitions by the key, so a series is never longer than its number of days; nothing
is collected. ``key``, ``day`` and ``n`` are the column names of a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

KEY, DAY, Y = "narrative_id", "day", "n"


def over(key: str = KEY, day: str = DAY) -> WindowSpec:
    return Window.partitionBy(key).orderBy(day)


def whole(key: str = KEY) -> WindowSpec:
    return Window.partitionBy(key)


def ratio(part: Column, base: Column, otherwise: float = 0.0) -> Column:
    """part / base; ``otherwise`` where the base is zero or missing."""
    return F.when(base != 0, part / base).otherwise(F.lit(otherwise))


def calendar(keys: DataFrame, first: str, last: str) -> DataFrame:
    """Every key on every day of a range (a generated spine, not a join)."""
    return keys.select("*", F.explode(F.expr(f"sequence(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)")).alias(DAY))


def daily_counts(rows: DataFrame, first: str, last: str, key: str = KEY, at: str = "detected_at") -> DataFrame:
    """Rows per key and day, zero on days without any."""
    counts = rows.groupBy(key, F.to_date(at).alias(DAY)).agg(F.count(F.lit(1)).alias(Y))
    return calendar(rows.select(key).distinct(), first, last).join(counts, [key, DAY], "left").withColumn(Y, F.coalesce(Y, F.lit(0).cast("long")))


def indexed(series: DataFrame, key: str = KEY) -> DataFrame:
    """With ``i`` (position from 0) and ``len`` (length of the series)."""
    return series.withColumn("i", F.row_number().over(over(key)) - 1).withColumn("len", F.count(F.lit(1)).over(whole(key)))


def growth_rate(series: DataFrame) -> DataFrame:
    """Daily count, running total, and its relative growth (0 after a zero total)."""
    total = F.sum(Y).over(over().rowsBetween(Window.unboundedPreceding, 0))
    rows = series.withColumn("cumulative", total)
    before = F.lag("cumulative").over(over())
    return rows.withColumn("rate", ratio(F.col("cumulative") - before, F.coalesce(before, F.lit(0))))


def growth_summary(series: DataFrame, edge: int = 7) -> DataFrame:
    """Mean growth and whether it gains or loses, from the first and last ``edge`` rates of a series twice as long."""
    rows = indexed(growth_rate(series))
    early, late = F.avg(F.when(F.col("i") < edge, F.col("rate"))), F.avg(F.when(F.col("i") >= F.col("len") - edge, F.col("rate")))
    out = rows.groupBy(KEY).agg(F.avg("rate").alias("mean_rate"), F.max("len").alias("len"), early.alias("early"), late.alias("late"), F.max("cumulative").alias("total"))
    trend = F.when(F.col("len") < 2 * edge, "stable").when(F.col("late") > F.col("early") * 1.1, "accelerating").when(F.col("late") < F.col("early") * 0.9, "decelerating").otherwise("stable")
    return out.select(KEY, "mean_rate", "total", trend.alias("trend"))


def trending(rows: DataFrame, as_of: str, days: int, k: int, key: str = KEY, at: str = "detected_at") -> DataFrame:
    """The k keys that grew most from the previous period to the current one (1 from nothing)."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date(at))
    counts = rows.filter(age.between(1, 2 * days)).groupBy(key).agg(F.count_if(age <= days).alias("current"), F.count_if(age > days).alias("previous"))
    growth = F.when(F.col("previous") > 0, (F.col("current") - F.col("previous")) / F.col("previous")).when(F.col("current") > 0, 1.0).otherwise(0.0)
    return counts.withColumn("growth", growth).orderBy(F.desc("growth"), F.desc("current"), key).limit(k)


def smooth_mean(series: DataFrame, width: int) -> DataFrame:
    """Centred moving mean over ``width // 2`` neighbours each side, fewer at the ends; short series stay."""
    h = width // 2
    mean = F.avg(Y).over(over().rowsBetween(-h, h))
    return indexed(series).withColumn("smooth", F.when(F.col("len") < width, F.col(Y).cast("double")).otherwise(mean)).drop("i", "len")


def smooth_exponential(series: DataFrame, width: int) -> DataFrame:
    """Exponential smoothing, alpha 2 / (width + 1), from the first value on."""
    alpha = 2 / (width + 1)
    ordered = series.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(DAY, F.col(Y).cast("double").alias("y")))).alias("a"))
    first = F.struct(F.element_at("a", 1)["y"].alias("s"), F.array(F.element_at("a", 1)["y"]).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = x["y"] * alpha + acc["s"] * (1 - alpha)
        return F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out"))

    folded = ordered.withColumn("s", F.aggregate(F.slice("a", 2, 1 << 30), first, step)["out"])
    return folded.select(KEY, F.posexplode(F.arrays_zip(F.col("a.day").alias("day"), F.col("s").alias("s")))).select(KEY, F.col("col.day").alias(DAY), F.col("col.s").alias("smooth"))


def smooth_gaussian(series: DataFrame, width: int) -> DataFrame:
    """Normalised Gaussian kernel, sigma a quarter of the width; zeros beyond the ends."""
    import math

    half, sigma = width // 2, width / 4
    weights = [math.exp(-((k - half) ** 2) / (2 * sigma**2)) for k in range(2 * half + 1)]
    total = sum(weights)
    terms = [F.coalesce(F.lag(Y, half - k, 0).over(over()), F.lit(0)) * (w / total) for k, w in enumerate(weights)]
    return series.withColumn("smooth", sum(terms[1:], terms[0]))


def rolling_anomaly(series: DataFrame, width: int, limit: float) -> DataFrame:
    """Points far from their neighbours' mean, in population deviations of at least three neighbours."""
    h = width // 2
    near = over().rowsBetween(-h, h)
    y = F.col(Y).cast("double")
    m = F.count(F.lit(1)).over(near) - 1
    mean = (F.sum(y).over(near) - y) / m
    var = (F.sum(y * y).over(near) - y * y) / m - mean * mean
    rows = series.withColumn("m", m).withColumn("mean", mean).withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.round(var, 9))))
    z = F.when((F.col("m") >= 3) & (F.col("sd") > 0), F.abs(y - F.col("mean")) / F.col("sd")).otherwise(F.lit(0.0))
    return rows.withColumn("z", z).withColumn("is_anomaly", z > limit).drop("m", "mean", "sd")


def global_anomaly(series: DataFrame, limit: float) -> DataFrame:
    """Points whose distance from the series' mean exceeds ``limit`` population deviations.

    Counts are summed from their smallest on, whole numbers that a double holds exactly, so that a point at the limit is never above it by the order of its sums.
    """
    x, n = (F.col(Y) - F.min(Y).over(whole())).cast("double"), F.count(Y).over(whole())
    total = F.sum("x").over(whole())
    spread = n * F.sum(F.col("x") * F.col("x")).over(whole()) - total * total
    series = series.withColumn("x", x).withColumns({"total": total, "spread": spread, "n_points": n})
    z = F.when(F.col("spread") > 0, F.abs(F.col("x") * F.col("n_points") - F.col("total")) / F.sqrt("spread")).otherwise(F.lit(0.0))
    series = series.withColumn("z", z).drop("x", "total", "spread", "n_points")
    return series.withColumn("is_anomaly", F.col("z") > limit)


def variance(values: Column) -> Column:
    """Population variance of a short array by Welford's update in its order; scores that are exactly a limit fall as with SQL's sums."""

    def step(acc: Column, v: Column) -> Column:
        x, n = v.cast("double"), acc["n"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + (x - acc["mean"]) * (x - mean)).alias("m2"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), step, lambda s: F.when(s["n"] > 0, s["m2"] / s["n"]))


def change_scores(series: DataFrame, m: int) -> DataFrame:
    """Mean of the m points before and from each point on, and the pooled t score between the two."""
    before, after = over().rowsBetween(-m, -1), over().rowsBetween(0, m - 1)
    rows = indexed(series).select("*", F.avg(Y).over(before).alias("before"), F.avg(Y).over(after).alias("after"), F.collect_list(Y).over(before).alias("yb"), F.collect_list(Y).over(after).alias("ya"))
    rows = rows.withColumns({"vb": variance(F.col("yb")), "va": variance(F.col("ya"))})
    rows = rows.filter((F.col("i") >= m) & (F.col("i") <= F.col("len") - m))
    pooled = F.sqrt((F.col("vb") + F.col("va")) / m)
    score = F.when(pooled > 0, F.abs(F.col("after") - F.col("before")) / pooled).otherwise(F.lit(0.0))
    return rows.select(KEY, DAY, "i", "before", "after", score.alias("score"))


def change_points(series: DataFrame, m: int, limit: float) -> DataFrame:
    """Points above the limit, greedily from the left at least m apart, with direction and change in per cent."""
    hits = change_scores(series, m).filter(F.col("score") > limit)
    hits = hits.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("i", DAY, "before", "after", "score"))).alias("a"))
    start = F.expr("struct(CAST(-1000000 AS INT) AS last, slice(a, 1, 0) AS kept)")

    def step(acc: Column, x: Column) -> Column:
        return F.when(x["i"] - acc["last"] >= m, F.struct(x["i"].cast("int").alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    out = hits.select(KEY, F.explode(F.aggregate("a", start, step)["kept"]).alias("p")).select(KEY, "p.*")
    change = F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100).otherwise(F.lit(0.0))
    return out.select(KEY, DAY, "score", F.when(F.col("after") > F.col("before"), "increase").otherwise("decrease").alias("direction"), change.alias("change_pct"))


def regression(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares by group: n, slope, intercept, r2; a flat line has slope 0 and r2 0."""
    out = rows.groupBy(*keys).agg(F.regr_count(y, x).alias("points"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    return out.select(*keys, "points", F.coalesce("slope", F.lit(0.0)).alias("slope"), "intercept", F.coalesce("r2", F.lit(0.0)).alias("r2"))


def piecewise_trend(series: DataFrame, width: int) -> DataFrame:
    """Slope of each window of ``width`` points, every half width, and whether it turns against the last one."""
    stride = max(1, width // 2)
    rows = indexed(series)
    starts = F.expr(f"filter(sequence(CAST(0 AS BIGINT), CAST(greatest(0, len - {width}) AS BIGINT), CAST({stride} AS BIGINT)), w -> i >= w AND i < w + {width})")
    parts = rows.filter(F.col("len") >= width).withColumn("w", F.explode(starts))
    fit = regression(parts.withColumn("x", F.col("i") - F.col("w")), [KEY, "w"], "x", Y)
    fit = fit.withColumn("slope", F.round("slope", 9))  # the sign of rounding noise is no direction
    last = F.lag("slope").over(Window.partitionBy(KEY).orderBy("w"))
    return fit.select(KEY, "w", "slope", "r2", F.coalesce(F.signum("slope") * F.signum(last) < 0, F.lit(False)).alias("turns"))


def acceleration(series: DataFrame, least: int = 6) -> DataFrame:
    """Slope of the second half less that of the first, and the slope of first differences."""
    rows = indexed(series).withColumn("half", (F.col("i") >= F.floor(F.col("len") / 2)).cast("int"))
    rows = rows.withColumn("d", F.col(Y) - F.lag(Y).over(over()))
    slope = lambda h: F.coalesce(F.regr_slope(F.when(F.col("half") == h, F.col(Y)), F.col("i")), F.lit(0.0))
    out = rows.groupBy(KEY).agg(F.max("len").alias("len"), (slope(1) - slope(0)).alias("by_halves"), F.coalesce(F.regr_slope("d", "i"), F.lit(0.0)).alias("by_differences"))
    return out.select(KEY, F.when(F.col("len") >= least, F.col("by_halves")).otherwise(F.lit(0.0)).alias("by_halves"), "by_differences")


def recent_change(series: DataFrame) -> DataFrame:
    """Half the change over the last three points; 0 for shorter series."""
    rows = indexed(series).withColumn("back", F.lag(Y, 2).over(over()))
    return rows.filter(F.col("i") == F.col("len") - 1).select(KEY, F.coalesce((F.col(Y) - F.col("back")) / 2, F.lit(0.0)).alias("recent_rate"))


def autocorrelation(series: DataFrame, max_lag: int) -> DataFrame:
    """Autocorrelation of first differences by lag, relative to lag 0."""
    diffs = series.withColumn("d", F.col(Y) - F.lag(Y).over(over())).filter("d is not null")
    rows = diffs.withColumn("e", F.col("d") - F.avg("d").over(whole()))
    lagged = rows.select(KEY, "e", *(F.lag("e", k).over(over()).alias(f"l{k}") for k in range(1, max_lag + 1)))
    sums = lagged.groupBy(KEY).agg(F.sum(F.col("e") * F.col("e")).alias("l0"), *(F.sum(F.col("e") * F.col(f"l{k}")).alias(f"l{k}") for k in range(1, max_lag + 1)))
    out = sums.unpivot([KEY, "l0"], [f"l{k}" for k in range(1, max_lag + 1)], "name", "s")
    return out.select(KEY, F.substring("name", 2, 9).cast("int").alias("lag"), ratio(F.coalesce("s", F.lit(0.0)), F.col("l0")).alias("acf"))


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson's correlation of the points without a null; 0 for fewer than two, a constant side or NaN.

    ``corr`` divides by the deviations, which is an error in ANSI mode where one is 0. Merged sums of a constant can miss
    0 by their noise, so its extremes decide; noise is rounded off lest it decide exact halves.
    """
    whole = {c: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)) for c in (x, y)}
    varied = (F.min(whole[x]) < F.max(whole[x])) & (F.min(whole[y]) < F.max(whole[y]))
    r = ratio(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x)))
    return F.when(varied, F.nanvl(F.round(r, 14), F.lit(0.0))).otherwise(F.lit(0.0))


def ordered_correlation(xs: Column, ys: Column) -> Column:
    """:func:`correlation` of two short arrays of one length, by Welford's updates in their order, as SQL sums them."""

    def step(acc: Column, p: Column) -> Column:
        n, dx, dy = acc["n"] + 1, p["x"] - acc["x"], p["y"] - acc["y"]
        x, y = acc["x"] + dx / n, acc["y"] + dy / n
        return F.struct(n.alias("n"), x.alias("x"), y.alias("y"), (acc["xx"] + dx * (p["x"] - x)).alias("xx"), (acc["yy"] + dy * (p["y"] - y)).alias("yy"), (acc["xy"] + dy * (p["x"] - x)).alias("xy"))

    def done(s: Column) -> Column:
        r = ratio(s["xy"] / s["n"], F.sqrt(s["xx"] / s["n"]) * F.sqrt(s["yy"] / s["n"]))
        return F.when(s["n"] > 1, F.nanvl(r, F.lit(0.0))).otherwise(F.lit(0.0))

    points = F.filter(F.zip_with(xs, ys, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.aggregate(points, F.struct(*(F.lit(0.0).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy"))), step, done)


def lag_correlation(pairs: DataFrame, max_lag: int) -> DataFrame:
    """For series pairs (a, b, day, ya, yb): correlation at each lag, the strongest first lag, its strength."""
    w = Window.partitionBy("a", "b").orderBy(DAY)
    shifted = F.array(*((F.lead("yb", k) if k >= 0 else F.lag("yb", -k)).over(w) for k in range(-max_lag, max_lag + 1)))
    points = pairs.select("a", "b", "ya", shifted.alias("s")).select("a", "b", "ya", F.posexplode("s").alias("at", "yb"))
    long = points.groupBy("a", "b", "at").agg(F.round(correlation("ya", "yb"), 6).alias("r")).select("a", "b", (F.col("at") - max_lag).alias("lag"), "r")
    best = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc(F.abs("r")), "lag"))
    strength = F.when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.4, "moderate").when(F.abs("r") >= 0.2, "weak").otherwise("none")
    return long.withColumn("place", best).filter("place = 1").select("a", "b", "lag", "r", strength.alias("strength"))


def sessions(rows: DataFrame, gap_hours: float, least: int, key: str = KEY, at: str = "detected_at") -> DataFrame:
    """Runs of items with less than the gap between neighbours, of at least ``least`` items."""
    w = Window.partitionBy(key).orderBy(at, "instance_id")
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    starts = F.coalesce((seconds - F.lag(seconds).over(w) >= gap_hours * 3600).cast("int"), F.lit(1))
    marked = rows.withColumn("starts", starts).withColumn("session", F.sum("starts").over(w))
    return marked.groupBy(key, "session").agg(F.count(F.lit(1)).alias("items"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).filter(F.col("items") >= least)


def ewma(series: DataFrame, span: int) -> DataFrame:
    """Final exponentially weighted mean (normalised weights) of each series."""
    rows = indexed(series)
    alpha = F.lit(2.0) / (F.least(F.lit(span), F.col("len")) + 1)
    weight = F.pow(1 - alpha, F.col("len") - 1 - F.col("i"))
    return rows.groupBy(KEY).agg((F.sum(F.col(Y) * weight) / F.sum(weight)).alias("ewma"))


def temporal_pattern(series: DataFrame) -> DataFrame:
    """Consistency (1 less the coefficient of variation), growth half over half, and their mean."""
    rows = indexed(series).withColumn("late", F.col("i") >= F.floor(F.col("len") / 2))
    out = rows.groupBy(KEY).agg(F.avg(Y).alias("mean"), F.coalesce(F.stddev_samp(Y), F.lit(0.0)).alias("sd"), F.avg(F.when(~F.col("late"), F.col(Y))).alias("early"), F.avg(F.when(F.col("late"), F.col(Y))).alias("later"))
    consistency = F.when(F.col("mean") > 0, 1 - F.least(F.lit(1.0), F.col("sd") / F.col("mean"))).otherwise(F.lit(0.0))
    growth = ratio(F.col("later") - F.col("early"), F.coalesce("early", F.lit(0.0)))
    rows = out.withColumn("consistency", consistency).withColumn("growth", growth)
    return rows.select(KEY, "consistency", "growth", (F.col("consistency") * 0.5 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("growth"))) * 0.5).alias("score"))


def first_last_change(scores: DataFrame, least_pct: float) -> DataFrame:
    """Change in per cent from the earliest to the latest score by key and dimension, where it is large enough."""
    ends = scores.groupBy(KEY, "dimension").agg(F.min_by("score", DAY).alias("first"), F.max_by("score", DAY).alias("last"), F.count(F.lit(1)).alias("points"))
    change = (F.col("last") - F.col("first")) / F.col("first") * 100
    return ends.filter((F.col("points") > 1) & (F.col("first") != 0)).withColumn("change_pct", change).filter(F.abs("change_pct") >= least_pct)


def decompose(series: DataFrame, period: int) -> DataFrame:
    """Additive decomposition: centred mean trend (half weights at the ends of an even period), seasonal means less their mean, residual.

    Trend and residual are null where the window leaves the series.
    """
    h = period // 2
    rows = indexed(series)
    y = F.col(Y).cast("double")
    if period % 2:
        trend = F.avg(y).over(over().rowsBetween(-h, h))
    else:
        inner = F.sum(y).over(over().rowsBetween(-h + 1, h - 1))
        trend = (inner + (F.lag(y, h).over(over()) + F.lead(y, h).over(over())) / 2) / period
    inside = (F.col("i") >= h) & (F.col("i") < F.col("len") - h)
    rows = rows.withColumn("trend", F.when(inside, trend)).withColumn("phase", F.col("i") % period)
    rows = rows.withColumn("mean", F.avg(F.col(Y) - F.col("trend")).over(Window.partitionBy(KEY, "phase")))
    level = rows.groupBy(KEY, "phase").agg(F.first("mean").alias("m")).groupBy(KEY).agg(F.avg("m").alias("level"))
    rows = rows.join(level, KEY).withColumn("seasonal", F.col("mean") - F.col("level"))
    return rows.select(KEY, DAY, "trend", "seasonal", (F.col(Y) - F.col("trend") - F.col("seasonal")).alias("residual"))


def detect_patterns(daily: DataFrame, deviations: float = 2.0, least: int = 3) -> DataFrame:
    """Segments of each narrative's daily counts (narrative_id, day, n): kind, first day, days.

    ``spike``: days above the mean by so many standard deviations; ``growth`` and ``decay``: at least
    ``least`` days in a row that rise or fall; ``quiet``: at least so many days without a post. Days in a
    row are found by their distance from their rank.
    """
    own, by_day = Window.partitionBy("narrative_id"), Window.partitionBy("narrative_id").orderBy("day")
    before = F.lag("n").over(by_day)
    usual = F.round(F.avg("n").over(own) + deviations * F.stddev_pop("n").over(own), 9)
    marked = daily.select("narrative_id", "day", (F.col("n") > usual).alias("spike"), (F.col("n") > before).alias("growth"), (F.col("n") < before).alias("decay"), (F.col("n") == 0).alias("quiet"))
    long = marked.unpivot(["narrative_id", "day"], ["spike", "growth", "decay", "quiet"], "kind", "here").filter("here")
    rank = F.row_number().over(Window.partitionBy("narrative_id", "kind").orderBy("day"))
    runs = long.withColumn("run", F.date_sub("day", rank)).groupBy("narrative_id", "kind", "run").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("days"))
    return runs.filter((F.col("kind") == "spike") | (F.col("days") >= least)).select("narrative_id", "kind", "first_day", "days")


def step_segments(daily: DataFrame, m: int = 5, limit: float = 2.0) -> DataFrame:
    """Segments of kind ``step``, as ``detect_patterns`` gives them: from each change of level to the day before the next one, or the series' end."""
    ends = daily.groupBy(KEY).agg(F.max(DAY).alias("end"))
    points = change_points(daily, m, limit).select(KEY, DAY).join(ends, KEY)
    last = F.coalesce(F.date_sub(F.lead(DAY).over(over()), 1), F.col("end"))
    return points.withColumn("last", last).select(KEY, F.lit("step").alias("kind"), F.col(DAY).alias("first_day"), (F.datediff("last", DAY) + 1).cast("long").alias("days"))


def pattern_table(segments: DataFrame) -> DataFrame:
    """Occurrences of each kind of segment in each narrative, mean length, and mean days between their starts (null for one)."""
    gap = F.datediff("first_day", F.lag("first_day").over(Window.partitionBy("narrative_id", "kind").orderBy("first_day")))
    rows = segments.withColumn("gap", gap)
    return rows.groupBy("narrative_id", "kind").agg(F.count(F.lit(1)).alias("occurrences"), F.avg("days").alias("mean_days"), F.avg("gap").alias("avg_interval"))
