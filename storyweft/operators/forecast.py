"""Trends and forecasts over series, all keys in one job.

``series`` has (narrative_id, day, n); forecasts have (narrative_id, step, yhat, lower, upper).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.functions.numbers import rounded
from storyweft.operators.series import DAY, KEY, Y, correlation, ewma, indexed, ordered_correlation, over, ratio, regression, whole

#: Critical values of Student's t for a two-sided 5 % test by degrees of freedom (fixed values); beyond 30 the normal one.
T_CRITICAL = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
NORMAL = 1.96


def critical_t(df: Column) -> Column:
    """Critical t for degrees of freedom from 1 on."""
    return F.when(df > len(T_CRITICAL), F.lit(NORMAL)).otherwise(F.element_at(F.array(*map(F.lit, T_CRITICAL)), F.greatest(F.lit(1), F.least(F.lit(len(T_CRITICAL)), df)).cast("int")))


def steps(horizon: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")


def linear_trend(series: DataFrame) -> DataFrame:
    """Least squares over position: slope, intercept, r2, t and direction (significant at 5 %); ``no_data`` below three points."""
    fit = regression(indexed(series), [KEY], "i", Y)
    t = F.when(F.col("r2") >= 1, F.lit(1e9)).otherwise(F.sqrt(F.col("r2") * (F.col("points") - 2) / (1 - F.col("r2"))))
    direction = F.when(F.col("points") < 3, "no_data").when((F.col("t") > critical_t(F.col("points") - 2)) & (F.col("slope") != 0), F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")).otherwise("stable")
    return fit.withColumn("t", F.when(F.col("points") < 3, F.lit(0.0)).otherwise(t)).withColumn("direction", direction)


def trend_metrics(scores: DataFrame, alone: float = 0.0) -> DataFrame:
    """By key and dimension: slope per day, r2, acceleration of halves, recent rate, significance (|slope| > 0.02).

    ``alone`` is the slope of a single score; where SQL takes it as NaN, it is above every limit.
    """
    w = Window.partitionBy(KEY, "dimension").orderBy(DAY)
    rows = scores.withColumn("i", F.row_number().over(w) - 1).withColumn("len", F.count(F.lit(1)).over(Window.partitionBy(KEY, "dimension")))
    rows = rows.withColumn("x", F.datediff(DAY, F.min(DAY).over(Window.partitionBy(KEY, "dimension")))).withColumn("back", F.lag("score", 2).over(w))
    late = F.col("i") >= F.floor(F.col("len") / 2)
    slope = lambda c: F.coalesce(F.regr_slope(F.when(c, F.col("score")), F.col("x")), F.lit(0.0))
    out = rows.groupBy(KEY, "dimension").agg(
        F.max("len").alias("points"), F.when(F.max("len") == 1, F.lit(alone)).otherwise(F.coalesce(F.regr_slope("score", "x"), F.lit(0.0))).alias("slope"), F.coalesce(F.regr_r2("score", "x"), F.lit(0.0)).alias("r2"),
        slope(late).alias("sl"), slope(~late).alias("se"), F.max(F.when(F.col("i") == F.col("len") - 1, (F.col("score") - F.col("back")) / 2)).alias("recent"), F.max_by("score", DAY).alias("latest"),
    )
    accel = F.when(F.col("points") >= 6, F.col("sl") - F.col("se")).otherwise(F.lit(0.0))
    return out.select(KEY, "dimension", "points", "slope", "r2", accel.alias("acceleration"), F.coalesce("recent", F.lit(0.0)).alias("recent_rate"), (F.abs("slope") > 0.02).alias("significant"), "latest")


def rank_trends(metrics: DataFrame, k: int) -> DataFrame:
    """Keys by the size of their overall slope; those that differ by the noise of sums only are ranked by key."""
    return metrics.filter("dimension = 'overall'").select(KEY, "slope").orderBy(F.desc(F.round(F.abs("slope"), 9)), KEY).limit(k)


def pattern_shift(metrics: DataFrame) -> DataFrame:
    """Dimensions whose acceleration, or recent rate against the slope, changed."""
    return metrics.withColumn("shifted", (F.abs("acceleration") > 0.1) | (F.abs(F.col("recent_rate") - F.col("slope")) > 0.2))


def insights(metrics: DataFrame) -> DataFrame:
    """Texts that say what stands out in each dimension's trend."""
    m = F.col("dimension")
    texts = F.array_compact(F.array(
        F.when(F.abs("slope") > 0.02, F.concat(m, F.when(F.col("slope") > 0, F.lit(" is rising")).otherwise(F.lit(" is falling")))),
        F.when(F.col("r2") > 0.7, F.concat(m, F.lit(" follows a steady line"))),
        F.when(F.abs("acceleration") > 0.1, F.concat(m, F.when(F.col("acceleration") > 0, F.lit(" is speeding up")).otherwise(F.lit(" is slowing down")))),
        F.when(F.col("latest") >= 8, F.concat(m, F.lit(" is very high"))),
    ))
    return metrics.select(KEY, "dimension", F.array_join(texts, "; ").alias("insight")).filter("insight <> ''")


def forecast_linear(series: DataFrame, horizon: int) -> DataFrame:
    """Least squares with a t prediction interval."""
    rows = indexed(series)
    fit = regression(rows, [KEY], "i", Y)
    sums = rows.groupBy(KEY).agg(F.avg("i").alias("mx"), F.regr_sxx(Y, "i").alias("sxx"), F.regr_syy(Y, "i").alias("syy"))
    m = fit.join(sums, KEY).filter("points >= 3")
    m = m.withColumn("s", F.sqrt(F.greatest(F.lit(0.0), F.col("syy") * (1 - F.col("r2"))) / (F.col("points") - 2))).select("*", steps(horizon))
    x = F.col("points") - 1 + F.col("step")
    half = critical_t(F.col("points") - 2) * F.col("s") * F.sqrt(1 + 1 / F.col("points") + (x - F.col("mx")) * (x - F.col("mx")) / F.col("sxx"))
    yhat = F.col("intercept") + F.col("slope") * x
    return m.select(KEY, "step", yhat.alias("yhat"), (yhat - half).alias("lower"), (yhat + half).alias("upper"))


def forecast_ar(series: DataFrame, horizon: int) -> DataFrame:
    """ARIMA(1,1,0) without constant by conditional least squares, in closed form for each step."""
    rows = series.withColumn("d", F.col(Y) - F.lag(Y).over(over())).withColumn("p", F.lag("d").over(over()))
    fit = rows.groupBy(KEY).agg(F.max_by(Y, DAY).alias("last"), F.max_by("d", DAY).alias("d"), F.sum(F.col("d") * F.col("p")).alias("dp"), F.sum(F.when(F.col("d").isNotNull(), F.col("p") * F.col("p"))).alias("pp"), F.sum(F.when(F.col("p").isNotNull(), F.col("d") * F.col("d"))).alias("dd"), F.count("p").alias("m"))
    phi = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), ratio(F.col("dp"), F.coalesce("pp", F.lit(0)))))
    fit = fit.filter("m > 0").withColumn("phi", phi)
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("dd") - 2 * F.col("phi") * F.col("dp") + F.col("phi") * F.col("phi") * F.col("pp")) / F.col("m"))
    out = fit.withColumn("sigma", sigma).select("*", steps(horizon))
    yhat = F.col("last") + F.col("d") * F.col("phi") * (1 - F.pow("phi", "step")) / (1 - F.col("phi"))
    half = NORMAL * F.col("sigma") * F.sqrt("step")
    return out.select(KEY, "step", yhat.alias("yhat"), (yhat - half).alias("lower"), (yhat + half).alias("upper"))


def forecast_simple(series: DataFrame, horizon: int) -> DataFrame:
    """Mean of the last seven points plus their end-to-end slope, not below 0, with 1.96 sample deviations."""
    last = indexed(series).filter(F.col("i") >= F.col("len") - 7)
    m = last.groupBy(KEY).agg(F.avg(Y).alias("mean"), F.coalesce(F.stddev_samp(Y), F.lit(0.0)).alias("sd"), F.min_by(Y, DAY).alias("first"), F.max_by(Y, DAY).alias("last"), F.count(F.lit(1)).alias("points"))
    slope = F.when(F.col("points") >= 2, (F.col("last") - F.col("first")) / (F.col("points") - 1)).otherwise(F.lit(0.0))
    out = m.withColumn("slope", slope).select("*", steps(horizon))
    yhat = F.greatest(F.lit(0.0), F.col("mean") + F.col("slope") * F.col("step"))
    return out.select(KEY, "step", yhat.alias("yhat"), F.greatest(F.lit(0.0), yhat - NORMAL * F.col("sd")).alias("lower"), (yhat + NORMAL * F.col("sd")).alias("upper"))


def forecast_short(series: DataFrame, horizon: int, below: int = 7) -> DataFrame:
    """For series of fewer than seven points: mean plus end-to-end slope, 30 % either way."""
    rows = indexed(series).filter(F.col("len") < below)
    m = rows.groupBy(KEY).agg(F.avg(Y).alias("mean"), F.min_by(Y, DAY).alias("first"), F.max_by(Y, DAY).alias("last"), F.count(F.lit(1)).alias("points"))
    slope = F.when(F.col("points") > 1, (F.col("last") - F.col("first")) / (F.col("points") - 1)).otherwise(F.lit(0.0))
    out = m.withColumn("slope", slope).select("*", steps(horizon))
    yhat = F.greatest(F.lit(0.0), F.col("mean") + F.col("slope") * F.col("step"))
    return out.select(KEY, "step", yhat.alias("yhat"), (yhat * 0.7).alias("lower"), (yhat * 1.3).alias("upper"))


def forecast_mean(series: DataFrame, horizon: int) -> DataFrame:
    """Mean of the last three points, 1.96 population deviations of the series."""
    rows = indexed(series)
    m = rows.groupBy(KEY).agg(F.avg(F.when(F.col("i") >= F.col("len") - 3, F.col(Y))).alias("yhat"), F.stddev_pop(Y).alias("sd")).select("*", steps(horizon))
    return m.select(KEY, "step", "yhat", (F.col("yhat") - NORMAL * F.col("sd")).alias("lower"), (F.col("yhat") + NORMAL * F.col("sd")).alias("upper"))


def choose_forecast(series: DataFrame, horizon: int, shortest: int = 7) -> DataFrame:
    """AR forecast where it can be fitted, the short rule below seven points, with the method's name."""
    length = series.groupBy(KEY).agg(F.count(F.lit(1)).alias("len"))
    long = series.join(length.filter(F.col("len") >= shortest), KEY, "left_semi")
    return forecast_ar(long, horizon).withColumn("method", F.lit("ar")).unionByName(forecast_short(series, horizon, shortest).withColumn("method", F.lit("short")))


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """Peak step and value (the first of equals), and direction from the first to the last step within 10 %."""
    m = forecast.groupBy(KEY).agg(F.max("yhat").alias("peak"), F.min_by("yhat", "step").alias("first"), F.max_by("yhat", "step").alias("last"), F.max_by("step", F.struct(F.col("yhat"), -F.col("step"))).alias("peak_step"))
    direction = F.when(F.col("last") > F.col("first") * 1.1, "increasing").when(F.col("last") < F.col("first") * 0.9, "decreasing").otherwise("stable")
    return m.select(KEY, "peak_step", "peak", direction.alias("direction"))


def threshold_crossing(forecast: DataFrame, value: float, above: bool = True) -> DataFrame:
    """First step at or beyond a value."""
    hit = F.col("yhat") >= value if above else F.col("yhat") <= value
    return forecast.filter(hit).groupBy(KEY).agg(F.min("step").alias("step"))


def exceedance_share(forecast: DataFrame, value: float) -> DataFrame:
    """Share of forecast steps above a value."""
    return forecast.groupBy(KEY).agg(F.avg((F.col("yhat") > value).cast("int")).alias("share"))


def complexity_series(series: DataFrame) -> DataFrame:
    """Counts as complexity between 0.3 and 1, on a log scale against the series' maximum."""
    top = F.max(Y).over(whole())
    scaled = F.when(top > 0, F.least(F.lit(1.0), 0.3 + 0.7 * F.log1p(F.col(Y)) / F.log1p(top))).otherwise(F.lit(0.3))
    return series.withColumn("complexity", scaled)


def what_if(forecast: DataFrame, interventions: DataFrame) -> DataFrame:
    """Forecasts under interventions (kind add, multiply or decay; from_step; impact; decay), not below 0, and the difference."""
    since = F.col("step") - F.col("from_step")
    on = since >= 0
    plus = F.sum(F.when(on & (F.col("kind") == "add"), F.col("impact")).when(on & (F.col("kind") == "decay"), F.col("impact") * F.pow("decay", since) * F.col("yhat")).otherwise(F.lit(0.0)))
    times = F.exp(F.sum(F.when(on & (F.col("kind") == "multiply"), F.log("impact")).otherwise(F.lit(0.0))))
    rows = forecast.select(KEY, "step", "yhat").join(interventions, KEY)
    out = rows.groupBy(KEY, "step", "yhat").agg(plus.alias("plus"), times.alias("times"))
    changed = F.greatest(F.lit(0.0), F.col("yhat") * F.col("times") + F.col("plus"))
    return out.select(KEY, "step", "yhat", changed.alias("changed"), (changed - F.col("yhat")).alias("difference"))


def predict_effectiveness(series: DataFrame, horizon: int) -> DataFrame:
    """Exponential mean plus a damped slope, within 0 and 1, with a sample-deviation interval; ``n`` holds effectiveness."""
    m = ewma(series, 7).join(regression(indexed(series), [KEY], "i", Y).select(KEY, "slope"), KEY).join(series.groupBy(KEY).agg(F.coalesce(F.stddev_samp(Y), F.lit(0.0)).alias("sd")), KEY).select("*", steps(horizon))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    yhat = clamp(F.col("ewma") + F.col("slope") * F.col("step") / (1 + 0.2 * F.col("step")))
    return m.select(KEY, "step", yhat.alias("yhat"), clamp(yhat - NORMAL * F.col("sd")).alias("lower"), clamp(yhat + NORMAL * F.col("sd")).alias("upper"))


#: Names of the dimensions in factor texts, in the order in which equal slopes are listed (fixed values).
FACTOR_NAMES = {"linguistic": "linguistic_complexity", "logical": "logical_structure", "rhetorical": "rhetorical_techniques", "emotional": "emotional_manipulation"}


def predict_evolution(scores: DataFrame, horizon: int, limit: float = 8.5, alone: float | None = None) -> DataFrame:
    """By dimension of dated scores: the line's value at the horizon within 0 and 10, slope, r2, direction in seven bands, and the day it reaches the limit if within 30.

    A single score is carried on unchanged, unless its slope is given as ``alone`` (NaN, as in SQL, is above every limit).
    """
    x = F.datediff(DAY, F.min(DAY).over(Window.partitionBy(KEY, "dimension")))
    fit = scores.filter("score IS NOT NULL").withColumn("x", x).groupBy(KEY, "dimension").agg(F.regr_slope("score", "x").alias("s"), F.regr_intercept("score", "x").alias("c"), F.coalesce(F.regr_r2("score", "x"), F.lit(0.0)).alias("r2"), F.max("x").alias("last"), F.max(DAY).alias("last_day"), F.max_by("score", DAY).alias("latest"), F.count("score").alias("points"))
    if alone is not None:
        fit = fit.withColumn("s", F.when(F.col("points") == 1, F.lit(alone)).otherwise(F.col("s")))
    s = F.coalesce("s", F.lit(0.0))
    yhat = F.when(F.col("s").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), s * (F.col("last") + horizon) + F.col("c")))).otherwise(F.col("latest"))
    band = F.when(s > 0.1, "strong_increase").when(s > 0.05, "moderate_increase").when(s > 0.01, "slight_increase").when(s < -0.1, "strong_decrease").when(s < -0.05, "moderate_decrease").when(s < -0.01, "slight_decrease").otherwise("stable")
    days = F.when((s > 0) & (F.col("latest") < limit), (limit - F.col("latest")) / s)
    return fit.select(KEY, "dimension", yhat.alias("yhat"), s.alias("slope"), "r2", band.alias("direction"), F.when(days < 30, F.date_add("last_day", F.floor(F.round(days, 6)).cast("int"))).alias("peak_day"))


def evolution_factors(evolution: DataFrame, least: float = 0.05) -> DataFrame:
    """What drives each key's complexity: its dimensions with a slope above ``least``, the steepest first, or that it is stable."""
    order = {name: k for k, name in enumerate(FACTOR_NAMES)}
    name, place = F.lit(None).cast("string"), F.lit(len(order))
    for key, text in FACTOR_NAMES.items():
        name, place = F.when(F.col("dimension") == key, F.lit(text)).otherwise(name), F.when(F.col("dimension") == key, F.lit(order[key])).otherwise(place)
    steep = F.when(name.isNotNull() & (F.abs("slope") > least), F.struct((~F.isnan("slope")).alias("known"), (-F.abs("slope")).alias("by"), place.alias("place"), F.concat(name, F.when(F.col("slope") > 0, F.lit(" is increasing")).otherwise(F.lit(" is decreasing")), F.lit(" significantly")).alias("text")))
    listed = evolution.groupBy(KEY).agg(F.array_sort(F.collect_list(steep)).alias("f"))  # one for each dimension
    texts = F.transform("f", lambda f: f["text"])
    return listed.select(KEY, F.posexplode(F.when(F.size("f") > 0, texts).otherwise(F.array(F.lit("complexity is relatively stable across all dimensions")))).alias("place", "factor"))


def trending_complexity(metrics: DataFrame, k: int, limit: float = 8.5) -> DataFrame:
    """Keys whose overall score rises by more than 0.05 a day, steepest first."""
    rows = metrics.filter("dimension = 'overall' AND slope > 0.05")
    days = F.when(F.col("latest") < limit, F.ceil(F.round((limit - F.col("latest")) / F.col("slope"), 6))).otherwise(F.lit(0).cast("long"))
    return rows.select(KEY, "slope", "acceleration", "latest", days.alias("days_to_limit")).orderBy(F.desc("slope"), KEY).limit(k)


def similar_trajectories(series: DataFrame, pairs: DataFrame, m: int, k: int, least: float = 0.6) -> DataFrame:
    """For listed key pairs (a, b): (correlation of their last m points + 1) / 2, the best k above a limit for each a."""
    rows = indexed(series).filter(F.col("i") >= F.col("len") - m).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("i", Y))).alias("last"))
    a, b = (rows.select(F.col(KEY).alias(key), F.col(f"last.{Y}").alias(f"y{key}")) for key in "ab")
    common = F.least(F.size("ya"), F.size("yb"))
    r = ordered_correlation(*(F.slice(c, -common, common) for c in ("ya", "yb")))
    joined = pairs.select("a", "b").distinct().join(a, "a").join(b, "b")
    scored = joined.select("a", "b", r.alias("r")).select("a", "b", rounded((F.col("r") + 1) / 2).alias("similarity"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return scored.withColumn("place", place).filter((F.col("place") <= k) & (F.col("similarity") > least)).drop("place")


def series_correlation(pairs: DataFrame) -> DataFrame:
    """Pearson correlation of paired series (a, b, ya, yb) with its band; 0 for a constant one."""
    out = pairs.groupBy("a", "b").agg(F.round(correlation("ya", "yb"), 6).alias("r"))
    band = F.when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.4, "moderate").when(F.abs("r") >= 0.2, "weak").otherwise("none")
    return out.withColumn("band", band)


def ramp(value: Column, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high``, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


#: Factors by their usual order: name, column, and the ramp from no to full impact (fixed values).
FACTORS = (
    ("Network Centrality", "centrality", 0.3, 0.8),
    ("Connection Strength", "connection_strength", 0.4, 0.9),
    ("Consistency", "consistency", 0.5, 0.7),
    ("Growth Rate", "growth", 0.1, 0.5),
    ("Source Diversity", "source_diversity", 0.2, 0.6),
)


def key_factors(facts: DataFrame) -> DataFrame:
    """Five factors of each narrative with value and impact, by size of the impact, then in the usual order; growth keeps its sign.

    ``facts`` has centrality, connection_strength, consistency, growth and source_diversity; a missing value is 0.
    """
    rows = []
    for order, (name, column, low, high) in enumerate(FACTORS):
        value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
        impact = ramp(F.abs(value), low, high) * F.when(value > 0, 1.0).otherwise(-1.0) if column == "growth" else ramp(value, low, high)
        rows.append(F.struct((-F.abs(impact)).alias("by"), F.lit(order).alias("order"), F.lit(name).alias("factor"), value.alias("value"), (impact + 0.0).alias("impact")))
    listed = F.array_sort(F.array(*rows))
    return facts.select(KEY, F.posexplode(listed).alias("at", "f")).select(KEY, (F.col("at") + 1).alias("place"), "f.factor", "f.value", "f.impact")


def next_occurrence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """When each pattern (keys, instance_id, at in seconds) is due again: its last time plus the mean gap, give or take a deviation of the gaps."""
    gap = F.col("at") - F.lag("at").over(Window.partitionBy(*keys).orderBy("at", "instance_id"))
    out = rows.withColumn("gap", gap).groupBy(*keys).agg(F.max("at").alias("last"), F.avg("gap").alias("mean"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("sd"))
    due = F.col("last") + F.col("mean")
    return out.filter("mean IS NOT NULL").select(*keys, due.alias("expected"), (due - F.col("sd")).alias("earliest"), (due + F.col("sd")).alias("latest"))


def two_sided_p(z: Column) -> Column:
    """Probability of a standard normal value at least as far from zero: one less the error function, by its series of positive terms."""
    x = F.least(F.abs(z), F.lit(9.0)) / math.sqrt(2)
    start = F.struct((x * (2 / math.sqrt(math.pi))).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, k: F.struct((s["term"] * x * x / (k + 1.5)).alias("term"), (s["sum"] + s["term"]).alias("sum"))
    erf = F.exp(-x * x) * F.aggregate(F.sequence(F.lit(0), F.lit(160)), start, step)["sum"]
    return F.greatest(F.lit(0.0), 1 - erf)


def _season_acf(series: DataFrame, max_period: int) -> DataFrame:
    """(narrative_id, len, lag, acf): products of first differences by lag, relative to the largest; only series of two longest periods at least."""
    rows = indexed(series).withColumn("d", F.col(Y) - F.lag(Y).over(over())).filter(F.col("len") >= 2 * max_period)
    rows = rows.withColumn("later", F.array(*(F.lead("d", k).over(over()) for k in range(1, max_period + 1))))
    sums = rows.select(KEY, "len", "d", F.posexplode("later").alias("k", "later")).filter(F.col("k") + 1 <= F.floor(F.col("len") / 3)).groupBy(KEY, "len", (F.col("k") + 1).alias("lag")).agg(F.coalesce(F.sum(F.col("d") * F.col("later")), F.lit(0.0)).alias("s"))
    return sums.select(KEY, "len", "lag", F.try_divide("s", F.max("s").over(Window.partitionBy(KEY))).alias("acf"))


def seasonality(series: DataFrame, max_period: int = 30, least: float = 0.3) -> DataFrame:
    """Whether a series repeats itself: period, strength and probability by chance of its strongest peak, and all peaks.

    Peaks are lags whose autocorrelation of differences, relative to the largest, is ``least`` or more and
    above both neighbours' (a plateau counts as its middle). A series shorter than two longest periods, or without peaks, is not seasonal.
    """
    acf = _season_acf(series, max_period)
    w = Window.partitionBy(KEY).orderBy("lag")
    runs = acf.withColumn("run", F.sum(F.when(F.col("acf") == F.lag("acf").over(w), 0).otherwise(1)).over(w)).groupBy(KEY, "len", "run").agg(F.max("acf").alias("acf"), F.floor((F.min("lag") + F.max("lag")) / 2).cast("int").alias("lag"))
    r = Window.partitionBy(KEY).orderBy("run")
    peaks = runs.withColumn("before", F.lag("acf").over(r)).withColumn("after", F.lead("acf").over(r)).filter((F.col("acf") >= least) & (F.col("acf") > F.col("before")) & (F.col("acf") > F.col("after")))
    best = peaks.groupBy(KEY, "len").agg(F.max(F.struct("acf", (-F.col("lag")).alias("back"))).alias("m"), F.array_join(F.array_sort(F.collect_list("lag")), ",").alias("peaks"))  # max_period / 2 at most
    found = best.select(KEY, (-F.col("m.back")).alias("period"), F.col("m.acf").alias("strength"), two_sided_p(F.col("m.acf") * F.sqrt("len")).alias("p_value"), "peaks")
    rows = series.select(KEY).distinct().join(found, KEY, "left")
    return rows.select(KEY, (F.coalesce("p_value", F.lit(1.0)) < 0.05).alias("seasonal"), "period", F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"), F.coalesce("peaks", F.lit("")).alias("peaks"))


def cyclic_segments(series: DataFrame, max_period: int = 30) -> DataFrame:
    """Segments of kind ``cyclic``, as ``detect_patterns`` gives them: each series that is seasonal, from its first day on."""
    found = seasonality(series, max_period).filter("seasonal").select(KEY)
    whole_series = series.groupBy(KEY).agg(F.min(DAY).alias("first_day"), F.count(F.lit(1)).alias("days"))
    return whole_series.join(found, KEY, "left_semi").select(KEY, F.lit("cyclic").alias("kind"), "first_day", "days")


def common_periods(series: DataFrame, max_period: int = 30, common: tuple[int, ...] = (1, 7, 14, 30)) -> DataFrame:
    """Strength and significance of the usual periods (daily, weekly, two weeks, monthly) below a third of the series; 0 for a lag beyond ``max_period``. Days are regular."""
    acf = _season_acf(series, max_period)
    keys = acf.select(KEY, "len").distinct().select(KEY, "len", F.explode(F.array(*map(F.lit, common))).alias("period")).filter(F.col("period") < F.floor(F.col("len") / 3))
    rows = keys.join(acf.select(KEY, F.col("lag").alias("period"), "acf"), [KEY, "period"], "left").withColumn("strength", F.coalesce("acf", F.lit(0.0)))
    p = two_sided_p(F.col("strength") * F.sqrt("len"))
    return rows.select(KEY, "period", "strength", (p < 0.05).alias("significant"), p.alias("p_value"))


#: Weights that exponential smoothing chooses from: level, trend, season.
ALPHAS, BETAS, GAMMAS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.05, 0.1, 0.2, 0.4), (0.1, 0.3, 0.6)


def forecast_holt(series: DataFrame, horizon: int, period: int | None = None) -> DataFrame:
    """Additive trend, and additive season where a period is given and the series has two of them; 1.96 deviations of the one-step errors, not below 0.

    The weights are those of a grid with the least squared errors. Each series is folded as one array in
    the JVM, its season a ring of ``period`` values. Without season the fold starts at the first value and
    the first difference; with season at the first period's mean, the two first periods' difference and the first period's deviations.
    """
    ordered = F.array_sort(F.collect_list(F.struct(DAY, F.col(Y).cast("double").alias("v"))))  # one value a day
    rows = series.groupBy(KEY).agg(F.transform(ordered, lambda s: s["v"]).alias("y")).withColumn("n", F.size("y"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.size(a)
    if period:
        rows = rows.withColumn("ring", F.when(F.col("n") >= 2 * period, F.lit(period)).otherwise(F.lit(0)))
        head, second = F.slice("y", 1, period), F.slice("y", period + 1, period)
        seasonal = F.col("ring") > 0
        level = F.when(seasonal, mean(head)).otherwise(F.element_at("y", 1))
        trend = F.when(seasonal, (mean(second) - mean(head)) / period)
        rows = rows.withColumn("l0", level).withColumn("season", F.when(seasonal, F.transform(head, lambda v: v - F.col("l0"))).otherwise(F.array().cast("array<double>")))
    else:
        rows = rows.withColumn("ring", F.lit(0)).withColumn("l0", F.element_at("y", 1)).withColumn("season", F.array().cast("array<double>"))
        trend = F.lit(None).cast("double")
    first = F.when(F.col("n") > 1, F.get("y", F.lit(1)) - F.get("y", F.lit(0))).otherwise(F.lit(0.0))
    rows = rows.withColumn("t0", F.coalesce(trend, first)).withColumn("from", F.when(F.col("ring") > 0, F.col("ring")).otherwise(F.lit(1)))

    def fold(w: Column) -> Column:
        start = F.struct(F.col("l0").alias("level"), F.col("t0").alias("trend"), F.col("season").alias("season"), F.lit(0.0).alias("sse"), F.lit(0.0).alias("sum"), F.lit(0).alias("m"))

        def step(s: Column, i: Column) -> Column:
            v, slot = F.get("y", i), F.when(F.col("ring") > 0, i % F.col("ring")).otherwise(F.lit(0))
            season = F.coalesce(F.get(s["season"], slot), F.lit(0.0))
            error = v - s["level"] - s["trend"] - season
            level = w["a"] * (v - season) + (1 - w["a"]) * (s["level"] + s["trend"])
            ring = F.transform(s["season"], lambda old, k: F.when(k == slot, w["g"] * (v - level) + (1 - w["g"]) * old).otherwise(old))
            return F.struct(level.alias("level"), (w["b"] * (level - s["level"]) + (1 - w["b"]) * s["trend"]).alias("trend"), ring.alias("season"), (s["sse"] + error * error).alias("sse"), (s["sum"] + error).alias("sum"), (s["m"] + 1).alias("m"))

        places = F.when(F.col("n") > F.col("from"), F.sequence(F.col("from"), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step)

    grid = [(a, b, g) for a in ALPHAS for b in BETAS for g in (GAMMAS if period else (0.0,))]
    weights = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g")) for a, b, g in grid))
    fits = F.transform(F.transform(weights, fold), lambda s, k: F.struct(F.round(s["sse"], 9).alias("loss"), k.alias("k"), s.alias("s")))
    best = rows.select(KEY, "n", "ring", F.array_min(fits)["s"].alias("s")).select(KEY, "n", "ring", "s.*", steps(horizon))
    spread = F.when(F.col("m") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("sse") / F.col("m") - F.pow(F.col("sum") / F.col("m"), 2)))).otherwise(F.lit(0.0))
    season = F.when(F.col("ring") > 0, F.get("season", ((F.col("n") - 1 + F.col("step")) % F.col("ring")).cast("int"))).otherwise(F.lit(0.0))
    yhat = F.col("level") + F.col("trend") * F.col("step") + season
    return best.select(KEY, "step", yhat.alias("yhat"), F.greatest(F.lit(0.0), yhat - NORMAL * spread).alias("lower"), (yhat + NORMAL * spread).alias("upper"))


def isolation_anomaly(series: DataFrame, limit: float = 0.6, trees: int = 100, seed: int = 42) -> DataFrame:
    """Isolation forest on the counts of each series: seeded one-dimensional trees; score 2 ** (-depth / expected)."""

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        y, rng = rows[Y].to_numpy(float), np.random.default_rng(seed)
        n = len(y)
        expected = 2 * (np.log(max(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n if n > 1 else 1.0
        depth = np.zeros(n)
        for _ in range(trees):
            parts = [(np.arange(n), 0)]
            while parts:
                at, d = parts.pop()
                low, high = y[at].min(), y[at].max()
                if len(at) < 2 or low == high or d >= 12:
                    depth[at] += d + (np.log2(len(at)) if len(at) > 1 else 0)
                    continue
                cut = rng.uniform(low, high)
                left = y[at] < cut
                parts += [(p, d + 1) for p in (at[left], at[~left]) if len(p)]
        score = 2 ** (-depth / trees / max(expected, 1e-9))
        return pd.DataFrame({KEY: rows[KEY], DAY: rows[DAY], "score": score, "is_anomaly": score > limit})

    return series.groupBy(KEY).applyInPandas(forest, f"{KEY} long, {DAY} date, score double, is_anomaly boolean")


def stored_predictions(predictions: DataFrame, most: int = 5) -> DataFrame:
    """Each narrative's newest ``most`` predictions (prediction_id, predicted_at, forecast as a JSON list of numbers), without those that are malformed."""
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("predicted_at"), F.desc("prediction_id")))
    newest = predictions.withColumn("place", place).filter(F.col("place") <= most).drop("place")
    return newest.withColumn("forecast", F.from_json("forecast", "array<double>", {"mode": "PERMISSIVE"})).filter("forecast IS NOT NULL")


def active_models(models: DataFrame, parameters: str) -> DataFrame:
    """Active models by name, their parameters parsed from JSON."""
    return models.filter("is_active").withColumn("parameters", F.from_json("parameters", parameters)).orderBy("name", "model_id")
