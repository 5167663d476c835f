"""Reconstruction errors: (enc, item, t, value, rec, is_observed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.quantiles import quantiles
from cohortloom.functions.spread import settled


def series_mean_reconstruction(observed: DataFrame) -> DataFrame:
    """The baseline: every time step of a series is its mean."""
    return observed.join(observed.groupBy("enc", "item").agg(F.avg("value").alias("rec")), ["enc", "item"])


def series_errors(pairs: DataFrame) -> DataFrame:
    """Mean squared error, count and population variance per encounter and item over observed cells."""
    seen = pairs.filter("value is not null and rec is not null")
    return seen.groupBy("enc", "item").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("value") - F.col("rec"), 2)).alias("mse"), F.var_pop("value").alias("variance"))


def encounter_errors(errors: DataFrame) -> DataFrame:
    """Observation-weighted mean of the item errors of each encounter."""
    return errors.groupBy("enc").agg((F.sum(F.col("n") * F.col("mse")) / F.sum("n")).alias("error"), F.sum("n").alias("n"))


def stats(errors: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, interquartile range, mean, population deviation, extremes; one row more for all (grouping set)."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = errors.rollup(*by).agg(q.alias("q"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return out.select(*by, F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), "mean", "sd", "low", "high", "n")


def mape(pairs: DataFrame) -> DataFrame:
    """Mean absolute percentage error per encounter and item; zeros on either side do not count."""
    used = (F.col("value") != 0) & (F.col("rec") != 0)
    return pairs.groupBy("enc", "item").agg(F.avg(F.when(used, F.abs((F.col("value") - F.col("rec")) / F.nullif(F.col("value"), F.lit(0.0))))).alias("mape"))


def percentile_ladder(df: DataFrame, value: str, steps: int = 200) -> DataFrame:
    """Percentiles 0 to 100 in equal steps: level, x."""
    levels = [i / steps for i in range(steps + 1)]
    q = quantiles(df, value, levels)
    return q.select(F.posexplode("q").alias("i", "x")).select((F.col("i") * (100.0 / steps)).alias("level"), "x")


def worst_left_out(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """For each share (percent): the percentile that cuts the worst values, and the mean of those up to it."""
    df = settled(df.select(value))
    cuts = quantiles(df, value, [1 - s / 100 for s in shares])
    rows = cuts.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("q").alias("threshold"))).alias("z")).select("z.*")
    return df.select(F.col(value).alias("x")).crossJoin(F.broadcast(rows)).filter("x <= threshold").groupBy("share", "threshold").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def percentile_of_score(df: DataFrame, value: str, score: float) -> DataFrame:
    """Mean of the strict and the weak percentage of values below a score."""
    x = F.col(value)
    less, leq = F.count(F.when(x < score, 1)), F.count(F.when(x <= score, 1))
    return df.agg((50.0 * (less + leq + F.when(leq > less, 1).otherwise(0)) / F.count(x)).alias("percentile"))
