"""Window-shaped work on series: (enc, item, t, value), t in minutes. A series may be long: windows run over
pieces of it (see functions/spread.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.spread import neighbours, running_total


SERIES = ["enc", "item"]


def interpolate(grid: DataFrame, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Fills null values linearly in time between known points and carries the last one forward; nothing is
    filled before the first. Adds is_observed."""
    near = neighbours(grid, SERIES, list(order), ["t", "value"], F.col("value").isNotNull(), before="b", after="a")
    line = F.col("b.value") + (F.col("a.value") - F.col("b.value")) * (F.col("t") - F.col("b.t")) / F.nullif(F.col("a.t") - F.col("b.t"), F.lit(0))
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("b").isNull(), F.lit(None)).when(F.col("a").isNull(), F.col("b.value")).otherwise(F.coalesce(line, F.col("b.value")))
    return near.withColumn("is_observed", F.col("value").isNotNull()).withColumn("value", filled).drop("a", "b")


def deimpute(filled: DataFrame) -> DataFrame:
    """Imputed cells become null again."""
    return filled.withColumn("value", F.when(F.col("is_observed"), F.col("value")))


def step_delta(series: DataFrame, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """(v2 - v1) / (t2 - t1) of successive points; null at equal times; the first point has none."""
    near = neighbours(series, SERIES, list(order), ["t", "value"], before="b", current=False).filter("b is not null")
    return near.withColumn("delta", F.try_divide(F.col("value") - F.col("b.value"), (F.col("t") - F.col("b.t")).cast("double"))).drop("b")


def rebase(series: DataFrame) -> DataFrame:
    """Time counted from the series' first point."""
    first = series.groupBy(*SERIES).agg(F.min("t").alias("_t0"))
    return series.join(first, SERIES).withColumn("t", F.col("t") - F.col("_t0")).drop("_t0")


def trend_angle(series: DataFrame) -> DataFrame:
    """Angle in degrees of the line through a series: 0 if constant, null below two points."""
    r = rebase(series)
    slope = F.regr_slope("value", F.col("t").cast("double"))
    angle = F.when(F.count("value") < 2, F.lit(None)).when(F.min("value") == F.max("value"), F.lit(0.0)).otherwise(F.degrees(F.atan(slope)))
    return r.groupBy("enc", "item").agg(angle.alias("angle"))


def aggregations() -> dict[str, Column]:
    """Registry of named aggregations over one series: name to Column; extend or replace it per call."""
    return {"max": F.max("value"), "min": F.min("value"), "mean": F.avg("value")}


def partition_stats(series: DataFrame, parts: int, funcs: dict[str, Column] | None = None, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Statistics of each of ``parts`` equally long pieces of a series (the first pieces are longer)."""
    size = series.groupBy(*SERIES).agg(F.count("*").alias("_n"))
    placed = running_total(series.withColumn("_one", F.lit(1)), order[0], {"_one": "_i"}, SERIES, list(order[1:])).join(size, SERIES)
    short, more = F.floor(F.col("_n") / parts), F.col("_n") % parts
    head = more * (short + 1)
    part = F.when(F.col("_i") < head, F.floor(F.col("_i") / (short + 1))).otherwise(more + F.floor((F.col("_i") - head) / F.greatest(short, F.lit(1)))) + 1
    cut = placed.withColumn("part", part.cast("int"))
    return cut.groupBy("enc", "item", "part").agg(*[c.alias(n) for n, c in (funcs or aggregations()).items()])


def series_stats(series: DataFrame, everyone: DataFrame) -> DataFrame:
    """Median, least and largest value of each series; an encounter without values keeps a row with nulls."""
    s = series.groupBy("enc").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))
    return everyone.select("enc").distinct().join(s, "enc", "left")


def signal_stats(series: DataFrame, everyone: DataFrame, items: DataFrame) -> DataFrame:
    """Median, least and largest value of each series; every encounter has a row for every signal of the
    dictionary ``items``, with nulls where it has no values. Other signals go."""
    s = series.groupBy(*SERIES).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))
    frame = everyone.select("enc").distinct().crossJoin(F.broadcast(items.select("item").distinct()))  # one row per signal
    return frame.join(s, SERIES, "left")


def positional_encoding(points: DataFrame, t_max: float, dims: int) -> DataFrame:
    """Sinusoidal time encoding with ``dims`` (even, at least 4) dimensions over training time 0..t_max."""
    base = t_max / (0.75 * 3.141592653589793)
    cols = []
    for dim in range(dims):
        omega = base ** (2 * (dim // 2) / (dims - 2))
        f = F.sin if dim % 2 == 0 else F.cos
        cols.append(f(F.col("t") / F.lit(omega)).alias(f"pe{dim}"))
    return points.select("*", *cols)


def time_buckets(series: DataFrame, least: int) -> DataFrame:
    """Exponential time buckets (base 2): bucket k ends at 2^k; buckets with fewer than ``least`` values merge
    forward into the next one. Output per item: first and last bucket, n, median."""
    k = F.when(F.col("t") <= 1, F.lit(0)).otherwise(F.ceil(F.log2(F.col("t").cast("double"))))
    raw = series.filter("t >= 0 and value is not null").withColumn("k", k.cast("int"))
    counts = raw.groupBy("item", "k").agg(F.count("*").alias("n"))
    # Merge forward: a bucket closes where the values since the last closing reach the limit. There are at
    # most 64 buckets an item, so the fold runs over one short array per item.
    arrays = counts.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("ks"))
    zero = F.struct(F.lit(0).alias("g"), F.lit(0).cast("long").alias("acc"), F.array().cast("array<struct<k:int,g:int>>").alias("out"))
    fold = F.aggregate(
        "ks",
        zero,
        lambda s, x: F.struct(
            F.when(s["acc"] + x["n"] >= least, s["g"] + 1).otherwise(s["g"]).alias("g"),
            F.when(s["acc"] + x["n"] >= least, F.lit(0).cast("long")).otherwise(s["acc"] + x["n"]).alias("acc"),
            F.concat(s["out"], F.array(F.struct(x["k"].alias("k"), s["g"].alias("g")))).alias("out"),
        ),
    )
    groups = arrays.select("item", F.explode(fold["out"]).alias("x")).select("item", "x.k", "x.g")
    return raw.join(groups, ["item", "k"]).groupBy("item", "g").agg(F.min("k").alias("k_from"), F.max("k").alias("k_to"), F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"))


def time_unit(series: DataFrame) -> DataFrame:
    """Unit for display by the largest time in minutes of each item."""
    m = F.max("t")
    return series.groupBy("item").agg(m.alias("t_max"), F.when(m > 2 * 24 * 60, "days").when(m > 2 * 60, "hours").otherwise("minutes").alias("unit"))
