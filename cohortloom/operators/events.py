"""Event logs in long form: (enc, item, ts, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(col: str | Column) -> Column:
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def pivot_mean(events: DataFrame, items: list[str], index: str = "ts") -> DataFrame:
    """Long to wide with the mean of repeated cells; the columns are given, so no job looks for them."""
    return events.groupBy("enc", index).pivot("item", items).agg(F.avg("value"))


def mean_per_key(events: DataFrame) -> DataFrame:
    """Mean per encounter, item and time; nulls do not count."""
    return events.groupBy("enc", "item", "ts").agg(F.avg("value").alias("value"))


def trusted_override(events: DataFrame) -> DataFrame:
    """Conflict resolution of two sources: repeated readings are averaged inside a source, a trusted reading
    replaces the other source's at the same item and time, keys of either source remain. One aggregation, no
    join. Keys without any value are dropped."""
    return (
        events.groupBy("enc", "item", "ts")
        .agg(F.avg(F.when(F.col("trusted"), F.col("value"))).alias("t"), F.avg(F.when(~F.col("trusted"), F.col("value"))).alias("n"))
        .select("enc", "item", "ts", F.coalesce("t", "n").alias("value"))
        .na.drop(subset=["value"])
    )


def minutes_since(events: DataFrame, admissions: DataFrame) -> DataFrame:
    """Adds t, whole minutes since admission, floored also before it; events of unknown encounters go."""
    return events.join(admissions, "enc").withColumn("t", F.floor((micros("ts") - micros("admit")) / F.lit(60_000_000.0)).cast("long"))


def combine_first(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union of rows and keys of two sources, the first's values win; nulls of the first are filled."""
    both = first.select(*keys, "value", F.lit(0).alias("prio")).unionByName(second.select(*keys, "value", F.lit(1).alias("prio")))
    value = F.coalesce(F.max(F.when(F.col("prio") == 0, F.col("value"))), F.max(F.when(F.col("prio") == 1, F.col("value"))))
    return both.groupBy(*keys).agg(value.alias("value"))


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    """SQL UNION of several sources: rows equal in all columns count once."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def drop_missing(events: DataFrame) -> DataFrame:
    """Rows without a measurement go."""
    return events.na.drop(subset=["value"])


def item_labels(items: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Label of each item from the first dictionary, else the second, else a made-up one. Dictionaries hold
    item and label; adaptive execution broadcasts them where their measured size allows it."""
    a, b = first.withColumnRenamed("label", "label_a"), second.withColumnRenamed("label", "label_b")
    name = F.coalesce("label_a", "label_b", F.concat(F.lit("unknown_item_label_for_id_"), F.col("item").cast("string")))
    return items.join(a, "item", "left").join(b, "item", "left").select("item", name.alias("label"))


def align(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """Union of wide frames over the pinned column list: missing columns are null, others are dropped."""
    out = []
    for f in frames:
        have = set(f.columns)
        out.append(f.select("enc", "t", *[F.col(f"`{c}`") if c in have else F.lit(None).cast("double").alias(c) for c in columns]))
    return reduce(lambda a, b: a.unionByName(b), out)


def resolved_label(df: DataFrame, fused: str = "fused_label", meta: str = "meta", dictionary: str = "label") -> DataFrame:
    """Label of a column: the fused one, else meta_ and its name, else the dictionary's; key is label_item."""
    name = F.coalesce(F.col(fused), F.concat(F.lit("meta_"), F.col(meta)), F.col(dictionary))
    return df.withColumn("resolved", name).withColumn("key", F.concat_ws("_", "resolved", F.col("item").cast("string")))


def overlap(lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> Column:
    """Number of integers that two closed ranges share."""
    return F.greatest(F.lit(0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b) + 1)
