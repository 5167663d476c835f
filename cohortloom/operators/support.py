"""Which signals have enough data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relative_support(events: DataFrame) -> DataFrame:
    """Share of encounters with any value of an item, among encounters with any value at all."""
    seen = events.filter("value is not null")
    total = seen.agg(F.countDistinct("enc").alias("total"))
    return seen.groupBy("item").agg(F.countDistinct("enc").alias("n_enc")).crossJoin(F.broadcast(total)).select("item", "n_enc", (F.col("n_enc") / F.col("total")).alias("support"))


def well_supported(events: DataFrame, least: float) -> DataFrame:
    """Events of items whose support is at least ``least``; the item list is small and joined by size."""
    return events.join(relative_support(events).filter(F.col("support") >= least).select("item"), "item", "left_semi")


def constant_items(events: DataFrame) -> DataFrame:
    """Items with at most one distinct value over the cohort."""
    return events.groupBy("item").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo is null or lo = hi").select("item")
