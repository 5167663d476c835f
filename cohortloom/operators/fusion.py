"""Fusion of columns that measure the same thing, decided for each encounter and group of columns.

Input in long form: chart rows (enc, item, t, value) where every encounter's chart has a row index, and rules
(item, label, pos, grp) with the place of an item in its configured list. The decision table: one column
present: it is taken; equal null patterns, or index ranges that overlap by less than a tenth of the largest
count: mean of each row; equal values in the same order: the column with the smallest mean index; otherwise
the column with the most values. Ties go to the first configured column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.spread import running_total


def collisions(dictionary: DataFrame) -> DataFrame:
    """Labels that at least two items carry, with their items in order."""
    return dictionary.groupBy("label").agg(F.sort_array(F.collect_set("item")).alias("items")).filter(F.size("items") >= 2)


def expand_rules(labels: DataFrame, simple: dict[str, list], split: dict[str, list[list]]) -> list[tuple]:
    """Rows (item, label, pos, grp, name, pretty) of the rule table for colliding labels (label, items); a
    split rule wins over a simple one, an empty split keeps every item apart. A label without a rule and a
    split that does not cover its items raise an error."""
    rows = []
    for label, items in labels.collect():  # a dictionary of labels
        if label in split:
            groups = split[label] or [[i] for i in items]
            if sorted(x for g in groups for x in g) != sorted(items):
                raise ValueError(f"the split of {label!r} does not cover its items")
            for g, members in enumerate(groups):
                name = "_".join([label, *map(str, members), str(g)])
                rows += [(i, label, p, g, name, f"{label} ({g + 1}/{len(groups)})") for p, i in enumerate(members)]
        elif label in simple:
            members = simple[label] or list(items)
            rows += [(i, label, p, 0, "_".join([label, *map(str, members)]), label) for p, i in enumerate(members)]
        else:
            raise ValueError(f"no rule for {label!r}")
    return rows


def with_row_index(chart: DataFrame) -> DataFrame:
    """Adds r, the index (from 0) of a chart row: the rank of its time among the encounter's times."""
    times = running_total(chart.select("enc", "t").distinct().withColumn("_one", F.lit(1)), "t", {"_one": "r"}, ["enc"]).drop("_one")
    return chart.join(times, ["enc", "t"])


def fuse(chart: DataFrame, rules: DataFrame) -> DataFrame:
    """Fused series: enc, name, t, value. Items without a rule are not part of the output. A chart of one
    encounter is bounded by its number of times; decisions are made on aggregated rows."""
    cells = with_row_index(chart).filter("value is not null").join(F.broadcast(rules.select("item", "name", "pos")), "item")
    # Patterns and contents are compared by two 64-bit digests each, so no series is collected.
    digest = lambda *c: F.struct(*[F.bit_xor(F.xxhash64(F.lit(k), *c)).alias(f"h{k}") for k in (1, 2)])
    placed = running_total(cells.withColumn("_one", F.lit(1)), "r", {"_one": "place"}, ["enc", "name", "item"])
    cols = placed.groupBy("enc", "name", "item", "pos").agg(
        F.count("*").alias("n"),
        F.min("r").alias("lo"),
        F.max("r").alias("hi"),
        F.avg("r").alias("mean_r"),
        digest("r").alias("pattern"),
        digest("place", "value").alias("content"),
    )
    groups = cols.groupBy("enc", "name").agg(
        F.count("*").alias("k"),
        F.max("n").alias("most"),
        F.greatest(F.lit(0), F.min("hi") - F.max("lo") + 1).alias("overlap"),
        F.countDistinct("n", "pattern").alias("patterns"),
        F.countDistinct("n", "content").alias("contents"),
        F.min(F.struct("mean_r", "pos")).alias("early"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("pos"))).alias("large"),
    )
    choice = groups.select(
        "enc",
        "name",
        F.when(F.col("k") == 1, "only")
        .when((F.col("patterns") == 1) | (F.col("overlap") < 0.1 * F.col("most")), "mean")
        .when(F.col("contents") == 1, "early")
        .otherwise("large")
        .alias("choice"),
        F.col("early.pos").alias("early_pos"),
        F.col("large.pos").alias("large_pos"),
    )
    keep = F.col("choice").isin("only", "mean") | ((F.col("choice") == "early") & (F.col("pos") == F.col("early_pos"))) | ((F.col("choice") == "large") & (F.col("pos") == F.col("large_pos")))
    return cells.join(choice, ["enc", "name"]).filter(keep).groupBy("enc", "name", "t").agg(F.avg("value").alias("value"))
