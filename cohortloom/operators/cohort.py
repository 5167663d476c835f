"""Choosing encounters: filters, set differences, samples and splits. Random choices order by a hash of the
key and a seed, so they depend neither on partitions nor on the size of the cluster; ties go by the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def text_contains_all(df: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Rows whose text holds every term in any letter case; null texts go only if there is a term."""
    if not terms:
        return df
    return df.filter(reduce(lambda a, b: a & b, [F.lower(F.col(column)).contains(t.lower()) for t in terms]))


def not_yet(wanted: DataFrame, done: DataFrame, key: str = "enc") -> DataFrame:
    """Keys of the first table that the second does not have."""
    return wanted.select(key).distinct().join(done.select(key), key, "left_anti")


def complete(base: DataFrame, kinds: list[DataFrame], key: str = "enc") -> DataFrame:
    """Encounters that every requested kind of data has."""
    return reduce(lambda a, k: a.join(k.select(key), key, "left_semi"), kinds, base)


#: Named cohort filters: name to predicate.
FILTERS: dict[str, str] = {"bed_and_breakfast": "days_in_care <= 1"}


def cohort(static: DataFrame, min_age: float | None = None, named: str | None = None) -> DataFrame:
    if min_age is not None:
        static = static.filter(F.col("age_years") >= min_age)
    return static.filter(FILTERS[named]) if named else static


def seed_of(text: str) -> int:
    """Seed from the bytes of a run id."""
    return int.from_bytes(text.encode(), "little") % 1_000_000


def shuffled(seed: int, *keys: str) -> Column:
    """Place of a row in a random order: 48 bits of the MD5 digest of the seed and the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys)), 1, 12), 16, 10).cast("long")


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A fixed random sample of n rows without replacement (a top-n, no full sort)."""
    return df.orderBy(shuffled(seed, key), key).limit(n)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(shuffled(seed, key), key)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def bootstraps(df: DataFrame, key: str, times: int, share: float, seed: int) -> DataFrame:
    """Membership of ``times`` samples without replacement: boot_id and key, int(share * rows) each. A row's
    place in a sample's hash order is a running count that is spread over tasks."""
    from cohortloom.functions.spread import running_total

    total = df.agg((F.count("*") * F.lit(share)).cast("long").alias("_k"))
    out = df.select(key).withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("_h", shuffled(seed, "boot_id", key)).withColumn("_one", F.lit(1))
    placed = running_total(out, "_h", {"_one": "below"}, ["boot_id"], [key])
    return placed.crossJoin(F.broadcast(total)).filter("below < _k").select(key, "boot_id")  # one row


def split(df: DataFrame, key: str, seed: int = 0, share: float = 0.9) -> DataFrame:
    """Adds split: the first floor(share * rows) rows in random order are 'training', the others 'validation'.
    Places are running counts that are spread over tasks; no sort of the whole cohort in one."""
    from cohortloom.functions.spread import running_total

    total = df.agg(F.floor(F.count("*") * F.lit(share)).alias("_k"))
    placed = running_total(df.withColumn("_h", shuffled(seed, key)).withColumn("_one", F.lit(1)), "_h", {"_one": "_below"}, None, [key])
    out = placed.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("split", F.when(F.col("_below") < F.col("_k"), "training").otherwise("validation")).drop("_h", "_one", "_below", "_k")


def in_split(df: DataFrame, which: str) -> DataFrame:
    """Rows of a split: 'training', 'validation', 'all' (training first, by split_pos) or a named filter."""
    if which == "all":
        return df.withColumn("split_pos", F.when(F.col("split") == "training", 0).otherwise(1))
    return df.filter(FILTERS[which]) if which in FILTERS else df.filter(F.col("split") == which)


def sample_with_replacement(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement, each any row with the same chance: key and draw, from 0. A draw picks the row at
    a place that the hash of its number gives, places being those of the keys in order."""
    from cohortloom.functions.spread import running_total

    placed = running_total(df.select(key).withColumn("_one", F.lit(1)), key, {"_one": "_at"}).select(key, "_at")
    size = df.agg(F.count("*").alias("_n"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).crossJoin(F.broadcast(size)).filter("_n > 0")  # one row
    return draws.withColumn("_at", F.pmod(shuffled(seed, "draw"), F.col("_n"))).join(placed, "_at").select(key, "draw")
