"""Code trees as a closure table: (code, depth, ancestor), one row for each ancestor of a code, depth from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(nodes: DataFrame) -> DataFrame:
    """Closure of (code, path), path an array of names from the root to the node."""
    return nodes.select("code", F.posexplode("path").alias("depth", "ancestor"))


def resolve(codes: DataFrame, known: DataFrame, shortest: int = 3) -> DataFrame:
    """Adds node: the known code equal to the code without dots, else after cutting last characters while more
    than two remain; null if none is known. codes needs code, known node. Codes are short, so the prefixes
    are a few rows each; adaptive execution broadcasts the tree where it is small."""
    plain = F.replace("code", F.lit("."), F.lit(""))
    bare = codes.select("code").distinct().withColumn("c", plain)
    tries = bare.withColumn("k", F.explode(F.when(F.length("c") >= shortest, F.sequence(F.length("c"), F.lit(shortest), F.lit(-1))).otherwise(F.array(F.length("c")))))
    hit = tries.withColumn("node", F.expr("substring(c, 1, k)")).join(known.select("node").distinct(), "node").groupBy("code").agg(F.max_by("node", "k").alias("node"))
    return codes.join(hit, "code", "left")


def ancestor_at(resolved: DataFrame, closed: DataFrame, depth: int) -> DataFrame:
    """Adds ancestor: the name at the given depth, or the node's own if it lies higher; 'UNKNOWN' without node."""
    a = closed.filter(F.col("depth") <= depth).groupBy(F.col("code").alias("node")).agg(F.max_by("ancestor", "depth").alias("ancestor"))
    return resolved.join(a, "node", "left").withColumn("ancestor", F.coalesce("ancestor", F.lit("UNKNOWN")))


def display_name(names: DataFrame, kind: str) -> DataFrame:
    """Name of a code, else the kind and the code."""
    return names.withColumn("name", F.coalesce("name", F.concat_ws("__", F.lit(kind), F.col("code"))))


def node_code(col: str):
    """Code at the start of a node's title; null without one."""
    found = F.regexp_extract(col, r"^[0-9VE][0-9]\S*", 0)
    return F.when(found != "", found)


def styled(resolved: DataFrame, styles: DataFrame) -> DataFrame:
    """Adds short and colour of a code's category (column ancestor) from a table (category, short, colour): the
    category's own name where it has no short one, null where it has no colour."""
    s = styles.groupBy(F.col("category").alias("ancestor")).agg(F.min("short").alias("short"), F.min("colour").alias("colour"))
    return resolved.join(s, "ancestor", "left").withColumn("short", F.coalesce("short", "ancestor"))
