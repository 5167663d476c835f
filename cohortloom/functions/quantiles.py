"""Exact quantiles of columns and groups that may hold most of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.spread import any_long, running_total, settled


def quantiles(df: DataFrame, value: str, levels: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: by..., q (array in the order of ``levels``). Nulls do not count;
    a group without values has no row, no group at all a row with a null.

    Groups of at most LONG rows take the built-in aggregate. Else equal values are counted first; running sums over the counts, spread over tasks, give each value its ranks,
    and the values at the wanted ranks are picked. No task holds the values of a longer group. Rows with a null in
    a key of the group are left out.
    """
    by = by or []
    seen = settled(df.select(*by, F.col(value).cast("double").alias("_v")).na.drop())
    if not any_long(seen, by):
        return seen.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in levels])).alias("q"))
    counts = settled(seen.groupBy(*by, "_v").agg(F.count("*").alias("_n")))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    placed = running_total(counts, "_v", {"_n": "_below"}, by)
    placed = placed.join(total, by) if by else placed.crossJoin(F.broadcast(total))  # one row
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(levels)])
    at = lambda w: w["p"] * (F.col("_total") - 1)
    inside = lambda rank: (rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_n"))
    hits = placed.select(*by, "_v", "_below", "_n", "_total", F.explode(F.filter(wanted, lambda w: inside(F.floor(at(w))) | inside(F.ceil(at(w))))).alias("w"))
    low = F.max(F.when(inside(F.floor(at(F.col("w")))), F.col("_v")))
    high = F.max(F.when(inside(F.ceil(at(F.col("w")))), F.col("_v")))
    part = F.max(at(F.col("w")) - F.floor(at(F.col("w"))))
    each = hits.groupBy(*by, F.col("w.i").alias("_i")).agg((low + (high - low) * part).alias("_q"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("q"))
