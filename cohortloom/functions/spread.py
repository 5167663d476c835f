"""Window functions over groups that may hold most of all rows.

Where every group has at most LONG rows (they are counted first) it is a window as it is. Else the rows of a group are cut into pieces at approximate quantiles of the order; every piece is a window of its
own, and what a piece needs from the others (sums, the last row before it, the first one after it) is taken
from one summary row for each piece. Results are exact wherever the cuts lie. The join with the summary uses
the same keys as the window, so rows are shuffled once. The input is read several times (counts, cuts, summary,
rows), so one that takes more than a scan is written to the shared folder first. Rows with a null in a key of the
group are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.sources.tables import shared_folder

#: Pieces of a group; their square on clusters with more cores than that, so that a hot group fills them.
PIECES = 64


#: Rows of a group that one task takes.
LONG = 1 << 17


def any_long(df: DataFrame, by: list[str]) -> bool:
    """Whether a group has more than LONG rows."""
    if not by:
        return df.limit(LONG + 1).count() > LONG
    return not df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > LONG).isEmpty()


def settled(df: DataFrame) -> DataFrame:
    """The rows as a table of the shared folder, unless they come from a scan without any shuffle."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if not any(f"{name} " in plan for name in ("Join", "Aggregate", "Window", "Sort", "Distinct", "RepartitionByExpression", "MapInArrow", "Generate")):
        return df
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(df: DataFrame, order: str, name: str = "_p") -> DataFrame:
    """Adds the number of the piece that a row's order (a number, null first) falls into."""
    x = F.col(order).cast("double")
    n = PIECES if df.sparkSession.sparkContext.defaultParallelism <= PIECES else PIECES * PIECES
    cuts = df.select(F.percentile_approx(x, [i / n for i in range(1, n)], max(1000, 4 * n)).alias("_q"))
    cuts = cuts.select(F.coalesce("_q", F.array().cast("array<double>")).alias("_q"))
    below = lambda q: F.size(F.filter(q, lambda c: F.coalesce(c < x, F.lit(False))))
    if n == PIECES:
        at = below(F.col("_q"))
    else:  # which of the coarse cuts, then which of the fine ones behind it
        cuts = cuts.withColumn("_c", F.filter("_q", lambda c, i: i % PIECES == PIECES - 1))
        at = below(F.col("_c")) * PIECES + below(F.slice("_q", below(F.col("_c")) * PIECES + 1, PIECES - 1))
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, at).drop(*cuts.columns)  # one row


def running_total(df: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Adds sums over the rows that come before, by ``order`` and ``ties``, per ``by``. ``sums`` names the new
    column of each summed column."""
    by = by or []
    df = settled(df.na.drop(subset=by) if by else df)
    if not any_long(df, by):
        w = Window.partitionBy(*by).orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({o: F.coalesce(F.sum(c).over(w), F.lit(0)) for c, o in sums.items()})
    keyed = pieces(df, order).repartition(*by, "_p")  # else a coarser partitioning from before would be kept
    totals = keyed.groupBy(*by, "_p").agg(*[F.sum(c).alias(f"_s_{o}") for c, o in sums.items()])
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*by, "_p", *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_s_{o}") for o in sums.values()])
    inside = Window.partitionBy(*by, "_p").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.withColumns({f"_i_{o}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, o in sums.items()}).join(start, [*by, "_p"])
    out = joined.withColumns({o: F.col(f"_i_{o}") + F.col(f"_s_{o}") for o in sums.values()})
    return out.drop("_p", *[f"{k}{o}" for o in sums.values() for k in ("_i_", "_s_")])


def neighbours(df: DataFrame, by: list[str], order: list[str], fields: list[str], where: Column | None = None, before: str | None = None, after: str | None = None, current: bool = True) -> DataFrame:
    """Adds structs of ``order`` and ``fields`` of the nearest rows of the group that satisfy ``where``: the last
    one before a row and the first one after it, the row itself included if ``current``. The order must be
    total; its first column is a number. ``by`` must not be null."""
    there = F.lit(True) if where is None else where
    names = list(dict.fromkeys([*order, *fields]))
    row = F.when(there, F.struct(*names))
    df = settled(df.na.drop(subset=by))
    step = 0 if current else 1
    if not any_long(df, by):
        w = Window.partitionBy(*by).orderBy(*order)
        new = {before: F.last(row, True).over(w.rowsBetween(Window.unboundedPreceding, -step))} if before else {}
        if after:
            new[after] = F.first(row, True).over(w.rowsBetween(step, Window.unboundedFollowing))
        return df.withColumns(new)
    keyed = pieces(df, order[0]).repartition(*by, "_p")  # else a coarser partitioning from before would be kept
    summary = keyed.groupBy(*by, "_p").agg(F.max(row).alias("_last"), F.min(row).alias("_first"))
    w = Window.partitionBy(*by).orderBy("_p")
    edges = summary.select(
        *by,
        "_p",
        F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inside = Window.partitionBy(*by, "_p").orderBy(*order)
    out = keyed
    if before:
        out = out.withColumn(before, F.last(row, True).over(inside.rowsBetween(Window.unboundedPreceding, -step)))
    if after:
        out = out.withColumn(after, F.first(row, True).over(inside.rowsBetween(step, Window.unboundedFollowing)))
    out = out.join(edges, [*by, "_p"])
    if before:
        out = out.withColumn(before, F.coalesce(before, "_before"))
    if after:
        out = out.withColumn(after, F.coalesce(after, "_after"))
    return out.drop("_p", "_before", "_after")
