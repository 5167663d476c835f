"""Irregular readings onto a regular grid (problem 5).

Readings are averaged per slot with a map-side combine. Time of a series is counted in slots from its first
filled one and cut into blocks of BLOCK slots, which all sources of an item share: the readings of an item in
a block of time are a source-by-time matrix, one row for a source, one column for a slot. (Columns of calendar
time would hold one source each, as de-identified dates do not meet.) Matrices of more than PANEL sources are
split by a hash of the source. Each matrix is factorised in one task with low rank by alternating least
squares. Observed cells stay exact; an empty cell is filled if its row and its column have enough readings;
all other cells stay marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.grouped import change_points, map_groups
from cohortloom.sources.tables import epoch_s, reading, shared_folder

#: Slots of a block, and sources of a panel on average at most.
BLOCK, PANEL = 32, 4096
#: Rank, weight of the ridge, rounds, the readings that a row needs to be filled and those of a column.
RANK, RIDGE, ROUNDS, SUPPORT, SOURCES = 2, 0.5, 5, 4, 3
#: Empty slots of a gap between blocks that leave a task at a time.
SLICE = 1 << 16

_STATES = np.array(["observed", "filled", "marked"], object)
_NONE = np.iinfo(np.int64).min


def slots(chartevents: DataFrame, grid_items: DataFrame) -> DataFrame:
    """Mean reading of each filled slot: hadm_id, itemid, slot, x.

    slot is floor(epoch seconds / (60 * step_min)). Rows without a number and rows with a null in hadm_id,
    itemid or charttime do not count; an item's smallest step counts if it stands in grid_items twice.
    """
    steps = grid_items.filter("step_min > 0").groupBy("itemid").agg(F.min("step_min").alias("step_min"))
    return (
        chartevents.select("hadm_id", "itemid", "charttime", "valuenum", "value")
        .join(steps, "itemid")
        .withColumn("x", reading())
        .filter("x is not null and hadm_id is not null and charttime is not null")
        .groupBy("hadm_id", "itemid", F.floor(epoch_s("charttime") / (60 * F.col("step_min"))).alias("slot"))
        .agg(F.avg("x").alias("x"))
    )


def matrix_rows(filled: DataFrame) -> DataFrame:
    """Rows of the matrices: hadm_id, itemid, block, start (the series' first slot), c and x (columns and values
    in order), and from the series before_slot and next_slot: the last filled slot before the block and the
    first one after it. ``filled`` is read twice.

    A row holds at most BLOCK cells; the window passes once over the blocks of a series.
    """
    starts = filled.groupBy("hadm_id", "itemid").agg(F.min("slot").alias("start"))
    w = Window.partitionBy("hadm_id", "itemid").orderBy("block")
    away = F.col("slot") - F.col("start")
    return (
        filled.join(starts, ["hadm_id", "itemid"])
        .groupBy("hadm_id", "itemid", F.floor(away / BLOCK).alias("block"), "start")
        .agg(F.sort_array(F.collect_list(F.struct(F.pmod(away, F.lit(BLOCK)).cast("int").alias("c"), "x"))).alias("cells"))
        .withColumn("base", F.col("start") + F.col("block") * BLOCK)
        .withColumn("before_slot", F.lag(F.col("base") + F.element_at("cells", -1)["c"]).over(w))
        .withColumn("next_slot", F.lead(F.col("base") + F.element_at("cells", 1)["c"]).over(w))
        .select("hadm_id", "itemid", "block", "start", F.col("cells.c").alias("c"), F.col("cells.x").alias("x"), "before_slot", "next_slot")
    )


def _dense(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of a table of matrix rows."""
    lists = t.column("c").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    col = lists.flatten().to_numpy().astype(np.int64)
    x, seen = np.zeros((len(n), BLOCK)), np.zeros((len(n), BLOCK), bool)
    x[row, col] = t.column("x").combine_chunks().flatten().to_numpy()
    seen[row, col] = True
    return x, seen


def _rows(x: np.ndarray, seen: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row step: mean, scale and factors of each row, given the column factors."""
    n = np.maximum(seen.sum(1), 1)
    mean = (x * seen).sum(1) / n
    z = (x - mean[:, None]) * seen
    scale = np.sqrt((z**2).sum(1) / n) + 1e-9
    z /= scale[:, None]
    outer = (columns[:, :, None] * columns[:, None, :]).reshape(BLOCK, -1)
    a = (seen.astype(float) @ outer).reshape(len(x), RANK, RANK) + RIDGE * np.eye(RANK)
    return mean, scale, np.linalg.solve(a, (z @ columns)[:, :, None])[:, :, 0]


def starting_factors() -> np.ndarray:
    """Column factors to begin with: the first waves over a block."""
    c = (np.arange(BLOCK) + 0.5) / BLOCK
    return np.stack([np.cos(np.pi * (k + 1) * c) for k in range(RANK)], axis=1)


def column_factors(x: np.ndarray, seen: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Column factors of one matrix by alternating least squares. A column that fewer than SOURCES rows with
    SUPPORT readings have filled gets none (zeros)."""
    good = seen.sum(1) >= SUPPORT
    x, seen = x[good], seen[good]
    told = seen.sum(0) >= SOURCES
    columns = starting_factors() * told[:, None]
    for _ in range(rounds if told.any() else 0):
        mean, scale, u = _rows(x, seen, columns)
        z = (x - mean[:, None]) / scale[:, None] * seen
        outer = (u[:, :, None] * u[:, None, :]).reshape(len(u), -1)
        a = (seen.T.astype(float) @ outer).reshape(BLOCK, RANK, RANK) + RIDGE * np.eye(RANK)
        columns = np.linalg.solve(a, (z.T @ u)[:, :, None])[:, :, 0] * told[:, None]
        columns /= np.sqrt((columns**2).mean(0)) + 1e-9  # the scale between rows and columns is free
    return columns


def completed(x: np.ndarray, seen: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and states (0 observed, 1 filled, 2 marked) of all cells of a matrix, given its column factors.
    A filled value stays between the least and the largest reading of its row."""
    mean, scale, u = _rows(x, seen, columns)
    low, high = np.where(seen, x, np.inf).min(1), np.where(seen, x, -np.inf).max(1)
    fill = np.clip(mean[:, None] + scale[:, None] * (u @ columns.T), low[:, None], high[:, None])
    can = (seen.sum(1) >= SUPPORT)[:, None] & (columns**2).any(1)[None, :]
    state = np.where(seen, 0, np.where(can, 1, 2))
    return np.where(seen, x, np.where(can, fill, np.nan)), state


def regular_series(rows: DataFrame, factorise=column_factors) -> DataFrame:
    """The grid: hadm_id, itemid, slot, x, state, one row for each slot between a series' first and last.

    state is 'observed' (x exact), 'filled' (x from the factors) or 'marked' (x null: too few readings in the
    row or the column, or none in the block). ``rows`` is read twice, for the number of panels too.
    """
    panels = rows.groupBy("itemid", "block").agg(F.ceil(F.count("*") / PANEL).alias("panels"))
    keyed = rows.join(panels, ["itemid", "block"]).withColumn("panel", F.pmod(F.xxhash64("hadm_id"), F.col("panels"))).drop("panels")

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        hadm, item, block, panel, start = (t.column(c).to_numpy() for c in ("hadm_id", "itemid", "block", "panel", "start"))
        before = t.column("before_slot").fill_null(_NONE).to_numpy()
        after = t.column("next_slot").fill_null(_NONE).to_numpy()
        x, seen = _dense(t)
        cuts = [*change_points([item, block, panel]).tolist(), len(item)]
        base = start + block * BLOCK
        place = np.arange(BLOCK)
        last = BLOCK - 1 - seen[:, ::-1].argmax(1)
        inside = (place <= last[:, None]) | (after > _NONE)[:, None]  # a series' first block begins with a reading
        for a, b in zip(cuts, cuts[1:]):
            columns = factorise(x[a:b], seen[a:b])
            value, state = completed(x[a:b], seen[a:b], columns)
            r, c = np.nonzero(inside[a:b])
            yield _cells(hadm[a + r], item[a + r], base[a + r] + c, value[r, c], state[r, c])
        # Whole blocks without a reading, between the filled slot before and this block, in slices.
        gap_from = start + ((before - start) // BLOCK + 1) * BLOCK
        n = np.where(before > _NONE, np.maximum(base - gap_from, 0), 0)
        parts = -(-n // SLICE)
        row = np.repeat(np.arange(len(n)), parts)
        at = gap_from[row] + SLICE * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
        size = np.minimum(SLICE, base[row] - at)
        for k in range(0, len(row), 16):
            i, s = np.repeat(row[k : k + 16], size[k : k + 16]), size[k : k + 16]
            slot = np.repeat(at[k : k + 16], s) + np.arange(len(i)) - np.repeat(np.cumsum(s) - s, s)
            yield _cells(hadm[i], item[i], slot, np.full(len(i), np.nan), np.full(len(i), 2))

    return map_groups(keyed, ["itemid", "block", "panel"], [], emit, "hadm_id bigint, itemid bigint, slot bigint, x double, state string")


def _cells(hadm: np.ndarray, item: np.ndarray, slot: np.ndarray, x: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hadm), pa.array(item), pa.array(slot), pa.array(x, from_pandas=True), pa.array(_STATES[state], pa.string())], ["hadm_id", "itemid", "slot", "x", "state"])


def empty_runs(series: DataFrame) -> DataFrame:
    """Longest runs of slots without a reading in the series that regular_series gives: hadm_id, itemid,
    slot_from, slot_to, n_filled (slots of the run that the factors fill).

    Runs are found in stretches of BLOCK slots first; a window over the runs of a series joins those that touch.
    """
    stretch = ["hadm_id", "itemid", "stretch"]
    cut = series.filter("state <> 'observed'").withColumn("stretch", F.floor(F.col("slot") / BLOCK))
    pieces = (
        cut.withColumn("island", F.col("slot") - F.row_number().over(Window.partitionBy(*stretch).orderBy("slot")))
        .groupBy(*stretch, "island")
        .agg(F.min("slot").alias("a"), F.max("slot").alias("z"), F.count(F.when(F.col("state") == "filled", 1)).alias("n"))
    )
    w = Window.partitionBy("hadm_id", "itemid").orderBy("a")
    new = F.when(F.col("a") == F.lag("z").over(w) + 1, 0).otherwise(1)
    numbered = pieces.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return numbered.groupBy("hadm_id", "itemid", "run").agg(F.min("a").alias("slot_from"), F.max("z").alias("slot_to"), F.sum("n").alias("n_filled")).drop("run")


def fit(chartevents: DataFrame, grid_items: DataFrame) -> DataFrame:
    """Matrix rows of the readings, from tables written into the shared folder, so that ``chartevents`` is
    scanned once and neither the slots nor the rows are made twice."""
    spark = chartevents.sparkSession
    folder = shared_folder(spark)
    slots(chartevents, grid_items).write.parquet(f"{folder}/slots")
    matrix_rows(spark.read.parquet(f"{folder}/slots")).write.parquet(f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows")
