"""Implausible readings per source: impossible values, spikes and frozen values (problem 6).

A series (encounter and item) is charted whole in one task as long as it has at most PIECE rows. A longer one
is numbered in order and cut into pieces of PIECE readings, wherever in time they lie. What a piece needs from
the others comes to it as readings, counted and not timed: the WARM readings on each side, from which both
charts warm up and runs of one value go on, and one number for the whole series, its normal movement, from a
histogram of steps that is added up over the pieces. So the flags do not depend on where the cuts lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.grouped import change_points, map_groups
from cohortloom.operators.chart import ChartParams, frozen_flags, scale_of, spike_flags, step_bins
from cohortloom.sources.tables import epoch_s, reading, shared_folder

#: Rows of a series that is charted whole, and readings of a piece of a longer one; readings that a piece sees
#: on each side (a chart keeps less than 1e-90 of what it knew before them); seconds of the shards that are
#: counted to number the readings.
PIECE, WARM, SHARD_S = 1 << 17, 2048, 1 << 16
#: Most items with limits; their table is sent to all tasks.
MAX_ITEMS = 1_000

_READING = "hadm_id bigint, itemid bigint, t bigint, x double"
_SERIES = ["hadm_id", "itemid"]


def limit_table(limits: DataFrame | None) -> dict[int, tuple[float, float, float]]:
    """Limits by item from rows (itemid, low, high, least): a patient's reading is above low and at most high,
    and least is the smallest movement that counts as one scale. Nulls set no limit; of repeated items the
    narrowest limits count; more than MAX_ITEMS items are refused."""
    if limits is None:
        return {}
    rows = limits.filter("itemid is not null").groupBy("itemid").agg(F.max("low"), F.min("high"), F.max("least")).limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items with limits: flag them in several calls")
    return {r[0]: (-np.inf if r[1] is None else r[1], np.inf if r[2] is None else r[2], r[3] or 0.0) for r in rows}


def _columns(t: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [t.column(c).to_numpy(zero_copy_only=False) for c in names]


def _reasons(t: np.ndarray, x: np.ndarray, bounds: tuple[float, float, float], params: ChartParams, scale: float | None = None) -> np.ndarray:
    """Reason of each reading of a series or piece: 0 none, 1 impossible, 2 spike, 3 frozen."""
    low, high, least = bounds
    bad = ~((x > low) & (x <= high))
    out = np.where(frozen_flags(t, x, params), 3, 0).astype(np.int8)
    good = np.flatnonzero(~bad)
    out[good[spike_flags(x[good], max(least, 1e-9), params, scale)]] = 2
    out[bad] = 1
    return out


_NAMES = np.array(["", "impossible", "spike", "frozen"], object)


def _flag_whole(readings: DataFrame, limits: dict[int, tuple[float, float, float]], params: ChartParams) -> DataFrame:
    """Flags of series that go to one task each."""

    def work(t: pa.Table) -> pa.Table:
        hadm, item, sec, x = _columns(t, ["hadm_id", "itemid", "t", "x"])
        cuts = [*change_points([hadm, item]).tolist(), len(x)]
        reason = np.zeros(len(x), np.int8)
        for a, b in zip(cuts, cuts[1:]):
            reason[a:b] = _reasons(sec[a:b], x[a:b], limits.get(int(item[a]), (-np.inf, np.inf, 0.0)), params)
        keep = np.flatnonzero(reason)
        return pa.table({"hadm_id": hadm[keep], "itemid": item[keep], "t": sec[keep], "x": x[keep], "reason": pa.array(_NAMES[reason[keep]], pa.string())})

    return map_groups(readings, _SERIES, ["t", "x"], work, _READING + ", reason string")


def _numbered(readings: DataFrame) -> DataFrame:
    """Adds r, the place of a reading in its series: rows are counted by shard, and a shard's readings are
    numbered from the sum of the shards before it."""
    cut = readings.withColumn("shard", F.floor(F.col("t") / SHARD_S))
    before = Window.partitionBy(*_SERIES).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*_SERIES, "shard").agg(F.count("*").alias("n")).select(*_SERIES, "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*_SERIES, "shard").orderBy("t", "x")
    return cut.withColumn("i", F.row_number().over(inside)).join(starts, [*_SERIES, "shard"]).select(*_SERIES, "t", "x", (F.col("start") + F.col("i") - 1).alias("r"))


def _flag_pieces(readings: DataFrame, limits: dict[int, tuple[float, float, float]], params: ChartParams, piece: int, warm: int) -> DataFrame:
    """Flags of series that are cut into pieces. Every reading goes to its piece, and to the next or the last
    one if it is within ``warm`` readings of it."""
    path = f"{shared_folder(readings.sparkSession)}/numbered"
    _numbered(readings).write.parquet(path)
    numbered = readings.sparkSession.read.parquet(path)
    first, last = F.floor((F.col("r") - warm) / piece), F.floor((F.col("r") + warm) / piece)
    spread = numbered.withColumn("piece", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))

    def movement(t: pa.Table) -> pa.Table:
        """Steps of the piece's own readings by the bin of their size. A step belongs to its second reading."""
        hadm, item, piece_no, x, r = _columns(t, ["hadm_id", "itemid", "piece", "x", "r"])
        cuts = [*change_points([hadm, item, piece_no]).tolist(), len(x)]
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(cuts, cuts[1:]):
            low, high, _ = limits.get(int(item[a]), (-np.inf, np.inf, 0.0))
            good = a + np.flatnonzero((x[a:b] > low) & (x[a:b] <= high))
            own = r[good[1:]] // piece == piece_no[a]
            bins, n = np.unique(step_bins(np.abs(np.diff(x[good]))[own]), return_counts=True)
            out.append((np.full(len(bins), hadm[a]), np.full(len(bins), item[a]), bins, n))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
        return pa.table(dict(zip(["hadm_id", "itemid", "bin", "n"], cols)))

    def middle(t: pa.Table) -> pa.Table:
        hadm, item, bins, n = _columns(t, ["hadm_id", "itemid", "bin", "n"])
        cuts = [*change_points([hadm, item]).tolist(), len(n)]
        scales = [scale_of(bins[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.table({"hadm_id": hadm[cuts[:-1]], "itemid": item[cuts[:-1]], "scale": pa.array(scales, pa.float64())})

    steps = map_groups(spread, [*_SERIES, "piece"], ["r"], movement, "hadm_id bigint, itemid bigint, bin bigint, n bigint")
    scales = map_groups(steps.groupBy(*_SERIES, "bin").agg(F.sum("n").alias("n")), _SERIES, ["bin"], middle, "hadm_id bigint, itemid bigint, scale double")
    # One row for each piece, so that the join has the key of the groups and no series meets in one task.
    ends = numbered.groupBy(*_SERIES).agg(F.floor(F.max("r") / piece).alias("last"))
    each = ends.join(scales, _SERIES, "left").select(*_SERIES, "scale", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("piece"))

    def work(t: pa.Table) -> pa.Table:
        hadm, item, piece_no, sec, x, r, scale = _columns(t, ["hadm_id", "itemid", "piece", "t", "x", "r", "scale"])
        cuts = [*change_points([hadm, item, piece_no]).tolist(), len(x)]
        reason = np.zeros(len(x), np.int8)
        for a, b in zip(cuts, cuts[1:]):
            s = 0.0 if np.isnan(scale[a]) else float(scale[a])
            reason[a:b] = _reasons(sec[a:b], x[a:b], limits.get(int(item[a]), (-np.inf, np.inf, 0.0)), params, s)
        keep = np.flatnonzero((reason > 0) & (r // piece == piece_no))
        return pa.table({"hadm_id": hadm[keep], "itemid": item[keep], "t": sec[keep], "x": x[keep], "reason": pa.array(_NAMES[reason[keep]], pa.string())})

    keyed = spread.join(each, [*_SERIES, "piece"])
    return map_groups(keyed, [*_SERIES, "piece"], ["r"], work, _READING + ", reason string")


def flag_readings(readings: DataFrame, limits: DataFrame | None = None, params: ChartParams = ChartParams(), piece: int = PIECE, warm: int = WARM) -> DataFrame:
    """Flagged readings (hadm_id, itemid, t, x, reason) of rows (hadm_id, itemid, t, x), t in epoch seconds.

    reason is 'impossible', 'spike' or 'frozen', the first that holds. Rows with a null in hadm_id, itemid,
    t or x are left out; repeated readings count once; an item without limits has no impossible values and a
    least scale of 0; series too short for a level have no spikes. For ``limits`` see limit_table. Whether a
    series is longer than ``piece`` is counted first, so ``readings`` should be cheap to read twice.

    Equal readings are merged before the shuffle, so copies cannot pile up in a task.
    """
    if warm > piece:
        raise ValueError("warm must not exceed piece")
    bounds = limit_table(limits)
    rows = readings.select(*_SERIES, "t", "x").na.drop()
    long = rows.groupBy(*_SERIES).agg(F.count("*").alias("n")).filter(F.col("n") > piece).select(*_SERIES)
    merged = rows.distinct()
    if long.isEmpty():
        return _flag_whole(merged, bounds, params)
    whole = _flag_whole(merged.join(long, _SERIES, "left_anti"), bounds, params)
    return whole.unionByName(_flag_pieces(merged.join(long, _SERIES, "left_semi"), bounds, params, piece, warm))


def series_rows(chartevents: DataFrame, items: DataFrame) -> DataFrame:
    """Rows with a number of the given items: row_id, hadm_id, itemid, t, x."""
    wanted = items.select("itemid").na.drop().distinct()
    return (
        chartevents.select("row_id", "hadm_id", "itemid", "charttime", "valuenum", "value")
        .join(wanted, "itemid", "left_semi")
        .select("row_id", "hadm_id", "itemid", epoch_s("charttime").alias("t"), reading().alias("x"))
        .filter("hadm_id is not null and t is not null and x is not null")
    )


def flag_rows(chartevents: DataFrame, items: DataFrame, limits: DataFrame | None = None, salts: int = 8) -> DataFrame:
    """Every row whose reading is implausible: row_id, hadm_id, itemid, t, x, reason. Repeated rows all count.

    The rows of the items are written to the shared folder once, so ``chartevents`` is scanned once. The
    flagged readings go back to their rows by an equi-join whose keys are salted by row_id, as copies of one
    reading may be many; the flagged side is a small share and is repeated for each salt. Adaptive execution
    broadcasts it only where its measured size is under the session's threshold.
    """
    path = f"{shared_folder(chartevents.sparkSession)}/readings"
    series_rows(chartevents, items).write.parquet(path)
    rows = chartevents.sparkSession.read.parquet(path)
    flagged = flag_readings(rows, limits).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.coalesce("row_id", F.lit(0)), F.lit(salts)).cast("int"))
    return salted.join(flagged, ["hadm_id", "itemid", "t", "x", "salt"]).select("row_id", "hadm_id", "itemid", "t", "x", "reason")
