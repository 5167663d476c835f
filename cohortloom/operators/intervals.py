"""Continuous periods and gaps of overlapping intervals (problem 1).

Time is discretised into whole seconds. Per entity and time shard the covered seconds form a bitmap that
is kept compressed as runs (pairs of first and one-past-last second inside the shard, uint32). Bitmaps are
united twice: inside each input partition, so a hot entity or a group of copies shrinks before the shuffle,
and after it. Set runs of the united bitmaps are periods, clear runs between them are gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.grouped import change_points, map_groups
from cohortloom.sources.tables import epoch_s

#: Seconds of a time shard (about 12 days).
SHARD_S = 1 << 20


def unite(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open runs per group number (ascending integers): group, start and end of the set runs."""
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    if not len(group):
        return group, start, end
    # One axis for all groups: groups stand so far apart that their runs cannot touch.
    base = int(start.min())
    width = int(end.max()) - base + 2
    a, b = group * width + (start - base), group * width + (end - base)
    reach = np.maximum.accumulate(b)
    new = np.concatenate(([True], a[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    return group[first], start[first], reach[last] - group[last] * width + base


def split_shards(start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of intervals at the shard edges: row, shard, first and one-past-last offset in the shard."""
    first, last = start // width, (end - 1) // width
    n = last - first + 1
    row = np.repeat(np.arange(len(start)), n)
    shard = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, shard, np.maximum(start[row] - shard * width, 0), np.minimum(end[row] - shard * width, width)


def pack(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Run bitmaps as bytes, one for each group number."""
    pairs = np.stack([start, end], axis=1).astype("<u4")
    first = change_points([group])
    cuts = [*first.tolist(), len(group)]
    return group[first], [pairs[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def unpack(bitmaps: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every run of the given bitmaps."""
    sizes = np.array([len(x) // 8 for x in bitmaps], np.int64)
    pairs = np.frombuffer(b"".join(bitmaps), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(bitmaps)), sizes), pairs[:, 0], pairs[:, 1]


_BITMAP = "scope string, entity_id bigint, shard bigint, runs binary"


def _partial(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            scopes = b.column("scope").dictionary_encode()
            code = scopes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            entity, s, e = (b.column(c).to_numpy(zero_copy_only=False) for c in ("entity_id", "s", "e"))
            # Intervals are united before they are cut, so copies and long intervals give each shard one piece.
            keys, group = np.unique(np.stack([code, entity]), axis=1, return_inverse=True)
            g, s, e = unite(group.ravel().astype(np.int64), s, e)
            row, shard, lo, hi = split_shards(s, e, width)
            first = change_points([g[row], shard])
            number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
            _, runs = pack(number, lo, hi)
            keys = np.stack([keys[0][g[row[first]]], keys[1][g[row[first]]], shard[first]])
            g = np.arange(len(first))
            names = scopes.dictionary.take(pa.array(keys[0][g]))
            yield pa.RecordBatch.from_arrays([names, pa.array(keys[1][g]), pa.array(keys[2][g]), pa.array(runs, pa.binary())], ["scope", "entity_id", "shard", "runs"])

    return run


def run_bitmaps(intervals: DataFrame, width: int = SHARD_S) -> DataFrame:
    """United run bitmap of each entity and shard, from rows (scope, entity_id, s, e) in seconds.

    After the union inside the input partitions a group holds at most one row for each of them.
    """

    def merge(t: pa.Table) -> pa.Table:
        scope, entity, shard = (t.column(c).to_numpy(zero_copy_only=False) for c in ("scope", "entity_id", "shard"))
        first = change_points([scope, entity, shard])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(scope))))
        row, lo, hi = unpack(t.column("runs").to_pylist())
        g, runs = pack(*unite(group[row], lo, hi))
        at = first[g]
        return pa.table({"scope": pa.array(scope[at], pa.string()), "entity_id": entity[at], "shard": shard[at], "runs": pa.array(runs, pa.binary())})

    return map_groups(intervals.mapInArrow(_partial(width), _BITMAP), ["scope", "entity_id", "shard"], [], merge, _BITMAP)


def periods_and_gaps(intervals: DataFrame, width: int = SHARD_S) -> DataFrame:
    """Longest continuous periods of each entity and the gaps between successive ones.

    ``intervals`` has scope, entity_id, start_s and end_s (epoch seconds); other columns are ignored. A row
    with a null in any of the four, or whose end is not after its start, is left out; repeated rows change
    nothing; an empty table gives an empty result. Intervals that overlap or touch belong together. Output:
    scope, entity_id, kind ('period' or 'gap'), start_s, end_s.

    The bitmaps of one entity are read in order by a streaming window over its shards; a row of the window
    is one shard, however many intervals fell into it.
    """
    rows = (
        intervals.select("scope", "entity_id", F.col("start_s").cast("long").alias("s"), F.col("end_s").cast("long").alias("e"))
        .filter("scope is not null and entity_id is not null and s is not null and e is not null and e > s")
        .withColumn("entity_id", F.col("entity_id").cast("long"))
    )

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            runs = [np.frombuffer(x, "<u4") for x in b.column("runs").to_pylist()]
            base = b.column("shard").to_numpy() * width
            cols = {n: np.array([int(r[k]) for r in runs]) + base for n, k in (("first_s", 0), ("last_s", -2), ("last_e", -1))}
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("scope", "entity_id", "shard", "runs")), *(pa.array(v) for v in cols.values()), pa.array([len(r) // 2 for r in runs], pa.int64())],
                ["scope", "entity_id", "shard", "runs", *cols, "n"],
            )

    w = Window.partitionBy("scope", "entity_id").orderBy("shard")
    left, right = F.col("shard") * width, (F.col("shard") + 1) * width
    ordered = (
        run_bitmaps(rows, width)
        .mapInArrow(edges, _BITMAP + ", first_s bigint, last_s bigint, last_e bigint, n bigint")
        .withColumn("before", F.lag("last_e").over(w))
        .withColumn("goes_on", (F.col("last_e") == right) & F.coalesce(F.lead("first_s").over(w) == right, F.lit(False)))
        .withColumn("came_on", (F.col("first_s") == left) & F.coalesce(F.col("before") == left, F.lit(False)))
        .withColumn("open_s", F.last(F.when(~(F.col("came_on") & (F.col("n") == 1)), F.col("last_s")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("carried", F.lag("open_s").over(w))
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            row, s, e = unpack(b.column("runs").to_pylist())
            s, e = s + col("shard")[row] * width, e + col("shard")[row] * width
            head = np.concatenate(([True], row[1:] != row[:-1]))
            tail = np.append(head[1:], True)
            joined = head & col("came_on").astype(bool)[row]
            before = np.where(head, np.nan_to_num(col("before").astype(float), nan=-1).astype(np.int64)[row], np.append(0, e[:-1]))
            known = ~head | (~b.column("before").is_null().to_numpy(zero_copy_only=False))[row]
            carried = np.nan_to_num(col("carried").astype(float), nan=0).astype(np.int64)
            start = np.where(joined, carried[row], s)
            period = ~(tail & col("goes_on").astype(bool)[row])
            gap = ~joined & known
            at = np.concatenate([row[period], row[gap]])
            kind = pa.array(["period"] * int(period.sum()) + ["gap"] * int(gap.sum()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("scope").take(pa.array(at)), b.column("entity_id").take(pa.array(at)), kind, pa.array(np.concatenate([start[period], before[gap]])), pa.array(np.concatenate([e[period], s[gap]]))],
                ["scope", "entity_id", "kind", "start_s", "end_s"],
            )

    return ordered.mapInArrow(emit, "scope string, entity_id bigint, kind string, start_s bigint, end_s bigint")


def stay_intervals(icustays: DataFrame, admissions: DataFrame) -> DataFrame:
    """Intervals of both scopes: stays of an admission ('icu') and admissions of a patient ('hospital')."""
    icu = icustays.select(F.lit("icu").alias("scope"), F.col("hadm_id").alias("entity_id"), epoch_s("intime").alias("start_s"), epoch_s("outtime").alias("end_s"))
    hospital = admissions.select(F.lit("hospital").alias("scope"), F.col("subject_id").alias("entity_id"), epoch_s("admittime").alias("start_s"), epoch_s("dischtime").alias("end_s"))
    return icu.unionByName(hospital)
