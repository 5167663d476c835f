"""Attribute-value rows into wide tables with typed columns (problem 3).

Equal values of a cell (entity, moment, attribute) are merged in the JVM first, with a map-side combine, so
repeated deliveries never meet in one task. Entities (encounter and moment) are then hash-bucketed; in a
bucket the entities and attributes are dictionary-encoded, values are scattered by row and column index into
one NumPy array per type, and the arrays leave as Arrow columns. A value that meets another one in its place
marks the cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.grouped import change_points
from cohortloom.sources.tables import BLANKS, reading

#: Most attributes of one wide table (a longer dictionary needs several tables or the long form), and cells of
#: the arrays that a task holds at a time.
MAX_ATTRIBUTES, CELLS = 5_000, 1 << 21


def item_types(chartevents: DataFrame, d_items: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """The attribute dictionary: itemid and is_text, a local table of at most MAX_ATTRIBUTES rows.

    param_type decides; for items without one, or not in d_items, their own rows do: an item is text unless at
    least as many of its rows have a number in valuenum as have only a text in value. Items of d_items with a
    type belong to the dictionary whether or not they have rows, so only the others' rows are looked at. Items
    of ``skip`` are left out. A longer dictionary is refused, so what is sent to all tasks is bounded.
    """

    def bounded(df: DataFrame) -> list:
        rows = df.limit(MAX_ATTRIBUTES + 1).collect()
        if len(rows) > MAX_ATTRIBUTES:
            raise ValueError(f"more than {MAX_ATTRIBUTES} attributes: pivot a subset or stay with the long form")
        return rows

    left_out = {r[0] for r in bounded(skip.select("itemid").na.drop().distinct())} if skip is not None else set()
    kinds = bounded(d_items.filter("itemid is not null").groupBy("itemid").agg(F.max(F.lower("param_type")).alias("kind")).filter("kind in ('text', 'numeric')"))
    known = {r[0]: r[1] == "text" for r in kinds if r[0] not in left_out}
    own = (
        chartevents.select("itemid", "valuenum", "value")
        .filter(~F.col("itemid").isin(sorted({*known, *left_out})))
        .groupBy("itemid")
        .agg(F.count(F.when(F.col("valuenum").isNotNull() & ~F.isnan("valuenum"), 1)).alias("numbers"), F.count(F.when(F.col("valuenum").isNull() & (F.trim("value") != ""), 1)).alias("texts"))
        .filter("itemid is not null")
    )
    found = {r[0]: r[1] for r in bounded(own.select("itemid", F.col("numbers") < F.col("texts")))}
    rows = sorted({**found, **known}.items())
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes: pivot a subset or stay with the long form")
    return chartevents.sparkSession.createDataFrame(rows, "itemid bigint, is_text boolean")


def cell_values(chartevents: DataFrame, types: DataFrame) -> DataFrame:
    """The different values of each cell: hadm_id, charttime, itemid, number, word, n (rows that have the value),
    stored (the last storetime of a word).

    Words are without outer blanks and in lower case. Rows without a value and rows with a null in hadm_id,
    itemid or charttime do not count.
    """
    rows = chartevents.select("hadm_id", "charttime", "itemid", "storetime", "valuenum", "value").filter("hadm_id is not null and charttime is not null")
    text = F.lower(F.regexp_replace("value", f"^{BLANKS}+|{BLANKS}+$", ""))
    return (
        rows.join(F.broadcast(types), "itemid")  # at most MAX_ATTRIBUTES rows
        .select("hadm_id", "charttime", "itemid", F.when(~F.col("is_text"), reading()).alias("number"), F.when(F.col("is_text"), text).alias("word"), F.when(F.col("is_text"), F.col("storetime")).alias("storetime"))
        .filter("number is not null or word <> ''")
        .groupBy("hadm_id", "charttime", "itemid", "number", "word")
        .agg(F.count("*").alias("n"), F.max("storetime").alias("stored"))
    )


@dataclass
class _Rows:
    """Wide rows: encounter and moment of each, and by attribute and row the number, the word and the mark.
    total and count belong to the numbers of the last row."""

    hadm: np.ndarray
    moment: np.ndarray
    number: np.ndarray
    word: np.ndarray
    marks: np.ndarray
    total: np.ndarray
    count: np.ndarray

    def part(self, a: int, b: int | None) -> _Rows:
        return _Rows(self.hadm[a:b], self.moment[a:b], *(m[:, a:b] for m in (self.number, self.word, self.marks)), self.total, self.count)


def _scatter(b: pa.RecordBatch, items: np.ndarray, text: np.ndarray, open_: _Rows | None) -> _Rows:
    """Scatter the values of a slice of a bucket, in order of encounter, moment and storetime. ``open_`` is the
    last row of the slice before, which goes on if this slice begins with the same encounter and moment."""
    hadm, moment, item = (b.column(c).to_numpy() for c in ("hadm_id", "charttime_us", "itemid"))
    first = change_points([hadm, moment])
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hadm))))
    col = np.searchsorted(items, item)
    place = np.zeros(len(items), np.int64)
    place[~text], place[text] = np.arange((~text).sum()), np.arange(text.sum())
    word_row = text[col]
    n_num, n_text, width = int((~text).sum()), int(text.sum()), len(first)
    out = _Rows(hadm[first], moment[first], np.full((n_num, width), np.nan), np.full((n_text, width), None, object), np.zeros((len(items), width), bool), np.zeros(n_num), np.zeros(n_num))
    goes_on = open_ is not None and (hadm[0], moment[0]) == (open_.hadm[0], open_.moment[0])
    r, c, full = row[~word_row], place[col[~word_row]], col[~word_row]
    wr, wc, wfull = row[word_row], place[col[word_row]], col[word_row]
    x = b.column("number").to_numpy(zero_copy_only=False)[~word_row]
    n = b.column("n").to_numpy()[~word_row]
    w = b.column("word").to_numpy(zero_copy_only=False)[word_row]
    if goes_on:
        out.number[:, 0], out.word[:, 0], out.marks[:, 0] = open_.number[:, 0], open_.word[:, 0], open_.marks[:, 0]
        there = out.number[c, r]
        hit = ~np.isnan(there) & (there != x)
        out.marks[full[hit], r[hit]] = True
        hit = np.array([a is not None and a != v for a, v in zip(out.word[wc, wr], w)], bool)
        out.marks[wfull[hit], wr[hit]] = True
    out.number[c, r] = x
    out.word[wc, wr] = w
    hit = out.number[c, r] != x
    out.marks[full[hit], r[hit]] = True
    hit = out.word[wc, wr] != w
    out.marks[wfull[hit], wr[hit]] = True
    # Only marked cells need a mean, and only the last row may go on.
    many = out.marks[full, r]
    cells, at = np.unique(c[many] * width + r[many], return_inverse=True)
    out.number.flat[cells] = np.bincount(at, (x * n)[many]) / np.bincount(at, n[many])

    def sums(of: int) -> tuple[np.ndarray, np.ndarray]:
        there = r == of
        return np.bincount(c[there], (x * n)[there], n_num), np.bincount(c[there], n[there], n_num)

    if goes_on:
        total, count = sums(0)
        total, count = total + open_.total, count + open_.count
        marked = out.marks[~text, 0]
        out.number[marked, 0] = total[marked] / count[marked]
    out.total, out.count = (total, count) if goes_on and width == 1 else sums(width - 1)
    return out


def _bucketed(values: DataFrame, types: DataFrame, work: Callable[[_Rows], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on all rows of all buckets. A slice of the sorted bucket is scattered at a time; its last row
    stays open, so memory is bounded whatever the number of values of a moment."""
    items, text = dictionary(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(items)))
        open_: _Rows | None = None
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                rows = _scatter(whole.slice(at, step), items, text, open_)
                if open_ is not None and (open_.hadm[0], open_.moment[0]) != (rows.hadm[0], rows.moment[0]):
                    yield work(open_)
                if len(rows.hadm) > 1:
                    yield work(rows.part(0, -1))
                open_ = rows.part(-1 + len(rows.hadm), None)
        if open_ is not None:
            yield work(open_)

    keyed = values.withColumn("charttime_us", F.unix_micros(F.col("charttime").cast("timestamp"))).drop("charttime")
    return keyed.repartition("hadm_id", "charttime_us").sortWithinPartitions("hadm_id", "charttime_us", "stored", "word").mapInArrow(run, schema)


def dictionary(types: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Item ids in order and whether each is text, from the local table of item_types."""
    rows = sorted(types.collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], bool)


def wide_table(values: DataFrame, types: DataFrame) -> DataFrame:
    """One row per hadm_id and charttime with a column for each attribute: n_<itemid> double for numbers,
    t_<itemid> string for words, and differing, the item ids whose cell had different values.

    The agreed number is the mean of the readings; the agreed word is the one stored last (the later in the
    alphabet at equal times). An attribute without a cell at that moment is null; no values give no rows.
    """
    items, text = dictionary(types)
    names = [*(f"n_{i}" for i in items[~text]), *(f"t_{i}" for i in items[text])]

    def work(rows: _Rows) -> pa.RecordBatch:
        columns = [pa.array(rows.hadm), pa.array(rows.moment)]
        columns += [pa.array(c, from_pandas=True) for c in rows.number] + [pa.array(c, pa.string()) for c in rows.word]
        row, col = np.nonzero(rows.marks.T)
        offsets = np.searchsorted(row, np.arange(len(rows.hadm) + 1)).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(items[col])))
        return pa.RecordBatch.from_arrays(columns, names=["hadm_id", "charttime_us", *names, "differing"])

    schema = ["hadm_id bigint", "charttime_us bigint", *(f"{n} {'double' if n[0] == 'n' else 'string'}" for n in names), "differing array<bigint>"]
    return _bucketed(values, types, work, ", ".join(schema)).withColumn("charttime", F.timestamp_micros("charttime_us").cast("timestamp_ntz")).drop("charttime_us")


def number_cells(values: DataFrame, types: DataFrame) -> DataFrame:
    """The cells with a number in the long form: hadm_id, itemid, charttime_s, number, differs."""
    items, text = dictionary(types)
    numeric = items[~text]

    def work(rows: _Rows) -> pa.RecordBatch:
        col, row = np.nonzero(~np.isnan(rows.number))
        cols = [rows.hadm[row], numeric[col], rows.moment[row] // 1_000_000, rows.number[col, row], rows.marks[~text][col, row]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["hadm_id", "itemid", "charttime_s", "number", "differs"])

    return _bucketed(values.filter("number is not null"), types, work, "hadm_id bigint, itemid bigint, charttime_s bigint, number double, differs boolean")


def differing_cells(values: DataFrame, types: DataFrame) -> DataFrame:
    """The cells that the scatter marked: hadm_id, itemid, charttime_s. The same buckets and scatter as
    wide_table, but only the marks leave the task."""
    items, _ = dictionary(types)

    def work(rows: _Rows) -> pa.RecordBatch:
        col, row = np.nonzero(rows.marks)
        return pa.RecordBatch.from_arrays([pa.array(rows.hadm[row]), pa.array(items[col]), pa.array(rows.moment[row] // 1_000_000)], ["hadm_id", "itemid", "charttime_s"])

    return _bucketed(values, types, work, "hadm_id bigint, itemid bigint, charttime_s bigint")
