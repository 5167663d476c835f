"""Items that appear together (problem 4): an incremental pair table.

A change of the input gives the baskets before and after it. Changed baskets emit signed deltas of pair
counts, item counts and the number of baskets; the deltas are combined inside each task, shuffled, and merged
into persistent counts that are hash-bucketed by pair. Only buckets with a delta are rewritten. Association
scores are kept too; those of the affected pairs are computed anew and put beside the former ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.sources.tables import shared_folder

#: Least number of buckets of the pair table and pairs of a bucket from which there are more; pairs that a task
#: holds before it combines them; items of a basket that one task takes as first of a pair; tables of scores
#: from which all are computed anew into one.
BUCKETS, BUCKET_PAIRS, HELD, FIRSTS, SCORE_TABLES = 8, 1 << 19, 1 << 21, 1024, 8

_COUNTS = "code_a string, code_b string, n bigint"
_PAIRS = _COUNTS + ", v bigint"
_ITEMS = "item string, n bigint"
_SCORES = "code_a string, code_b string, n_ab bigint, n_a bigint, n_b bigint, v bigint"


def code_baskets(diagnoses: DataFrame | None, procedures: DataFrame | None) -> DataFrame:
    """Rows (basket, item): codes in capitals without dot and blanks, 'd:' before diagnoses and 'p:' before
    procedures. Null and empty codes and null encounters are dropped; repeated rows stay."""
    parts = []
    for df, prefix in ((diagnoses, "d:"), (procedures, "p:")):
        if df is not None:
            code = F.upper(F.regexp_replace("icd9_code", "[.\\s\\u00A0]", ""))
            parts.append(df.select(F.col("hadm_id").alias("basket"), code.alias("code")).filter("basket is not null and code <> ''").select("basket", F.concat(F.lit(prefix), "code").alias("item")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def changed_baskets(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Baskets whose items differ: basket, items (sorted array of item, old, new), old and new as 0 or 1.

    Both inputs hold (basket, item), repeated rows count once; before may be None. A basket is an array of its
    distinct items, so its size is bounded by the number of items there are, however often they repeat.
    """
    marked = after.select("basket", "item", F.lit(0).alias("old"), F.lit(1).alias("new"))
    if before is not None:
        marked = marked.unionByName(before.select("basket", "item", F.lit(1).alias("old"), F.lit(0).alias("new")))
    return (
        marked.groupBy("basket", "item")
        .agg(F.max("old").alias("old"), F.max("new").alias("new"))
        .groupBy("basket")
        .agg(F.sort_array(F.collect_list(F.struct("item", "old", "new"))).alias("items"), F.max(F.abs(F.col("old") - F.col("new"))).alias("differs"))
        .filter("differs = 1")
        .drop("differs")
    )


def count_deltas(changed: DataFrame) -> DataFrame:
    """Signed deltas, combined in each task: code_a, code_b, n. Pairs have code_a < code_b; a null code_b stands
    for the count of an item, two nulls for the number of baskets.

    A basket of many items is spread: each task takes FIRSTS of its items as the first of a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("items")
            flat = lists.flatten()
            coded = flat.field("item").dictionary_encode()
            names = np.array(coded.dictionary.to_pylist(), object)
            order = np.argsort(names)
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            item = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
            old, new = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("old", "new"))
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            begin = b.column("begin").to_numpy()
            size = max(len(names), 1)
            sorted_names = pa.array(names[order], pa.string())
            keys, signs, held = [], [], 0

            def combined() -> pa.RecordBatch:
                key, at = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate(signs), minlength=len(key)).astype(np.int64)
                key, n = key[n != 0], n[n != 0]
                return pa.RecordBatch.from_arrays([sorted_names.take(pa.array(key // size)), sorted_names.take(pa.array(key % size)), pa.array(n)], ["code_a", "code_b", "n"])

            for s, e, at in zip(offsets[:-1], offsets[1:], begin):
                m = e - s
                last = min(m - 1, at + FIRSTS)
                for lo in range(at, last, max(1, HELD // max(m, 1))):  # rows of the pair triangle, in blocks
                    hi = min(last, lo + max(1, HELD // m))
                    i = np.repeat(np.arange(lo, hi), m - 1 - np.arange(lo, hi))
                    j = np.arange(len(i)) - np.repeat(np.cumsum(m - 1 - np.arange(lo, hi)) - (m - 1 - np.arange(lo, hi)), m - 1 - np.arange(lo, hi)) + i + 1
                    i, j = s + i, s + j
                    sign = new[i] * new[j] - old[i] * old[j]
                    keep = sign != 0
                    keys.append(item[i[keep]] * size + item[j[keep]])
                    signs.append(sign[keep])
                    held += int(keep.sum())
                    if held > HELD:
                        yield combined()
                        keys, signs, held = [], [], 0
            if held:
                yield combined()
            head = begin == 0  # a basket counts once for its items and the number of baskets
            own = np.repeat(head, np.diff(offsets))
            moved = np.bincount(item[own], weights=(new - old)[own], minlength=len(names)).astype(np.int64)
            at = np.flatnonzero(moved)
            starts = offsets[:-1][head]
            more = int((np.maximum.reduceat(new, offsets[:-1]) - np.maximum.reduceat(old, offsets[:-1]))[head].sum()) if len(starts) else 0
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([sorted_names.take(pa.array(at)), pa.nulls(1, pa.string())]), pa.nulls(len(at) + 1, pa.string()), pa.array(np.append(moved[at], more))], ["code_a", "code_b", "n"])

    usual = changed.filter(F.size("items") <= FIRSTS).select("items", F.lit(0).cast("long").alias("begin"))
    begins = F.sequence(F.lit(0).cast("long"), (F.size("items") - 1).cast("long"), F.lit(FIRSTS).cast("long"))
    large = changed.filter(F.size("items") > FIRSTS).select("basket", "items", F.explode(begins).alias("begin")).repartition("basket", "begin")
    return usual.unionByName(large.select("items", "begin")).mapInArrow(run, _COUNTS).groupBy("code_a", "code_b").agg(F.sum("n").alias("n")).filter("n <> 0")


class PairTable:
    """Persistent counts and scores in a shared folder: pairs by bucket, items, tables of scores, and a manifest
    of the current files, from which a later session goes on.

    Each update writes new files, then a new manifest, then removes what the manifest no longer names; a failed
    update leaves the former state whole. A DataFrame of the table must be used before the next update.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.least = spark, folder or shared_folder(spark), buckets
        self.version, self.buckets, self.files, self.items_path, self.score_paths = 0, buckets, {}, "", []
        fs, path = self._path(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        versions = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if versions:
            text = self.spark.read.text(f"{self.folder}/manifest-{max(versions)}.json").head()[0]
            m = json.loads(text)
            self.version, self.buckets, self.items_path, self.score_paths = m["version"], m["buckets"], m["items"], m["scores"]
            self.files = {int(k): p for k, p in m["files"].items()}

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _remove(self, names: list[str]) -> None:
        for name in names:
            fs, path = self._path(name)
            fs.delete(path, True)

    def _buckets_in(self, folder: str) -> list[int]:
        """Buckets that a partitioned table has, from the names of its folders."""
        fs, path = self._path(folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))

    def _bucket(self):
        return F.pmod(F.xxhash64("code_a", "code_b"), F.lit(self.buckets)).cast("int")

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read(_PAIRS, [p for b, p in sorted(self.files.items()) if buckets is None or b in buckets])

    def pairs(self) -> DataFrame:
        """Current pair counts: code_a, code_b, n."""
        return self._rows().filter("n <> 0").drop("v")

    def items(self) -> DataFrame:
        """Current item counts: item, n; the null item is the number of baskets."""
        return self._read(_ITEMS, [self.items_path] if self.items_path else [])

    def update(self, before: DataFrame | None, after: DataFrame) -> None:
        """Merge the change from ``before`` to ``after`` into the counts and compute the affected scores.

        Both hold (basket, item) rows without nulls, as code_baskets gives them; repeated rows count once; either
        may be empty, ``before`` may be None. Equal tables change nothing; a basket of one item counts only for its item.
        """
        v = self.version + 1
        root = f"{self.folder}/v{v}"
        count_deltas(changed_baskets(before, after)).write.parquet(f"{root}/deltas")
        deltas = self._read(_COUNTS, [f"{root}/deltas"])
        moved = deltas.filter("code_b is null").select(F.col("code_a").alias("item"), "n")
        self.items().unionByName(moved).groupBy("item").agg(F.sum("n").alias("n")).filter("n <> 0").write.parquet(f"{root}/items")
        needed = max(self.least, -(-deltas.filter("code_b is not null").count() // BUCKET_PAIRS))
        hit = None
        if not self.files or needed > 4 * self.buckets:  # the table is new or has grown: all buckets anew
            self.buckets = needed
        else:
            hit = [r[0] for r in deltas.filter("code_b is not null").select(self._bucket()).distinct().collect()]
        gone = [p for b, p in self.files.items() if hit is None or b in hit]
        now = F.lit(v).cast("long").alias("v")
        both = self._rows(hit).filter("n <> 0").unionByName(deltas.filter("code_b is not null").withColumn("v", now))
        merged = both.withColumn("bucket", self._bucket()).repartition("bucket").groupBy("bucket", "code_a", "code_b").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
        merged.write.partitionBy("bucket").parquet(f"{root}/pairs")
        files = {b: p for b, p in self.files.items() if p not in gone}
        files.update({b: f"{root}/pairs/bucket={b}" for b in self._buckets_in(f"{root}/pairs")})
        gone += [f"{root}/deltas", *([self.items_path] if self.items_path else [])]
        self.files, self.items_path = files, f"{root}/items"

        whole = len(self.score_paths) + 1 >= SCORE_TABLES
        rows = self._rows()
        if whole:
            gone += self.score_paths
            self.score_paths, rows = [], rows.filter("n <> 0")
        elif self.version:
            a, b = (moved.filter("item is not null").select(F.col("item").alias(c), F.lit(True).alias(f"m_{c}")) for c in ("code_a", "code_b"))
            rows = rows.join(a, "code_a", "left").join(b, "code_b", "left").filter((F.col("v") == v) | (F.col("n") != 0) & (F.col("m_code_a") | F.col("m_code_b")))
        named = self.items().filter("item is not null")
        a, b = (named.select(F.col("item").alias(f"code_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
        scored = rows.withColumnRenamed("n", "n_ab").join(a, "code_a", "left").join(b, "code_b", "left")
        scored.select("code_a", "code_b", "n_ab", "n_a", "n_b", now).write.parquet(f"{root}/scores")
        self.version, self.score_paths = v, [*self.score_paths, f"{root}/scores"]

        manifest = json.dumps({"version": v, "buckets": self.buckets, "files": {str(k): p for k, p in self.files.items()}, "items": self.items_path, "scores": self.score_paths})
        fs, path = self._path(f"{self.folder}/manifest-{v}.json")
        out = fs.create(path, True)
        out.write(bytearray(manifest, "utf-8"))
        out.close()
        self._remove([*gone, f"{self.folder}/manifest-{v - 1}.json"])

    def scores(self, least: int = 1, affected_only: bool = False) -> DataFrame:
        """Association of each pair with at least ``least`` common baskets: code_a, code_b, n_ab, n_a, n_b,
        total (number of baskets), lift (how many times chance).

        The counts come from the stored scores, the last one of each pair; the number of baskets, one factor of
        all lifts, from now. affected_only restricts to the pairs that the last update computed anew: their own
        count or an item's count changed, or all of them were.
        """
        stored = self._read(_SCORES, self.score_paths)
        if affected_only:
            stored = stored.filter(F.col("v") == self.version)
        elif len(self.score_paths) > 1:
            last = F.max(F.struct("v", "n_ab", "n_a", "n_b")).alias("s")
            stored = stored.groupBy("code_a", "code_b").agg(last).select("code_a", "code_b", "s.n_ab", "s.n_a", "s.n_b")
        total = self.items().filter("item is null").select(F.col("n").alias("total"))
        return (
            stored.filter(F.col("n_ab") >= max(1, least))
            .select("code_a", "code_b", "n_ab", "n_a", "n_b")
            .crossJoin(F.broadcast(total))  # one row
            .withColumn("lift", F.col("n_ab") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b")))
        )
