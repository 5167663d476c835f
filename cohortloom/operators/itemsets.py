"""Frequent item sets: (enc, item) transactions of few, general items (categories of a code tree)."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.ship import ship, shipped
from cohortloom.operators.stats import fisher_p

#: Candidates of several sizes that one pass counts, and of one size beyond which the library mines.
PASS, MOST = 20_000, 200_000


def transactions(items: DataFrame) -> DataFrame:
    """Distinct items of each encounter as a sorted list."""
    return items.select("enc", "item").na.drop().distinct().groupBy("enc").agg(F.sort_array(F.collect_list("item")).alias("items"))


def frequent(tx: DataFrame, support: float) -> DataFrame:
    """All item sets with at least the support: itemset (sorted), n."""
    m = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(tx.select("items"))
    return m.freqItemsets.select(F.sort_array("items").alias("itemset"), F.col("freq").alias("n"))


def maximal(sets: DataFrame) -> DataFrame:
    """Sets without a frequent strict superset. As every subset of a frequent set is frequent, a set is not
    maximal exactly if some set with one item more contains it: each set removes its own subsets with one item
    less, by an equi-join."""
    covered = sets.filter(F.size("itemset") > 1).select(F.explode("itemset").alias("x"), "itemset").select(F.expr("filter(itemset, i -> i <> x)").alias("itemset")).distinct()
    return sets.join(covered, "itemset", "left_anti")


def all_sets(tx: DataFrame, support: float, label: str, maximal_only: bool = True) -> DataFrame:
    """Sets of an analysis: the (maximal) frequent sets of the population and of each cluster, and every single
    item, once each. Clusters are few; each is mined by itself."""
    pick = maximal if maximal_only else (lambda sets: sets)
    out = pick(frequent(tx, support)).select("itemset").unionByName(tx.select(F.explode("items").alias("x")).distinct().select(F.array("x").alias("itemset")))
    for (lab,) in tx.select(label).na.drop().distinct().orderBy(label).limit(1001).collect():
        out = out.unionByName(pick(frequent(tx.filter(F.col(label) == lab), support)).select("itemset"))
    return out.distinct()


def support_counts(tx: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """Transactions per group that hold all items of a set. Sets are matched through their items: exploded
    items join exploded sets, and a set is held where all its items met."""
    keyed = sets.select("itemset").distinct().withColumn("k", F.size("itemset"))
    parts = keyed.select("itemset", "k", F.explode("itemset").alias("item"))
    rows = tx.select("enc", *by, F.explode("items").alias("item"))
    held = rows.join(parts, "item").groupBy("enc", *by, "itemset", "k").agg(F.count("*").alias("m")).filter("m = k")
    return held.groupBy(*by, "itemset").agg(F.count("*").alias("n"))


def item_bits(batch: pa.RecordBatch, items: pa.Array) -> np.ndarray:
    """A row of bits for each item: the transactions of the batch that hold it."""
    lists = batch.column("items")
    at = pc.index_in(lists.flatten(), value_set=items)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    held = np.zeros((len(items), batch.num_rows), bool)
    held[at.drop_null().to_numpy(), pc.list_parent_indices(lists).to_numpy()[known]] = True
    return np.packbits(held, axis=1)


def candidates(sets: list[tuple[int, ...]], most: int) -> list[tuple[int, ...]] | None:
    """Sets with one item more of which all subsets are given; None if more than ``most`` come into question."""
    given, last = set(sets), defaultdict(list)
    for s in sets:
        last[s[:-1]].append(s[-1])
    if sum(math.comb(len(ends), 2) for ends in last.values()) > most:
        return None
    pairs = ((*head, x, y) for head, ends in last.items() for x, y in combinations(sorted(ends), 2))
    return [s for s in pairs if all(s[:i] + s[i + 1 :] in given for i in range(len(s) - 2))]


def counted(tx: DataFrame, items: list[str], sets: list[tuple[int, ...]]) -> DataFrame:
    """Transactions that hold all items of a set: i (its place), n. The sets come as places in ``items``; each batch
    of transactions becomes bits of its items, so a set costs an AND of a few bytes, and nothing but counts is shuffled."""
    heads = defaultdict(list)
    for i, s in enumerate(sets):
        heads[s[:-1]].append((i, s[-1]))
    groups = [(list(h), np.array([i for i, _ in ends]), np.array([x for _, x in ends])) for h, ends in heads.items()]
    box = ship(tx.sparkSession.sparkContext, (items, groups, len(sets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, groups, size = shipped(box)
        n, names = np.zeros(size, np.int64), pa.array(items, pa.string())
        for b in batches:
            bits = item_bits(b, names)
            for head, places, ends in groups:
                both = bits[ends] & np.bitwise_and.reduce(bits[head], axis=0) if head else bits[ends]
                n[places] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["i", "n"])

    return tx.select("items").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n"))


def counted_by_label(tx: DataFrame, items: list[str], sets: list[tuple[int, ...]], label: str) -> DataFrame:
    """The same for each label: i, label, n where there are any."""
    box = ship(tx.sparkSession.sparkContext, (items, [list(s) for s in sets]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, sets = shipped(box)
        n, names, kind = {}, pa.array(items, pa.string()), None
        for b in batches:
            bits, labels, kind = item_bits(b, names), b.column(label).to_pylist(), b.column(label).type
            place = {x: k for k, x in enumerate(dict.fromkeys(labels))}
            own = np.packbits(np.array([place[x] for x in labels])[None, :] == np.arange(len(place))[:, None], axis=1)
            here = [np.bitwise_count(own & np.bitwise_and.reduce(bits[s], axis=0)).sum(axis=1, dtype=np.int64) for s in sets]
            for x, count in zip(place, np.array(here).T):
                n[x] = n.get(x, 0) + count
        for x, count in n.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([x] * len(at), kind), pa.array(count[at])], ["i", label, "n"])

    found = T.StructType([T.StructField("i", T.LongType()), tx.schema[label], T.StructField("n", T.LongType())])
    return tx.select("items", label).mapInArrow(run, found).groupBy("i", label).agg(F.sum("n").alias("n"))


def frequent_places(tx: DataFrame, items: list[str], least: int) -> list[tuple[int, ...]] | None:
    """All sets of the given (frequent) items that at least so many transactions hold, as places, by levels. A pass over
    the transactions counts the candidates of a size and, while they are few, those of the next sizes. None where a
    size has more than MOST candidates."""
    level = [(i,) for i in range(len(items))]
    found = list(level)
    while True:
        ask, step = [], candidates(level, MOST)
        if step is None:
            return None
        while step and len(ask) + len(step) <= (PASS if ask else MOST):
            ask += step
            step = candidates(step, PASS - len(ask)) if len(ask) < PASS else None
        if not ask:
            return found
        got = {ask[r.i] for r in counted(tx, items, ask).filter(F.col("n") >= least).collect()}
        found += sorted(got)
        level = sorted(s for s in got if len(s) == len(ask[-1]))


def maximal_inside(tx: DataFrame, n: int, support: float, label: str) -> DataFrame:
    """Maximal frequent sets of n transactions and how many of each label hold them: label, itemset (sorted), n where
    there are any. ``tx`` is read several times. Frequent items (at most the mean size of a transaction over the
    support) and candidates are known to the driver; where they are too many the library mines."""
    least = math.ceil(support * n)
    held = tx.select(F.explode("items").alias("x")).groupBy("x").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    items = sorted(r.x for r in held.collect())
    sets = frequent_places(tx, items, least)
    if sets is None:
        return support_counts(tx, maximal(frequent(tx, support)), [label])
    covered = {s[:i] + s[i + 1 :] for s in sets if len(s) > 1 for i in range(len(s))}
    sets = [s for s in sets if s not in covered]
    spark = tx.sparkSession
    if not sets:
        return spark.createDataFrame([], T.StructType([tx.schema[label], *T.StructType.fromDDL("itemset array<string>, n bigint").fields]))
    named = spark.createDataFrame([(i, [items[x] for x in s]) for i, s in enumerate(sets)], "i bigint, itemset array<string>")
    return counted_by_label(tx, items, sets, label).join(named, "i").select(label, "itemset", "n")


def enrichment(tx: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Support of each set in each cluster and in its complement, their ratio, and Fisher's two-sided p-value:
    label, itemset, support, complement_support, factor, p_value, significant (Bonferroni at 0.01). The
    complement's counts are the totals minus the cluster's."""
    size = tx.groupBy(label).agg(F.count("*").alias("size"))
    return tested(size, tx.agg(F.count("*").alias("n_all")), support_counts(tx, sets, [label]), label)


def tested(size: DataFrame, total: DataFrame, inside: DataFrame, label: str) -> DataFrame:
    """Enrichment from counts: transactions of each label (label, size) and in all (n_all), and those of each label that
    hold a set (label, itemset, n)."""
    everywhere = inside.groupBy("itemset").agg(F.sum("n").alias("n_set"))
    frame = everywhere.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(total))  # sets by clusters
    t = frame.join(inside, [label, "itemset"], "left").withColumn("a", F.coalesce("n", F.lit(0)))
    t = t.withColumn("b", F.col("size") - F.col("a")).withColumn("c", F.col("n_set") - F.col("a")).withColumn("d", F.col("n_all") - F.col("size") - F.col("c"))
    support, other = F.col("a") / F.col("size"), F.try_divide(F.col("c").cast("double"), (F.col("n_all") - F.col("size")).cast("double"))
    tests = frame.agg(F.count("*").alias("tests"))
    out = t.withColumn("support", support).withColumn("complement_support", other).withColumn("factor", F.try_divide("support", "complement_support")).withColumn("p_value", fisher_p("a", "b", "c", "d"))
    return out.crossJoin(F.broadcast(tests)).withColumn("significant", F.col("p_value") <= 0.01 / F.col("tests")).select(label, "itemset", "a", "b", "c", "d", "support", "complement_support", "factor", "p_value", "significant")


def itemset_text(col: str = "itemset"):
    """A single item as it is, more as (n) [a, b]; semicolons go."""
    joined = F.array_join(F.transform(col, lambda x: F.replace(x, F.lit(";"), F.lit(""))), ", ")
    return F.when(F.size(col) == 1, joined).otherwise(F.format_string("(%d) [%s]", F.size(col), joined))


def listing(enriched: DataFrame, label: str, default: int = 7, most: int = 20) -> DataFrame:
    """The sets to show per cluster, by support: the default number, extended to the last significant one."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(label).orderBy(F.desc("support"), F.col("itemset").cast("string"))
    p = enriched.withColumn("place", F.row_number().over(w))
    last = F.max(F.when(F.col("significant"), F.col("place"))).over(Window.partitionBy(label))
    return p.withColumn("_k", F.least(F.greatest(F.coalesce(last, F.lit(0)), F.lit(default)), F.lit(most))).filter("place <= _k").drop("_k")


def p_values(enriched: DataFrame) -> DataFrame:
    """All p-values of an analysis in one column."""
    return enriched.select("p_value").na.drop()


def permutation_null(tx: DataFrame, sets: DataFrame, label: str, times: int, seed: int) -> DataFrame:
    """P-values of the same analysis under shuffled cluster labels: rep_id, p_value. The number of repetitions
    is a parameter, each a part of the result."""
    from pyspark.sql.window import Window

    out = None
    for rep in range(times):
        keyed = tx.withColumn("_i", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("enc"), F.lit(64))).orderBy("enc"))).withColumn("_b", F.pmod(F.xxhash64("enc"), F.lit(64)))
        moved = tx.select("enc", F.col(label)).withColumn("_b", F.pmod(F.xxhash64("enc"), F.lit(64)))
        moved = moved.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64("enc", F.lit(seed + rep)), "enc"))).select("_b", "_i", F.col(label).alias("_label"))
        mixed = keyed.join(moved, ["_b", "_i"]).select("enc", "items", F.col("_label").alias(label))
        part = p_values(enrichment(mixed, sets, label)).withColumn("rep_id", F.lit(rep))
        out = part if out is None else out.unionByName(part)
    return out
