"""Agreement of labelings, from their contingency table. Labelings: (id, a, b); the table is bounded by the
number of labels."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.operators.stats import Hypergeometric


def contingency(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    return labels.groupBy(*(by or []), "a", "b").agg(F.count("*").alias("n"))


def _pairs(c):
    return c * (c - 1) / 2.0


def rand_index(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index; 1 where both labelings are one cluster or all singletons."""
    by = by or []
    cells = table.groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("sab"), F.sum("n").alias("total"))
    a = table.groupBy(*by, "a").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("sa"))
    b = table.groupBy(*by, "b").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("sb"))
    j = cells.join(a, by).join(b, by) if by else cells.crossJoin(a).crossJoin(b)  # one row each
    expected = F.col("sa") * F.col("sb") / F.nullif(_pairs(F.col("total")), F.lit(0.0))
    return j.select(*by, F.coalesce((F.col("sab") - expected) / F.nullif((F.col("sa") + F.col("sb")) / 2 - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def jaccard(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Label-agnostic Jaccard score: each label meets its most common partner; weight times intersection over
    union is intersection over all points, so the score is a purity; the smaller direction counts."""
    by = by or []
    total = table.groupBy(*by).agg(F.sum("n").alias("total"))
    a = table.groupBy(*by, "a").agg(F.max("n").alias("m")).groupBy(*by).agg(F.sum("m").alias("ma"))
    b = table.groupBy(*by, "b").agg(F.max("n").alias("m")).groupBy(*by).agg(F.sum("m").alias("mb"))
    j = total.join(a, by).join(b, by) if by else total.crossJoin(a).crossJoin(b)
    return j.select(*by, (F.least("ma", "mb") / F.col("total")).alias("jaccard"))


def adjusted_mutual_info(cells: list[tuple[int, int, int]]) -> float:
    """Adjusted mutual information of a contingency table (a, b, n), arithmetic mean of the entropies. The work
    grows with the number of labels and the root of the number of points."""
    rows, cols, total = sums_of(cells)
    if len(rows) == len(cols) and len(rows) in (0, 1, total):
        return 1.0
    h = lambda c: -sum(n / total * math.log(n / total) for n in c.values() if n)
    mi = sum(n / total * math.log(n * total / (rows[a] * cols[b])) for a, b, n in cells if n)
    expected = 0.0
    for (x, y), times in Counter((x, y) for x in rows.values() for y in cols.values()).items():
        table = Hypergeometric(x, y, total)
        n = table.likely(1)
        expected += times * float((n / total * np.log(total * n / (x * y)) * np.exp(table.log_p(n))).sum())
    mean = (h(rows) + h(cols)) / 2
    gap = mean - expected
    gap = min(gap, -1e-15) if gap < 0 else max(gap, 1e-15)
    return (mi - expected) / gap


def mutual_information(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adjusted mutual information of each group's table; a group has at most labels times labels rows."""
    by = by or []
    keyed = table.withColumn("_one", F.lit(0)) if not by else table
    keys = by or ["_one"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ami = adjusted_mutual_info([(int(a), int(b), int(n)) for a, b, n in zip(pdf["a"], pdf["b"], pdf["n"])])
        return pdf[keys].head(1).assign(ami=ami)

    types = dict(keyed.dtypes)
    out = keyed.groupBy(*keys).applyInPandas(work, ", ".join(f"{k} {types[k]}" for k in keys) + ", ami double")
    return out.select(*by, "ami")


def sums_of(cells: list[tuple[int, int, int]]) -> tuple[dict[int, int], dict[int, int], int]:
    """Row sums, column sums and total of a contingency table."""
    rows: dict[int, int] = {}
    cols: dict[int, int] = {}
    for a, b, n in cells:
        rows[a] = rows.get(a, 0) + n
        cols[b] = cols.get(b, 0) + n
    return rows, cols, sum(rows.values())


def rand_of(cells: list[tuple[int, int, int]]) -> float:
    """Adjusted Rand index of a contingency table."""
    rows, cols, total = sums_of(cells)
    two = lambda counts: sum(n * (n - 1) / 2 for n in counts)
    sa, sb, sab = two(rows.values()), two(cols.values()), two(n for _, _, n in cells)
    expected = sa * sb / two([total]) if total > 1 else 0.0
    gap = (sa + sb) / 2 - expected
    return (sab - expected) / gap if gap else 1.0


def jaccard_of(cells: list[tuple[int, int, int]]) -> float:
    """Label-agnostic Jaccard score of a contingency table."""
    best_a: dict[int, int] = {}
    best_b: dict[int, int] = {}
    for a, b, n in cells:
        best_a[a], best_b[b] = max(best_a.get(a, 0), n), max(best_b.get(b, 0), n)
    return min(sum(best_a.values()), sum(best_b.values())) / sum(n for _, _, n in cells)


#: Registry of agreement measures that robustness uses: name to a function of the cells of a contingency table.
#: Entries can be added or replaced.
MEASURES = {"mutual_info": adjusted_mutual_info, "rand": rand_of, "jaccard": jaccard_of}


def all_measures(table: DataFrame, by: list[str]) -> DataFrame:
    """Every measure of the registry of each group's contingency table in one pass: by..., metric, score. A
    group has at most labels times labels rows."""
    measures = dict(MEASURES)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = [(int(a), int(b), int(n)) for a, b, n in zip(pdf["a"], pdf["b"], pdf["n"])]
        m = {name: f(cells) for name, f in measures.items()}
        keys = pdf[by].iloc[[0] * len(m)].reset_index(drop=True)
        return keys.assign(metric=list(m), score=[float(v) for v in m.values()])

    types = dict(table.dtypes)
    return table.groupBy(*by).applyInPandas(work, ", ".join(f"{k} {types[k]}" for k in by) + ", metric string, score double")


def label_quality(labels: DataFrame, clustering: str = "clustering_id") -> DataFrame:
    """Counts of a labeling: clusters, effective clusters (exponential of the entropy), trivial (one label),
    pseudo-trivial (one label has more than nine tenths)."""
    n = labels.groupBy(clustering, "label").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(clustering)))
    return p.groupBy(clustering).agg(
        F.count("*").alias("k"),
        F.exp(-F.sum(F.col("p") * F.ln("p"))).alias("k_effective"),
        (F.count("*") < 2).alias("trivial"),
        (F.max("p") > 0.9).alias("pseudo_trivial"),
    )


def lineage(labels: DataFrame) -> DataFrame:
    """Share of each label in every label of coarser clusterings. labels: id, clustering_id, k, label."""
    child = labels.select("id", F.col("clustering_id").alias("child_id"), F.col("k").alias("child_k"), F.col("label").alias("child"))
    parent = labels.select("id", F.col("clustering_id").alias("parent_id"), F.col("k").alias("parent_k"), F.col("label").alias("parent"))
    n = child.join(parent, "id").filter("parent_k < child_k").groupBy("child_id", "child", "parent_id", "parent").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("child_id", "child", "parent_id")))


def flow(labels: DataFrame) -> DataFrame:
    """Points moving between the labels of neighbouring clusterings (by rank): rank, label, next_label, n."""
    a = labels.select("id", "rank", "label")
    b = labels.select("id", (F.col("rank") - 1).alias("rank"), F.col("label").alias("next_label"))
    return a.join(b, ["id", "rank"]).groupBy("rank", "label", "next_label").agg(F.count("*").alias("n"))


def run_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every clustering of one run against every one of another (id, clustering_id, label): left_id, right_id,
    ami, ari, jaccard, sim_score (their mean); null where the numbers of points differ. The pairs come from
    the equi-join on the points, so no product is formed."""
    size = lambda d, n: d.groupBy("clustering_id").agg(F.count("*").alias(n))
    l = left.join(size(left, "n_left"), "clustering_id").select("id", F.col("clustering_id").alias("left_id"), F.col("label").alias("a"), "n_left")
    r = right.join(size(right, "n_right"), "clustering_id").select("id", F.col("clustering_id").alias("right_id"), F.col("label").alias("b"), "n_right")
    pairs = l.join(r, "id")
    by = ["left_id", "right_id"]
    t = contingency(pairs.filter("n_left = n_right"), by)
    all_pairs = pairs.select(*by).distinct()
    scores = rand_index(t, by).join(jaccard(t, by), by).join(mutual_information(t, by), by)
    return all_pairs.join(scores, by, "left").withColumn("sim_score", (F.col("ami") + F.col("ari") + F.col("jaccard")) / 3)


def pairwise_similarity(labels: DataFrame) -> DataFrame:
    """Every two clusterings of one table (id, clustering_id, label): left_id < right_id, ami, ari, jaccard,
    sim_score. The pairs come from the equi-join on the points."""
    l = labels.select("id", F.col("clustering_id").alias("left_id"), F.col("label").alias("a"))
    r = labels.select("id", F.col("clustering_id").alias("right_id"), F.col("label").alias("b"))
    by = ["left_id", "right_id"]
    t = contingency(l.join(r, "id").filter("left_id < right_id"), by)
    out = rand_index(t, by).join(jaccard(t, by), by).join(mutual_information(t, by), by)
    return out.withColumn("sim_score", (F.col("ami") + F.col("ari") + F.col("jaccard")) / 3)


def triple_similarity(pairs: DataFrame) -> DataFrame:
    """Mean score of every three clusterings over their three pairs: first, second, third, sim_score."""
    ab = pairs.select(F.col("left_id").alias("first"), F.col("right_id").alias("second"), F.col("sim_score").alias("x"))
    bc = pairs.select(F.col("left_id").alias("second"), F.col("right_id").alias("third"), F.col("sim_score").alias("y"))
    ac = pairs.select(F.col("left_id").alias("first"), F.col("right_id").alias("third"), F.col("sim_score").alias("z"))
    return ab.join(bc, "second").join(ac, ["first", "third"]).select("first", "second", "third", ((F.col("x") + F.col("y") + F.col("z")) / 3).alias("sim_score"))


def robustness_by_option(scores: DataFrame, quality: DataFrame) -> DataFrame:
    """Robustness measurements by algorithm and option value with the effective cluster count. A clustering id
    is algorithm and option joined by an underscore."""
    parts = F.split("clustering_id", "_")
    return scores.join(quality.select("clustering_id", "k_effective"), "clustering_id").select(parts[0].alias("algorithm"), parts[1].cast("int").alias("option"), "metric", "threshold", "actual", "k_effective")
