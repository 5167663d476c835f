"""Clustering sweep, robustness and selection over feature vectors (id, features array<double>).

k-medoids, centroid linkage and density clustering need all distances, which grow with the square of the
points; they refuse more than MAX_POINTS points, whose matrix is then small enough to send to every task. Each
run of the sweep is a task of its own. k-means has no such bound, nor have silhouette and neighbour counts, which
work in pairs of blocks. Agreement and selection are aggregates over
long tables of labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.spread import running_total
from cohortloom.operators import similarity as A
from cohortloom.sources.tables import shared_folder

MAX_POINTS = 5_000
#: points of a block where distances are worked in pairs of blocks.
BLOCK = 2_048

_LABELS = "clustering_id string, k int, id bigint, label int"


def matrix(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix on the driver, ordered by id; refused beyond MAX_POINTS."""
    rows = features.select("id", "features").orderBy("id").limit(MAX_POINTS + 1).collect()
    if len(rows) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points: use kmeans, or cluster a sample and assign the rest")
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)


def distances(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def kmedoids_labels(d: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Alternating k-medoids with a deterministic start: the most central point, then the farthest ones."""
    medoids = [int(d.sum(1).argmin())]
    while len(medoids) < k:
        medoids.append(int(d[:, medoids].min(1).argmax()))
    medoids = np.array(medoids)
    for _ in range(rounds):
        label = d[:, medoids].argmin(1)
        new = medoids.copy()
        for c in range(k):
            at = np.flatnonzero(label == c)
            if len(at):
                new[c] = at[d[np.ix_(at, at)].sum(1).argmin()]
        if (new == medoids).all():
            break
        medoids = new
    return d[:, medoids].argmin(1)


def centroid_linkage(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, height) by centroid linkage; clusters from n on are merges. Squared distances
    are updated by the Lance-Williams rule; heights may fall (inversions)."""
    n = len(x)
    d = distances(x) ** 2
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    name = np.arange(n)
    out = []
    nearest = d.argmin(1)
    best = d[np.arange(n), nearest]
    live = np.ones(n, bool)
    for step in range(n - 1):
        i = int(best.argmin())
        j = int(nearest[i])
        out.append((int(name[i]), int(name[j]), float(np.sqrt(max(d[i, j], 0)))))
        a, b = size[i], size[j]
        row = (a * d[i] + b * d[j]) / (a + b) - a * b * d[i, j] / (a + b) ** 2
        row[i] = row[j] = np.inf
        row[~live] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        live[j], best[j] = False, np.inf
        size[i], name[i] = a + b, n + step
        nearest[i], best[i] = int(row.argmin()), row.min()
        stale = live & ((nearest == i) | (nearest == j))
        stale[i] = False
        for r in np.flatnonzero(stale):
            nearest[r], best[r] = int(d[r].argmin()), d[r].min()
        closer = live & (row < best)
        nearest[closer], best[closer] = i, row[closer]
    return out


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels from 1 of the tree's k clusters: the first n - k merges are applied."""
    parent = list(range(2 * n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for step, (a, b, _) in enumerate(merges[: n - k]):
        parent[root(a)] = parent[root(b)] = n + step
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(v), len(seen) + 1) for v in range(n)])


def density_labels(d: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Density clustering: core points with at least ``least`` neighbours within eps join; -1 is noise."""
    near = d <= eps
    core = near.sum(1) >= least
    label = np.full(len(d), -1)
    c = 0
    for s in range(len(d)):
        if not core[s] or label[s] >= 0:
            continue
        stack = [s]
        label[s] = c
        while stack:
            p = stack.pop()
            for q in np.flatnonzero(near[p] & (label < 0)):
                label[q] = c
                if core[q]:
                    stack.append(int(q))
        c += 1
    return label


def cluster_range(n: int) -> list[int]:
    return list(range(2, int(min(40, n // 2)) + 1))


def sweep(features: DataFrame, algorithm: str, ks: list[int] | None = None, **options) -> DataFrame:
    """Labels of every clustering of a sweep: clustering_id, k, id, label. The runs are spread over tasks."""
    ids, x = matrix(features)
    spark = features.sparkSession
    shared = spark.sparkContext.broadcast((ids, x))
    ks = ks or cluster_range(len(ids))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = shared.value
        d = None
        merges = None
        for f in frames:
            for k in f["k"].tolist():
                if algorithm == "hierarchical":
                    merges = merges or centroid_linkage(x)
                    label = cut(merges, len(x), k)
                else:
                    d = distances(x) if d is None else d
                    label = kmedoids_labels(d, k) if algorithm == "kmedoids" else density_labels(d, options["eps"], k)
                yield pd.DataFrame({"clustering_id": f"{algorithm}_{k}", "k": k, "id": ids, "label": label})

    parts = 1 if algorithm == "hierarchical" else len(ks)
    return spark.createDataFrame([(k,) for k in ks], "k int").repartition(parts).mapInPandas(run, _LABELS)


def sweep_boots(features: DataFrame, members: DataFrame, algorithm: str, ks: list[int] | None = None) -> DataFrame:
    """The sweep on every bootstrap: boot_id, clustering_id, k, id, label. members holds boot_id and id; with at
    most MAX_POINTS points its lists are small. Each bootstrap and k is a task; with hierarchical clustering each
    bootstrap is, as all k are cuts of one tree. Without ks, the range is that of all points."""
    ids, x = matrix(features)
    at = {i: n for n, i in enumerate(ids.tolist())}
    boots = {r[0]: sorted(at[i] for i in r[1]) for r in members.groupBy("boot_id").agg(F.collect_list("id")).collect()}
    spark = features.sparkSession
    shared = spark.sparkContext.broadcast((ids, x, boots))
    ks = ks or cluster_range(len(ids))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x, boots = shared.value
        for f in frames:
            for b, some in zip(f["boot_id"].tolist(), f["ks"].tolist()):
                rows = np.array(boots[b])
                made = centroid_linkage(x[rows]) if algorithm == "hierarchical" else distances(x[rows])
                for k in some:
                    label = cut(made, len(rows), k) if algorithm == "hierarchical" else kmedoids_labels(made, k)
                    yield pd.DataFrame({"boot_id": b, "clustering_id": f"{algorithm}_{k}", "k": k, "id": ids[rows], "label": label})

    tasks = [(b, s) for b in sorted(boots) for s in ([ks] if algorithm == "hierarchical" else [[k] for k in ks])]
    return spark.createDataFrame(tasks, "boot_id int, ks array<int>").repartition(max(1, len(tasks))).mapInPandas(run, "boot_id int, " + _LABELS)


def kmeans(features: DataFrame, ks: list[int], seed: int = 1) -> DataFrame:
    """k-means labels for each k, for any number of points."""
    v = features.select("id", array_to_vector("features").alias("v"))
    out = None
    for k in ks:
        part = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="label").fit(v).transform(v).select(F.lit(f"kmeans_{k}").alias("clustering_id"), F.lit(k).alias("k"), "id", "label")
        out = part if out is None else out.unionByName(part)
    return out


def technical_quality(features: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Calinski-Harabasz and negative Davies-Bouldin scores of one labeling, from centroids: one row."""
    x = features.join(labels.select("id", label), "id").select(label, F.posexplode("features").alias("dim", "v"), "id")
    cent = x.groupBy(label, "dim").agg(F.avg("v").alias("c"), F.count("*").alias("n"))
    allc = x.groupBy("dim").agg(F.avg("v").alias("g"))
    between = cent.join(allc, "dim").agg(F.sum(F.col("n") * F.pow(F.col("c") - F.col("g"), 2)).alias("between"))
    dist = x.join(F.broadcast(cent.select(label, "dim", "c")), [label, "dim"]).groupBy(label, "id").agg(F.sum(F.pow(F.col("v") - F.col("c"), 2)).alias("sq"))
    within = dist.agg(F.sum("sq").alias("within"), F.count("*").alias("n"), F.countDistinct(label).alias("k"))
    spread = dist.groupBy(label).agg(F.avg(F.sqrt("sq")).alias("s"))
    a, b = (cent.select(F.col(label).alias(f"{s}_l"), "dim", F.col("c").alias(f"{s}_c")) for s in "ab")
    gap = a.join(b, "dim").filter("a_l <> b_l").groupBy("a_l", "b_l").agg(F.sqrt(F.sum(F.pow(F.col("a_c") - F.col("b_c"), 2))).alias("m"))
    worst = (
        gap.join(spread.select(F.col(label).alias("a_l"), F.col("s").alias("sa")), "a_l")
        .join(spread.select(F.col(label).alias("b_l"), F.col("s").alias("sb")), "b_l")
        .groupBy("a_l")
        .agg(F.max((F.col("sa") + F.col("sb")) / F.col("m")).alias("r"))
        .agg((-F.avg("r")).alias("davies_bouldin"))
    )
    ch = F.col("between") * (F.col("n") - F.col("k")) / (F.col("within") * (F.col("k") - 1))
    return between.crossJoin(within).crossJoin(worst).select(ch.alias("calinski_harabasz"), "davies_bouldin")  # one row each


def _cells(points: DataFrame) -> DataFrame:
    """Unordered pairs of blocks of points (id, features, ...) as groups i, j (i <= j), each row with its side; a
    block has about BLOCK points, by a hash of the id."""
    g = max(1, -(-points.count() // BLOCK))
    p = points.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(g)).cast("int"))
    left = p.withColumn("j", F.explode(F.sequence("i", F.lit(g - 1)))).withColumn("side", F.lit(0))
    right = p.withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j")))).withColumn("side", F.lit(1))
    return left.unionByName(right)


def _strips(f: pd.DataFrame, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of a cell's rows in f and their distances to the columns: rows, columns, distances, in strips."""
    x = np.array(f["features"].tolist(), float)
    sq, ids, side = (x * x).sum(1), f["id"].to_numpy(), f["side"].to_numpy()
    at, to = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for k in range(0, len(at), step):
        r = at[k : k + step]
        d = np.sqrt(np.maximum(sq[r][:, None] + sq[to][None, :] - 2 * x[r] @ x[to].T, 0))
        d[ids[r][:, None] == ids[to][None, :]] = 0
        yield r, to, d


def silhouette(features: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Mean silhouette with Euclidean distances, for any number of points: distances of each pair of blocks are
    summed per point and label in a task of its own; -1 where there is only one cluster or every point is its
    own."""
    points = features.select("id", "features").join(labels.select("id", F.col(label).alias("_y")), "id")
    sizes = points.groupBy("_y").agg(F.count("*").alias("_n"))
    k, n = sizes.agg(F.count("*"), F.sum("_n")).head()
    if n is None or not 1 < k < n:
        return features.sparkSession.createDataFrame([(-1.0,)], "silhouette double")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, same = f["id"].to_numpy(), f["i"].iat[0] == f["j"].iat[0]
        names, y = np.unique(f["_y"].to_numpy(), return_inverse=True)
        one, out, back = np.eye(len(names)), [], 0.0

        def rows(at: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"id": np.repeat(ids[at], len(names)), "other": np.tile(names, len(at)), "s": sums.ravel()})

        to = np.flatnonzero(f["side"].to_numpy() == 1)
        for r, to, d in _strips(f):
            out.append(rows(r, d @ one[y[to]]))
            back = back + d.T @ one[y[r]]
        if not same and len(out) and len(to):
            out.append(rows(to, back))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "s": []})

    kind = dict(points.dtypes)
    schema = f"id {kind['id']}, other {kind['_y']}, s double"
    sums = _cells(points).groupBy("i", "j").applyInPandas(run, schema).groupBy("id", "other").agg(F.sum("s").alias("s"))
    met = sums.join(sizes.withColumnRenamed("_y", "other"), "other").join(points.select("id", "_y"), "id")
    own = F.col("other") == F.col("_y")
    near = met.groupBy("id").agg(
        F.max(F.when(own, F.col("_n"))).alias("_n"),
        F.max(F.when(own, F.col("s") / F.greatest(F.col("_n") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~own, F.col("s") / F.col("_n"))).alias("b"),
    )
    s = F.when(F.col("_n") > 1, F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).otherwise(0.0)
    return near.agg(F.avg(s).alias("silhouette"))


def neighbour_counts(features: DataFrame, eps: float) -> DataFrame:
    """Points within eps of each point, itself included, for any number of points: id, neighbours."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, same = f["id"].to_numpy(), f["i"].iat[0] == f["j"].iat[0]
        out, back, to = [], 0, None
        for r, to, d in _strips(f):
            near = d <= eps
            out.append(pd.DataFrame({"id": ids[r], "n": near.sum(1)}))
            back = back + near.sum(0)
        if not same and out and len(to):
            out.append(pd.DataFrame({"id": ids[to], "n": back}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n": []})

    cells = _cells(features.select("id", "features")).groupBy("i", "j")
    return cells.applyInPandas(run, f"id {dict(features.dtypes)['id']}, n bigint").groupBy("id").agg(F.sum("n").alias("neighbours"))


def permuted(labels: DataFrame, times: int, seed: int) -> DataFrame:
    """Shuffled copies of labelings: clustering_id, rep_id, id, label. The point at a place of one hash order
    takes the label at the same place of another; places are running counts that are spread over tasks."""
    keys = ["clustering_id", "rep_id"]
    reps = labels.withColumn("rep_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("_one", F.lit(1))
    a = running_total(reps.withColumn("_h", F.xxhash64("id")), "_h", {"_one": "n"}, keys, ["id"]).select(*keys, "n", "id")
    b = running_total(reps.withColumn("_h", F.xxhash64("id", "rep_id", F.lit(seed))), "_h", {"_one": "n"}, keys, ["id"]).select(*keys, "n", "label")
    return a.join(b, [*keys, "n"]).drop("n")


def agreements(pairs: DataFrame, by: list[str]) -> DataFrame:
    """All agreement measures per group of (a, b) pairs, long: by..., metric, score."""
    return A.all_measures(A.contingency(pairs, by), by)


def robustness(full: DataFrame, boots: DataFrame, times: int = 10, seed: int = 1) -> DataFrame:
    """Robustness of clusterings: agreement with the same clustering of each bootstrap on the shared points.

    full: clustering_id, id, label; boots: boot_id, clustering_id, id, label. Clusterings that a bootstrap
    lacks, or that are (pseudo-)trivial anywhere, are out. A clustering is robust in a metric if the 10th
    percentile of its agreements exceeds the 90th percentile of agreements with shuffled labels; it is robust if
    it is in all metrics. Output: clustering_id, metric, threshold, actual, is_robust.
    """
    n_boots = boots.select("boot_id").distinct().count()
    whole = boots.groupBy("clustering_id").agg(F.countDistinct("boot_id").alias("b")).filter(F.col("b") == n_boots).select("clustering_id")
    bad = A.label_quality(full).filter("trivial or pseudo_trivial").select("clustering_id")
    tag = boots.withColumn("key", F.concat_ws("#", "clustering_id", "boot_id"))
    bad_boot = A.label_quality(tag, "key").filter("trivial or pseudo_trivial").select(F.substring_index("key", "#", 1).alias("clustering_id"))
    good = full.join(whole, "clustering_id", "left_semi").join(bad.union(bad_boot), "clustering_id", "left_anti")
    met = good.select("clustering_id", "id", F.col("label").alias("a")).join(boots.select("boot_id", "clustering_id", "id", F.col("label").alias("b")), ["clustering_id", "id"])
    actual = agreements(met, ["clustering_id", "boot_id"]).groupBy("clustering_id", "metric").agg(F.percentile("score", F.lit(0.1)).alias("actual"))
    mixed = permuted(good.select("clustering_id", "id", "label"), times, seed).withColumnRenamed("label", "b").join(good.select("clustering_id", "id", F.col("label").alias("a")), ["clustering_id", "id"])
    limit = agreements(mixed, ["clustering_id", "rep_id"]).groupBy("clustering_id", "metric").agg(F.percentile("score", F.lit(0.9)).alias("threshold"))
    out = actual.join(limit, ["clustering_id", "metric"]).withColumn("passes", F.col("actual") > F.col("threshold"))
    return out.withColumn("is_robust", F.min("passes").over(Window.partitionBy("clustering_id"))).drop("passes")


def pick_one_per_k(quality: DataFrame) -> DataFrame:
    """One clustering per cluster count: the smallest gap between the count and the effective count."""
    w = Window.partitionBy("k").orderBy(F.abs(F.col("k") - F.col("k_effective")), "clustering_id")
    return quality.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def pick_interesting(scores: DataFrame, share: float = 0.5) -> DataFrame:
    """Clusterings in the top share (rounded up) of any metric, and all with the smallest count. scores:
    clustering_id, k, metric, score."""
    w = Window.partitionBy("metric")
    top = F.row_number().over(w.orderBy(F.desc("score"), "clustering_id")) <= F.ceil(share * F.count("*").over(w))
    least = F.col("k") == F.min("k").over(Window.partitionBy())  # one row per clustering and metric
    return scores.withColumn("top", top).withColumn("least", least).groupBy("clustering_id", "k").agg(F.max(F.col("top") | F.col("least")).alias("interesting")).filter("interesting").drop("interesting")


def cluster_complete(features: DataFrame, algorithms: tuple[str, ...] = ("kmedoids", "hierarchical"), ks: list[int] | None = None, boots: int = 10, share: float = 0.7, seed: int = 1, best: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole analysis of features (id, features): clusterings of all points and of each bootstrap, their
    robustness, and the robust clusterings that differ most from one another. Gives the labels of all
    clusterings, their robustness, and the interesting ones (clustering_id, k), chosen among the robust ones by
    silhouette and by the gap between clusters and effective clusters."""
    from cohortloom.operators.cohort import bootstraps

    folder = shared_folder(features.sparkSession)
    spark = features.sparkSession
    members = bootstraps(features, "id", boots, share, seed)
    for name, parts in (("full", [sweep(features, a, ks) for a in algorithms]), ("boots", [sweep_boots(features, members, a, ks) for a in algorithms])):
        reduce(lambda x, y: x.unionByName(y), parts).write.parquet(f"{folder}/{name}")
    full = spark.read.parquet(f"{folder}/full")
    robustness(full, spark.read.parquet(f"{folder}/boots")).write.parquet(f"{folder}/robust")
    found = spark.read.parquet(f"{folder}/robust")
    kept = found.filter("is_robust").select("clustering_id").distinct()
    quality = pick_one_per_k(A.label_quality(full.join(kept, "clustering_id", "left_semi")))
    scores = quality.select("clustering_id", "k", F.lit("gap").alias("metric"), (-F.abs(F.col("k") - F.col("k_effective"))).alias("score"))
    for (name,) in quality.select("clustering_id").collect():  # at most one for each number of clusters
        s = silhouette(features, full.filter(F.col("clustering_id") == name)).select(F.lit(name).alias("clustering_id"), F.lit("silhouette").alias("metric"), F.col("silhouette").alias("score"))
        scores = scores.unionByName(s.join(quality.select("clustering_id", "k"), "clustering_id").select("clustering_id", "k", "metric", "score"))
    return full, found, pick_interesting(scores, best)


def spread_positions(n: int, most: int = 6) -> list[int]:
    """At most ``most`` log-spaced positions of 0..n-1, both ends included."""
    if n <= most:
        return list(range(n))
    inner = np.unique(np.round(np.logspace(0, np.log10(n - 1), most)[1:-1]).astype(int))
    return sorted({0, n - 1, *inner.tolist()})


def top_labels(labels: DataFrame, n: int) -> DataFrame:
    """The n largest clusters; of equal sizes the larger label."""
    return labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("label")).limit(n)


def sensitivity(labels: DataFrame, shares: list[float], seed: int = 1) -> DataFrame:
    """Agreement of a labeling (id, label) with itself after a share of its labels was replaced: share, metric,
    score."""
    k = labels.select(F.max("label").alias("k"))
    noisy = labels.crossJoin(F.broadcast(k)).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    b = F.when(u < F.col("share"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("k") + 1).cast("int")).otherwise(F.col("label"))
    return agreements(noisy.select("share", F.col("label").alias("a"), b.alias("b")), ["share"])
