"""Feature matrices, principal components, cached features, and models that explain labels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.spread import running_total

#: least gains of the grid of trees.
GAINS = tuple(2.0**-i for i in range(4, 9))


def baseline_matrix(series: DataFrame, items: list[str], static: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each series beside static columns, one row per encounter; missing cells take the column's
    median, then every column is standardised (population deviation)."""
    from cohortloom.operators.scaling import normalise

    wide = static.select("enc", *columns).join(series.groupBy("enc").pivot("item", items).agg(F.avg("value")), "enc", "left")
    names = [*columns, *items]
    med = wide.agg(*[F.percentile(c, F.lit(0.5)).alias(f"_{c}") for c in names])
    filled = wide.crossJoin(F.broadcast(med)).select("enc", *[F.coalesce(c, f"_{c}", F.lit(0.0)).alias(c) for c in names])  # one row
    return normalise(filled, names)


def one_hot(codes: DataFrame, everyone: DataFrame, category: str, values: list[str]) -> DataFrame:
    """1.0 where an encounter has a code of the category, else 0.0; every encounter keeps a row."""
    hit = codes.select("enc", category).distinct().groupBy("enc").pivot(category, values).agg(F.lit(1.0))
    return everyone.select("enc").distinct().join(hit, "enc", "left").select("enc", *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(v) for v in values])


class Components:
    """Principal components: centred first (the library's transform does not centre), signs fixed so that the
    largest weight of each component is positive."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, train: DataFrame) -> Components:
        """train: id, features array<double>."""
        n = train.select(F.size("features")).head()[0]
        sums = train.agg(*[F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(n)], *[F.var_samp(F.col("features")[i]).alias(f"v{i}") for i in range(n)]).head()
        self.mean, self.total = np.array(sums[:n]), float(sum(v or 0.0 for v in sums[n:]))
        v = self._centred(train).select("id", array_to_vector("features").alias("v"))
        model = PCA(k=min(self.k, n), inputCol="v", outputCol="p").fit(v)
        w = model.pc.toArray()
        w = w * np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])])
        self.weights, self.explained = w, model.explainedVariance.toArray()
        return self

    def _centred(self, df: DataFrame) -> DataFrame:
        mean = F.array(*[F.lit(float(m)) for m in self.mean])
        return df.withColumn("features", F.zip_with(F.col("features").cast("array<double>"), mean, lambda a, b: a - b))

    def _mapped(self, df: DataFrame, f: Callable[[np.ndarray], np.ndarray], schema: str, name: str) -> DataFrame:
        """Rows of equally long arrays through a function of their matrix; other rows give null."""
        kind = dict(df.dtypes)["id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column("features").to_pylist()
                out: list = [None] * len(lists)
                at = [i for i, x in enumerate(lists) if x is not None and None not in x]
                if at:
                    for i, row in zip(at, f(np.array([lists[i] for i in at], float)).tolist()):
                        out[i] = row
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float64()) if schema.startswith("array") else pa.float64())], ["id", name])

        return df.select("id", F.col("features").cast("array<double>").alias("features")).mapInArrow(run, f"id {kind}, {name} {schema}")

    def transform(self, df: DataFrame) -> DataFrame:
        """Projections: id, features."""
        w, mean = self.weights, self.mean
        return self._mapped(df, lambda x: (x - mean) @ w, "array<double>", "features")

    def inverse(self, df: DataFrame) -> DataFrame:
        """Reconstruction of the original features from projections."""
        w, mean = self.weights, self.mean
        return self._mapped(df, lambda x: x @ w.T + mean, "array<double>", "features")

    def log_likelihood(self, df: DataFrame) -> DataFrame:
        """Mean log-likelihood of rows under the probabilistic model of the components: what they leave of the
        variance is noise of equal size in the other directions."""
        n, k = len(self.mean), self.weights.shape[1]
        var = np.maximum(self.explained * self.total, 1e-12)
        noise = max((self.total - var.sum()) / (n - k), 1e-12) if n > k else 0.0
        w, mean = self.weights, self.mean
        fixed = n * np.log(2 * np.pi) + np.log(var).sum() + ((n - k) * np.log(noise) if n > k else 0.0)

        def density(x: np.ndarray) -> np.ndarray:
            z = x - mean
            p = z @ w
            rest = (z**2).sum(1) - (p**2).sum(1)
            return -0.5 * (fixed + (p**2 / var).sum(1) + (rest / noise if n > k else 0.0))

        return self._mapped(df, density, "double", "d").agg(F.avg("d").alias("log_likelihood"))

    def cumulative(self, spark) -> DataFrame:
        """Explained variance and its running sum: component, explained, cumulative."""
        rows = [(i + 1, float(e), float(c)) for i, (e, c) in enumerate(zip(self.explained, np.cumsum(self.explained)))]
        return spark.createDataFrame(rows, "component int, explained double, cumulative double")

    def needed(self, share: float = 0.99) -> int:
        """Components for a share of the variance."""
        return int(np.searchsorted(np.cumsum(self.explained), share) + 1)


def upsert(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Feature cache: new rows replace old ones of the same key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def sparsity(df: DataFrame) -> DataFrame:
    """Share of feature values that are zero."""
    x = df.select(F.explode("features").alias("x"))
    return x.agg(F.avg(F.when(F.col("x") == 0, 1.0).otherwise(0.0)).alias("sparsity"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (k n_c) of each class."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # one row per class
    return n.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


def padded(series: DataFrame, length: int, fill: float) -> DataFrame:
    """Series as arrays of one length: cut, or filled with the mask value. Only the first ``length`` values of
    a series are collected."""
    w = Window.partitionBy("enc", "item").orderBy("t", "value")
    placed = series.withColumn("_i", F.row_number().over(w))
    kept = F.sort_array(F.collect_list(F.when(F.col("_i") <= length, F.struct("_i", "value"))))
    xs = placed.groupBy("enc", "item").agg(F.count("*").cast("int").alias("n"), F.transform(kept, lambda x: x["value"]).alias("xs"))
    return xs.select("enc", "item", "n", F.concat("xs", F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.col("n")))).alias("xs"))


def padded_batches(series: DataFrame, fill: float, batch: int = 4, most: int = 0, chunk: int = 1024) -> DataFrame:
    """Series as arrays of one length per batch, that of its longest series; a batch holds the series of
    ``batch`` encounters, in order of their keys (numbers). Nothing is cut unless ``most`` (0: never) bounds the
    length. Arrays come in chunks of at most ``chunk`` values, so a long series is many rows. Places of values are
    running counts over pieces of a series. Output: batch, enc, item, n, chunk, xs."""
    keys = ["enc", "item"]
    placed = running_total(series.withColumn("_one", F.lit(1)), "t", {"_one": "_i"}, keys, ["value"])
    if most:
        placed = placed.filter(F.col("_i") < most)
    sizes = series.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    place = running_total(sizes.select("enc").distinct().withColumn("_one", F.lit(1)), "enc", {"_one": "_e"}).select("enc", F.floor(F.col("_e") / batch).alias("batch"))
    longest = sizes.join(place, "enc").groupBy("batch").agg(F.max("n").alias("_l"))
    if most:
        longest = longest.withColumn("_l", F.least("_l", F.lit(most)))
    frame = sizes.join(place, "enc").join(longest, "batch").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_l") - 1) / chunk).cast("int"))))
    held = F.sort_array(F.collect_list(F.struct("_i", "value")))
    parts = placed.groupBy(*keys, F.floor(F.col("_i") / chunk).cast("int").alias("chunk")).agg(F.transform(held, lambda x: x["value"]).alias("xs"))
    xs = F.coalesce("xs", F.array().cast("array<double>"))
    whole = F.least(F.lit(chunk), F.col("_l") - F.col("chunk") * chunk)
    return frame.join(parts, [*keys, "chunk"], "left").select("batch", *keys, "n", "chunk", F.concat(xs, F.array_repeat(F.lit(float(fill)), (whole - F.size(xs)).cast("int"))).alias("xs"))


def trees(data: DataFrame, label: str, columns: list[str] | str, depths: tuple[int, ...] = (6, 10), gains: tuple[float, ...] = GAINS, least: int = 50) -> DataFrame:
    """Decision trees over a grid of depth and least gain; trees that are only a root and repeated trees are
    left out. ``columns`` are numbers, or one column with equally long arrays. Gains are those of the node, splits are binned (an approximation the library makes).
    Output: depth, gain, nodes, accuracy, rules."""
    features = F.col(columns).cast("array<double>") if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
    v = data.select(F.col(label).cast("double").alias("y"), array_to_vector(features).alias("v")).na.drop().persist()
    rows, seen = [], set()
    for depth in depths:
        for gain in gains:
            m = DecisionTreeClassifier(labelCol="y", featuresCol="v", maxDepth=depth, minInfoGain=gain, minInstancesPerNode=least // 2, seed=1).fit(v)
            rules = m.toDebugString.split("\n", 1)[1]
            if m.numNodes > 1 and rules not in seen:
                seen.add(rules)
                acc = m.transform(v).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).head()[0]
                rows.append((depth, gain, m.numNodes, acc, rules))
    v.unpersist()
    return data.sparkSession.createDataFrame(rows, "depth int, gain double, nodes int, accuracy double, rules string")


def tree_selections(data: DataFrame, label: str, selections: dict[str, list[str]], **grid) -> DataFrame:
    """The trees of each named selection of attributes, with the selection as a column. Attributes are columns
    of equally long arrays. A missing cell takes one value below all that there are, so trees can split on it."""
    names = sorted({c for columns in selections.values() for c in columns})
    low = data.agg(*[F.min(F.array_min(c)).alias(c) for c in names]).head() if names else []
    sentinel = math.floor(min((x for x in low if x is not None), default=0.0) - 1)
    out = None
    for name, columns in selections.items():
        joined = F.transform(F.concat(*[F.col(c).cast("array<double>") for c in columns]), lambda x: F.coalesce(x, F.lit(float(sentinel))))
        part = trees(data.select(label, joined.alias("_x")), label, "_x", **grid).withColumn("selection", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def classify_each(train: DataFrame, test: DataFrame, targets: list[str]) -> DataFrame:
    """One classifier for each 0/1 target on the same features: target and the measures of classify. A target
    with one class only in the training rows has none."""
    out = None
    both = train.agg(*[F.countDistinct(t).alias(t) for t in targets]).head()
    for t in targets:
        if both[t] > 1:
            part = classify(train.select("features", t).na.drop(), test.select("features", t).na.drop(), t).withColumn("target", F.lit(t))
            out = part if out is None else out.unionByName(part)
    return out


def classify(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Logistic classifier on features with class weights: precision, recall, f1 and area under the curve on
    the test rows. The area comes from rank sums over distinct scores."""
    from cohortloom.operators.stats import rank_sum

    w = class_weights(train, label).select(label, "weight")
    v = lambda d: d.withColumn("v", array_to_vector(F.col("features").cast("array<double>"))).withColumn("y", F.col(label).cast("double"))
    m = LogisticRegression(featuresCol="v", labelCol="y", weightCol="weight", maxIter=50).fit(v(train.join(F.broadcast(w), label)))
    p = m.transform(v(test)).select("y", "prediction", vector_to_array("probability")[1].alias("score"))
    c = p.agg(
        F.count(F.when((F.col("y") == 1) & (F.col("prediction") == 1), 1)).alias("tp"),
        F.count(F.when((F.col("y") == 0) & (F.col("prediction") == 1), 1)).alias("fp"),
        F.count(F.when((F.col("y") == 1) & (F.col("prediction") == 0), 1)).alias("fn"),
    )
    r = rank_sum(p, "y", "score").filter("y = 1")
    auc = r.select((0.5 + F.col("z") * F.sqrt((F.col("n_in") + F.col("n_out") + 1) / (12.0 * F.col("n_in") * F.col("n_out")))).alias("auc"))
    prec, rec = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    return c.join(auc, how="left").select(prec.alias("precision"), rec.alias("recall"), F.try_divide(2 * prec * rec, prec + rec).alias("f1"), "auc")
