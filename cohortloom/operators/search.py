"""Hyper-parameter search: sampling runs, reading their logs, analysing results."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a run by its last log line, in the order in which they are tried.
STATES: list[tuple[str, str]] = [("oom", "memory"), ("timeout", "time limit"), ("error", "error"), ("done", "finished"), ("running", "epoch")]


def log_state(line: str, states: list[tuple[str, str]] = STATES) -> Column:
    """First state whose text the line holds in any letter case, else 'unknown'."""
    out = None
    for name, text in states:
        cond = F.lower(F.col(line)).contains(text.lower())
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("unknown")


def last_line(text: str) -> Column:
    """Last line of a text."""
    return F.element_at(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), -1)


def typed(col: str) -> Column:
    """Struct of a text read as integer, else as number, else as text; missing is NotSet."""
    c = F.col(col)
    i, d = c.try_cast("bigint"), c.try_cast("double")
    return F.struct(i.alias("as_int"), F.when(i.isNull(), d).alias("as_float"), F.when(c.isNull(), "NotSet").when(i.isNull() & d.isNull(), c).alias("as_text"))


def to_bool(col: str) -> Column:
    return F.lower(F.col(col)) == "true"


def routed(args: DataFrame, prefixes: list[str], rest: str = "general") -> DataFrame:
    """Arguments (run, arg, value) by the part they belong to: group, the longest of the prefixes that the name
    starts with and an underscore (``rest`` if none), and name, what follows it."""
    group = F.lit(rest)
    for p in sorted(prefixes, key=len):
        group = F.when(F.col("arg").startswith(f"{p}_"), p).otherwise(group)
    name = F.when(F.col("group") == rest, F.col("arg")).otherwise(F.expr("substring(arg, length(group) + 2)"))
    return args.withColumn("group", group).withColumn("name", name).drop("arg")


def options(kind: type, values: dict[str, str]):
    """A dataclass from texts by the types of its fields' defaults; a name that it does not have is an error."""
    import dataclasses

    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(values) - set(fields):
        raise ValueError(f"no such option: {', '.join(sorted(unknown))}")
    read = lambda t, v: v.lower() == "true" if t is bool else t(v)
    return kind(**{k: read(type(fields[k].default), v) for k, v in values.items()})


def sample_runs(space: dict[str, list], n: int, seed: int) -> list[dict]:
    """Random search: n settings, each argument drawn from its values."""
    r = random.Random(seed)
    return [{k: r.choice(v) for k, v in sorted(space.items())} for _ in range(n)]


def objective(results: DataFrame, worst: float = 5000.0, broken: float = 10e6) -> DataFrame:
    """Objective of each run: its value, the worst value where it is missing, a larger one where the run broke."""
    return results.withColumn("objective", F.when(F.col("state").isin("error", "oom"), F.lit(broken)).otherwise(F.coalesce("objective", F.lit(worst))))


def run_estimates(n: int, epochs: int = 500) -> dict[str, float]:
    """Planning constants for a cohort of n encounters: seconds of training, loading, plotting, MB of memory,
    seconds of the job with tolerance and cap."""
    training = 0.045 * n * epochs
    loading = (0.5 + (0.05 + 0.001 + 0.2) * n / 3600) / 5 * 3600
    plotting = 50 * loading
    return {"training_s": training, "loading_s": loading, "plotting_s": plotting, "job_s": min(1.3 * (training + loading + plotting), 7 * 86_400.0), "memory_mb": min(18_000 + 3.0 * n, 168_000.0)}


def plotted_sample(n: str) -> Column:
    """ceil(n ^ (ln 100 / ln 50000)) points are drawn of n."""
    return F.ceil(F.pow(F.col(n), F.lit(math.log(100) / math.log(50_000))) - 1e-9)


def best_and_worst(runs: DataFrame, k: int) -> DataFrame:
    """The k runs with the lowest and the k with the highest objective."""
    best = runs.orderBy("objective", "run").limit(k).withColumn("side", F.lit("best"))
    return best.unionByName(runs.orderBy(F.desc("objective"), "run").limit(k).withColumn("side", F.lit("worst")))


def running_best(epochs: DataFrame) -> DataFrame:
    """Best value of the objective up to each epoch of a run, and whether the epoch set it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("run").orderBy("epoch")
    before = F.min("objective").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return epochs.withColumn("best", F.min("objective").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("is_best", before.isNull() | (F.col("objective") < before))


def pages(df: DataFrame, order: str, size: int) -> DataFrame:
    """Rows in pages of a size: adds page, from 0, along the order inside 64 ranges counted by tasks."""
    from cohortloom.functions.spread import running_total

    n = running_total(df.withColumn("_n", F.lit(1)), order, {"_n": "below"})
    return n.withColumn("page", F.floor(F.col("below") / size)).drop("below", "_n")


def one_hot_args(args: DataFrame, names: list[str], values: dict[str, list[str]]) -> DataFrame:
    """Text arguments of a wide run table as 0/1 columns, one for each listed value."""
    cols = [F.when(F.col(a) == v, 1.0).otherwise(0.0).alias(f"{a}={v}") for a in names for v in values[a]]
    return args.select("run", *[c for c in args.columns if c not in {"run", *names}], *cols)


def surrogate(runs: DataFrame, columns: list[str], candidates: DataFrame, seed: int = 1) -> DataFrame:
    """Predicted objective of candidate settings by boosted trees fitted on finished runs (the surrogate net of
    the original is out of scope; trees take its place)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    va = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip")
    m = GBTRegressor(featuresCol="_v", labelCol="objective", maxIter=20, seed=seed).fit(va.transform(runs))
    return m.transform(va.transform(candidates)).drop("_v").withColumnRenamed("prediction", "predicted")
