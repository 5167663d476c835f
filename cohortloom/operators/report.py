"""Grouped summaries that explain a clustering. Every table is one query with the label as grouping column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.quantiles import quantiles
from cohortloom.functions.spread import running_total, settled
from cohortloom.operators.stats import t_half_width


def quartiles(col: str) -> Column:
    return F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def cluster_summary(enc: DataFrame, label: str, number: str, died: str, flag: Column) -> DataFrame:
    """Population row (label null) and one row per cluster by grouping sets: size, percent of the population,
    median and quartiles of a number, mortality, share of a flag."""
    src = enc.withColumn("_flag", flag.cast("int"))
    g = src.groupingSets([[], [F.col(label)]], F.col(label)).agg(
        F.count("*").alias("size"),
        quartiles(number).alias("q"),
        F.avg(F.col(died).cast("int")).alias("mortality"),
        F.avg("_flag").alias("share"),
        F.grouping(label).alias("population"),
    )
    total = F.max(F.when(F.col("population") == 1, F.col("size"))).over(Window.partitionBy())  # one row per label
    return g.withColumn("percent", 100.0 * F.col("size") / total).select((F.col("population") == 1).alias("population"), label, "size", "percent", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mortality", "share")


def full_summary(enc: DataFrame, label: str, numbers: list[str], flags: list[str]) -> DataFrame:
    """Population row and one row per cluster by grouping sets: size, mean and quartiles of each number, share of
    each flag. population tells the first from a cluster whose label is null."""
    aggs = [F.count("*").alias("size"), F.grouping(label).alias("_g")]
    for c in numbers:
        aggs += [F.avg(c).alias(f"{c}_mean"), quartiles(c).alias(f"_q_{c}")]
    aggs += [F.avg(F.col(f).cast("int")).alias(f"{f}_share") for f in flags]
    g = enc.groupingSets([[], [F.col(label)]], F.col(label)).agg(*aggs)
    parts = [x for c in numbers for x in (F.col(f"{c}_mean"), *(F.col(f"_q_{c}")[i].alias(f"{c}_{n}") for i, n in enumerate(("q1", "median", "q3"))))]
    return g.select((F.col("_g") == 1).alias("population"), label, "size", *parts, *[f"{f}_share" for f in flags])


def listed(values: DataFrame, label: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of the population and of each cluster as one text, 'value (n); ...', ties by the
    value: population, label, text."""
    seen = values.filter(F.col(value).isNotNull())
    n = seen.groupingSets([[F.col(value)], [F.col(label), F.col(value)]], F.col(label), F.col(value)).agg(F.count("*").alias("n"), F.grouping(label).alias("_g"))
    place = F.row_number().over(Window.partitionBy("_g", label).orderBy(F.desc("n"), value))
    best = n.withColumn("_p", place).filter(F.col("_p") <= k)
    items = F.sort_array(F.collect_list(F.struct("_p", F.format_string("%s (%d)", F.col(value), "n").alias("t"))))
    return best.groupBy((F.col("_g") == 1).alias("population"), label).agg(F.array_join(F.transform(items, lambda x: x["t"]), "; ").alias("text"))


def with_lists(summary: DataFrame, label: str, lists: dict[str, DataFrame]) -> DataFrame:
    """A summary (population, label, ...) with the texts of listed beside it, one column for each name."""
    for name, part in lists.items():
        right = part.select(F.col("population").alias("_p"), F.col(label).alias("_l"), F.col("text").alias(name))
        summary = summary.join(right, (F.col("population") == F.col("_p")) & F.col(label).eqNullSafe(F.col("_l")), "left").drop("_p", "_l")
    return summary


def mortality_interval(enc: DataFrame, label: str, died: str) -> DataFrame:
    """Mortality with its standard error and, where it is neither 0 nor 1, the half width of the 95 % Student
    interval."""
    x = F.col(died).cast("double")
    m = enc.groupBy(label).agg(F.count(x).alias("n"), F.avg(x).alias("mortality"), F.stddev_samp(x).alias("sd"))
    m = m.withColumn("se", F.col("sd") / F.sqrt("n"))
    return m.withColumn("half_width", F.when((F.col("mortality") > 0) & (F.col("mortality") < 1), t_half_width("n", "se")))


def histogram_of(values: DataFrame, label: str, value: str) -> DataFrame:
    """Count of each value and its share of all values of the label."""
    n = values.groupBy(label, value).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def top_values(values: DataFrame, label: str, value: str, k: int) -> DataFrame:
    """The k most frequent values per label, ties by the value."""
    n = values.filter(F.col(value).isNotNull()).groupBy(label, value).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("n"), value))).filter(F.col("place") <= k)


def prevalence(codes: DataFrame, enc: DataFrame, label: str | None, category: str) -> DataFrame:
    """Share of encounters with at least one code of a category, per label or for all."""
    by = [label] if label else []
    size = enc.groupBy(*by).agg(F.countDistinct("enc").alias("size"))
    hit = codes.join(enc.select("enc", *by), "enc").groupBy(*by, F.col(category).alias("category")).agg(F.countDistinct("enc").alias("n"))
    j = hit.join(size, by) if by else hit.crossJoin(F.broadcast(size))  # one row
    return j.select(*by, "category", (F.col("n") / F.col("size")).alias("prevalence"))


def prevalence_difference(codes: DataFrame, enc: DataFrame, label: str, category: str) -> DataFrame:
    """Prevalence of each category in each cluster minus that in the population; a category that a cluster
    lacks counts 0. largest is the category's largest absolute difference."""
    pop = prevalence(codes, enc, None, category).withColumnRenamed("prevalence", "population")
    labels = enc.select(label).distinct()
    frame = pop.crossJoin(F.broadcast(labels))  # categories by labels, both dictionaries
    diff = frame.join(prevalence(codes, enc, label, category), [label, "category"], "left").withColumn("difference", F.coalesce("prevalence", F.lit(0.0)) - F.col("population"))
    return diff.withColumn("largest", F.max(F.abs("difference")).over(Window.partitionBy("category"))).select(label, "category", "difference", "largest")


def category_frequency(enc: DataFrame, label: str, category: str) -> DataFrame:
    """Relative frequency of each category per cluster, minus the population's unless there are fewer than
    three categories."""
    inside = enc.groupBy(label, category).agg(F.count("*").alias("n")).withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy(label)))
    pop = enc.groupBy(category).agg(F.count("*").alias("m")).withColumn("p", F.col("m") / F.sum("m").over(Window.partitionBy())).withColumn("k", F.count("*").over(Window.partitionBy()))
    return inside.join(pop, category).select(label, category, F.when(F.col("k") < 3, F.col("f")).otherwise(F.col("f") - F.col("p")).alias("frequency"))


def code_mortality(codes: DataFrame, enc: DataFrame, label: str, died: str) -> DataFrame:
    """Per code: encounters, mortality, and surprise: the sum over clusters of the squared difference of the
    cluster's mortality from the code's (clusters without the code add nothing)."""
    cells = codes.select("enc", "code").distinct().join(enc.select("enc", label, F.col(died).cast("int").alias("d")), "enc").groupBy("code", label).agg(F.count("*").alias("n"), F.sum("d").alias("dead"))
    w = Window.partitionBy("code")
    pop = F.sum("dead").over(w) / F.sum("n").over(w)
    cells = cells.withColumn("pop", pop).withColumn("sq", F.pow(F.col("dead") / F.col("n") - F.col("pop"), 2))
    return cells.groupBy("code").agg(F.sum("n").alias("total"), F.max("pop").alias("mortality"), F.sum("sq").alias("surprise"))


def code_mortality_cells(codes: DataFrame, enc: DataFrame, label: str, died: str) -> DataFrame:
    """Encounters and mortality of each code in each cluster that has it, in long form: code, label, n,
    mortality, and share, the cluster's percentage of the code's encounters."""
    cells = codes.select("enc", "code").distinct().join(enc.select("enc", label, F.col(died).cast("int").alias("d")), "enc").groupBy("code", label).agg(F.count("*").alias("n"), F.avg("d").alias("mortality"))
    return cells.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("code")))


def js_distance(p: Column, q: Column) -> Column:
    """Terms whose sum, halved, is the squared Jensen-Shannon distance to base 2."""
    m = (p + q) / 2
    side = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return side(p) + side(q)


def code_distribution(codes: DataFrame, enc: DataFrame, label: str) -> DataFrame:
    """Per code: encounters and the Jensen-Shannon distance of its spread over clusters to their sizes."""
    sizes = enc.groupBy(label).agg(F.count("*").alias("size")).withColumn("q", F.col("size") / F.sum("size").over(Window.partitionBy()))
    n = codes.select("enc", "code").distinct().join(enc.select("enc", label), "enc").groupBy("code", label).agg(F.count("*").alias("n"))
    frame = n.select("code").distinct().crossJoin(F.broadcast(sizes.select(label, "q")))  # codes by clusters
    p = frame.join(n, ["code", label], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("code")))
    return p.groupBy("code").agg(F.sum("n").alias("total"), F.sqrt(F.greatest(F.sum(js_distance(F.col("p"), F.col("q"))) / 2, F.lit(0.0))).alias("distance"))


def cluster_distances(codes: DataFrame, enc: DataFrame, label: str, category: str) -> DataFrame:
    """Jensen-Shannon distance between the softmax of the category prevalences of each two clusters."""
    p = prevalence(codes, enc, label, category)
    frame = p.select("category").distinct().crossJoin(F.broadcast(enc.select(label).distinct()))
    p = frame.join(p, [label, "category"], "left").withColumn("e", F.exp(F.coalesce("prevalence", F.lit(0.0))))
    p = p.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy(label)))
    a = p.select(F.col(label).alias("left"), "category", F.col("p").alias("p"))
    b = p.select(F.col(label).alias("right"), "category", F.col("p").alias("q"))
    return a.join(b, "category").groupBy("left", "right").agg(F.sqrt(F.greatest(F.sum(js_distance(F.col("p"), F.col("q"))) / 2, F.lit(0.0))).alias("distance"))


def cumulative_cover(codes: DataFrame, enc: DataFrame, label: str, top: int = 20) -> DataFrame:
    """Share of a cluster's encounters with any of its first 1, 2, ... most frequent codes, cut where all are
    covered: label, place, code, percent. Frequencies count occurrences."""
    placed = codes.join(enc.select("enc", label), "enc")
    n = placed.groupBy(label, "code").agg(F.count("*").alias("n"))
    best = n.withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("n"), "code"))).filter(F.col("place") <= top).select(label, "code", "place")
    first = placed.join(F.broadcast(best), [label, "code"]).groupBy(label, "enc").agg(F.min("place").alias("place"))
    new = first.groupBy(label, "place").agg(F.count("*").alias("fresh"))
    size = enc.groupBy(label).agg(F.count("*").alias("size"))
    w = Window.partitionBy(label).orderBy("place")
    out = best.join(new, [label, "place"], "left").join(size, label).withColumn("covered", F.sum(F.coalesce("fresh", F.lit(0))).over(w)).withColumn("before", F.coalesce(F.lag("covered").over(w), F.lit(0)))
    return out.filter("before < size").select(label, "place", "code", (100.0 * F.col("covered") / F.col("size")).alias("percent"))


def occurrence_counts(codes: DataFrame, enc: DataFrame, label: str, category: str) -> DataFrame:
    """Occurrences (not encounters) of each category per cluster and their share of the cluster's."""
    n = codes.join(enc.select("enc", label), "enc").groupBy(label, F.col(category).alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def trimmed(df: DataFrame, value: str, percent: float, two_sided: bool = False) -> DataFrame:
    """Rows up to a percentile, or between two; the bounds are one row."""
    levels = [percent / 200, 1 - percent / 200] if two_sided else [percent / 100]
    b = quantiles(df, value, levels).withColumnRenamed("q", "_b")
    kept = df.crossJoin(F.broadcast(b)).filter(F.col(value) <= F.col("_b")[len(levels) - 1])  # one row
    return (kept.filter(F.col(value) >= F.col("_b")[0]) if two_sided else kept).drop("_b")


def capped_bmi(df: DataFrame, value: str) -> DataFrame:
    """Values above ceil(min(95th percentile, 75)) become null."""
    b = quantiles(df, value, [0.95]).select(F.ceil(F.least(F.get("q", F.lit(0)), F.lit(75.0))).alias("_b"))
    return df.crossJoin(F.broadcast(b)).withColumn(value, F.when(F.col(value) <= F.col("_b"), F.col(value))).drop("_b")


def clipped(df: DataFrame, value: str, times: float = 3.0) -> DataFrame:
    """Values above a multiple of the median become that multiple."""
    b = quantiles(df, value, [0.5]).select((times * F.get("q", F.lit(0))).alias("_b"))
    return df.crossJoin(F.broadcast(b)).withColumn(value, F.when(F.col(value).isNotNull(), F.least(value, "_b"))).drop("_b")


def binned(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Adds bin, 0 to bins - 1, of equal width over the range; the last bin is closed."""
    b = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return df.crossJoin(F.broadcast(b)).withColumn("bin", F.coalesce(F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(w, F.lit(0.0))), F.lit(bins - 1)), F.lit(0)).cast("int")).drop("_lo", "_hi")


def survival_bins(df: DataFrame, value: str, alive: str, bins: int, upper_percent: float) -> DataFrame:
    """Survival rate per bin of a value, its upper outliers cut first."""
    return binned(trimmed(df.filter(F.col(value).isNotNull()), value, upper_percent), value, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col(alive).cast("int")).alias("survival"))


def kaplan_meier(df: DataFrame, label: str, time: str, died: str) -> DataFrame:
    """Product-limit survival curve per cluster: label, t, at_risk, deaths, survival. Rows are first counted per
    time; running sums over the times are spread over tasks."""
    n = settled(df.filter(F.col(time).isNotNull()).groupBy(label, F.col(time).alias("t")).agg(F.count("*").alias("n"), F.sum(F.col(died).cast("int")).alias("deaths")))
    size = n.groupBy(label).agg(F.sum("n").alias("size"))
    risk = running_total(n, "t", {"n": "below"}, [label]).join(size, label).withColumn("at_risk", F.col("size") - F.col("below")).drop("below", "size")
    q = 1 - F.col("deaths") / F.col("at_risk")
    terms = risk.withColumn("log_q", F.when(q > 0, F.ln(q)).otherwise(0.0)).withColumn("gone", F.when(q <= 0, 1).otherwise(0))
    sums = running_total(terms, "t", {"log_q": "logs", "gone": "ended"}, [label])
    survival = F.when(F.col("ended") + F.col("gone") > 0, F.lit(0.0)).otherwise(F.exp(F.col("logs") + F.col("log_q")))
    return sums.select(label, "t", "at_risk", "deaths", survival.alias("survival"))


def heat_map(df: DataFrame, x: str, y: str, value: str, max_labels: int = 6, bins: int = 4) -> DataFrame:
    """Mean of a value on a grid: an axis with few distinct values keeps them, another has equal-width
    half-open bins, so its largest value falls out."""
    for c in (x, y):
        k = df.select(c).distinct().limit(max_labels + 1).count()
        if k <= max_labels:
            df = df.withColumn(f"{c}_cell", F.col(c).cast("double"))
        else:
            b = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
            df = df.crossJoin(F.broadcast(b)).withColumn(f"{c}_cell", F.floor((F.col(c) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))).cast("double")).filter(F.col(f"{c}_cell") < bins).drop("_lo", "_hi")
    return df.groupBy(f"{x}_cell", f"{y}_cell").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def mode_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells take the column's most frequent value, the smallest of several."""
    for c in columns:
        top = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), c).limit(1).select(F.col(c).alias("_mode"))
        df = df.join(F.broadcast(top), how="left").withColumn(c, F.coalesce(c, "_mode")).drop("_mode")  # one row
    return df


def varying_args(args: DataFrame) -> DataFrame:
    """Arguments (run, arg, value) that have more than one value."""
    return args.join(args.groupBy("arg").agg(F.countDistinct("value").alias("_k")).filter("_k > 1").select("arg"), "arg", "left_semi")


def spread_by_cluster(values: DataFrame, label: str) -> DataFrame:
    """Per attribute and cluster with at least two values: n, median, interquartile range."""
    s = values.filter("value is not null").groupBy("attr", label).agg(F.count("*").alias("n"), quartiles("value").alias("q"))
    return s.filter("n >= 2").select("attr", label, "n", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def medians_and_errors(values: DataFrame, by: str, value: str) -> DataFrame:
    """Median with its distance to the quartiles."""
    q = values.groupBy(by).agg(quartiles(value).alias("q"))
    return q.select(by, F.col("q")[1].alias("median"), (F.col("q")[1] - F.col("q")[0]).alias("below"), (F.col("q")[2] - F.col("q")[1]).alias("above"))


def power_sums(df: DataFrame, x: str, y: str, degree: int) -> DataFrame:
    """Sums that a least-squares polynomial needs, over x scaled to -1..1: one row."""
    b = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    u = (2 * F.col(x) - F.col("_lo") - F.col("_hi")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    s = df.crossJoin(F.broadcast(b)).withColumn("_u", u)
    return s.agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), *[F.sum(F.pow("_u", F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow("_u", F.lit(k)) * F.col(y)).alias(f"t{k}") for k in range(degree + 1)])


def polynomial(df: DataFrame, x: str, y: str, degree: int) -> tuple[list[float], float, float]:
    """Least-squares polynomial by its normal equations: coefficients over the scaled x, and the range of x."""
    import numpy as np

    r = power_sums(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, degree).head().asDict()
    a = np.array([[r[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.lstsq(a, np.array([r[f"t{i}"] for i in range(degree + 1)]), rcond=None)[0].tolist(), r["lo"], r["hi"]


def enrichment_text(col: str) -> Column:
    """+x.x% text of a difference."""
    return F.format_string("%+.1f%%", 100 * F.col(col))


def direction(col: str, strong: float = 0.1, weak: float = 0.02) -> Column:
    """++, +, ~, -, -- by the size of a difference."""
    c = F.col(col)
    return F.when(c >= strong, "++").when(c >= weak, "+").when(c <= -strong, "--").when(c <= -weak, "-").otherwise("~")
