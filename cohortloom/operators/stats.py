"""Tests. Counts, ranks and moments are aggregates; only the last step to a p-value runs in Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.spread import running_total


def rank_sum(df: DataFrame, label: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Wilcoxon rank-sum score of each label against the rest, for each group of ``by`` (attributes): by...,
    label, n_in, n_out, z; average ranks for ties, no correction; null where a side is empty. Equal values meet
    in one count row before they are ranked."""
    by = by or []
    seen = df.filter(F.col(value).isNotNull() & F.col(label).isNotNull())
    cells = seen.groupBy(*by, label, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    per_value = cells.groupBy(*by, "v").agg(F.sum("n").alias("t"))
    ranked = running_total(per_value, "v", {"t": "below"}, by).withColumn("rank", F.col("below") + (F.col("t") + 1) / 2.0)
    w = cells.join(ranked, [*by, "v"]).groupBy(*by, label).agg(F.sum(F.col("n") * F.col("rank")).alias("w"), F.sum("n").alias("n_in"))
    total = seen.groupBy(*by).agg(F.count("*").alias("n_all"))
    out = (w.join(total, by) if by else w.crossJoin(F.broadcast(total))).withColumn("n_out", F.col("n_all") - F.col("n_in"))  # one row
    n_in, n_out, n_all = (F.col(c).cast("double") for c in ("n_in", "n_out", "n_all"))  # their product leaves whole numbers at millions of rows
    z = (F.col("w") - n_in * (n_all + 1) / 2.0) / F.sqrt(n_in * n_out * (n_all + 1) / 12.0)
    return out.select(*by, label, "n_in", "n_out", F.when((F.col("n_in") > 0) & (F.col("n_out") > 0), z).alias("z"))


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Logarithm of n! of whole numbers: summed up to 32, by Stirling's series beyond."""
    n = np.asarray(n, float)
    x = np.maximum(n, 32.0)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n <= 32, _SMALL[np.clip(n, 0, 32).astype(int)], series)


_SMALL = np.array([math.lgamma(k + 1) for k in range(33)])


class Hypergeometric:
    """Counts in the first cell of a 2x2 table with fixed sums: r1 of n rows, c1 of n columns."""

    def __init__(self, r1: int, c1: int, n: int):
        self.r1, self.c1, self.n = r1, c1, n
        self.low, self.high = max(0, r1 + c1 - n), min(r1, c1)
        self.mean = r1 * c1 / n if n else 0.0
        self.sd = math.sqrt(max(0.0, self.mean * (n - r1) * (n - c1) / n / (n - 1))) if n > 1 else 0.0
        self.fixed = float(log_factorial(np.array([r1, n - r1, c1, n - c1])).sum() - log_factorial(np.array(n)))

    def log_p(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        return self.fixed - log_factorial(x) - log_factorial(self.r1 - x) - log_factorial(self.c1 - x) - log_factorial(self.n - self.r1 - self.c1 + x)

    def likely(self, least: int = 0) -> np.ndarray:
        """All counts within 40 deviations of the mean; those beyond have no weight (below 1e-300)."""
        reach = 40 * self.sd + 50
        return np.arange(max(self.low, least, int(self.mean - reach)), min(self.high, int(self.mean + reach)) + 1)

    def tail(self, x: int, step: int, limit: float) -> float:
        """Sum of the probabilities of the counts from x away from the mean that are no likelier than ``limit``."""
        reach = int(40 * self.sd + 50)
        far = np.arange(x, min(self.high, x + reach) + 1) if step > 0 else np.arange(max(self.low, x - reach), x + 1)
        p = self.log_p(far)
        return float(np.exp(p[p <= limit]).sum())


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a 2x2 table: the probability of all tables no likelier than the given one. The
    likelihood falls on both sides of its peak, so the work grows with the root of the counts only."""
    h = Hypergeometric(a + b, a + c, a + b + c + d)
    peak = min(h.high, max(h.low, (h.r1 + 1) * (h.c1 + 1) // (h.n + 2)))
    limit = float(h.log_p(np.array(a))) + 1e-7
    if float(h.log_p(np.array(peak))) <= limit:
        return 1.0
    step = 1 if a > peak else -1
    # The first count on the other side that is no likelier, by halving.
    near, far = peak, h.low - 1 if step > 0 else h.high + 1
    while abs(far - near) > 1:
        mid = (near + far) // 2
        near, far = (mid, far) if float(h.log_p(np.array(mid))) > limit else (near, mid)
    # On the given side, counts of equal likelihood up to rounding may stand before a.
    return min(1.0, h.tail(a, step, limit) + (h.tail(far, -step, limit) if h.low <= far <= h.high else 0.0))


def fisher_p(a: str, b: str, c: str, d: str) -> Column:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_exact(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)])

    return p(a, b, c, d)


def normal_two_sided(z: str) -> Column:
    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else None)

    return p(z)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > 1e-30 else 1e-30)
        c = 1 + num / (c if abs(c) > 1e-30 else 1e-30)
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's correlation of two columns over rows that have both: r, n, and the two-sided p-value."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if a != a or k < 3 else 0.0 if abs(a) >= 1 else student_two_sided(a * math.sqrt((k - 2) / (1 - a * a)), k - 2) for a, k in zip(r, n)], dtype="float64")

    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.corr(x, y).alias("r"), F.count("*").alias("n")).withColumn("p_value", p("r", "n"))


def membership_test(codes: DataFrame, enc: DataFrame, label: str) -> DataFrame:
    """Fisher's test of having a code at all, each cluster against its complement: label, code, a, b, c, d (with
    and without the code inside, with and without outside) and p_value."""
    size = enc.groupBy(label).agg(F.count("*").alias("size"))
    total = enc.agg(F.count("*").alias("n_all"))
    has = codes.select("enc", "code").na.drop().distinct().join(enc.select("enc", label), "enc").groupBy("code", label).agg(F.count("*").alias("a"))
    every = has.groupBy("code").agg(F.sum("a").alias("n_code"))
    t = every.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(total)).join(has, ["code", label], "left")  # codes by clusters
    a = F.coalesce("a", F.lit(0))
    cells = t.select(label, "code", a.alias("a"), (F.col("size") - a).alias("b"), (F.col("n_code") - a).alias("c"), (F.col("n_all") - F.col("size") - F.col("n_code") + a).alias("d"))
    return cells.withColumn("p_value", fisher_p("a", "b", "c", "d"))


def student_quantile(p: float, df: float) -> float:
    """Quantile above the median, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - student_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def t_half_width(n: str, se: str, level: float = 0.95) -> Column:
    """Half width of a Student t interval."""

    @F.pandas_udf("double")
    def half(n: pd.Series, se: pd.Series) -> pd.Series:
        return pd.Series([student_quantile(0.5 + level / 2, k - 1) * s if k > 1 and s == s else None for k, s in zip(n, se)], dtype="float64")

    return half(n, se)


def welch(df: DataFrame, group: str, value: str) -> DataFrame:
    """Welch's t statistic, degrees of freedom and p-value of the two groups (0 and 1) of a column."""
    g = df.groupBy().agg(*[f.alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count(F.when(F.col(group) == k, F.col(value)))), ("m", F.avg(F.when(F.col(group) == k, F.col(value)))), ("v", F.var_samp(F.when(F.col(group) == k, F.col(value)))))])
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    out = g.withColumn("t", (F.col("m0") - F.col("m1")) / F.sqrt(a + b)).withColumn("df", (a + b) * (a + b) / (a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1)))

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_two_sided(x, k) for x, k in zip(t, df)])

    return out.withColumn("p_value", p("t", "df")).select("t", "df", "p_value")
