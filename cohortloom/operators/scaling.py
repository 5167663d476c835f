"""Scalers and imputers fitted on training rows only. Fitted parameters are one row per item and are joined
back; the order is interpolate, fit, fill what is still missing, transform."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.quantiles import quantiles

NORMAL = 1e-7


def medians(train: DataFrame) -> DataFrame:
    """Training median of each item."""
    return quantiles(train, "value", [0.5], ["item"]).select("item", F.col("q")[0].alias("median"))


def fill_medians(df: DataFrame, fitted: DataFrame) -> DataFrame:
    return df.join(fitted, "item", "left").withColumn("value", F.coalesce("value", "median")).drop("median")


def mask_value(scaled: DataFrame, col: str = "value") -> DataFrame:
    """A value above all scaled values: round(max + 1)."""
    return scaled.agg(F.round(F.max(col) + 1).alias("mask_value"))


def sentinel_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells of the columns become floor(least value of all of them - 1)."""
    low = df.agg(*[F.min(c).alias(c) for c in columns])
    sentinel = low.select(F.floor(F.least(*columns) - 1).cast("double").alias("_s")) if len(columns) > 1 else low.select(F.floor(F.col(columns[0]) - 1).cast("double").alias("_s"))
    return df.crossJoin(F.broadcast(sentinel)).withColumns({c: F.coalesce(c, "_s") for c in columns}).drop("_s")  # one row


def normalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population variance of each column; a constant column becomes 0."""
    p = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(p))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in columns}).drop(*p.columns)


class MinMax:
    """Scales the training range of each item to 0..1."""

    def fit(self, train: DataFrame) -> DataFrame:
        return train.groupBy("item").agg(F.min("value").alias("shift"), (F.max("value") - F.min("value")).alias("range")).withColumn("scale", F.when(F.col("range") > 0, F.col("range")).otherwise(1.0)).drop("range")

    def transform(self, df: DataFrame, fitted: DataFrame) -> DataFrame:
        return df.join(fitted, "item").withColumn("value", (F.col("value") - F.col("shift")) / F.col("scale")).drop("shift", "scale")

    def inverse(self, df: DataFrame, fitted: DataFrame) -> DataFrame:
        return df.join(fitted, "item").withColumn("value", F.col("value") * F.col("scale") + F.col("shift")).drop("shift", "scale")


class Standard(MinMax):
    """Zero mean and unit population variance."""

    def fit(self, train: DataFrame) -> DataFrame:
        return train.groupBy("item").agg(F.avg("value").alias("shift"), F.stddev_pop("value").alias("sd")).withColumn("scale", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).drop("sd")


class Robust(MinMax):
    """Median and interquartile range, exact."""

    def fit(self, train: DataFrame) -> DataFrame:
        return quantiles(train, "value", [0.25, 0.5, 0.75], ["item"]).select("item", F.col("q")[1].alias("shift"), F.when(F.col("q")[2] > F.col("q")[0], F.col("q")[2] - F.col("q")[0]).otherwise(1.0).alias("scale"))


class QuantileNormal:
    """Maps training quantiles to those of a normal distribution, linear in between, clipped at the ends."""

    def __init__(self, steps: int = 1000):
        self.levels = [i / steps for i in range(steps + 1)]

    def fit(self, train: DataFrame) -> DataFrame:
        return quantiles(train, "value", self.levels, ["item"]).withColumnRenamed("q", "ladder")

    def transform(self, df: DataFrame, fitted: DataFrame) -> DataFrame:
        levels = np.array(self.levels)
        nd = NormalDist()
        scores = np.array([nd.inv_cdf(min(max(p, NORMAL), 1 - NORMAL)) for p in self.levels])

        @F.pandas_udf("double")
        def to_normal(value: pd.Series, ladder: pd.Series) -> pd.Series:
            out = np.full(len(value), np.nan)
            groups: dict[tuple, list[int]] = {}
            for i, l in enumerate(ladder):
                groups.setdefault((float(l[0]), float(l[len(l) // 2]), float(l[-1])), []).append(i)
            for at in groups.values():
                l = np.asarray(ladder.iloc[at[0]])
                v = value.to_numpy()[at]
                u = 0.5 * (np.interp(v, l, levels) - np.interp(-v, -l[::-1], -levels[::-1]))
                out[at] = np.interp(u, levels, scores)
            return pd.Series(out)

        return df.join(fitted, "item").withColumn("value", F.when(F.col("value").isNotNull(), to_normal("value", "ladder"))).drop("ladder")

    def inverse(self, df: DataFrame, fitted: DataFrame) -> DataFrame:
        levels = np.array(self.levels)
        nd = NormalDist()
        scores = np.array([nd.inv_cdf(min(max(p, NORMAL), 1 - NORMAL)) for p in self.levels])

        @F.pandas_udf("double")
        def back(value: pd.Series, ladder: pd.Series) -> pd.Series:
            u = np.interp(value.to_numpy(), scores, levels)
            return pd.Series([float(np.interp(x, levels, l)) for x, l in zip(u, ladder)])

        return df.join(fitted, "item").withColumn("value", F.when(F.col("value").isNotNull(), back("value", "ladder"))).drop("ladder")


def yeo_johnson(x: np.ndarray, lam: float) -> np.ndarray:
    """Power transform of Yeo and Johnson."""
    out = np.empty(len(x))
    up = x >= 0
    out[up] = np.log1p(x[up]) if abs(lam) < 1e-9 else ((x[up] + 1) ** lam - 1) / lam
    out[~up] = -np.log1p(-x[~up]) if abs(lam - 2) < 1e-9 else -(((1 - x[~up]) ** (2 - lam)) - 1) / (2 - lam)
    return out


class Power:
    """Yeo-Johnson transform, its exponent chosen by the likelihood over a grid, then standardised. The sums
    that the likelihood needs are aggregated for all grid points at once, so no group is collected."""

    def __init__(self):
        self.grid = [round(-2 + 0.1 * i, 1) for i in range(41)]

    @staticmethod
    def _yj(v: Column, lam: float) -> Column:
        up = F.log1p(v) if lam == 0 else (F.pow(v + 1, F.lit(lam)) - 1) / lam
        down = -F.log1p(-v) if lam == 2 else -(F.pow(1 - v, F.lit(2 - lam)) - 1) / (2 - lam)
        return F.when(v >= 0, up).otherwise(down)

    def fit(self, train: DataFrame) -> DataFrame:
        v = F.col("value")
        aggs = [F.sum(F.signum(v) * F.log1p(F.abs(v))).alias("jac"), F.count(v).alias("n")]
        for i, lam in enumerate(self.grid):
            aggs += [F.var_pop(self._yj(v, lam)).alias(f"v{i}"), F.avg(self._yj(v, lam)).alias(f"m{i}")]
        found = train.groupBy("item").agg(*aggs)
        likelihood = [F.struct((-F.col("n") / 2 * F.log(F.greatest(F.col(f"v{i}"), F.lit(1e-12))) + (lam - 1) * F.col("jac")).alias("l"), F.lit(lam).alias("lam"), F.col(f"m{i}").alias("shift"), F.sqrt(F.col(f"v{i}")).alias("sd")) for i, lam in enumerate(self.grid)]
        best = F.array_max(F.array(*likelihood))
        return found.select("item", best.alias("b")).select("item", "b.lam", "b.shift", F.when(F.col("b.sd") > 0, F.col("b.sd")).otherwise(1.0).alias("scale"))

    def transform(self, df: DataFrame, fitted: DataFrame) -> DataFrame:
        v, lam = F.col("value"), F.col("lam")
        up = F.when(lam == 0, F.log1p(v)).otherwise((F.pow(v + 1, lam) - 1) / F.when(lam == 0, 1.0).otherwise(lam))
        down = F.when(lam == 2, -F.log1p(-v)).otherwise(-(F.pow(1 - v, 2 - lam) - 1) / F.when(lam == 2, 1.0).otherwise(2 - lam))
        return df.join(fitted, "item").withColumn("value", (F.when(v >= 0, up).otherwise(down) - F.col("shift")) / F.col("scale")).drop("lam", "shift", "scale")

    def inverse(self, df: DataFrame, fitted: DataFrame) -> DataFrame:
        lam = F.col("lam")
        y = F.col("value") * F.col("scale") + F.col("shift")
        up = F.when(lam == 0, F.expm1(y)).otherwise(F.pow(F.greatest(y * lam + 1, F.lit(0.0)), 1 / F.when(lam == 0, 1.0).otherwise(lam)) - 1)
        down = F.when(lam == 2, -F.expm1(-y)).otherwise(1 - F.pow(F.greatest(1 - (2 - lam) * y, F.lit(0.0)), 1 / F.when(lam == 2, 1.0).otherwise(2 - lam)))
        return df.join(fitted, "item").withColumn("value", F.when(y >= 0, up).otherwise(down)).drop("lam", "shift", "scale")


#: Registry of scalers by mode.
SCALERS = {"minmax": MinMax, "standard": Standard, "robust": Robust, "quantile": QuantileNormal, "power": Power}
