"""Trimmed variance of differences, and smoothing of outliers against their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import inflation_factor


def trimmed_variance(df: DataFrame, keys: list[str], x: str, order: list[str], trim: float = 0.025) -> DataFrame:
    """keys, variance: of adjacent differences without the largest, scaled to a normal distribution's."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.select(*keys, F.abs(F.col(x) - F.lead(x).over(w)).alias("_d")).filter("_d IS NOT NULL")
    ranked = d.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_d"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    keep = F.bround((1 - 2 * trim) * F.col("_n")).cast("long")
    kept = ranked.withColumn("_keep", keep).filter("_k <= _keep")
    return kept.groupBy(*keys).agg((F.sum(F.col("_d") * F.col("_d")) / (2 * F.max("_keep")) * F.lit(inflation_factor(trim))).alias("variance"))


def smooth_outliers(df: DataFrame, keys: list[str], x: str, order: list[str], k: int, outlier: str, shrink: str, name: str = "smoothed") -> DataFrame:
    """Values further than ``outlier`` from all of their k neighbours move to ``shrink`` from the local median.

    Neighbours are the k rows before and the k - 1 after; the median is over k rows either side and the row. ``outlier`` and
    ``shrink`` are columns (4 and 2 standard deviations, usually). With k of 0 or less nothing moves.
    """
    if k <= 0:
        return df.withColumn(name, F.col(x))
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_near", F.concat(F.collect_list(x).over(w.rowsBetween(-k, -1)), F.collect_list(x).over(w.rowsBetween(1, k - 1)) if k > 1 else F.array().cast("array<double>")))
    df = df.withColumn("_all", F.array_sort(F.collect_list(x).over(w.rowsBetween(-k, k)))).withColumn("_n", F.size("_all"))
    median = (F.element_at("_all", F.floor((F.col("_n") + 1) / 2).cast("int")) + F.element_at("_all", F.floor((F.col("_n") + 2) / 2).cast("int"))) / 2
    v, o = F.col(x), F.col(outlier)
    near = F.exists("_near", lambda y: F.abs(v - y) <= o) | (F.size("_near") == 0)
    above, below = F.forall("_near", lambda y: v > y), F.forall("_near", lambda y: v < y)
    out = F.when(near, v).when(above, median + F.col(shrink)).when(below, median - F.col(shrink)).otherwise(v)
    return df.withColumn(name, out).drop("_near", "_all", "_n")
