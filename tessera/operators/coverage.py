"""Read depth in bins, and depth and allele fraction at breakpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(reads: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """keys, bin, depth: reads over each bin from the first that a read touches to before its last.

    A difference array: +1 where a read begins, -1 where it ends, and a running sum. The rows before the sum
    are two a read whatever its length, and equal ones combine on the map side.
    """
    first, last = (F.floor(F.col(c) / F.lit(width)).cast("long") for c in (start, end))
    step = F.explode(F.array(F.struct(first.alias("bin"), F.lit(1).alias("d")), F.struct(last.alias("bin"), F.lit(-1).alias("d")))).alias("s")
    steps = reads.filter(last > first).select(*keys, step).select(*keys, "s.bin", "s.d").groupBy(*keys, "bin").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*keys).orderBy("bin")
    runs = steps.withColumn("depth", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).withColumn("_next", F.lead("bin").over(order))
    return runs.filter("depth > 0 AND _next IS NOT NULL").withColumn("bin", F.explode(F.sequence(F.col("bin"), F.col("_next") - 1))).select(*keys, "bin", "depth")


def depth_at(breaks: DataFrame, depths: DataFrame, keys: list[str], pos: str, width: int, n_bins: int | None = None) -> DataFrame:
    """``breaks`` with dp_before, dp_at and dp_after: depth in the bin of ``pos`` and its neighbours, 0 where none is.

    The bin is held within [0, n_bins); there is nothing before the first bin or after the last.
    """
    at = F.greatest(F.lit(0), F.floor(F.col(pos) / F.lit(width))).cast("long")
    if n_bins is not None:
        at = F.least(at, F.lit(n_bins - 1).cast("long"))
    near = depths.select(*keys, F.explode(F.array(*[F.struct((F.col("bin") + d).alias("bin"), *[F.when(F.lit(d == e), F.col("depth")).alias(n) for e, n in ((1, "dp_before"), (0, "dp_at"), (-1, "dp_after"))]) for d in (-1, 0, 1)])).alias("s"))
    names = ("dp_before", "dp_at", "dp_after")
    near = near.select(*keys, "s.*").groupBy(*keys, "bin").agg(*[F.max(n).alias(n) for n in names])
    out = breaks.withColumn("bin", at).join(near, [*keys, "bin"], "left")
    return out.select(*[F.col(c) for c in breaks.columns], *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def allele_fraction(support, depth):
    """Support over depth to 3 digits, at most 1, and 0 where there is no depth."""
    return F.when(depth == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.round(support / depth, 3)))
