"""Range and interval joins as equi-joins on position buckets.

A bare distance or overlap condition plans as a nested loop over all pairs. Here one side is spread over the buckets that
it can meet, so that Spark hashes and sorts on (keys, bucket) and the exact condition filters what meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, buffer: int, how: str = "inner") -> DataFrame:
    """Pairs of equal ``keys`` whose positions differ by ``buffer`` at most. Other names must differ between the sides."""
    width = max(int(buffer), 1)
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    x = left.withColumn("_bucket", bucket(left_pos))
    y = right.withColumn("_bucket", F.explode(F.array(*[bucket(right_pos) + d for d in (-1, 0, 1)])))
    for k in keys:
        y = y.withColumnRenamed(k, f"_r_{k}")
    on = (x["_bucket"] == y["_bucket"]) & (F.abs(x[left_pos] - y[right_pos]) <= buffer)
    for k in keys:
        on = on & (x[k] == y[f"_r_{k}"])
    return x.join(y, on, how).drop(*[f"_r_{k}" for k in keys]).drop(x["_bucket"]).drop(y["_bucket"])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int, condition: Column | None = None) -> DataFrame:
    """Pairs of equal ``keys`` whose closed intervals overlap, each once. ``width``: bucket size, about a usual interval's.

    Both sides are spread over the buckets they touch; a pair counts in the first bucket that both touch.
    """
    span = lambda s: F.explode(F.sequence(F.floor(F.col(s[0]) / width).cast("long"), F.floor(F.greatest(F.col(s[0]), F.col(s[1])) / width).cast("long")))
    x = left.withColumn("_bucket", span(left_span))
    y = right.withColumn("_rb", span(right_span))
    for k in keys:
        y = y.withColumnRenamed(k, f"_r_{k}")
    first = F.floor(F.greatest(F.col(left_span[0]), F.col(right_span[0])) / width).cast("long")
    on = (F.col("_bucket") == F.col("_rb")) & (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1])) & (F.col("_bucket") == first)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    if condition is not None:
        on = on & condition
    return x.join(y, on).drop("_bucket", "_rb", *[f"_r_{k}" for k in keys])
