"""Mixing sources to target weights by Poisson replication.

Each source gets a target share of the corpus, measured in code points of text: given weights, or the
sources' sizes to the power ``temperature``. Its repetition rate is target over present size. A
document's copies are the inverse of the Poisson distribution of that mean at a uniform number hashed from
its id, so the result depends on no partitioning. Copies get a hashed key, and a shuffle on that key puts all in random order: a copy's key decides its partition and its place there.

Null sources are a source of their own, null texts have no size, texts of any length count whole. A source whose texts are all empty keeps rate 1.
Rows that repeat an id are replicated alike; rows of a null id are hashed by their text. Sources that
given weights do not name get no copies. An empty table stays empty. Columns of the input pass through;
``copy``, ``rate`` and ``shuffle_key`` are added with ``prefix`` before them, for inputs that have such columns.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import own_prefix, spread, stage

SEED = 20_240_601
TEMPERATURE = 0.5
BITS = 52


def _hash52(*parts: Column) -> Column:
    """13 hexadecimal digits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, BITS // 4), 16, 10).cast("long")


def _log_factorial(j: Column) -> Column:
    """ln j!: the sum for small numbers, else Stirling's series, exact to a double's digits from 20 on."""
    small = F.element_at(F.array(*[F.lit(math.lgamma(k + 1.0)) for k in range(20)]), (F.least(j, F.lit(19)) + 1).cast("int"))
    x = j.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(j < 20, small).otherwise(series)


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``rates`` (_source, _rate) with ``_low`` and ``_cdf``: the distribution function from _low on, to where the rest is below the resolution of the uniform
    numbers. Below _low, 12 standard deviations and 40 under the mean, it is nothing. A table is as long as the square root of its rate."""
    wide = 12 * F.sqrt("_rate") + 40
    low = F.greatest(F.lit(0), F.floor(F.col("_rate") - wide)).cast("long")
    rows = rates.filter("_rate > 0").withColumn("_low", low).withColumn("j", F.explode(F.sequence("_low", F.ceil(F.col("_rate") + wide).cast("long"))))
    p = F.exp(F.col("j") * F.log("_rate") - F.col("_rate") - _log_factorial(F.col("j")))
    so_far = Window.partitionBy("_source").orderBy("j")
    rows = rows.withColumn("c", F.sum(p).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    cdf = F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda x: x["c"])
    some = rows.groupBy("_source", "_rate", "_low").agg(cdf.alias("_cdf"))
    none = rates.filter("NOT _rate > 0").select("_source", "_rate", F.lit(0).cast("long").alias("_low"), F.array(F.lit(1.0)).alias("_cdf"))
    return some.unionByName(none)


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """_source, _rate, _low, _cdf for each source. ``budget``: expected output size over input size."""
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source_col).alias("_source")).agg(F.sum(F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("double")).alias("_size"))
    sizes = stage(sizes, "mix-sizes")
    if weights is None:
        sizes = sizes.withColumn("_w", F.when(F.col("_size") > 0, F.pow("_size", F.lit(float(temperature)))).otherwise(0.0))
    else:
        rows = [(k, float(v)) for k, v in weights.items()]
        given = spark.createDataFrame(rows, "_name string, _w double")
        sizes = sizes.join(given, F.col("_source").eqNullSafe(F.col("_name")), "left").drop("_name").fillna(0.0, ["_w"])
    total = sizes.agg(F.sum("_size").alias("s"), F.sum(F.when(F.col("_size") > 0, F.col("_w"))).alias("w")).first()
    size, weight = float(total["s"] or 0.0), float(total["w"] or 0.0)
    rate = F.when(F.col("_size") > 0, F.col("_w") / F.lit(weight or 1.0) * F.lit(size * budget) / F.col("_size")).otherwise(1.0)
    out = sizes.select("_source", rate.alias("_rate"))
    return stage(poisson_tables(out), "mix-rates")


def mix_sources(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0, seed: int = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", prefix: str = "",
) -> DataFrame:
    """Replicated and shuffled rows of ``docs``, with ``copy`` from 1, ``rate`` and ``shuffle_key`` added."""
    p = own_prefix(docs)
    rates = source_rates(docs, weights, temperature, budget, source_col, text_col).toDF(p + "source", p + "rate", p + "low", p + "cdf")
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    u = _hash52(F.lit(str(seed)), name) / F.lit(float(1 << BITS))
    out = docs.join(rates, F.col(source_col).eqNullSafe(F.col(p + "source")))
    out = out.withColumn(p + "n", F.col(p + "low").cast("int") + F.size(F.filter(p + "cdf", lambda c: c < u))).filter(F.col(p + "n") > 0)
    out = out.withColumn(p + "copy", F.explode(F.sequence(F.lit(1), F.col(p + "n"))))
    out = out.withColumn(p + "key", _hash52(F.lit(str(seed)), name, F.col(p + "copy").cast("string")))
    # the key is hashed: partitions are even whatever the sources, and a sort in each makes the order random throughout
    out = out.repartition(spread(docs.sparkSession), p + "key").sortWithinPartitions(p + "key")
    added = {p + "copy": "copy", p + "rate": "rate", p + "key": "shuffle_key"}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(a).alias(prefix + b) for a, b in added.items()])
