"""Somatic classification by rules, parameters and copy-number change-points."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import range_join


def params_predicate(rules: Mapping[str, float], columns: Mapping[str, str] | None = None, arrays: frozenset[str] = frozenset()) -> Column:
    """Predicate of ``{"MIN_<FIELD>": x, "MAX_<FIELD>": y}``; fields in ``arrays`` are judged by their first element."""
    parts = []
    for key, value in rules.items():
        side, _, field = key.partition("_")
        if side not in ("MIN", "MAX"):
            raise ValueError(f"a rule begins with MIN_ or MAX_: {key}")
        c = F.col((columns or {}).get(field, field))
        c = (F.element_at(c, 1) if field in arrays else c).cast("double")
        parts.append(c >= float(value) if side == "MIN" else c <= float(value))
    return reduce(and_, parts, F.lit(True))


def by_params(variants: DataFrame, params: Mapping[str, Mapping[str, float]], columns: Mapping[str, str] | None = None, arrays: frozenset[str] = frozenset()) -> DataFrame:
    """``variants`` with ``categories``: the names of all rule sets that a row passes."""
    marks = [F.when(params_predicate(rules, columns, arrays), F.lit("PASSED_" + name.upper())) for name, rules in params.items()]
    return variants.withColumn("categories", F.array_compact(F.array(*marks)))


def pacbio_somatic(min_support: int = 7, min_af: float = 0.1) -> Column:
    """Rule for high-accuracy long reads over the typed INFO columns."""
    c = F.col
    return (
        (c("NORMAL_READ_SUPPORT") == 0) & (c("TUMOUR_READ_SUPPORT") >= min_support)
        & (c("ORIGIN_STARTS_STD_DEV") <= 50.0) & (c("END_STARTS_STD_DEV") <= 50.0) & (c("ORIGIN_MAPQ_MEAN") >= 40.0) & (c("END_MAPQ_MEAN") >= 40.0)
        & (c("ORIGIN_EVENT_SIZE_STD_DEV") <= 60.0) & (c("END_EVENT_SIZE_STD_DEV") <= 60.0) & (c("TUMOUR_AF") >= min_af) & (c("CLUSTERED_READS_NORMAL") <= 3)
    )


def with_mates(variants: DataFrame, own: Column, name: str = "pass", id_col: str = "ID", mate_col: str = "MATEID", first: Column | None = None) -> DataFrame:
    """``own`` for each row, or'ed with its mate's for the first edge of a pair."""
    rows = variants.withColumn("_own", F.coalesce(own, F.lit(False)))
    mates = rows.select(F.col(id_col).alias("_mate"), F.col("_own").alias("_mate_own"))
    first = F.col(id_col).endswith("_1") if first is None else first
    out = rows.join(mates, F.col(mate_col) == F.col("_mate"), "left")
    return out.withColumn(name, F.col("_own") | (first & F.coalesce("_mate_own", F.lit(False)))).drop("_own", "_mate", "_mate_own")


def legacy_strict(tumour: Column, normal: Column, origin_sd: Column, origin_size_sd: Column, end_sd: Column, end_size_sd: Column) -> Column:
    """Uncertainties are products of (spread + 1); rows of the first kind that fail its second test do not fall through."""
    ou, eu = (origin_sd + 1) * (origin_size_sd + 1), (end_sd + 1) * (end_size_sd + 1)
    return lambda eh: (normal == 0) & (tumour > 7) & F.when((tumour > 12) & (ou <= 15), F.coalesce(eh <= 0.025, F.lit(False))).when((tumour > 12) & (eu <= 30), True).otherwise(eu <= 10)


def heterogeneity(size_sd: Column, size_median: Column) -> Column:
    return F.when(size_median > 0, size_sd / size_median)


def legacy_lenient(tumour: Column, normal: Column, origin_sd: Column, eh: Column, is_insertion: Column) -> Column:
    good = (tumour != 0) & (normal / tumour < 0.1) & (origin_sd < 150) & (eh < 3) & F.when(is_insertion, tumour > 25).otherwise(tumour > 5)
    return F.coalesce(good, F.lit(False))


def reconcile_model_classes(variants: DataFrame, min_support: int, min_af: float) -> DataFrame:
    """Final class of model predictions (column ``pred``: 0 noise, 1 somatic, 2 germline, -1 neither, -2 both).

    Either mate somatic: 4 for too little support or less than normal, 5 for a low fraction unless the
    tumour's depth is over 5 times the normal's, else 1. Both germline: 4, 5 or 2 alike by the normal's. Either noise: 0.
    A mix of -1 and -2: -2. Mates share their class.
    """
    c = F.col
    mates = variants.select(c("ID").alias("_mate"), c("pred").alias("_mp"), c("af").alias("_maf"), c("amplified").alias("_mamp"))
    v = variants.join(mates, c("MATEID") == c("_mate"), "left").withColumns({"_mp": F.coalesce("_mp", "pred"), "_maf": F.coalesce("_maf", "af"), "_mamp": F.coalesce("_mamp", "amplified")})
    low = (c("af") < min_af) & (c("_maf") < min_af)
    spared = c("amplified") | c("_mamp")
    somatic = F.when((c("tumour") < min_support) | (c("tumour") < c("normal")), 4).when(low & ~spared, 5).when(low, c("pred")).otherwise(1)
    germline = F.when(c("normal") < min_support, 4).when(c("normal_af") < min_af, 5).otherwise(2)
    noise = (c("pred") == 0) | (c("_mp") == 0)
    out = F.when((c("pred") == 1) | (c("_mp") == 1), somatic).when((c("pred") == 2) & (c("_mp") == 2), germline).when(noise, 0).when(c("pred") != c("_mp"), F.when((c("pred") < 0) & (c("_mp") < 0), -2).otherwise(c("pred"))).otherwise(c("pred"))
    return v.withColumn("class", out.cast("int")).drop("_mate", "_mp", "_maf", "_mamp")


def mondrian_classes(scores: DataFrame, calibration: DataFrame, confidence: float) -> DataFrame:
    """Class-conditional conformal sets: row_id, p0, p1 and the class (0, 1, -2 both, -1 neither).

    ``scores``: row_id, s0, s1; ``calibration``: class, score. A p-value is the share of the class's
    calibration scores below the score, counting equal ones half. Scores lie in [0, 1]; they are ranked among the
    calibration scores, never paired with them.
    """

    def ranks(c: int) -> DataFrame:
        pts = scores.select(F.col(f"s{c}").alias("x"), F.col("row_id"), F.lit(0).alias("cal")).unionByName(calibration.filter(F.col("class") == c).select(F.col("score").alias("x"), F.lit(None).cast("long").alias("row_id"), F.lit(1).alias("cal")))
        # running counts in two levels, a thousandth of the scores' range to a partition
        by = pts.groupBy("x").agg(F.sum("cal").alias("n")).withColumn("part", F.floor(F.col("x") * 1000))
        sums = by.groupBy("part").agg(F.sum("n").alias("m"))
        sums = sums.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy()).alias("all"))
        inner = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        run = by.join(F.broadcast(sums), "part").withColumn("below", F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
        p = run.select(F.col("x").alias(f"s{c}"), ((F.col("below") + F.when(F.col("n") > 0, (F.col("n") + 1) / 2.0).otherwise(0.0)) / F.col("all")).alias(f"p{c}"))
        return p

    out = scores.join(ranks(0), "s0").join(ranks(1), "s1")
    a, b = F.col("p0") > 1 - confidence, F.col("p1") > 1 - confidence
    return out.withColumn("class", F.when(a & b, -2).when(a, 0).when(b, 1).otherwise(-1)).select("row_id", "p0", "p1", "class")


def change_points(segments: DataFrame, keys: list[str], start: str = "start", end: str = "end", seg: str = "segment_id", cn: str = "copy_number") -> DataFrame:
    """Steps of the rounded copy number: start of a run, start of the next, first segment of the run.

    The last run of a key never ends, and is not given. A copy number of 0 counts as not set: the next value
    takes its place without a step.
    """
    order = Window.partitionBy(*keys).orderBy(start)
    r = F.bround(F.col(cn)).cast("long")
    rows = segments.withColumn("_cn", r)
    prev = F.lag("_cn").over(order)
    new = F.when(prev.isNull() | ((prev != 0) & (F.col("_cn") != prev)), 1).otherwise(0)
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_run").agg(F.min(start).alias("run_start"), F.min_by(seg, start).alias("segment"))
    step = F.lead("run_start").over(Window.partitionBy(*keys).orderBy("_run"))
    return runs.withColumn("run_end", step).filter("run_end IS NOT NULL").select(*keys, "run_start", "run_end", "segment")


def rescue_by_copy_number(variants: DataFrame, points: DataFrame, keys: list[str], pos: str, distance: int, support: str, min_support: int | None = None, normal: str | None = None, clustered_normal: str | None = None) -> DataFrame:
    """For each change-point side, the variant of most support within ``distance``; one row a variant (last segment wins).

    Where named, these bound the candidates: support of ``min_support`` or more, no support in the column ``normal``,
    fewer than 3 reads in ``clustered_normal``. Without a normal sample the last two are not named.
    """
    if min_support is not None:
        variants = variants.filter(F.col(support) >= min_support)
    if normal is not None:
        variants = variants.filter(F.col(normal) == 0)
    if clustered_normal is not None:
        variants = variants.filter(F.col(clustered_normal) < 3)
    sides = points.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("run_start").alias("at")), F.struct(F.lit(1).alias("side"), F.col("run_end").alias("at")))).alias("s"), "segment", "run_start").select(*keys, "segment", "run_start", "s.side", F.col("s.at").alias("change"))
    near = range_join(variants, sides, keys, pos, "change", distance)
    # a variant near both ends of a run counts for its start
    near = near.withColumn("_k", F.row_number().over(Window.partitionBy("variant_id", *keys, "segment").orderBy("side"))).filter("_k = 1").drop("_k")
    best = Window.partitionBy(*keys, "segment").orderBy(F.desc(support), "variant_id")
    top = near.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")
    last = Window.partitionBy("variant_id").orderBy(F.desc("run_start"))
    return top.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
