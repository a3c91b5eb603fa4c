"""Comparison of calls with a truth set."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import range_join
from tessera.session import ship


def within(calls: DataFrame, truth: DataFrame, keys: list[str], call_pos: str, truth_pos: str, buffer: int = 100) -> DataFrame:
    """Candidate pairs and their ``distance``."""
    return range_join(calls, truth, keys, call_pos, truth_pos, buffer).withColumn("distance", F.abs(F.col(call_pos) - F.col(truth_pos)))


def nearest(candidates: DataFrame, call_id: str, truth_id: str) -> DataFrame:
    """Each call's nearest truth, whoever else takes it."""
    order = Window.partitionBy(call_id).orderBy("distance", truth_id)
    return candidates.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def exclusive_nearest(candidates: DataFrame, keys: list[str], call_id: str, truth_id: str, uses: int = 1) -> DataFrame:
    """Greedy one-to-one matching: calls in order of their least distance take their nearest truth that is left.

    Candidates of one key (a chromosome) meet in one task, in order; chains of buffers do not cross keys.
    """
    ship(candidates.sparkSession)
    kinds = dict(candidates.dtypes)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.groupby(call_id)["distance"].transform("min")
        pdf = pdf.assign(_first=first).sort_values(["_first", call_id, "distance", truth_id], kind="stable")
        used: dict = {}
        out = []
        for c, g in pdf.groupby(call_id, sort=False):
            for t, d in zip(g[truth_id], g["distance"], strict=True):
                if used.get(t, 0) < uses:
                    used[t] = used.get(t, 0) + 1
                    out.append((c, t, d))
                    break
        return pd.DataFrame(out, columns=[call_id, truth_id, "distance"])

    schema = f"{call_id} {kinds[call_id]}, {truth_id} {kinds[truth_id]}, distance {kinds['distance']}"
    return candidates.select(*keys, call_id, truth_id, "distance").groupBy(*keys).applyInPandas(match, schema)


def precision_recall(n_true: DataFrame, n_calls: int | None = None) -> DataFrame:
    """precision, recall and F of one row (tp, fp, fn), to 3 digits; 0 where undefined."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return n_true.select("tp", "fp", "fn", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f, 3).alias("f_measure"))


def labelled(calls: DataFrame, matches: DataFrame, call_id: str, truth_id: str, name: str = "FOUND_IN_BOTH", missing: str = "NOT_IN_COMPARISON") -> DataFrame:
    """``calls`` with LABEL, LABEL_VARIANT_ID and DISTANCE_TO_MATCH from their matches; ``name`` is the truth set's label."""
    m = matches.select(F.col(call_id).alias("_c"), F.col(truth_id).alias("LABEL_VARIANT_ID"), F.col("distance").alias("DISTANCE_TO_MATCH"))
    out = calls.join(m, F.col(call_id) == F.col("_c"), "left").drop("_c")
    return out.withColumn("LABEL", F.when(F.col("LABEL_VARIANT_ID").isNull(), missing).otherwise(name))


def inherit_from_mates(calls: DataFrame, call_id: str, mate_id: str, missing: str = "NOT_IN_COMPARISON") -> DataFrame:
    """Unlabelled calls take their mate's label with the prefix MATE_."""
    m = calls.select(F.col(call_id).alias("_m"), F.col("LABEL").alias("_l"))
    out = calls.join(m, F.col(mate_id) == F.col("_m"), "left")
    takes = (F.col("LABEL") == missing) & F.col("_l").isNotNull() & (F.col("_l") != missing)
    return out.withColumn("LABEL", F.when(takes, F.concat(F.lit("MATE_"), F.col("_l"))).otherwise(F.col("LABEL"))).drop("_m", "_l")
