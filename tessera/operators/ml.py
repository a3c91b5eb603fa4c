"""Features, random forests and conformal calibration for variant classification."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Classes of event types, and the categories that always have a column.
SV_TYPES = {"BND": 0, "INS": 1, "SBND": 2}
SOURCES = ("CIGAR", "SOFTCLIP", "SUPPLEMENTARY")
NOTATIONS = ("+", "++", "+-", "-", "-+", "--", "<INS>")


def format_features(v: DataFrame, pairs: tuple[str, ...] = ("TUMOUR_AF", "NORMAL_AF"), triples: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns as numbers: list columns by place, phasing summaries, ratios, types and one-hot categories.

    A missing second value of a pair takes the first's; ratios are of counts plus one; infinite values become -1.
    """
    c = F.col
    out = v
    for name in pairs:
        if name in v.columns and not dict(v.dtypes)[name].startswith("array"):  # one value: that of the edge itself
            out = out.withColumns({f"{name}_0": F.coalesce(c(name).cast("double"), F.lit(0.0)), f"{name}_1": F.coalesce(c(name).cast("double"), F.lit(0.0))}).drop(name)
        elif name in v.columns:
            first = F.coalesce(F.try_element_at(c(name), F.lit(1)), F.lit(0.0))
            out = out.withColumns({f"{name}_0": first, f"{name}_1": F.coalesce(F.try_element_at(c(name), F.lit(2)), first)}).drop(name)
    for name in triples:
        if name in v.columns:
            at = [F.coalesce(F.try_element_at(c(name), F.lit(i)), F.lit(0)).cast("double") for i in (1, 2, 3)]
            hi, lo = F.greatest(at[0], at[1]), F.least(at[0], at[1])
            out = out.withColumns({f"{name}_MAX": hi, f"{name}_MIN": lo, f"{name}_NA": at[2], f"{name}_RATIO": (hi + 1) / (lo + 1)}).drop(name)
    if {"TUMOUR_READ_SUPPORT", "NORMAL_READ_SUPPORT"} <= set(v.columns):
        out = out.withColumn("SUPPORT_RATIO", (c("TUMOUR_READ_SUPPORT") + 1) / (c("NORMAL_READ_SUPPORT") + 1))
    if "SVTYPE" in v.columns:
        out = out.withColumn("SVTYPE", F.coalesce(*[F.when(c("SVTYPE") == k, i) for k, i in SV_TYPES.items()], F.lit(0)))
    if "SOURCE" in v.columns:
        out = out.withColumns({f"SOURCE_{s}": F.array_contains(F.split("SOURCE", "/"), s).cast("int") for s in SOURCES}).drop("SOURCE")
    if "BP_NOTATION" in v.columns:
        out = out.withColumns({f"NOTATION_{n}": (c("BP_NOTATION") == n).cast("int") for n in NOTATIONS}).drop("BP_NOTATION")
    doubles = [n for n, t in out.dtypes if t == "double"]
    return out.withColumns({n: F.when(F.abs(c(n)) == float("inf"), -1.0).otherwise(F.coalesce(n, F.lit(0.0))) for n in doubles})


def sane_labels(v: DataFrame, label: str = "LABEL", normal: str = "NORMAL_READ_SUPPORT") -> DataFrame:
    """Somatic rows with any support in the normal are not to be compared."""
    return v.withColumn(label, F.when((F.col(label) == "SOMATIC") & (F.col(normal) > 0), "NOT_IN_COMPARISON").otherwise(F.col(label)))


def train_forest(rows: DataFrame, features: list[str], label: str = "label", trees: int = 100, depth: int = 20, seed: int = 42) -> PipelineModel:
    """Random forest on numeric columns; saves and loads as any pipeline model does."""
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), forest]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with prediction and the scores s0 and s1 of both classes."""
    p = vector_to_array("probability")
    return model.transform(rows).withColumns({"s0": p[0], "s1": p[1], "prediction": F.col("prediction").cast("int")}).drop("features", "rawPrediction", "probability")


def fit_conformal(rows: DataFrame, features: list[str], label: str = "label", seed: int = 42, test: float = 0.2, calibrate: float = 0.3, trees: int = 100, depth: int = 20) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(model, calibration scores by class, held-out rows): trained, calibrated and tested on disjoint rows."""
    train, held = rows.randomSplit([1 - test, test], seed)
    proper, cal = train.randomSplit([1 - calibrate, calibrate], seed)
    model = train_forest(proper, features, label, trees, depth, seed)
    scores = predict(model, cal).select(F.col(label).cast("int").alias("class"), F.when(F.col(label) == 0, F.col("s0")).otherwise(F.col("s1")).alias("score"))
    return model, scores, held


def area_under_pr(scored: DataFrame, label: str = "label", score: str = "s1") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, metricName="areaUnderPR").evaluate(scored)


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: tp, fp, tn, fn of class 1, and rows predicted as both or neither."""
    a, b = F.col(label), F.col(predicted)
    return rows.agg(
        F.count_if((a == 1) & (b == 1)).alias("tp"), F.count_if((a == 0) & (b == 1)).alias("fp"), F.count_if((a == 0) & (b == 0)).alias("tn"), F.count_if((a == 1) & (b == 0)).alias("fn"),
        F.count_if(b == -2).alias("both"), F.count_if(b == -1).alias("neither"),
    )


def value_counts(rows: DataFrame, col: str) -> DataFrame:
    """value, n and share of all rows; the window runs over one row a value."""
    n = rows.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def cutoff_sweep(rows: DataFrame, label: str, score: str, steps: int = 100) -> DataFrame:
    """cutoff, precision, recall for steps + 1 cut-offs: counts by score grade first, then running sums over the grades."""
    grade = F.least(F.lit(steps), F.floor(F.col(score) * steps)).cast("int")
    by = rows.groupBy(grade.alias("g")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    spark = rows.sparkSession
    by = spark.range(steps + 1).select(F.col("id").cast("int").alias("g")).join(by, "g", "left").fillna(0)
    above = Window.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumns({"tp": F.sum("p").over(above), "fp": F.sum("n").over(above), "all": F.sum("p").over(Window.partitionBy())})
    return run.select((F.col("g") / F.lit(float(steps))).alias("cutoff"), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("all")), F.lit(0.0)).alias("recall"))
