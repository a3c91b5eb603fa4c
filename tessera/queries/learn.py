"""Queries on features, conformal prediction, confusion and model training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import classify, ml
from tessera.queries.registry import load, query

_SCORES = "s AS (SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS row_id, l_discount * 10 AS s0, 1 - l_discount * 10 AS s1 FROM lineitem), c AS (SELECT (l_linestatus = 'O')::INTEGER AS class, l_tax * 12.5 AS score FROM lineitem)"


@query(f"""
WITH {_SCORES}, x AS (SELECT DISTINCT s0, s1 FROM s),
p AS (SELECT s0, s1, {", ".join(f"(SELECT (count(*) FILTER (score < s{k}) + CASE WHEN count(*) FILTER (score = s{k}) > 0 THEN (count(*) FILTER (score = s{k}) + 1) / 2.0::DOUBLE ELSE 0 END) / count(*) FROM c WHERE class = {k}) AS p{k}" for k in (0, 1))} FROM x)
SELECT s.row_id, round(p0, 9) AS p0, round(p1, 9) AS p1, CASE WHEN p0 > 1 - 0.7 AND p1 > 1 - 0.7 THEN -2 WHEN p0 > 1 - 0.7 THEN 0 WHEN p1 > 1 - 0.7 THEN 1 ELSE -1 END AS class FROM s JOIN p USING (s0, s1)
""")
def mondrian_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    s = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), (F.col("l_discount") * 10).alias("s0"), (1 - F.col("l_discount") * 10).alias("s1"))
    c = li.select((F.col("l_linestatus") == "O").cast("int").alias("class"), (F.col("l_tax") * 12.5).alias("score"))
    return classify.mondrian_classes(s, c, 0.7).select("row_id", F.round("p0", 9).alias("p0"), F.round("p1", 9).alias("p1"), "class")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    pick = lambda x, i: F.element_at(F.array(*[F.lit(v) for v in x]), (i + 1).cast("int"))
    return load(spark, sf_dir, "lineitem").select(
        (k * 8 + F.col("l_linenumber")).alias("row_id"), F.when(k % 2 == 0, F.array("l_discount", "l_tax")).otherwise(F.array("l_discount")).alias("TUMOUR_AF"),
        F.array((k % 5).cast("int"), (k % 3).cast("int"), (k % 2).cast("int")).alias("TUMOUR_ALT_HP"), (k % 25).alias("TUMOUR_READ_SUPPORT"), (k % 3).alias("NORMAL_READ_SUPPORT"),
        pick(("BND", "INS", "SBND"), k % 3).alias("SVTYPE"), pick(("CIGAR", "CIGAR/SUPPLEMENTARY", "SOFTCLIP"), k % 3).alias("SOURCE"), pick(ml.NOTATIONS, k % 7).alias("BP_NOTATION"),
    )


@query(f"""
WITH x AS (SELECT *, l_orderkey AS k FROM lineitem)
SELECT (k * 8 + l_linenumber)::BIGINT AS row_id, l_discount AS "TUMOUR_AF_0", CASE WHEN k % 2 = 0 THEN l_tax ELSE l_discount END AS "TUMOUR_AF_1",
  greatest(k % 5, k % 3)::DOUBLE AS "TUMOUR_ALT_HP_MAX", least(k % 5, k % 3)::DOUBLE AS "TUMOUR_ALT_HP_MIN", (k % 2)::DOUBLE AS "TUMOUR_ALT_HP_NA", (greatest(k % 5, k % 3) + 1) / (least(k % 5, k % 3) + 1)::DOUBLE AS "TUMOUR_ALT_HP_RATIO",
  k % 25 AS "TUMOUR_READ_SUPPORT", k % 3 AS "NORMAL_READ_SUPPORT", (k % 25 + 1) / (k % 3 + 1)::DOUBLE AS "SUPPORT_RATIO", (k % 3)::INTEGER AS "SVTYPE",
  (k % 3 IN (0, 1))::INTEGER AS "SOURCE_CIGAR", (k % 3 = 2)::INTEGER AS "SOURCE_SOFTCLIP", (k % 3 = 1)::INTEGER AS "SOURCE_SUPPLEMENTARY",
  {", ".join(f'(k % 7 = {i})::INTEGER AS "NOTATION_{n}"' for i, n in enumerate(ml.NOTATIONS))} FROM x
""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.format_features(_typed(spark, sf_dir), pairs=("TUMOUR_AF",), triples=("TUMOUR_ALT_HP",))


@query("""
SELECT count(*) FILTER (quality = 1 AND p = 1) AS tp, count(*) FILTER (quality = 0 AND p = 1) AS fp, count(*) FILTER (quality = 0 AND p = 0) AS tn, count(*) FILTER (quality = 1 AND p = 0) AS fn,
       count(*) FILTER (p = -2) AS "both", count(*) FILTER (p = -1) AS neither FROM (SELECT quality, doc_id % 4 - 2 AS p FROM labels)
""")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.confusion(load(spark, sf_dir, "labels").select("quality", (F.col("doc_id") % 4 - 2).alias("p")), "quality", "p")


@query("SELECT toxic AS value, count(*) AS n, count(*) / (SELECT count(*) FROM labels)::DOUBLE AS share FROM labels GROUP BY toxic")
def label_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.value_counts(load(spark, sf_dir, "labels"), "toxic")


@query("""
WITH x AS (SELECT (l_linestatus = 'O')::INTEGER AS label, l_quantity / 50 AS s FROM lineitem), g AS (SELECT label, least(20, floor(s * 20)) AS g FROM x), c AS (SELECT unnest(range(21)) AS g)
SELECT c.g / 20.0::DOUBLE AS cutoff, count(*) FILTER (label = 1) / count(*)::DOUBLE AS "precision", count(*) FILTER (label = 1) / (SELECT count(*) FROM x WHERE label = 1)::DOUBLE AS recall FROM c JOIN g ON g.g >= c.g GROUP BY c.g
""")
def cutoff_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "lineitem").select((F.col("l_linestatus") == "O").cast("int").alias("label"), (F.col("l_quantity") / 50).alias("s"))
    return ml.cutoff_sweep(x, "label", "s", 20)


@query()
def rf_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest on labelled documents: quality by length and language, scored over all of them."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.size(F.split("text", "[!#$%*|]")) - 1).alias("marks"), F.size(F.split("text", " ")).alias("n_words"))
    labelled = d.join(load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    model = ml.train_forest(labelled, ["n_chars", "marks", "n_words"])
    return ml.predict(model, d).select("doc_id", "prediction", F.round("s1", 6).alias("s1"))
