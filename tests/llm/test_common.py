from pyspark.sql import functions as F

from tessera.llm import common


def test_bitmap_lets_all_wanted_rows_through(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).unionByName(spark.createDataFrame([(None, "n")], "doc_id long, text string"))
    ids = spark.range(0, 5000, 50)
    got = {r[0] for r in common.maybe_in(rows, "doc_id", ids, "id").select("doc_id").collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 200
    few = common.flag_maybe_in(rows, "doc_id", ids, "id", "f", bits=7)  # a full bitmap loses nothing either
    assert few.count() == 5001 and {r[0] for r in few.filter("f").collect()} >= set(range(0, 5000, 50))
    assert common.maybe_in(rows, "doc_id", ids.limit(0), "id").count() == 0


def test_staged_tables_are_deleted(spark):
    df = common.stage(spark.range(10), "test")
    assert df.count() == 10
    assert common.unstage(spark) >= 1 and common.unstage(spark) == 0
