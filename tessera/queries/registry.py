"""Registry of queries: name -> function of (spark, sf_dir), and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HOUR = 3_600_000_000


def query(sql: str | None = None):
    """Register a function under its name, with the same in SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as positions in microseconds on the users' axes."""
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), "event_type", "value")


#: The same in SQL, as the first of the common table expressions of a query.
EVENTS = "e AS (SELECT user_id, event_id, epoch_us(ts) AS pos, event_type, value FROM events)"
