"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators everywhere in this subpackage: space and 0x09-0x0D.
SPACES = " \t\n\x0b\f\r"
SPACE_RE = r"[ \t\n\x0B\f\r]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, as a bound lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE, -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_prefix(df: DataFrame, start: str = "_t_") -> str:
    """A prefix that no column of ``df`` begins with."""
    while any(c.lower().startswith(start) for c in df.columns):
        start = "_" + start
    return start


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        found = "/tmp/checkpoints/tessera"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_STAGED: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the work before the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, since: int = 0, keep: str | None = None) -> int:
    """Delete the tables that :func:`stage` wrote in this process, from the ``since``-th on; returns their number."""
    gone = [p for p in _STAGED[since:] if p != keep]
    _STAGED[since:] = [keep] if keep in _STAGED[since:] else []
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def scoped(f):
    """``f`` with its result staged and every table that it staged on the way deleted, also when it fails."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        since, kept = len(_STAGED), None
        try:
            out = stage(f(df, *args, **kwargs), f.__name__)
            kept = _STAGED[-1]
            return out
        finally:
            unstage(df.sparkSession, since, kept)

    return run


def flag_maybe_in(rows: DataFrame, key: str, ids: DataFrame, id_col: str, flag: str, bits: int = 24) -> DataFrame:
    """``rows`` with ``flag``: false only where the key is surely not among ``ids``.

    A bitmap of hashed ids, of 2^(bits - 6) rows of 64 bits at most, is broadcast, so that joins after it shuffle little
    else than wanted rows. With more ids than bits it flags more, and the join still decides.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int"))
    p = own_prefix(rows)
    words = ids.select(F.floor(place(id_col) / 64).alias(p + "w"), bit(id_col).alias(p + "b")).groupBy(p + "w").agg(F.bit_or(p + "b").alias(p + "bits"))
    words = stage(words, "bitmap")
    out = rows.withColumn(p + "w", F.floor(place(key) / 64)).join(F.broadcast(words), p + "w", "left")
    return out.withColumn(flag, F.coalesce(F.col(p + "bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop(p + "w", p + "bits")


def maybe_in(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """``rows`` without most of those whose key is not among ``ids``; none that is goes."""
    flag = own_prefix(rows) + "maybe"
    return flag_maybe_in(rows, key, ids, id_col, flag).filter(F.col(flag)).drop(flag)


def spread(spark: SparkSession) -> int:
    """Partitions for an explicit repartition."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
