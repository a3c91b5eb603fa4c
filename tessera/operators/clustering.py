"""Clustering of breakpoints: gaps and islands with a gap of each row's own, and chains of growing lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import rounded


def gap_cluster(df: DataFrame, keys: list[str], start: str, end: str | Column, buffer: Column, ties: list[str], name: str = "cluster_id") -> DataFrame:
    """Islands of rows: a row joins the island before it when the island's end plus the row's own buffer reaches it.

    ``end`` is how far a row itself extends its island. Adds ``name``, counted from 1 in each key. The rows
    of a key are one window partition; for keys too large for a task see :func:`gap_cluster_blocks`.
    """
    order = Window.partitionBy(*keys).orderBy(start, *ties)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(past)
    new = F.when(reach.isNull() | (reach + buffer < F.col(start)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def gap_cluster_blocks(df: DataFrame, keys: list[str], start: str, end: str, buffer: Column, ties: list[str], block: int, name: str = "cluster_id") -> DataFrame:
    """:func:`gap_cluster` for keys of any size: rows meet in blocks of ``block`` positions.

    A running maximum needs from earlier blocks their maximum alone, and cluster numbers need their counts of new
    clusters: both come from one row a block. Results equal those of :func:`gap_cluster`.
    """
    df = df.withColumn("_block", F.floor(F.col(start) / F.lit(block)).cast("long")).withColumn("_end", end if isinstance(end, Column) else F.col(end))
    by = [*keys, "_block"]
    blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    reach = df.groupBy(*by).agg(F.max("_end").alias("_top")).withColumn("_before", F.max("_top").over(blocks)).drop("_top")
    order = Window.partitionBy(*by).orderBy(start, *ties)
    df = df.join(reach, by)
    past = F.greatest(F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    df = df.withColumn("_new", F.when(past.isNull() | (past + buffer < F.col(start)), 1).otherwise(0))
    counts = df.groupBy(*by).agg(F.sum("_new").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(blocks), F.lit(0))).drop("_n")
    df = df.join(counts, by).withColumn(name, (F.col("_base") + F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    return df.drop("_block", "_end", "_before", "_new", "_base")


def keep_clusters(df: DataFrame, by: list[str], min_reads: int, read: str = "read_name", label: str = "label", background: str = "normal") -> DataFrame:
    """Rows of clusters with ``min_reads`` distinct reads that are not all of the background label."""
    good = df.groupBy(*by).agg(F.countDistinct(read).alias("_reads"), F.min((F.col(label) == background).cast("int")).alias("_all")).filter(f"_reads >= {int(min_reads)} AND _all = 0")
    return df.join(good.select(*by), by, "left_semi")


def cluster_stats(df: DataFrame, by: list[str], start: str = "start", mapq: str = "mapq", size: str = "event_size", prefix: str = "") -> DataFrame:
    """Spread of starts, mean mapping quality and spread, median and mean of event sizes, to 3 digits."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias(prefix + "n_rows"),
        rounded(F.stddev_pop(start), 3).alias(prefix + "starts_std_dev"), rounded(F.avg(mapq), 3).alias(prefix + "mapq_mean"),
        rounded(F.stddev_pop(size), 3).alias(prefix + "event_size_std_dev"), rounded(F.median(size), 3).alias(prefix + "event_size_median"), rounded(F.avg(size), 3).alias(prefix + "event_size_mean"),
    )


def length_chains(df: DataFrame, keys: list[str], length: str, ties: list[str], growth: float = 1.25, name: str = "length_group") -> DataFrame:
    """Chains of lengths: a row starts a new one where it exceeds the one before times ``growth``, rounded up.

    Rows without a length (single breakends) join the last chain, or one of their own where there is none.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(length).isNull(), length, *ties)
    before = F.lag(length).over(order)
    new = F.when(F.col(length).isNotNull() & (before.isNull() | (F.col(length) > F.ceil(before * F.lit(float(growth))))), 1).otherwise(0)
    df = df.withColumn("_new", new).withColumn(name, F.greatest(F.lit(1), F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    return df.drop("_new")


def flip_recluster(df: DataFrame, keys: list[str], start: str, end: str, spans: str, buffer: int, ties: list[str], name: str = "end_cluster") -> DataFrame:
    """Clusters of end edges: start and end change places, then gap clustering with ``buffer``.

    A spanning row that opens a cluster ends before it starts once flipped; such a cluster takes in every later
    row of its key.
    """
    flipped = df.withColumns({start: F.col(end), end: F.col(start)})
    order = Window.partitionBy(*keys).orderBy(start, *ties)
    past, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col(spans), F.col(end)).otherwise(F.col(start))).over(past)
    flipped = flipped.withColumn("_open", F.when(reach.isNull() | (reach + buffer < F.col(start)), 1).otherwise(0))
    reverse = F.max(F.when((F.col("_open") == 1) & F.col(spans) & (F.col(end) < F.col(start)), 1).otherwise(0)).over(past)
    flipped = flipped.withColumn("_new", F.when(F.coalesce(reverse, F.lit(0)) == 1, 0).otherwise(F.col("_open")))
    return flipped.withColumn(name, F.sum("_new").over(so_far).cast("long")).drop("_open", "_new")


def run_stats(df: DataFrame, by: list[str], read: str = "read_name", mapq: str = "mapq", start: str = "start") -> DataFrame:
    """One row: mapping quality of distinct reads, sizes and widths of all clusters."""
    reads = df.groupBy(read).agg(F.max(mapq).alias("_q")).agg(F.avg("_q").alias("mean_mapq"), F.median("_q").alias("median_mapq")).withColumn("_", F.lit(1))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), (F.max(start) - F.min(start)).alias("_w"))
    sizes = sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.avg("_n").alias("mean_size"), F.median("_n").alias("median_size"), F.max("_n").alias("max_size"), F.avg("_w").alias("mean_width")).withColumn("_", F.lit(1))
    return sizes.join(reads, "_").drop("_")
