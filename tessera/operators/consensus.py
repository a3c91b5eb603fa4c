"""From clustered breakpoints to consensus events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INS, SINGLE = "<INS>", ("+", "-")


def label_counts(df: DataFrame, by: list[str], labels: tuple[str, ...] = ("tumour", "normal"), order: tuple[str, ...] = ("start", "read_name"), read: str = "read_name", label: str = "label", hp: str | None = "hp", ps: str | None = None) -> DataFrame:
    """For each group and label: distinct reads, alignments, haplotypes 1, 2 and none; distinct phase sets.

    A read counts for the label that it is first seen with, in ``order``. Alignments count for their own label.
    """
    first = F.row_number().over(Window.partitionBy(*by, read).orderBy(*order)) == 1
    rows = df.withColumn("_first", first)
    aggs = []
    for x in labels:
        is_x = F.col(label) == x
        own = is_x & F.col("_first")
        aggs += [F.count_if(own).alias(f"{x}_reads"), F.count_if(is_x).alias(f"{x}_alns")]
        if hp:
            aggs += [F.count_if(own & (F.col(hp) == 1)).alias(f"{x}_hp1"), F.count_if(own & (F.col(hp) == 2)).alias(f"{x}_hp2"), F.count_if(own & F.col(hp).isNull()).alias(f"{x}_hp_na")]
        if ps:
            aggs.append(F.array_sort(F.collect_set(F.when(own, F.col(ps)))).alias(f"{x}_ps"))
    return rows.groupBy(*by).agg(*aggs)


def event_size(notation: Column, insert_length: Column, start_chr: Column, start: Column, end_chr: Column, end: Column) -> Column:
    """Insert length for insertions and single breakends, else the distance on one chromosome, else 0."""
    return F.when(notation.isin(INS, *SINGLE), insert_length).when(start_chr == end_chr, F.abs(end - start)).otherwise(0)


def consensus(df: DataFrame, by: list[str]) -> DataFrame:
    """Location, length, sources and support of each group of breakpoints.

    Columns: start_chr, start, end_chr, end, notation, insert_length, source, read_name, label.
    """
    return df.groupBy(*by).agg(
        F.median("start").cast("long").alias("start"), F.median("end").cast("long").alias("end"),
        F.array_join(F.array_sort(F.collect_set("source")), "/").alias("source"),
        F.avg(F.when(F.col("notation") == INS, F.col("insert_length"))).cast("long").alias("mean_insert"),
        F.countDistinct("read_name").alias("n_reads"), F.count(F.lit(1)).alias("n_rows"),
    )


def sv_length(notation: Column, start_chr: Column, end_chr: Column, start: Column, end: Column, mean_insert: Column) -> Column:
    return F.when(notation == INS, mean_insert).when(notation.isin(*SINGLE) | (start_chr != end_chr), F.lit(0).cast("long")).otherwise(F.abs(end - start))


def long_enough(length: Column, start_chr: Column, end_chr: Column, min_length: int) -> Column:
    return (length >= min_length) | ((start_chr != end_chr) & (length == 0))


def without_weak_single_breakends(df: DataFrame, by: list[str], notation: str = "notation") -> DataFrame:
    """Drop single breakends of groups in which any other notation stands."""
    single = F.col(notation).isin(*SINGLE)
    return df.withColumn("_major", F.max((~single).cast("int")).over(Window.partitionBy(*by))).filter(~single | (F.col("_major") == 0)).drop("_major")


def call_breakpoints(df: DataFrame, min_support: int = 3, end_buffer: int = 50, min_length: int = 30) -> DataFrame:
    """Consensus events of clustered breakpoints (column cluster_id): insertions and paired edges.

    Insert-like rows chain by length; where at least two alignments spell an insertion it is one, else single
    breakends by notation. Other rows are clustered again by their end and split by notation.
    """
    from tessera.operators.clustering import cluster_stats, flip_recluster, keep_clusters, length_chains

    key = ["start_chr", "cluster_id", "end_chr"]
    big = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(f"_n >= {int(min_support)}").drop("_n")
    df = df.join(big, key, "left_semi")
    total = Window.partitionBy("start_chr", "cluster_id")
    for x in ("tumour", "normal"):
        df = df.withColumn(f"clustered_{x}", F.count_if(F.col("label") == x).over(total))

    like = df.filter(F.col("notation").isin(INS, *SINGLE))
    like = length_chains(like.withColumn("_len", F.when(F.col("notation") == INS, F.col("insert_length"))), key, "_len", ["start", "read_name"]).drop("_len")
    group = [*key, "length_group"]
    votes = like.groupBy(*group, "label").agg(F.countDistinct("read_name").alias("r"), F.count_if(F.col("notation") == INS).alias("i")).groupBy(*group).agg(F.max("r").alias("_r"), F.sum("i").alias("_i"))
    like = like.join(votes.filter(f"_r >= {int(min_support)}"), group).withColumn("notation", F.when(F.col("_i") >= 2, F.lit(INS)).otherwise(F.col("notation"))).drop("_r", "_i")
    like = like.withColumn("sub", F.col("length_group")).drop("length_group")

    pairs = df.filter(~F.col("notation").isin(INS, *SINGLE))
    pairs = flip_recluster(pairs, key, "start", "end", "spans_cluster", end_buffer, ["notation", "read_name", "end"], "sub")
    pairs = keep_clusters(pairs, [*key, "sub"], min_support)
    pairs = pairs.withColumns({"start": F.col("end"), "end": F.col("start")})

    rows = like.select(*pairs.columns).unionByName(pairs)
    by = [*key, "sub", "notation"]
    support = rows.groupBy(*by, "label").agg(F.countDistinct("read_name").alias("r")).groupBy(*by).agg(F.max("r").alias("_r")).filter(f"_r >= {int(min_support)}").drop("_r")
    rows = rows.join(support, by, "left_semi")
    called = consensus(rows, by).join(label_counts(rows, by, hp=None), by)
    called = called.join(rows.groupBy(*by).agg(F.max("clustered_tumour").alias("clustered_reads_tumour"), F.max("clustered_normal").alias("clustered_reads_normal")), by)
    # spread of the rows used, and of all that share the end cluster, whatever their notation
    sized = rows.withColumn("event_size", event_size(F.col("notation"), F.col("insert_length"), F.col("start_chr"), F.col("start"), F.col("end_chr"), F.col("end")))
    called = called.join(cluster_stats(sized, by, prefix="origin_").drop("origin_n_rows"), by).join(cluster_stats(sized, [*key, "sub"], "end", prefix="end_").drop("end_n_rows"), [*key, "sub"])
    called = called.withColumn("end", F.when(F.col("notation").isin(INS, *SINGLE), F.col("start")).otherwise(F.col("end")))
    called = called.withColumn("sv_length", sv_length(F.col("notation"), F.col("start_chr"), F.col("end_chr"), F.col("start"), F.col("end"), F.col("mean_insert")))
    called = called.filter(long_enough(F.col("sv_length"), F.col("start_chr"), F.col("end_chr"), min_length) | F.col("notation").isin(*SINGLE))
    return without_weak_single_breakends(called, key).drop("mean_insert")
