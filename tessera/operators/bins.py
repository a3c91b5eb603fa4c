"""Tiling of chromosomes into bins, overlap with intervals, and read counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import interval_join


def tile(contigs: DataFrame, width: int, breaks: DataFrame | None = None, contig: str = "contig", length: str = "length") -> DataFrame:
    """contig, start, end: closed 1-based bins of ``width``, cut also at the positions of ``breaks`` (contig, start)."""
    starts = contigs.select(contig, length, F.explode(F.sequence(F.lit(1).cast("long"), F.col(length).cast("long"), F.lit(width).cast("long"))).alias("start"))
    if breaks is not None:
        inside = breaks.select(contig, "start").join(contigs.select(contig, length), contig).filter((F.col("start") >= 1) & (F.col("start") <= F.col(length)))
        starts = starts.unionByName(inside.select(contig, length, F.col("start").cast("long").alias("start"))).distinct()
    following = F.lead("start").over(Window.partitionBy(contig).orderBy("start"))
    return starts.select(contig, "start", F.coalesce(following - 1, F.col(length)).cast("long").alias("end"))


def windows(contigs: DataFrame, width: int, contig: str = "contig", length: str = "length") -> DataFrame:
    """contig, start, end: windows [start, end) of fixed width over each contig."""
    at = F.explode(F.sequence(F.lit(1).cast("long"), F.col(length).cast("long"), F.lit(width).cast("long"))).alias("start")
    return contigs.select(contig, length, at).select(contig, "start", F.least(F.col("start") + width, F.col(length) + 1).alias("end"))


def overlap_percent(bins: DataFrame, others: DataFrame, keys: list[str], width: int, name: str = "overlap") -> DataFrame:
    """``bins`` (keys, start, end) with the share of each that ``others`` cover, in percent; what overlaps twice counts twice."""
    y = others.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    shared = F.least("end", "_e") - F.greatest("start", "_s") + 1
    sums = interval_join(bins.select(*keys, "start", "end").distinct(), y, keys, ("start", "end"), ("_s", "_e"), width).groupBy(*keys, "start", "end").agg(F.sum(shared).alias("_n"))
    out = bins.join(sums, [*keys, "start", "end"], "left")
    return out.withColumn(name, 100.0 * F.coalesce("_n", F.lit(0)) / (F.col("end") - F.col("start") + 1)).drop("_n")


def known_base_percent(bins: DataFrame, sequence: str = "seq") -> DataFrame:
    bases = F.length(sequence) - F.length(F.translate(sequence, "ACGTacgt", ""))
    return bins.withColumn("known_bases", 100.0 * bases / (F.col("end") - F.col("start") + 1))


def usable(blacklist, known, bl_threshold: float | None = 5.0, bases_threshold: float | None = 75.0):
    """Whether a bin is used; a threshold of None switches its test off."""
    a = F.lit(True) if bl_threshold is None else blacklist <= bl_threshold
    return a if bases_threshold is None else a & (known >= bases_threshold)


def reads_per_bin(reads: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """keys, bin, n_reads over regular bins: a read counts where it begins (before the bin's last position) and where it ends
    (after its first), once if both are one bin. Reads that cross a whole bin do not count there.

    Bin b holds positions [b * width + 1, (b + 1) * width], which are met as half-open.
    """
    w = F.lit(width)
    first = F.when(F.pmod(F.col(start), w) != 0, F.floor(F.col(start) / w))
    last = F.when(F.pmod(F.col(end) - 1, w) != 0, F.floor((F.col(end) - 1) / w))
    hit = F.explode(F.array_distinct(F.array_compact(F.array(first, last)))).alias("bin")
    return reads.select(*keys, hit).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n_reads"))


def normalise_self(counts: DataFrame, tumour: str = "tumour") -> DataFrame:
    """log2r of counts over their median; rows of no reads go."""
    good = counts.filter(F.col(tumour) != 0)
    mid = good.agg(F.median(tumour).alias("_m"))
    return good.crossJoin(F.broadcast(mid)).withColumn("log2r", F.log2(F.col(tumour) / F.col("_m"))).drop("_m")


def normalise_matched(counts: DataFrame, tumour: str = "tumour", normal: str = "normal") -> DataFrame:
    """log2r of tumour over normal, less its median; rows without reads of either go."""
    good = counts.filter((F.col(tumour) != 0) & (F.col(normal) != 0)).withColumn("_r", F.log2(F.col(tumour) / F.col(normal)))
    mid = good.agg(F.median("_r").alias("_m"))
    return good.crossJoin(F.broadcast(mid)).withColumn("log2r", F.col("_r") - F.col("_m")).drop("_r", "_m")
