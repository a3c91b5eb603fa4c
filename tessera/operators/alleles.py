"""Base counts at heterozygous sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import cigar

BASES = ("A", "C", "G", "T")


def pileup(reads: DataFrame, min_mapq: int = 5) -> DataFrame:
    """contig, pos (0-based), base: of every aligned base of primary reads; bases beside insertions or deletions are kept.

    Columns: contig, ref_start, flags, mapq, cigar, seq.
    """
    good = reads.filter((F.col("flags").bitwiseAND(F.lit(0x4 | 0x100 | 0x200 | 0x400)) == 0) & (F.col("mapq") >= min_mapq))
    ops = F.filter(cigar.cursors(cigar.operations(F.col("cigar"))), lambda o: o["op"].isin("M", "=", "X"))
    runs = good.select("contig", "ref_start", "seq", F.explode(ops).alias("o")).filter("o.len > 0")
    at = runs.select("contig", "seq", F.col("o.q").alias("q"), (F.col("ref_start") + F.col("o.r")).alias("r"), F.explode(F.sequence(F.lit(0), F.col("o.len") - 1)).alias("i"))
    return at.select("contig", (F.col("r") + F.col("i")).cast("long").alias("pos"), F.expr("substring(seq, cast(q + i + 1 AS int), 1)").alias("base"))


def base_counts(bases: DataFrame, keys: list[str], base: str = "base") -> DataFrame:
    """keys, A, C, G, T, N: counts of each base, in either case; other tokens do not count."""
    up = F.upper(base)
    return bases.groupBy(*keys).agg(*[F.count_if(up == b).alias(b) for b in (*BASES, "N")])


def site_filter(counts: DataFrame, reference: str = "ref", min_depth: int = 10) -> DataFrame:
    """Sites deep enough with a known reference base and any other base seen."""
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T") + F.col("N")
    own = F.coalesce(*[F.when(F.col(reference) == b, F.col(b)) for b in BASES])
    return counts.filter((total >= min_depth) & F.col(reference).isin(*BASES) & (own + F.col("N") < total))


def allele_counts(sites: DataFrame, counts: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Heterozygous sites (keys, ref, alt) with counts, both allele fractions and the block of the position.

    The last of sites that repeat a position and reference counts.
    """
    pick = lambda c: F.coalesce(*[F.when(F.col(c) == b, F.col(b)) for b in BASES])
    joined = counts.join(sites, keys)
    r, a = pick("ref"), pick("alt")
    block = F.concat_ws("_", F.col(keys[0]).cast("string"), (F.floor(F.col(keys[1]) / F.lit(window)) * window).cast("string"))
    return joined.withColumns({"af_0": F.try_divide(r, r + a), "af_1": F.try_divide(a, r + a), "block_id": block})


def heterozygous(variants: DataFrame) -> DataFrame:
    """Single-base variants whose two alleles differ. Columns ref, alt, gt."""
    alleles = F.split("gt", "[/|]")
    return variants.filter(F.upper("ref").isin(*BASES) & F.upper("alt").isin(*BASES) & (F.size(alleles) >= 2) & (alleles[0] != alleles[1]))
