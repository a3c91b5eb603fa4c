"""Readers of the text formats: contig indexes and lists, BED, TSV, VCF, SAM, FASTA and filter parameters."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of aligned reads, whatever they come from.
ALIGNMENTS = "label string, contig string, ref_start long, ref_end long, flags int, mapq int, qname string, seq string, cigar string, sa string, hp int, ps string"
_BED = ("contig", "start", "end")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """contig, length of a FASTA index."""
    return spark.read.csv(path, sep="\t", schema="contig string, length long, o long, b long, w long").select("contig", "length")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig, ord: one name a line, in the file's order. The file is read whole: it names chromosomes."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("ord", "contig")).select("contig", "ord")


def read_bed(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """contig, start, end and further columns by ``extra`` (a schema string)."""
    return spark.read.csv(path, sep="\t", schema="contig string, start long, end long" + (f", {extra}" if extra else ""), comment="#")


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_params(path: str) -> dict[str, dict[str, float]]:
    """Filter parameters of a local JSON file, ``{category: {"MIN_<FIELD>": x}}``."""
    with open(path) as f:
        return json.load(f)


def info_types(header: list[str]) -> dict[str, tuple[str, str]]:
    """INFO fields of header lines: name -> (Number, Type)."""
    found = (re.match(r"##INFO=<ID=([^,]+),Number=([^,]+),Type=([^,]+)", x) for x in header)
    return {m[1]: (m[2], m[3]) for m in found if m}


def _info(name: str, number: str, kind: str) -> Column:
    raw = F.col("_info")[name]
    to = {"Integer": "long", "Float": "double"}.get(kind, "string")
    if kind == "Flag" or number == "0":
        return F.map_contains_key("_info", name)
    if number in ("1",):
        return raw.try_cast(to)
    return F.transform(F.split(raw, ","), lambda x: x.try_cast(to))


def read_vcf(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """CHROM, POS, ID, REF, ALT, QUAL, FILTER, FORMAT, sample and the typed INFO fields of plain or gzipped VCF.

    Types come from the headers' INFO lines, which alone are collected. Files are united by name.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    fields = info_types([r[0] for r in lines.filter(F.col("value").startswith("##INFO")).distinct().collect()])
    f = F.split("value", "\t")
    names = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "sample")
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])
    rows = rows.withColumns({"POS": F.col("POS").try_cast("long"), "QUAL": F.col("QUAL").try_cast("double"), "_info": F.str_to_map("INFO", F.lit(";"), F.lit("="))})
    return rows.select(*[n for n in names if n != "INFO"], *[_info(k, *v).alias(k) for k, v in sorted(fields.items()) if k not in names])


def read_sam(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Aligned reads of SAM text, with the columns of :data:`ALIGNMENTS`; binary formats need converting first."""
    from tessera.functions import cigar

    f = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").startswith("@"))
    tag = lambda t, kind: F.nullif(F.regexp_extract("value", rf"\t{t}:{kind}:([^\t]*)", 1), F.lit(""))
    out = lines.select(
        F.lit(label).alias("label"), f[2].alias("contig"), (F.get(f, F.lit(3)).try_cast("long") - 1).alias("ref_start"), f[1].try_cast("int").alias("flags"), F.get(f, F.lit(4)).try_cast("int").alias("mapq"), f[0].alias("qname"), F.get(f, F.lit(9)).alias("seq"),
        F.get(f, F.lit(5)).alias("cigar"), tag("SA", "Z").alias("sa"), tag("HP", "i").try_cast("int").alias("hp"), F.coalesce(tag("PS", "i"), tag("PS", "Z")).alias("ps"),
    )
    end = F.col("ref_start") + cigar.consumed_reference(cigar.operations(F.col("cigar")))
    return out.withColumn("ref_end", end).select("label", "contig", "ref_start", "ref_end", "flags", "mapq", "qname", "seq", "cigar", "sa", "hp", "ps")


def read_fasta(spark: SparkSession, path: str, chunk: int = 1_000_000) -> DataFrame:
    """contig, offset, seq: sequences in chunks, so that no later step holds a whole chromosome."""
    whole = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    one = whole.select(F.regexp_extract("value", r"^(\S+)", 1).alias("contig"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "").alias("seq"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(chunk)))
    return one.withColumn("offset", at).select("contig", F.col("offset").cast("long").alias("offset"), F.expr(f"substring(seq, offset + 1, {chunk})").alias("seq"))


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    """contig, pos (1-based), ref, alt of heterozygous single-base variants; the last of repeated ones counts."""
    from tessera.operators.alleles import heterozygous

    v = read_vcf(spark, path)
    rows = v.select(F.col("CHROM").alias("contig"), F.col("POS").alias("pos"), F.upper("REF").alias("ref"), F.upper("ALT").alias("alt"), F.split("sample", ":")[0].alias("gt"))
    return heterozygous(rows).groupBy("contig", "pos", "ref").agg(F.max("alt").alias("alt"))


def truth_edges(v: DataFrame, min_qual: float | None = None) -> DataFrame:
    """variant_id, contig (without ``chr``), pos, length, kind of each edge of truth variants: END and END2 add an edge."""
    c = v.columns
    kept = v if min_qual is None else v.filter(F.col("QUAL").isNull() | (F.col("QUAL") >= min_qual))
    col = lambda n, kind: F.col(n).cast(kind) if n in c else F.lit(None).cast(kind)
    ends = F.array_compact(F.array((F.col("POS") - 1).alias("a"), col("END", "long"), col("END2", "long")))
    length = F.abs(F.element_at(F.col("SVLEN"), 1)) if dict(v.dtypes).get("SVLEN", "").startswith("array") else F.abs(col("SVLEN", "long"))
    return kept.select(F.col("ID").alias("variant_id"), F.regexp_replace("CHROM", "^chr", "").alias("contig"), F.explode(ends).alias("pos"), length.alias("length"), col("SVTYPE", "string").alias("kind"))


def read_allele_counts(spark: SparkSession, path: str, min_depth: int = 20) -> DataFrame:
    """Allele counts of heterozygous sites, deeper than ``min_depth``: contig, pos, ref, alt, bases, dp, af_0, af_1, block_id."""
    schema = "contig string, pos long, _end long, ref string, alt string, A long, C long, G long, T long, N long, af_0 double, af_1 double, block_id string"
    rows = spark.read.csv(path, sep="\t", schema=schema).drop("_end")
    return rows.withColumn("dp", F.expr("A + C + G + T + N")).filter(F.col("dp") > min_depth)
