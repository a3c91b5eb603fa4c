"""Writers: VCF, BEDPE, read support, FASTA and tab-separated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import notation as nt

#: INFO fields in the order of a record: name, Number, Type, meaning.
INFO = (
    ("SVTYPE", "1", "String", "Type of structural variant"), ("MATEID", "1", "String", "ID of mate edge"),
    ("NORMAL_READ_SUPPORT", "1", "Integer", "Normal reads in support"), ("TUMOUR_READ_SUPPORT", "1", "Integer", "Tumour reads in support"),
    ("NORMAL_ALN_SUPPORT", "1", "Integer", "Normal alignments in support"), ("TUMOUR_ALN_SUPPORT", "1", "Integer", "Tumour alignments in support"),
    ("SVLEN", "1", "Integer", "Length"), ("BP_NOTATION", "1", "String", "Orientation of both edges"), ("SOURCE", "1", "String", "Where breakpoints were seen"),
    ("CLUSTERED_READS_TUMOUR", "1", "Integer", "Tumour alignments in the cluster"), ("CLUSTERED_READS_NORMAL", "1", "Integer", "Normal alignments in the cluster"),
    *[(f"{x.upper()}_DP_{w}", "1", "Integer", f"{x} depth {how} the edge") for x in ("Tumour", "Normal") for w, how in (("BEFORE", "before"), ("AT", "at"), ("AFTER", "after"))],
    *[(f"{e}_{n}", "1", "Float", f"{d} of breakpoints at the {e.lower()}") for e in ("ORIGIN", "END") for n, d in (("STARTS_STD_DEV", "Spread of positions"), ("MAPQ_MEAN", "Mean mapping quality"), ("EVENT_SIZE_STD_DEV", "Spread of sizes"), ("EVENT_SIZE_MEDIAN", "Median size"), ("EVENT_SIZE_MEAN", "Mean size"))],
    ("TUMOUR_AF", "1", "Float", "Tumour allele fraction at the edge"), ("NORMAL_AF", "1", "Float", "Normal allele fraction at the edge"),
)


def vcf_header(contigs: list[tuple[str, int]], fields: tuple = INFO, source: str = "tessera") -> list[str]:
    lines = ["##fileformat=VCFv4.2", f"##source={source}"]
    lines += [f"##contig=<ID={c},length={n}>" if n else f"##contig=<ID={c}>" for c, n in contigs]
    lines += ["##ALT=<ID=INS,Description=\"Insertion\">", "##FILTER=<ID=PASS,Description=\"All filters passed\">"]
    lines += [f'##INFO=<ID={n},Number={k},Type={t},Description="{d}">' for n, k, t, d in fields]
    return [*lines, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"]


def vcf_edges(calls: DataFrame) -> DataFrame:
    """One row for an insertion or single breakend, two for a pair of edges: CHROM, POS, ID, REF, ALT, INFO columns.

    ``calls``: number, start_chr, start, end_chr, end, notation, start_base, end_base, source, sv_length and counts.
    """
    c = F.col
    alts = nt.alt_alleles(c("notation"), c("start_chr"), c("start"), c("end_chr"), c("end"), c("start_base"), c("end_base"))
    rows = calls.withColumn("_e", F.explode(F.transform(alts, lambda a, i: F.struct(i.alias("i"), a.alias("alt"))))).withColumn("_two", F.size(alts) == 2)
    first = c("_e.i") == 0
    name = F.concat(F.lit("ID_"), c("number").cast("string"))
    kind = F.when(c("notation") == "<INS>", "INS").when(c("notation").isin("+", "-"), "SBND").otherwise("BND")
    return rows.select(
        F.when(first, c("start_chr")).otherwise(c("end_chr")).alias("CHROM"), F.when(first, c("start")).otherwise(c("end")).alias("POS"), F.concat(name, F.lit("_"), (c("_e.i") + 1).cast("string")).alias("ID"),
        F.when(first, c("start_base")).otherwise(c("end_base")).alias("REF"), c("_e.alt").alias("ALT"), kind.alias("SVTYPE"), F.when(c("_two"), F.concat(name, F.lit("_"), F.when(first, "2").otherwise("1"))).alias("MATEID"),
        *[F.coalesce(c(a), F.lit(0)).cast("long").alias(b) for a, b in (("normal_reads", "NORMAL_READ_SUPPORT"), ("tumour_reads", "TUMOUR_READ_SUPPORT"), ("normal_alns", "NORMAL_ALN_SUPPORT"), ("tumour_alns", "TUMOUR_ALN_SUPPORT"), ("sv_length", "SVLEN"), ("clustered_reads_tumour", "CLUSTERED_READS_TUMOUR"), ("clustered_reads_normal", "CLUSTERED_READS_NORMAL"))],
        c("notation").alias("BP_NOTATION"), c("source").alias("SOURCE"),
        *[F.when(first, c(f"{x}_{a}start")).otherwise(c(f"{x}_{a}end")).alias(f"{x.upper()}_{b}") for x in ("tumour", "normal") for a, b in (("dp_before_", "DP_BEFORE"), ("dp_", "DP_AT"), ("dp_after_", "DP_AFTER"), ("af_", "AF")) if f"{x}_{a}start" in calls.columns],
        *[c(n).alias(n.upper()) for e in ("origin", "end") for n in (f"{e}_starts_std_dev", f"{e}_mapq_mean", f"{e}_event_size_std_dev", f"{e}_event_size_median", f"{e}_event_size_mean") if n in calls.columns],
    )


def vcf_lines(edges: DataFrame, fields: tuple = INFO) -> DataFrame:
    """value: record lines; a field that is null is left out."""
    parts: list[Column] = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}="), F.col(n).cast("string"))) for n, *_ in fields if n in edges.columns]
    genotype = F.when(F.col("NORMAL_READ_SUPPORT") >= 1, "0/0").otherwise("0/1")
    site = F.coalesce(F.col("FILTER"), F.lit("PASS")) if "FILTER" in edges.columns else F.lit("PASS")
    return edges.withColumn("value", F.concat_ws("\t", "CHROM", F.col("POS").cast("string"), "ID", "REF", "ALT", F.lit("."), site, F.concat_ws(";", *parts), F.lit("GT"), genotype))


def write_vcf(edges: DataFrame, path: str, contigs: list[tuple[str, int]], fields: tuple = INFO) -> None:
    """Records in contig order and position under ``path``: a header part, then range-partitioned parts in order."""
    spark = edges.sparkSession
    order = spark.createDataFrame([(c, i) for i, (c, _) in enumerate(contigs)], "CHROM string, _ord int")
    head = spark.createDataFrame([(i, x) for i, x in enumerate(vcf_header(contigs, fields))], "i int, value string").select(F.lit(-1).alias("_ord"), F.col("i").cast("long").alias("POS"), F.lit("").alias("ID"), "value")
    body = vcf_lines(edges, fields).join(F.broadcast(order), "CHROM").select("_ord", "POS", "ID", "value")
    head.unionByName(body).orderBy("_ord", "POS", "ID").select("value").write.text(path)


def write_bedpe(calls: DataFrame, path: str) -> None:
    c = F.col
    line = nt.bedpe_line(c("start_chr"), c("start"), c("end_chr"), c("end"), c("number"), c("sv_length"), c("tumour_reads"), c("normal_reads"), c("notation"))
    calls.select(line.alias("value")).write.text(path)


def somatic_bedpe(edges: DataFrame, path: str) -> None:
    """First edges of classified variants, mates read from their ALT."""
    c = F.col
    chrom, pos = nt.mate_of_alt(c("ALT"))
    own = edges.filter(c("ID").endswith("_1")).withColumns({"_c": F.when(chrom != "", chrom).otherwise(c("CHROM")), "_p": F.coalesce(pos, c("POS"))})
    number = F.regexp_extract("ID", r"ID_(\d+)_1", 1)
    line = nt.bedpe_line(c("CHROM"), c("POS"), c("_c"), c("_p"), number, c("SVLEN"), c("TUMOUR_READ_SUPPORT"), c("NORMAL_READ_SUPPORT"), c("BP_NOTATION"))
    own.select(line.alias("value")).write.text(path)


def write_read_support(calls: DataFrame, path: str) -> None:
    """``calls`` with tumour_names and normal_names, arrays of read names."""
    calls.select(nt.read_support_line(F.col("number"), F.col("tumour_names"), F.col("normal_names")).alias("value")).write.text(path)


def write_insertions(calls: DataFrame, path: str) -> None:
    """FASTA of inserted sequences (column sequences)."""
    calls.select(F.explode(nt.insertion_fasta(F.col("number"), F.col("notation"), F.col("sequences"))).alias("value")).write.text(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.option("sep", "\t").option("header", header).csv(path)
