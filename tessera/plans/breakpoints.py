"""Workflow: aligned reads to consensus breakpoints with depth and allele fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cigar
from tessera.operators import clustering, consensus, coverage
from tessera.plans.params import CallParams
from tessera.session import checkpointed

UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x800
COLUMNS = ("start_chr", "start", "end_chr", "end", "notation", "insert_length", "insert_seq", "source", "read_name", "mapq", "label", "hp", "ps", "spans_cluster")


def _flag(bit: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(bit)) != 0


#: Positions of a chromosome that one task clusters.
CLUSTER_BLOCK = 1 << 20


def mapped_reads(alignments: DataFrame) -> DataFrame:
    """Reads that are mapped and not secondary; haplotypes and phase sets hold for primary alignments."""
    good = alignments.filter(~_flag(SECONDARY) & ~_flag(UNMAPPED))
    primary = ~_flag(SUPPLEMENTARY)
    return good.withColumns({"hp": F.when(primary, F.col("hp")), "ps": F.when(primary, F.col("ps")), "ops": cigar.operations(F.col("cigar"))})


def _rows(df: DataFrame, p: CallParams) -> DataFrame:
    near = (F.col("start_chr") == F.col("end_chr")) & (F.abs(F.col("end") - F.col("start")) <= 300) & ~F.col("notation").isin("<INS>", "+", "-")
    return df.withColumn("spans_cluster", near).select(*COLUMNS)


def cigar_breakpoints(reads: DataFrame, p: CallParams) -> DataFrame:
    """Insertions, merged deletions and, with single breakends, long clips inside alignments."""
    least = F.when(F.col("label") == "normal", F.greatest(F.lit(p.length - p.length // 5), F.lit(0))).otherwise(F.lit(p.length))
    kept = reads.filter((F.col("label") == "normal") | (F.col("mapq") >= p.mapq))
    e = kept.withColumn("e", F.explode(cigar.events_of(F.col("ops"), least)))
    start = F.col("ref_start") + F.col("e.r")
    is_ins = F.col("e.kind") == "INS"
    out = e.select(
        F.col("contig").alias("start_chr"), start.alias("start"), F.col("contig").alias("end_chr"), F.when(is_ins, start).otherwise(start + F.col("e.len")).alias("end"),
        F.when(is_ins, "<INS>").otherwise("+-").alias("notation"), F.when(is_ins, F.col("e.len")).alias("insert_length"), F.when(is_ins, F.expr("substring(seq, cast(e.q + 1 AS int), cast(e.len AS int))")).alias("insert_seq"),
        F.lit("CIGAR").alias("source"), F.col("qname").alias("read_name"), "mapq", "label", "hp", "ps",
    )
    out = _rows(out, p)
    if not p.single_bnd:
        return out
    left, right = F.element_at("ops", 1), F.element_at("ops", -1)
    alone = kept.filter(F.col("sa").isNull() & ~_flag(SUPPLEMENTARY) & (F.size("ops") > 0))
    clip = lambda o: F.when((o["op"] == "S") & (o["len"] >= p.single_bnd_min_length), o["len"])
    sides = alone.select("*", F.explode(F.array(F.struct(clip(left).alias("n"), F.col("ref_start").alias("at"), F.lit("-").alias("s"), F.lit(1).alias("from")), F.struct(clip(right).alias("n"), F.col("ref_end").alias("at"), F.lit("+").alias("s"), (F.length("seq") - right["len"] + 1).alias("from")))).alias("c")).filter("c.n IS NOT NULL")
    single = sides.select(
        F.col("contig").alias("start_chr"), F.col("c.at").alias("start"), F.col("contig").alias("end_chr"), F.col("c.at").alias("end"), F.col("c.s").alias("notation"), F.col("c.n").cast("long").alias("insert_length"),
        F.expr("substring(seq, cast(c.from AS int), cast(c.n AS int))").alias("insert_seq"), F.lit("SOFTCLIP").alias("source"), F.col("qname").alias("read_name"), "mapq", "label", "hp", "ps",
    )
    return out.unionByName(_rows(single, p))


def split_read_breakpoints(reads: DataFrame, contigs: DataFrame, p: CallParams) -> DataFrame:
    """Breakpoints between neighbouring alignments of one read.

    The primary and its supplementary regions are put in the read's order; each leaves where it ends in that direction and the
    next enters where it begins. Edges are ordered by position, or by contig order on two contigs.
    """
    own = reads.filter(~_flag(SUPPLEMENTARY) & F.col("sa").isNotNull() & ((F.col("label") == "normal") | (F.col("mapq") >= p.mapq)))
    rev = _flag(REVERSE)
    left, _ = cigar.clipping(F.col("ops"), rev)
    me = F.struct(left.cast("long").alias("at"), F.col("contig").alias("chrom"), F.col("ref_start").alias("pos"), F.when(rev, "-").otherwise("+").alias("strand"), (F.col("ref_end") - F.col("ref_start")).alias("ref"), F.col("mapq").alias("mapq"), F.lit(True).alias("primary"))
    others = F.transform(cigar.chimeric_regions(F.col("sa")), lambda r: F.struct(r["left_softclip"].alias("at"), r["chrom"].alias("chrom"), r["pos"].alias("pos"), r["strand"].alias("strand"), r["consumed_reference"].alias("ref"), r["mapq"].alias("mapq"), F.lit(False).alias("primary")))
    chain = own.withColumn("chain", F.array_sort(F.concat(F.array(me), others)))
    pair = F.explode(F.zip_with(F.slice("chain", F.lit(1), F.size("chain") - 1), F.slice("chain", F.lit(2), F.size("chain") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    e = chain.withColumn("p", pair)
    forward_a, forward_b = F.col("p.a.strand") == "+", F.col("p.b.strand") == "+"
    e = e.select(
        "qname", "mapq", "label", "hp", "ps", F.col("p.a.chrom").alias("c1"), F.when(forward_a, F.col("p.a.pos") + F.col("p.a.ref")).otherwise(F.col("p.a.pos")).alias("x1"), F.when(forward_a, "+").otherwise("-").alias("s1"),
        F.col("p.b.chrom").alias("c2"), F.when(forward_b, F.col("p.b.pos")).otherwise(F.col("p.b.pos") + F.col("p.b.ref")).alias("x2"), F.when(forward_b, "-").otherwise("+").alias("s2"),
    )
    o = contigs.select("contig", "ord")
    e = e.join(F.broadcast(o.toDF("c1", "o1")), "c1").join(F.broadcast(o.toDF("c2", "o2")), "c2")  # contig lists name chromosomes
    keep = F.when(F.col("c1") == F.col("c2"), F.col("x1") < F.col("x2")).otherwise(F.col("o1") < F.col("o2"))
    side = lambda a, b: F.when(keep, F.col(a)).otherwise(F.col(b))
    out = e.select(
        side("c1", "c2").alias("start_chr"), side("x1", "x2").alias("start"), side("c2", "c1").alias("end_chr"), side("x2", "x1").alias("end"), F.concat(side("s1", "s2"), side("s2", "s1")).alias("notation"),
        F.lit(None).cast("long").alias("insert_length"), F.lit(None).cast("string").alias("insert_seq"), F.lit("SUPPLEMENTARY").alias("source"), F.col("qname").alias("read_name"), "mapq", "label", "hp", "ps",
    )
    if not p.keep_inv_artefact:
        foldback = (F.col("start_chr") == F.col("end_chr")) & F.col("notation").isin("++", "--") & (F.abs(F.col("end") - F.col("start")) <= p.inv_artefact_distance)
        out = out.filter(~foldback)
    return _rows(out, p)


def potential_breakpoints(alignments: DataFrame, contigs: DataFrame, p: CallParams) -> DataFrame:
    reads = mapped_reads(alignments)
    return cigar_breakpoints(reads, p).unionByName(split_read_breakpoints(reads, contigs, p)).join(F.broadcast(contigs.select(F.col("contig").alias("start_chr"))), "start_chr", "left_semi")


def call(alignments: DataFrame, contigs: DataFrame, p: CallParams | None = None) -> DataFrame:
    """Numbered consensus breakpoints with support, depth and allele fractions of both edges."""
    p = p or CallParams()
    points = checkpointed(potential_breakpoints(alignments, contigs, p))  # reads are parsed once
    buffer = F.when(F.col("notation") == "<INS>", p.insertion_buffer).otherwise(p.buffer)
    reach = F.when(F.col("spans_cluster"), F.col("end")).otherwise(F.col("start"))
    c = clustering.gap_cluster_blocks(points.withColumn("_reach", reach), ["start_chr"], "start", "_reach", buffer, ["notation", "read_name", "end"], CLUSTER_BLOCK).drop("_reach")
    c = clustering.keep_clusters(c, ["start_chr", "cluster_id"], min(p.min_support, p.min_reads_per_cluster))
    called = checkpointed(consensus.call_breakpoints(checkpointed(c), p.min_support, p.end_buffer, p.length))
    reads = mapped_reads(alignments).select("label", "contig", "ref_start", "ref_end")
    depth = checkpointed(coverage.coverage(reads, ["label", "contig"], "ref_start", "ref_end", p.coverage_binsize))
    for label in ("tumour", "normal"):
        own = depth.filter(F.col("label") == label).drop("label")
        for edge in ("start", "end"):
            at = coverage.depth_at(called, own.withColumnRenamed("contig", f"{edge}_chr"), [f"{edge}_chr"], edge, p.coverage_binsize)
            called = at.withColumns({f"{label}_dp_{edge}": F.col("dp_at"), f"{label}_af_{edge}": coverage.allele_fraction(F.col(f"{label}_alns"), F.col("dp_at")), f"{label}_dp_before_{edge}": F.col("dp_before"), f"{label}_dp_after_{edge}": F.col("dp_after")}).drop("dp_before", "dp_at", "dp_after")
    order = Window.orderBy("ord", "start", "end_chr", "end", "notation")  # one row a call: thousands
    return called.join(F.broadcast(contigs.select(F.col("contig").alias("start_chr"), "ord")), "start_chr").withColumn("number", F.row_number().over(order) - 1).drop("ord")
