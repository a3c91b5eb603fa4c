"""Workflow: binned read counts to segments and absolute copy numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import bins, fit, segment, smooth
from tessera.plans.params import CnaParams


def relative_profile(alignments: DataFrame, contigs: DataFrame, p: CnaParams, excluded: DataFrame | None = None, matched: bool = True) -> DataFrame:
    """contig, start, end, log2r, smoothed of every usable bin."""
    tiles = bins.tile(contigs, p.cn_binsize)
    if excluded is not None:
        tiles = bins.overlap_percent(tiles, excluded, ["contig"], p.cn_binsize, "overlap").filter(F.col("overlap") <= p.bl_threshold).drop("overlap")
    good = alignments.filter((F.col("flags").bitwiseAND(F.lit(0x4 | 0x100 | 0x800)) == 0) & (F.col("mapq") >= p.readcount_mapq))
    counts = bins.reads_per_bin(good, ["contig", "label"], "ref_start", "ref_end", p.cn_binsize)
    wide = counts.groupBy("contig", "bin").agg(*[F.sum(F.when(F.col("label") == x, F.col("n_reads"))).alias(x) for x in ("tumour", "normal")])
    rows = tiles.withColumn("bin", F.expr(f"(start - 1) div {p.cn_binsize}")).join(wide, ["contig", "bin"], "left").fillna(0, ["tumour", "normal"])
    ratio = bins.normalise_matched(rows) if matched else bins.normalise_self(rows)
    sd = smooth.trimmed_variance(ratio, ["contig"], "log2r", ["start"], p.trim).select("contig", F.sqrt("variance").alias("sd"))
    ratio = ratio.join(F.broadcast(sd), "contig", "left").withColumns({"o": 4 * F.coalesce("sd", F.lit(0.0)), "s": 2 * F.coalesce("sd", F.lit(0.0))})
    return smooth.smooth_outliers(ratio, ["contig"], "log2r", ["start"], p.smoothing_level, "o", "s").drop("o", "s", "sd", "bin")


def segments(profile: DataFrame, p: CnaParams, breaks: DataFrame | None = None) -> DataFrame:
    """Collapsed segments of a profile; with ``breaks`` (contig, pos) cut there too."""
    rows = profile.select("contig", "start", "end", F.col("smoothed").alias("log2r"))
    seg = segment.segment_profiles(rows, shuffles=p.shuffles, p_seg=p.p_seg, p_val=p.p_val, least=p.min_segment_size, quantile=p.quantile)
    if breaks is not None:
        cut = fit.split_at_breakpoints(seg, breaks.select("contig", "pos").distinct(), ["contig"]).drop("seg_id", "seg_log2r").withColumnRenamed("split_id", "seg_id")
        level = cut.groupBy("contig", "seg_id").agg(F.median("log2r").alias("seg_log2r"))
        seg = cut.join(level, ["contig", "seg_id"])
    return fit.collapse_segments(seg, ["contig"]).withColumn("ord", F.struct("contig", "start"))


def heterozygous_blocks(sites: DataFrame, p: CnaParams) -> DataFrame:
    """Blocks that tell purity: many sites, long, of usual depth, with more than one mode."""
    good = sites.filter("dp > 20 AND af_0 BETWEEN 0.05 AND 0.95 AND af_1 BETWEEN 0.05 AND 0.95 AND block_id IS NOT NULL")
    cut = good.agg((2 * F.avg("dp")).alias("_cut"))
    summary = fit.block_summary(good).crossJoin(F.broadcast(cut)).filter((F.col("n") > p.min_block_size) & (F.col("length") > p.min_block_length) & (F.col("mean_dp") < F.col("_cut"))).drop("_cut")
    modes = fit.block_modes(good.join(summary.select("block_id"), "block_id", "left_semi")).filter("n_modes > 1")
    return summary.join(modes, "block_id")


def absolute(seg: DataFrame, p: CnaParams, sites: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked solutions, absolute copy numbers of the best one). Raises ValueError when nothing fits."""
    purity = p.cellularity
    if sites is not None:
        got = fit.cellularity(sites, heterozygous_blocks(sites, p)).first()
        if got and got[0] is not None:
            b = p.cellularity_buffer
            purity = (round(max(0.0, got[0] - b), 2), round(min(1.0, got[0] + b), 2), p.cellularity[2])
    ranked = fit.fit_purity_ploidy(seg, purity, p.ploidy)
    best = ranked.orderBy("rank").first()
    if best is None:
        raise ValueError("no acceptable fit of purity and ploidy")
    if sites is None:
        return ranked, fit.absolute_segments(seg, best["purity"], best["ploidy"], None)
    inside = fit.snps_in_segments(sites.select("contig", "pos", "af_0"), seg.select("contig", "start", "end", "seg_id"), ["contig"], p.cn_binsize * 10)
    baf = fit.segment_baf(inside, ["contig", "seg_id"])
    return ranked, fit.absolute_segments(seg.join(baf, ["contig", "seg_id"], "left"), best["purity"], best["ploidy"])
