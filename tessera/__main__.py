"""Command line: ``python -m tessera run|classify|evaluate|train|cna|to ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.plans import workflows
from tessera.plans.params import CallParams
from tessera.sources import readers


def share(text: str) -> float:
    """A number from 0 to 1."""
    x = float(text)
    if not 0 <= x <= 1:
        raise argparse.ArgumentTypeError(f"not within 0 and 1: {text}")
    return x


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="command", required=True)
    d = CallParams()
    for name in ("run", "to"):
        p = sub.add_parser(name, help="call breakpoints" if name == "run" else "call breakpoints of a tumour alone")
        p.add_argument("--tumour", required=True)
        if name == "run":
            p.add_argument("--normal", required=True)
        p.add_argument("--ref_index", required=True)
        p.add_argument("--contigs")
        p.add_argument("--ref", help="FASTA, for the reference's letters")
        p.add_argument("--outdir", required=True)
        for f in ("length", "mapq", "buffer", "insertion_buffer", "end_buffer", "min_support"):
            p.add_argument(f"--{f}", type=int, default=getattr(d, f))
        p.add_argument("--single_bnd", action="store_true")
        p.add_argument("--keep_inv_artefact", action="store_true")
    p = sub.add_parser("classify", help="classify called variants")
    p.add_argument("--vcf", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--custom_params")
    p.add_argument("--custom_model")
    p.add_argument("--min_support", type=int, default=7)
    p.add_argument("--min_af", type=share, default=0.1)
    p.add_argument("--pb", action="store_true")
    p.add_argument("--legacy", action="store_true")
    p.add_argument("--confidence", type=share)
    p = sub.add_parser("evaluate", help="compare variants with a truth set")
    p.add_argument("--input", required=True)
    p.add_argument("--truth", required=True)
    p.add_argument("--overlap_buffer", type=int, default=100)
    p.add_argument("--qual_filter", type=float)
    p = sub.add_parser("train", help="train a forest on labelled variants")
    p.add_argument("--labelled", required=True)
    p.add_argument("--outdir", required=True)
    p.add_argument("--features", required=True)
    p = sub.add_parser("cna", help="copy numbers")
    p.add_argument("--tumour", required=True)
    p.add_argument("--normal")
    p.add_argument("--ref_index", required=True)
    p.add_argument("--blacklist")
    p.add_argument("--outdir", required=True)
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if a.command in ("run", "to"):
        names = ("length", "mapq", "buffer", "insertion_buffer", "end_buffer", "min_support", "single_bnd", "keep_inv_artefact")
        workflows.run(spark, a.tumour, getattr(a, "normal", None), a.ref_index, a.outdir, a.contigs, CallParams(**{n: getattr(a, n) for n in names}), a.ref)
    elif a.command == "classify":
        workflows.classify_vcf(spark, a.vcf, a.output, a.custom_params, a.custom_model, a.min_support, a.min_af, a.pb, a.legacy, a.confidence)
    elif a.command == "evaluate":
        workflows.evaluate_vcf(spark, a.input, a.truth, a.overlap_buffer, a.qual_filter).show()
    elif a.command == "train":
        print(workflows.train(spark, a.labelled, a.outdir, tuple(a.features.split(","))))
    else:
        reads = readers.read_sam(spark, a.tumour, "tumour")
        if a.normal:
            reads = reads.unionByName(readers.read_sam(spark, a.normal, "normal"))
        workflows.cna(spark, reads, a.ref_index, a.outdir, a.blacklist, matched=bool(a.normal))


if __name__ == "__main__":
    main()
