"""Whole workflows over small made-up inputs."""

import random

from pyspark.sql import functions as F

from tessera.plans import breakpoints, copy_number
from tessera.plans.params import CallParams, CnaParams
from tessera.sources import readers, writers


def sam(path):
    lines = ["@SQ\tSN:chr1\tLN:20000", "@SQ\tSN:chr2\tLN:20000"]
    seq = "A" * 1000
    for i in range(5):  # a junction, an insertion and a deletion
        lines.append(f"t{i}\t0\tchr1\t1001\t60\t970M30S\t*\t0\t0\t{seq}\t*\tSA:Z:chr2,5000,+,970S30M,60,0;\tHP:i:1")
        lines.append(f"i{i}\t0\tchr1\t{5000 + i}\t60\t{500 - i}M100I400M\t*\t0\t0\t{seq}\t*")
        lines.append(f"d{i}\t16\tchr2\t{9000 - i}\t60\t{400 + i}M200D{600 - i}M\t*\t0\t0\t{seq}\t*")
    path.write_text("\n".join(lines) + "\n")


def test_reads_to_calls_to_files(spark, tmp_path):
    sam(tmp_path / "t.sam")
    (tmp_path / "x.fai").write_text("chr1\t20000\t6\t60\t61\nchr2\t20000\t9\t60\t61\n")
    (tmp_path / "contigs.txt").write_text("chr1\nchr2\n")
    reads = readers.read_sam(spark, str(tmp_path / "t.sam"), "tumour")
    contigs = readers.read_contigs(spark, str(tmp_path / "contigs.txt"))
    got = breakpoints.call(reads, contigs, CallParams())
    calls = {(r["start_chr"], r["start"], r["end_chr"], r["end"], r["notation"], r["sv_length"], r["tumour_reads"], r["source"]) for r in got.collect()}
    assert calls == {
        ("chr1", 1970, "chr2", 5000, "+-", 0, 5, "SUPPLEMENTARY"), ("chr1", 5499, "chr1", 5499, "<INS>", 100, 5, "CIGAR"), ("chr2", 9399, "chr2", 9599, "+-", 200, 5, "CIGAR"),
    }
    d = got.filter("start = 9399").first()
    assert 0 < d["tumour_af_start"] <= 1 and d["normal_dp_start"] == 0
    edges = writers.vcf_edges(got.withColumns({"start_base": F.lit("N"), "end_base": F.lit("N")}))
    lengths = [(r["contig"], r["length"]) for r in readers.read_fai(spark, str(tmp_path / "x.fai")).collect()]
    writers.write_vcf(edges, str(tmp_path / "vcf"), lengths)
    back = readers.read_vcf(spark, str(tmp_path / "vcf"))
    assert back.count() == 5 and dict(back.dtypes)["TUMOUR_READ_SUPPORT"] == "bigint"
    assert {r["ALT"] for r in back.filter("SVTYPE = 'BND' AND CHROM = 'chr1'").collect()} == {"N[chr2:5000["}
    writers.write_bedpe(got, str(tmp_path / "bedpe"))
    writers.somatic_bedpe(back, str(tmp_path / "somatic"))
    assert spark.read.text(str(tmp_path / "bedpe")).count() == spark.read.text(str(tmp_path / "somatic")).count() == 3
    assert readers.truth_edges(back).count() == 5


def test_fasta_bed_and_windows(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a desc\nACGT\nNNAC\n>b\nTT\n")
    got = sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "r.fa"), 5).collect()))
    assert got == [("a", 0, "ACGTN"), ("a", 5, "NAC"), ("b", 0, "TT")]
    (tmp_path / "b.bed").write_text("chr1\t5\t9\tx\n")
    assert readers.read_bed(spark, str(tmp_path / "b.bed"), "name string").first()["name"] == "x"


def test_counts_to_absolute_copy_numbers(spark):
    rng = random.Random(3)
    rows = []
    for label, level in (("tumour", (2, 3, 2)), ("normal", (2, 2, 2))):
        for b in range(150):
            for _ in range(rng.randint(48, 52) * level[b // 50] // 2):
                at = b * 1000 + rng.randint(1, 900)
                rows.append((label, "chr1", at, at + 50, 0, 60))
    reads = spark.createDataFrame(rows, "label string, contig string, ref_start long, ref_end long, flags int, mapq int")
    contigs = spark.createDataFrame([("chr1", 150_000)], "contig string, length long")
    p = CnaParams(cn_binsize=1000, shuffles=200, ploidy=(1.5, 3.0, 0.05), cellularity=(0.8, 1.0, 0.1))
    profile = copy_number.relative_profile(reads, contigs, p)
    assert profile.count() == 150
    seg = copy_number.segments(profile, p).cache()
    starts = [r["start"] for r in seg.orderBy("start").collect()]
    assert len(starts) == 3 and abs(starts[1] - 50_001) <= 1000 and abs(starts[2] - 100_001) <= 1000
    ranked, out = copy_number.absolute(seg, p)
    cn = [r["copy_number"] for r in out.orderBy("start").collect()]
    assert ranked.count() >= 1 and cn[1] > cn[0] and abs(cn[0] - cn[2]) < 0.3


def test_run_then_classify(spark, tmp_path):
    """The VCF that calling writes goes through rules and parameters, with the reference's letters and written results."""
    import json

    from tessera.plans import workflows

    sam(tmp_path / "t.sam")
    (tmp_path / "n.sam").write_text("\n".join(x for x in (tmp_path / "t.sam").read_text().split("\n") if x.startswith("@") or x.startswith("d0")) + "\n")
    (tmp_path / "x.fai").write_text("chr1\t20000\t6\t60\t61\nchr2\t20000\t9\t60\t61\n")
    (tmp_path / "x.fa").write_text("".join(f">{c}\n" + "\n".join(["ACGT" * 15] * 334) + "\n" for c in ("chr1", "chr2")))
    out = str(tmp_path / "run")
    workflows.run(spark, str(tmp_path / "t.sam"), str(tmp_path / "n.sam"), str(tmp_path / "x.fai"), out, ref=str(tmp_path / "x.fa"))
    vcf = f"{out}/sv_breakpoints.vcf"
    v = {r["ID"]: r for r in readers.read_vcf(spark, vcf).collect()}
    assert all(r["REF"] == "ACGT"[(r["POS"] - 1) % 4] for r in v.values())
    junction = next(r for r in v.values() if r["POS"] == 1970)
    assert junction["ALT"] == f"{junction['REF']}[chr2:5000[" and junction["ORIGIN_MAPQ_MEAN"] == 60.0 and junction["END_STARTS_STD_DEV"] == 0.0 and junction["TUMOUR_DP_BEFORE"] == 5
    lines = lambda p: [r[0] for r in spark.read.text(str(p)).collect() if not r[0].startswith("#")]

    got = workflows.classify_vcf(spark, vcf, str(tmp_path / "rule"), min_support=3).collect()
    somatic = {r["ID"] for r in got if r["CLASS"] == "SOMATIC"}
    assert len(got) == 5 and len(lines(tmp_path / "rule.classified.vcf")) == 5
    assert {x.split("\t")[2] for x in lines(tmp_path / "rule.somatic.vcf")} == somatic and len(somatic) == 3
    assert all("CLASS=SOMATIC" in x and x.split("\t")[6] == "PASS" for x in lines(tmp_path / "rule.somatic.vcf"))
    assert len(lines(tmp_path / "rule.somatic.bedpe")) == 2
    assert {r["CLASS"] for r in workflows.classify_vcf(spark, vcf, str(tmp_path / "pb"), min_support=3, pb=True).collect()} == {"SOMATIC", "FAIL"}
    (tmp_path / "p.json").write_text(json.dumps({"somatic": {"MAX_NORMAL_READ_SUPPORT": 0, "MIN_TUMOUR_READ_SUPPORT": 3}, "germline": {"MIN_NORMAL_READ_SUPPORT": 1}}))
    workflows.classify_vcf(spark, vcf, str(tmp_path / "params"), params=str(tmp_path / "p.json"))
    assert len(lines(tmp_path / "params.passed_somatic.vcf")) == 3 and len(lines(tmp_path / "params.passed_germline.vcf")) == len(lines(tmp_path / "params.germline.vcf")) == 2
