"""Workflows over files: call, classify, evaluate, train, copy numbers; all of them, or the tumour alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import classify, evaluate, ml
from tessera.plans import breakpoints, copy_number
from tessera.plans.params import CallParams, CnaParams
from tessera.sources import readers, writers


def run(spark: SparkSession, tumour: str, normal: str | None, fai: str, out: str, contigs: str | None = None, params: CallParams | None = None, ref: str | None = None) -> DataFrame:
    """Calls from SAM text or Parquet of aligned reads; writes raw VCF and BEDPE under ``out``. Without ``normal``: tumour only; without ``ref`` (FASTA) bases are N.

    The calls, far fewer than reads, are written once and read again by all writers."""
    read = lambda path, label: spark.read.parquet(path).withColumn("label", F.lit(label)) if path.rstrip("/").endswith(".parquet") else readers.read_sam(spark, path, label)
    reads = read(tumour, "tumour")
    if normal:
        reads = reads.unionByName(read(normal, "normal"))
    lengths = [(r["contig"], r["length"]) for r in readers.read_fai(spark, fai).collect()]  # one row a chromosome
    names = readers.read_contigs(spark, contigs) if contigs else spark.createDataFrame([(c, i) for i, (c, _) in enumerate(lengths)], "contig string, ord int")
    breakpoints.call(reads, names, params).write.parquet(f"{out}/calls.parquet")
    called = spark.read.parquet(f"{out}/calls.parquet")
    bases = called.withColumns({"start_base": F.lit("N"), "end_base": F.lit("N")})
    if ref:
        bases = with_base(with_base(called, readers.read_fasta(spark, ref), "start"), readers.read_fasta(spark, ref), "end")
    edges = writers.vcf_edges(bases)
    writers.write_vcf(edges, f"{out}/sv_breakpoints.vcf", lengths)
    writers.write_bedpe(called, f"{out}/sv_breakpoints.bedpe")
    return called


def with_base(calls: DataFrame, reference: DataFrame, edge: str, chunk: int = 1_000_000) -> DataFrame:
    """``<edge>_base``: the reference's letter at the edge's position, N where there is none."""
    pieces = reference.select(F.col("contig").alias(f"{edge}_chr"), F.col("offset").alias("_at"), "seq")
    at = F.col(edge) - 1
    rows = calls.withColumn("_at", (F.floor(F.greatest(at, F.lit(0)) / chunk) * chunk).cast("long")).join(pieces, [f"{edge}_chr", "_at"], "left")
    letter = F.nullif(F.upper(F.substring("seq", (at - F.col("_at") + 1).cast("int"), F.lit(1))), F.lit(""))
    return rows.withColumn(f"{edge}_base", F.coalesce(F.when(at >= 0, letter), F.lit("N"))).drop("_at", "seq")


#: Classes of a model's final numbers; fixed values.
MODEL_CLASSES = {1: "PREDICTED_SOMATIC", 2: "PREDICTED_GERMLINE", 4: "LOW_SUPPORT", 5: "LOW_AF", -1: "NEITHER", -2: "BOTH"}
SOMATIC = ("PREDICTED_SOMATIC", "SOMATIC", "RESCUED_CNA", "PASSED_SOMATIC", "PASSED_SOMATIC_STRICT", "PASSED_SOMATIC_LENIENT")
GERMLINE = ("PREDICTED_GERMLINE", "PASSED_GERMLINE")


def amplified(v: DataFrame) -> Column:
    """Mean depth of the tumour over five times the normal's, before, at and after the edge."""
    if not {"TUMOUR_DP_AT", "NORMAL_DP_AT"} <= set(v.columns):
        return F.lit(False)
    mean = lambda x: sum((F.coalesce(F.col(f"{x}_DP_{w}"), F.lit(0)) for w in ("BEFORE", "AT", "AFTER")), F.lit(0)) / 3
    return mean("TUMOUR") > 5 * mean("NORMAL")


def _by_model(spark: SparkSession, v: DataFrame, model: str, min_support: int, min_af: float, confidence: float | None) -> DataFrame:
    from pyspark.ml import PipelineModel

    scored = ml.predict(PipelineModel.load(f"{model}/model" if confidence is not None else model), ml.format_features(v)).withColumn("pred", F.col("prediction").cast("int"))
    if confidence is not None:
        told = classify.mondrian_classes(scored.select(F.xxhash64("ID").alias("row_id"), "s0", "s1").dropDuplicates(["row_id"]), spark.read.parquet(f"{model}/calibration"), confidence)
        scored = scored.drop("pred").withColumn("row_id", F.xxhash64("ID")).join(told.select("row_id", F.col("class").alias("pred")), "row_id")
    rows = scored.select(
        "ID", "MATEID", "pred", F.col("TUMOUR_READ_SUPPORT").alias("tumour"), F.col("NORMAL_READ_SUPPORT").alias("normal"),
        F.col("TUMOUR_AF_0").alias("af"), F.col("NORMAL_AF_0").alias("normal_af"), amplified(scored).alias("amplified"),
    )
    final = classify.reconcile_model_classes(rows, min_support, min_af).select("ID", "class")
    name = F.coalesce(*[F.when(F.col("class") == k, n) for k, n in MODEL_CLASSES.items()], F.lit("PREDICTED_NOISE"))
    return v.join(final, "ID").withColumn("CLASS", name)


def _by_legacy_rules(v: DataFrame) -> DataFrame:
    c = F.col
    eh = classify.heterogeneity(c("END_EVENT_SIZE_STD_DEV"), c("END_EVENT_SIZE_MEDIAN"))
    strict = classify.legacy_strict(c("TUMOUR_READ_SUPPORT"), c("NORMAL_READ_SUPPORT"), c("ORIGIN_STARTS_STD_DEV"), c("ORIGIN_EVENT_SIZE_STD_DEV"), c("END_STARTS_STD_DEV"), c("END_EVENT_SIZE_STD_DEV"))(eh)
    lenient = classify.legacy_lenient(c("TUMOUR_READ_SUPPORT"), c("NORMAL_READ_SUPPORT"), c("ORIGIN_STARTS_STD_DEV"), eh, c("SVTYPE") == "INS")
    out = classify.with_mates(classify.with_mates(v, strict, "strict"), lenient, "lenient")
    return out.withColumn("CLASS", F.when(c("strict"), "PASSED_SOMATIC_STRICT").when(c("lenient"), "PASSED_SOMATIC_LENIENT").otherwise("NOISE"))


def classify_vcf(
    spark: SparkSession, vcf: str, out: str, params: str | None = None, model: str | None = None, min_support: int = 7, min_af: float = 0.1, pb: bool = False,
    legacy: bool = False, confidence: float | None = None,
) -> DataFrame:
    """Variants with their CLASS by the legacy rules, by parameters (JSON), by a saved model, or by rule (``pb``: that for high-accuracy reads).

    Under ``out``: a Parquet table; beside it VCFs of all, somatic and germline variants and of each category of parameters, and a
    BEDPE of the somatic ones. With ``confidence`` the model's folder holds its calibration, and classes are conformal.
    """
    v = readers.read_vcf(spark, vcf)
    if legacy:
        out_df = _by_legacy_rules(v)
    elif params:
        out_df = classify.by_params(v, readers.read_params(params)).withColumn("CLASS", F.array_join("categories", ","))
    elif model:
        out_df = _by_model(spark, v, model, min_support, min_af, confidence)
    elif pb:
        out_df = classify.with_mates(v, classify.pacbio_somatic(min_support, min_af), "somatic").withColumn("CLASS", F.when(F.col("somatic"), "SOMATIC").otherwise("FAIL"))
    else:
        rule = classify.params_predicate({"MAX_NORMAL_READ_SUPPORT": 0, "MIN_TUMOUR_READ_SUPPORT": min_support})
        out_df = classify.with_mates(v, rule, "somatic").withColumn("CLASS", F.when(F.col("somatic"), "SOMATIC").otherwise("NOISE"))
    out_df.write.parquet(out)
    done = spark.read.parquet(out)
    write_classified(done, out.rstrip("/"), params and sorted(readers.read_params(params)))
    return done


def write_classified(v: DataFrame, stem: str, categories: list[str] | None = None) -> None:
    """``<stem>.classified.vcf``, ``.somatic.vcf``, ``.germline.vcf``, one for each category, and ``.somatic.bedpe``."""
    contigs = sorted((r[0], 0) for r in v.select("CHROM").distinct().collect())  # a row a chromosome
    passed = F.split("CLASS", ",")
    keeps = F.arrays_overlap(passed, F.array(*[F.lit(x) for x in (*SOMATIC, *GERMLINE)])) | passed[0].startswith("PASSED_")
    rows = v.withColumn("FILTER", F.when(keeps, "PASS").when(F.col("CLASS") == "", "FAIL").otherwise(F.col("CLASS")))
    fields = (*writers.INFO, ("CLASS", ".", "String", "Class of the variant"))
    is_one_of = lambda names: F.arrays_overlap(passed, F.array(*[F.lit(x) for x in names]))
    parts = {"classified": F.lit(True), "somatic": is_one_of(SOMATIC), "germline": is_one_of(GERMLINE)} | {f"passed_{c.lower()}": is_one_of([f"PASSED_{c.upper()}"]) for c in categories or ()}
    for name, rule in parts.items():
        writers.write_vcf(rows.filter(rule), f"{stem}.{name}.vcf", contigs, fields)
    if {"SVLEN", "TUMOUR_READ_SUPPORT", "NORMAL_READ_SUPPORT", "BP_NOTATION"} <= set(v.columns):
        writers.somatic_bedpe(rows.filter(is_one_of(SOMATIC)), f"{stem}.somatic.bedpe")


def evaluate_vcf(spark: SparkSession, vcf: str, truth: str, buffer: int = 100, min_qual: float | None = None) -> DataFrame:
    """One row of precision, recall and F of the calls' edges against a truth set."""
    calls = readers.truth_edges(readers.read_vcf(spark, vcf), min_qual).select("contig", F.concat("variant_id", F.lit("@"), F.col("pos").cast("string")).alias("call_id"), F.col("pos").alias("call_pos"))
    true = readers.truth_edges(readers.read_vcf(spark, truth)).select("contig", F.concat("variant_id", F.lit("@"), F.col("pos").cast("string")).alias("truth_id"), F.col("pos").alias("truth_pos"))
    hits = evaluate.exclusive_nearest(evaluate.within(calls, true, ["contig"], "call_pos", "truth_pos", buffer), ["contig"], "call_id", "truth_id")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_", F.lit(1))
    one = n(hits, "tp").join(n(calls, "calls"), "_").join(n(true, "truths"), "_")
    return evaluate.precision_recall(one.select("tp", (F.col("calls") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("fn")))


def train(spark: SparkSession, labelled: str, out: str, features: tuple[str, ...], label: str = "LABEL", positive: str = "SOMATIC") -> float:
    """Fit and save a forest on labelled variants (Parquet); returns the area under precision and recall of held-out ones."""
    rows = ml.sane_labels(spark.read.parquet(labelled), label).filter(F.col(label) != "NOT_IN_COMPARISON")
    x = ml.format_features(rows.withColumn("label", (F.col(label) == positive).cast("double")))
    model, calibration, held = ml.fit_conformal(x, list(features))
    model.write().overwrite().save(f"{out}/model")
    calibration.write.mode("overwrite").parquet(f"{out}/calibration")
    return ml.area_under_pr(ml.predict(model, held))


def cna(spark: SparkSession, alignments: DataFrame, fai: str, out: str, excluded: str | None = None, breaks: DataFrame | None = None, params: CnaParams | None = None, matched: bool = True, sites: DataFrame | None = None) -> DataFrame:
    """Absolute copy numbers; each step's table is written under ``out``."""
    p = params or CnaParams()
    profile = copy_number.relative_profile(alignments, readers.read_fai(spark, fai), p, readers.read_bed(spark, excluded) if excluded else None, matched)
    profile.write.parquet(f"{out}/log2r")
    copy_number.segments(spark.read.parquet(f"{out}/log2r"), p, breaks).write.parquet(f"{out}/segments")
    ranked, absolute = copy_number.absolute(spark.read.parquet(f"{out}/segments"), p, sites)
    writers.write_tsv(ranked.orderBy("rank"), f"{out}/ranked_solutions")
    writers.write_tsv(absolute.drop("ord"), f"{out}/absolute_copy_number")
    return absolute
