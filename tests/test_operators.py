"""Miniature cases with results worked out by hand."""

import inspect
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import cigar, notation, numeric
from tessera.operators import alleles, bins, classify, clustering, consensus, coverage, evaluate, fit, ml, segment, smooth


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_gap_clusters_use_the_incoming_rows_buffer(spark):
    data = [(100, "+-", "a", "tumour"), (108, "+-", "b", "tumour"), (115, "+-", "c", "tumour"), (300, "<INS>", "d", "tumour"), (400, "+-", "e", "tumour")]
    df = spark.createDataFrame(data, "start long, notation string, read_name string, label string").withColumn("k", F.lit(1))
    buffer = F.when(F.col("notation") == "<INS>", 250).otherwise(10)
    c = clustering.gap_cluster(df, ["k"], "start", "start", buffer, ["read_name"])
    assert [r[1] for r in rows(c, "start", "cluster_id")] == [1, 1, 1, 1, 2]
    assert len(rows(clustering.keep_clusters(c, ["k", "cluster_id"], 3), "start")) == 4
    normal = c.withColumn("label", F.lit("normal"))
    assert clustering.keep_clusters(normal, ["k", "cluster_id"], 3).count() == 0
    for block in (7, 50, 1000):
        b = clustering.gap_cluster_blocks(df, ["k"], "start", "start", buffer, ["read_name"], block)
        assert rows(b, "start", "cluster_id") == rows(c, "start", "cluster_id")


def test_reverse_clusters_absorb_what_follows(spark):
    data = [(900, 1000, True), (9000, 1500, False), (1, 9999, False)]
    df = spark.createDataFrame(data, "start long, end long, spans boolean").withColumn("k", F.lit(1))
    got = clustering.flip_recluster(df, ["k"], "start", "end", "spans", 50, ["end"])
    assert got.select("end_cluster").distinct().count() == 1
    got = clustering.flip_recluster(df.withColumn("spans", F.lit(False)), ["k"], "start", "end", "spans", 50, ["end"])
    assert got.select("end_cluster").distinct().count() == 3


def test_length_chains(spark):
    df = spark.createDataFrame([(50,), (60,), (75,), (100,), (126,), (None,)], "n long").withColumn("k", F.lit(1))
    assert dict(rows(clustering.length_chains(df, ["k"], "n", []), "n", "length_group")) == {50: 1, 60: 1, 75: 1, 100: 2, 126: 3, None: 3}
    none = df.filter("n IS NULL")
    assert rows(clustering.length_chains(none, ["k"], "n", []), "length_group") == [(1,)]


def test_coverage_depth_and_fraction(spark):
    reads = spark.createDataFrame([("a", 12, 31), ("a", 100, 101), ("b", 0, 50)], "c string, s long, e long")
    d = coverage.coverage(reads, ["c"], "s", "e", 5)
    assert rows(d.filter("c = 'a'"), "bin", "depth") == [(2, 1), (3, 1), (4, 1), (5, 1)]
    breaks = spark.createDataFrame([("a", 14), ("a", 14), ("a", 31), ("b", 49), ("z", 3)], "c string, pos long")
    got = sorted(map(tuple, coverage.depth_at(breaks, d, ["c"], "pos", 5).collect()))
    assert got == [("a", 14, 0, 1, 1), ("a", 14, 0, 1, 1), ("a", 31, 1, 0, 0), ("b", 49, 1, 1, 0), ("z", 3, 0, 0, 0)]
    af = spark.createDataFrame([(7, 5), (5, 0), (1, 3)], "s long, d long").select(coverage.allele_fraction(F.col("s"), F.col("d")).alias("af"))
    assert [r[0] for r in af.collect()] == [1.0, 0.0, 0.333]


def test_reads_per_bin_counts_ends_inside(spark):
    for read, want in {(0, 5): [0], (2, 18): [0, 1], (10, 11): [], (0, 25): [2]}.items():
        df = spark.createDataFrame([read], "s long, e long").withColumn("k", F.lit(1))
        assert [r[0] for r in rows(bins.reads_per_bin(df, ["k"], "s", "e", 10), "bin")] == want, read


def test_smoothing(spark):
    df = spark.createDataFrame(list(enumerate([0.0, 0.1, 5.0, 0.2, 0.1])), "i int, x double").withColumns({"k": F.lit(1), "o": F.lit(1.0), "s": F.lit(0.5)})
    got = [round(r[1], 6) for r in rows(smooth.smooth_outliers(df, ["k"], "x", ["i"], 2, "o", "s"), "i", "smoothed")]
    assert got == [0, 0.1, 0.6, 0.2, 0.1]
    assert abs(numeric.inflation_factor(0.025) - 1.3177980408) < 1e-6


def test_cigar_and_sa(spark):
    df = spark.createDataFrame([("chr2,5000,-,30S970M,60,5;",)], "sa string").select(F.explode(cigar.chimeric_regions(F.col("sa"))).alias("r"))
    r = df.select("r.*").first()
    assert (r["left_softclip"], r["right_softclip"], r["consumed_query"], r["consumed_reference"]) == (0, 30, 970, 970)
    ops = cigar.operations(F.lit("5S100M40D3M60D10M40I50M35D"))
    e = spark.range(1).select(cigar.events_of(ops, F.lit(30)).alias("e")).first()["e"]
    assert [(x["kind"], x["r"], x["len"]) for x in e] == [("DEL", 100, 103), ("INS", 213, 40), ("DEL", 263, 35)]
    assert spark.range(1).select(cigar.reverse_complement(F.lit("AACGt"))).first()[0] == "aCGTT"


def test_cigar_keeps_long_operations_alone(spark):
    rng = random.Random(8)
    texts = ["".join(f"{rng.randint(1, 60)}{rng.choice('MIDNSH=X')}" for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["*", "", "5M7", "031M40D", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string").withColumn("o", cigar.operations(F.col("c")))
    got = df.select("c", "o", cigar.total(F.col("o")).alias("all"), cigar.consumed_query(F.col("o")).alias("q"), cigar.cursors(F.col("o"), F.lit(30)).alias("long"), cigar.events_of(F.col("o"), F.lit(30)).alias("e")).collect()
    for x in got:
        if x["c"] is None:
            assert all(v is None for v in x)
            continue
        ops = [(o, int(n)) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", x["c"])]
        at = [(o, n, sum(m for p, m in ops[:i] if p in "MIS=X"), sum(m for p, m in ops[:i] if p in "MDN=X")) for i, (o, n) in enumerate(ops)]
        assert [tuple(o) for o in x["o"]] == ops and x["all"] == sum(n for _, n in ops) and x["q"] == sum(n for o, n in ops if o in "MIS=X")
        assert [tuple(o) for o in x["long"]] == [a for a in at if a[1] > 30]
        want, began, to = [], None, None
        for o, n, q, r in [a for a in at if a[1] > 30] + [("end", 0, 0, 0)]:
            if o == "D":
                began, to = r if began is None else began, r + n
                continue
            if began is not None:
                want.append(("DEL", None, began, to - began))
            began = None
            if o == "I":
                want.append(("INS", q, r, n))
        assert [tuple(v) for v in x["e"]] == want


def test_notations(spark):
    def alts(n):
        c = notation.alt_alleles(F.lit(n), F.lit("chr1"), F.lit(10), F.lit("chr2"), F.lit(20), F.lit("N"), F.lit("N"))
        return spark.range(1).select(c).first()[0]

    assert alts("+-") == ["N[chr2:20[", "]chr1:10]N"] and alts("--") == ["[chr2:20[N", "[chr1:10[N"]
    line = notation.bedpe_line(F.lit("chr1"), F.lit(100), F.lit("chr1"), F.lit(250), F.lit(4), F.lit(150), F.lit(5), F.lit(0), F.lit("+-"))
    assert spark.range(1).select(line).first()[0].endswith("ID_4|150bp|TUMOUR_5/NORMAL_0|+-")
    fasta = notation.insertion_fasta(F.lit(1), F.lit("<INS>"), F.array(F.lit("A" * 81)))
    assert spark.range(1).select(fasta).first()[0] == [">ID_1-INSSEQ_00001 | <INS> | 1/1 | 81bp\n" + "A" * 80 + "\nA"]
    assert spark.range(1).select(*notation.mate_of_alt(F.lit("N[chr2:20["))).first() == ("chr2", 20)


def test_copy_numbers(spark):
    d = lambda x: F.lit(float(x))
    r = spark.range(1).select(numeric.absolute_copy_number(d(1.5), d(0.8), d(2)), numeric.allele_copy_number(d(1.5), d(0.3), d(0.8), d(2)), numeric.allele_copy_number(d(1.5), d(0.7), d(0.8), d(2))).first()
    assert [round(x, 6) for x in r] == [3.25, 0.875, 2.375]
    assert numeric.search_space(0.2, 0.5, 0.1) == [0.2, 0.3, 0.4, 0.5] and numeric.search_space(1, 1, 0.1) == []
    seg = spark.createDataFrame([("s1", 1, 2.0), ("s2", 101, 2.2), ("s3", 201, 3.0), ("s4", 301, 1.0)], "segment_id string, start long, copy_number double").withColumns({"k": F.lit(1), "end": F.col("start") + 99})
    assert rows(classify.change_points(seg, ["k"]), "run_start", "run_end", "segment") == [(1, 201, "s1"), (201, 301, "s3")]


def _zero_events(spark):
    data = [(1, 1, 10, "view", 0.0), (1, 2, 20, "error", 490.0), (1, 3, 30, "view", None), (2, 4, 40, "error", 0.0), (2, 5, 50, "view", 245.0)]
    return spark.createDataFrame(data, "user_id long, event_id long, pos long, event_type string, value double")


def test_segments_of_no_reads_have_no_copies(spark, monkeypatch):
    from tessera.queries import cna

    monkeypatch.setattr(cna, "events", lambda *_: _zero_events(spark))
    assert rows(cna.segment_collapse(spark, ""), "seg_id", "bin_count", "relative_cn") == [("u1_seg0", 3, 0.0), ("u2_seg0", 2, 0.0)]
    assert rows(cna.sv_split_segments(spark, ""), "split_id", "n_bins", "seg_log2r") == [("u1_seg0", 1, float("-inf")), ("u1_seg0-SV1", 2, 1.0), ("u2_seg0-SV1", 2, float("-inf"))]
    got = spark.createDataFrame([(0.0,), (8.0,), (-1.0,), (None,)], "x double").select(numeric.log2(F.col("x")).alias("y")).collect()
    assert [str(r[0]) for r in got] == ["-inf", "3.0", "nan", "None"]
    first_missing = spark.createDataFrame([(1, 5, None), (7, 9, 1.0)], "start long, end long, seg_log2r double").withColumns({"k": F.lit(1), "seg_id": F.lit("s")})
    assert rows(fit.collapse_segments(first_missing, ["k"]), "relative_cn") == [(2.0,)]


def test_bins_that_share_a_start_share_the_segment(spark, monkeypatch):
    from tessera.queries import cna

    data = [(1, i, 0, kind, 245.0 * v) for i, kind, v in [(1, "view", 1), (2, "view", 1), (2, "error", 2), (2, "error", 4), (2, None, 8), (3, "view", 4), (3, "view", 4), (4, "error", 4), (4, "error", 4), (None, "error", 1)]]
    monkeypatch.setattr(cna, "events", lambda *_: spark.createDataFrame(data, "user_id long, event_id long, pos long, event_type string, value double"))
    assert rows(cna.sv_split_segments(spark, ""), "split_id", "n_bins", "seg_log2r") == [("u1_seg0", 1, 0.0), ("u1_seg0-SV2", 6, 2.0), ("u1_seg0-SV4", 2, 2.0), (None, 1, 0.0)]


def test_smoothing_of_zeros(spark, monkeypatch):
    from tessera.queries import cna

    data = [(1, i, i, "view", v) for i, v in enumerate([4.0, 0.0, 4.0, 0.0, 4.0])]
    ev = spark.createDataFrame(data, "user_id long, event_id long, pos long, event_type string, value double")
    monkeypatch.setattr(cna, "events", lambda *_: ev)
    assert [r[1] for r in rows(cna.smooth_outliers(spark, ""), "event_id", "smoothed")] == [2.0, float("-inf"), 2.0, float("-inf"), 2.0]
    monkeypatch.setattr(cna, "events", lambda *_: ev.filter("event_id < 3"))
    assert [r[1] for r in rows(cna.smooth_outliers(spark, ""), "event_id", "smoothed")] == [2.0, 1.75, 2.0]


def test_exclusive_matching(spark):
    calls = spark.createDataFrame([(1, 1010), (2, 1005), (3, 5000)], "call_id long, call_pos long").withColumn("k", F.lit(1))
    truth = spark.createDataFrame([(9, 1000)], "truth_id long, truth_pos long").withColumn("k", F.lit(1))
    near = evaluate.within(calls, truth, ["k"], "call_pos", "truth_pos", 100)
    assert near.count() == 2
    assert rows(evaluate.exclusive_nearest(near, ["k"], "call_id", "truth_id"), "call_id", "truth_id", "distance") == [(2, 9, 5)]
    assert len(rows(evaluate.exclusive_nearest(near, ["k"], "call_id", "truth_id", uses=2), "call_id")) == 2


def test_label_counts_credit_the_first_label(spark):
    df = spark.createDataFrame([("r", "tumour", 1), ("r", "normal", 2), ("s", "normal", 3)], "read_name string, label string, start long").withColumn("k", F.lit(1))
    got = consensus.label_counts(df, ["k"], hp=None).first()
    assert (got["tumour_reads"], got["normal_reads"], got["tumour_alns"], got["normal_alns"]) == (1, 1, 1, 2)


def test_segmentation_finds_steps_and_repeats_itself(spark):
    rng = random.Random(1)
    data = [("chr1", i, i + 1, rng.gauss((0, 1, -1)[(i >= 60) + (i >= 130)], 0.1)) for i in range(200)]
    df = spark.createDataFrame(data, "contig string, start long, end long, log2r double").repartition(7)
    got = segment.segment_profiles(df, shuffles=200)
    ends = [tuple(r) for r in got.groupBy("seg_id").agg(F.min("start").alias("a"), F.max("start").alias("b")).orderBy("a").select("a", "b").collect()]
    assert [a for a, _ in ends] == [0, 60, 130]
    assert rows(got, "start", "seg_id") == rows(segment.segment_profiles(df.coalesce(1), shuffles=200), "start", "seg_id")


def test_pair_quantile_of_many_values_is_numpys():
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=1203), rng.integers(0, 40, 1100) / 7, np.full(1001, 0.3)):
        i, j = np.triu_indices(len(values), 1)
        pairs = np.abs(values[i] - values[j])
        for q in (0.0, 0.2, 0.77, 1.0):
            assert segment.pair_quantile(list(values), q) == np.quantile(pairs, q)


def test_profiles_pass_through_python_in_small_batches(spark):
    rng = random.Random(5)
    data = [(c, i // 2, i, None if c == "c" and i % 50 == 7 else float("-inf") if i % 40 == 3 else rng.gauss((0, 2, -2)[(i >= 100) + (i >= 200)], 0.2)) for c in "abc" for i in range(300)]
    df = spark.createDataFrame(data, "contig string, start long, event_id long, log2r double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = rows(segment.segment_profiles(df.repartition(5), shuffles=100), "contig", "event_id", "seg_id", "seg_log2r")
        assert got == rows(segment.segment_profiles(df.orderBy(F.desc("event_id")).coalesce(1), shuffles=100), "contig", "event_id", "seg_id", "seg_log2r")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 900 and {(r[1], r[2]) for r in got if r[0] == "a" and r[1] in (99, 100)} == {(99, "a_seg1"), (100, "a_seg2")}
    plan = segment.segment_profiles(df)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan


def test_fit_recovers_purity_and_ploidy(spark):
    p, q = 0.7, 2.3
    copies = [2, 2, 2, 3, 1, 2, 4, 2, 3, 2, 3]
    rel = [1 + (c - q) / (q + 2 / p - 2) for c in copies]
    seg = spark.createDataFrame([(i, r, 1.0) for i, r in enumerate(rel)], "ord int, relative_cn double, weight double")
    best = fit.fit_purity_ploidy(seg, (0.4, 1.0, 0.05), (1.5, 3.5, 0.1)).filter("distance < 0.01")
    assert (p, q) in {(round(r["purity"], 2), round(r["ploidy"], 2)) for r in best.collect()}


def test_grid_sums_follow_whole_numbers_not_segments(spark, monkeypatch):
    rng = np.random.default_rng(6)
    r = np.concatenate([np.round(rng.exponential(0.4, 4000), 3), [0.0, 0.5, -0.7, 1e6, 40.25]])  # 5 lie outside the cells of many
    w = rng.integers(1, 10, len(r)) / 5
    purity, ploidy = np.array([0.2, 0.35, 0.8, 1.0, 1.0, 0.0]), np.array([5.0, 1.5, 2.3, 4.0, 0.0, 2.0])
    slope = np.array([p + 2 / q - 2 if q > 0 else p for q, p in zip(purity, ploidy)])
    origin, shift = np.where(purity > 0, ploidy, 0.0), np.where(purity > 0, 1.0, 0.0)
    cn = origin + (r[:, None] - shift) * slope
    each, seen = fit._far_each, []
    monkeypatch.setattr(fit, "_far_each", lambda r, *a: seen.append((len(r), len(a[1]))) or each(r, *a))
    for squared in (True, False):
        d = np.abs(cn - np.rint(cn))
        want = w @ (d * d if squared else d)
        assert np.abs(fit.far_sums(r, w, origin, shift, slope, squared).astype(float) / want - 1)[slope != 0].max() < 1e-12
    assert sum(n for n, points in seen if points == 5) < 800  # of 8,010; the point of no slope is summed alone
    seg = spark.createDataFrame(pd.DataFrame({"relative_cn": r[:4002], "weight": w[:4002]})).repartition(3)
    got = {(x["i"], x["j"]): x["distance"] for x in fit.grid_distances(seg, fit.grid(spark, [0.2, 0.8], [1.5, 2.3])).collect()}
    for i, p in enumerate((0.2, 0.8)):
        for j, q in enumerate((1.5, 2.3)):
            cn = q + (r[:4002] - 1) * (q + 2 / p - 2)
            assert abs(got[i, j] - np.sqrt((w[:4002] @ (cn - np.rint(cn)) ** 2) / w[:4002].sum())) < 1e-13


def test_forest_and_conformal_sets(spark):
    rng = random.Random(2)
    data = [(i, float(y), y * 2 + rng.gauss(0, 0.4), rng.random()) for i in range(600) for y in [rng.randint(0, 1)]]
    df = spark.createDataFrame(data, "row_id long, label double, a double, b double")
    model, cal, held = ml.fit_conformal(df, ["a", "b"], trees=10, depth=4)
    scored = ml.predict(model, held)
    assert ml.area_under_pr(scored) > 0.95
    got = classify.mondrian_classes(scored.select("row_id", "s0", "s1"), cal, 0.8).join(held, "row_id")
    c = ml.confusion(got.withColumn("label", F.col("label").cast("int")), "label", "class").first()
    assert got.count() == held.count() and c["tp"] + c["tn"] > 5 * (c["fp"] + c["fn"])


def test_pileup(spark):
    reads = spark.createDataFrame([("c", 10, 0, 60, "2S3M1I2M1D2M", "NNACGTACGT"), ("c", 10, 0x100, 60, "3M", "AAA"), ("c", 10, 0, 1, "3M", "AAA")], "contig string, ref_start long, flags int, mapq int, cigar string, seq string")
    assert rows(alleles.pileup(reads), "pos", "base") == [(10, "A"), (11, "C"), (12, "G"), (13, "A"), (14, "C"), (16, "G"), (17, "T")]


def test_modes_do_not_depend_on_the_number_of_values():
    rng = np.random.default_rng(3)
    for n in (9_999, 10_000, 30_000):
        x = np.concatenate([rng.normal(0.3, 0.05, n), rng.normal(0.7, 0.05, n)])
        got = fit.kde_modes(x)
        assert [round(p, 1) for p, _ in got] == [0.3, 0.7] and all(abs(s - 0.5) < 0.02 for _, s in got), n
    few = rng.normal(0.5, 0.1, 5_000)
    assert len(fit.kde_modes(few)) == len(fit.kde_modes(np.repeat(few, 5))) == 1


def test_modes_count_equal_fractions_once(spark):
    rng = np.random.default_rng(7)
    x = np.round(np.concatenate([rng.normal(0.3, 0.05, 4000), rng.normal(0.7, 0.05, 6000)]), 2)
    seen, counts = np.unique(x, return_counts=True)
    got, want = fit.kde_modes(seen, counts=counts), fit.kde_modes(x)
    assert len(got) == 2 and np.allclose(got, want, rtol=1e-12) and [round(p, 1) for p, _ in got] == [0.3, 0.7]
    width = x.std(ddof=1) * len(x) ** -0.2
    at = np.linspace(x.min() - width, x.max() + width, 1000)
    density = np.exp(-0.5 * ((at[:, None] - x) / width) ** 2).sum(1)
    assert abs(got[1][0] - at[500 + density[500:].argmax()]) < 1e-9
    sites = spark.createDataFrame(pd.DataFrame({"block_id": 1, "af_0": x, "af_1": 1 - x})).unionAll(spark.createDataFrame([(1, None, None), (2, None, 0.5)], "block_id long, af_0 double, af_1 double"))
    many = fit.block_modes(sites)
    assert rows(many, "block_id", "n_modes") == [(1, len(fit.kde_modes(np.concatenate([x, 1 - x])))), (2, 0)]
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInPandas") < plan.index("HashAggregate")  # counted before Python


def test_registered_queries_keep_the_operators_defaults(spark, monkeypatch):
    from tessera.queries import cna, learn

    seen = {}

    def spy(f):
        def run(*args, **named):
            bound = inspect.signature(f).bind(*args, **named)
            bound.apply_defaults()
            seen.update(bound.arguments)
            raise StopIteration

        return run

    events = spark.createDataFrame([(1, 1, 5, "view", 2.0)], "user_id long, event_id long, pos long, event_type string, value double")
    docs = spark.createDataFrame([(1, 3, "a b", 1)], "doc_id long, n_chars long, text string, quality int")
    monkeypatch.setattr(cna, "events", lambda *_: events)
    monkeypatch.setattr(learn, "load", lambda _s, _d, name: docs.select("doc_id", "quality") if name == "labels" else docs.drop("quality"))
    monkeypatch.setattr(segment, "segment_profiles", spy(segment.segment_profiles))
    monkeypatch.setattr(ml, "train_forest", spy(ml.train_forest))
    for q in (cna.cbs_segments, learn.rf_train_predict):
        with pytest.raises(StopIteration):
            q(spark, "")
    assert (seen["shuffles"], seen["trees"], seen["depth"]) == (1000, 100, 20)


def test_rescue_takes_eligible_variants_only(spark):
    v = spark.createDataFrame([(1, 100, 9, 1, 0), (2, 101, 8, 0, 3), (3, 102, 2, 0, 0), (4, 103, 3, 0, 2), (5, 500, 2, 0, 0)], "variant_id long, pos long, t int, n int, cn int").withColumn("k", F.lit(1))
    points = spark.createDataFrame([(100, 300, "s1"), (500, 700, "s2")], "run_start long, run_end long, segment string").withColumn("k", F.lit(1))
    got = classify.rescue_by_copy_number(v, points, ["k"], "pos", 50, "t", min_support=3, normal="n", clustered_normal="cn")
    assert rows(got, "variant_id", "segment") == [(4, "s1")]
    got = classify.rescue_by_copy_number(v, points, ["k"], "pos", 50, "t", min_support=3)  # no normal sample
    assert rows(got, "variant_id", "segment") == [(1, "s1")]


def test_solutions_over_the_production_grid_match_brute_force(spark, monkeypatch):
    from tessera.queries import cna

    p, q = 0.67, 2.33  # off the coarse grid of 0.05
    copies = [2, 2, 2, 3, 1, 2, 4, 2, 3, 2, 3]
    rel = np.array([1 + (c - q) / (q + 2 / p - 2) for c in copies])
    seg = spark.createDataFrame([(i, float(r), 1.0) for i, r in enumerate(rel)], "start int, relative_cn double, weight double")
    monkeypatch.setattr(cna, "_segments", lambda *_: seg)
    got = {(r["i"], r["j"]) for r in cna.purity_ploidy_solutions(spark, "").collect()}
    pu, pl = np.array(numeric.search_space(0.2, 1.0, 0.01)), np.array(numeric.search_space(1.5, 5.0, 0.01))
    assert (len(pu), len(pl)) == (81, 351)
    cn = pl[None, :, None] + (rel - 1) * (pl[None, :, None] + 2 / pu[:, None, None] - 2)
    d = np.sqrt(((cn - np.rint(cn)) ** 2).mean(2))
    wide = np.pad(d, 1, constant_values=np.inf)
    near = np.min([wide[a : a + 81, b : b + 351] for a in range(3) for b in range(3)], 0)
    low = [(i, j) for i, j in zip(*np.nonzero(d <= near))]
    least = min(d[c] for c in low)
    want = set()
    for c in low:
        s = np.rint(cn[c]).tolist()
        top = sorted(set(s), key=lambda x: (-s.count(x), s.index(x)))[:2]
        if (d[c] < 1.25 * least or d[c] == least) and (cn[c] <= 0).mean() <= 0.1 and (abs(cn[c] - s) < 0.25).mean() >= 0.5 and abs(top[0] - top[-1]) <= 1:
            want.add((int(c[0]), int(c[1])))
    assert got == want and any(abs(pu[i] - p) < 1e-9 and abs(pl[j] - q) < 1e-9 for i, j in got)
