"""Queries on breakpoints: clustering, support, depth, calls, classification and comparison.

Users stand for chromosomes, event times for positions, event types for labels, sources and notations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cigar, notation
from tessera.operators import classify, clustering, consensus, coverage, evaluate
from tessera.queries.registry import EVENTS, HOUR, events, load, query

_CLUSTERED = f"""{EVENTS},
p AS (SELECT *, max(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM e),
n AS (SELECT *, CASE WHEN pe IS NULL OR pe + CASE WHEN event_type = 'error' THEN {4 * HOUR} ELSE {HOUR} END < pos THEN 1 ELSE 0 END AS new FROM p),
c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS BIGINT) AS cluster_id FROM n)"""


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    buffer = F.when(F.col("event_type") == "error", 4 * HOUR).otherwise(HOUR)
    return clustering.gap_cluster(events(spark, sf_dir), ["user_id"], "pos", "pos", buffer, ["event_id"])


@query(f"""
WITH {_CLUSTERED}
SELECT user_id, cluster_id, count(*) AS n_rows, round_even(stddev_pop(pos / 1000000.0::DOUBLE), 3) AS starts_std_dev, round_even(avg(value), 3) AS mapq_mean,
       round_even(stddev_pop(value), 3) AS event_size_std_dev, round_even(median(value), 3) AS event_size_median, round_even(avg(value), 3) AS event_size_mean
FROM c GROUP BY user_id, cluster_id HAVING count(DISTINCT event_id) >= 3 AND NOT bool_and(event_type = 'view')
""")
def gap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clustered(spark, sf_dir).withColumn("start", F.col("pos") / F.lit(1e6))
    c = clustering.keep_clusters(c, ["user_id", "cluster_id"], 3, "event_id", "event_type", "view")
    return clustering.cluster_stats(c, ["user_id", "cluster_id"], "start", "value", "value")


@query(f"""WITH {_CLUSTERED} SELECT user_id, event_id, cluster_id FROM c""")
def gap_cluster_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    buffer = F.when(F.col("event_type") == "error", 4 * HOUR).otherwise(HOUR)
    c = clustering.gap_cluster_blocks(events(spark, sf_dir), ["user_id"], "pos", "pos", buffer, ["event_id"], 24 * HOUR)
    return c.select("user_id", "event_id", "cluster_id")


@query("""
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN l_quantity END AS len FROM lineitem),
b AS (SELECT *, lag(len) OVER (PARTITION BY l_suppkey ORDER BY (len IS NULL), len, l_orderkey, l_linenumber) AS p FROM r),
n AS (SELECT *, CASE WHEN len IS NOT NULL AND (p IS NULL OR len > ceil(p * 1.25::DOUBLE)) THEN 1 ELSE 0 END AS new FROM b),
g AS (SELECT *, greatest(1, sum(new) OVER (PARTITION BY l_suppkey ORDER BY (len IS NULL), len, l_orderkey, l_linenumber))::BIGINT AS length_group FROM n)
SELECT l_suppkey, length_group, count(*) AS n_rows, count(len) AS n_lengths, min(len) AS shortest, max(len) AS longest FROM g GROUP BY l_suppkey, length_group
""")
def insert_length_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("len"))
    g = clustering.length_chains(r, ["l_suppkey"], "len", ["l_orderkey", "l_linenumber"])
    return g.groupBy("l_suppkey", "length_group").agg(F.count(F.lit(1)).alias("n_rows"), F.count("len").alias("n_lengths"), F.min("len").alias("shortest"), F.max("len").alias("longest"))


@query(f"""
WITH {EVENTS},
b AS (SELECT user_id, event_id, pos + floor(value * 10000000)::BIGINT AS s, pos AS t, event_type = 'error' AS spans FROM e),
r AS (SELECT *, max(CASE WHEN spans THEN t ELSE s END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
o AS (SELECT *, CASE WHEN reach IS NULL OR reach + {HOUR} < s THEN 1 ELSE 0 END AS opens FROM r),
v AS (SELECT *, coalesce(max(CASE WHEN opens = 1 AND spans AND t < s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reverse FROM o),
c AS (SELECT *, CAST(sum(CASE WHEN reverse = 1 THEN 0 ELSE opens END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS end_cluster FROM v)
SELECT user_id, end_cluster, count(*) AS n_rows, min(s) AS first_start, max(s) AS last_start FROM c GROUP BY user_id, end_cluster
""")
def flip_recluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = events(spark, sf_dir).select("user_id", "event_id", F.col("pos").alias("s"), (F.col("pos") + F.floor(F.col("value") * 10_000_000)).alias("t"), (F.col("event_type") == "error").alias("spans"))
    c = clustering.flip_recluster(b, ["user_id"], "s", "t", "spans", HOUR, ["event_id"])
    return c.groupBy("user_id", "end_cluster").agg(F.count(F.lit(1)).alias("n_rows"), F.min("s").alias("first_start"), F.max("s").alias("last_start"))


def _labelled(c: DataFrame) -> DataFrame:
    return c.select(
        "user_id", "cluster_id", "pos", "event_id", "event_type", "value", F.expr("event_id div 3").alias("read_name"),
        F.when(F.col("event_type").isin("view", "click", "error"), "tumour").otherwise("normal").alias("label"), F.expr("nullif(event_id % 3, 0)").alias("hp"), F.expr("user_id % 5").alias("ps"),
    )


_LABELLED = f"""{_CLUSTERED},
l AS (SELECT user_id, cluster_id, pos, event_id, event_type, value, event_id // 3 AS read_name, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'tumour' ELSE 'normal' END AS label,
        nullif(event_id % 3, 0) AS hp FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, cluster_id, read_name ORDER BY pos, event_id) = 1 AS first FROM l)"""


@query(f"""
WITH {_LABELLED}
SELECT user_id, cluster_id, {", ".join(f"count(*) FILTER (label = '{x}' AND first) AS {x}_reads, count(*) FILTER (label = '{x}') AS {x}_alns, count(*) FILTER (label = '{x}' AND first AND hp = 1) AS {x}_hp1, count(*) FILTER (label = '{x}' AND first AND hp = 2) AS {x}_hp2, count(*) FILTER (label = '{x}' AND first AND hp IS NULL) AS {x}_hp_na" for x in ("tumour", "normal"))}
FROM f GROUP BY user_id, cluster_id
""")
def label_phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.label_counts(_labelled(_clustered(spark, sf_dir)), ["user_id", "cluster_id"], order=("pos", "event_id"))


_NOTATIONS = ("<INS>", "+-", "++", "+")


@query(f"""
WITH {_CLUSTERED},
b AS (SELECT user_id, cluster_id, event_id, pos AS start, pos + floor(value * 1000000)::BIGINT AS "end", event_type AS source, event_id // 2 AS read_name,
        CASE event_id % 4 WHEN 0 THEN '<INS>' WHEN 1 THEN '+-' WHEN 2 THEN '++' ELSE '+' END AS notation, floor(value)::BIGINT AS insert_length FROM c),
g AS (SELECT user_id, cluster_id, notation, trunc(median(start))::BIGINT AS start, trunc(median("end"))::BIGINT AS "end", array_to_string(list_sort(list_distinct(list(source))), '/') AS source,
        trunc(avg(CASE WHEN notation = '<INS>' THEN insert_length END))::BIGINT AS mean_insert, count(DISTINCT read_name) AS n_reads, count(*) AS n_rows FROM b GROUP BY user_id, cluster_id, notation),
s AS (SELECT *, CASE WHEN notation = '<INS>' THEN mean_insert WHEN notation IN ('+', '-') THEN 0 ELSE abs("end" - start) END AS sv_length,
        max(CASE WHEN notation IN ('+', '-') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, cluster_id) AS major FROM g)
SELECT user_id, cluster_id, notation, start, "end", source, n_reads, n_rows, sv_length FROM s
WHERE (sv_length >= 30 OR notation IN ('+', '-')) AND (major = 0 OR notation NOT IN ('+', '-'))
""")
def consensus_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.element_at(F.array(*[F.lit(x) for x in _NOTATIONS]), (F.col("event_id") % 4 + 1).cast("int"))
    b = _clustered(spark, sf_dir).select("user_id", "cluster_id", F.col("pos").alias("start"), (F.col("pos") + F.floor(F.col("value") * 1_000_000)).alias("end"), F.col("event_type").alias("source"), F.expr("event_id div 2").alias("read_name"), n.alias("notation"), F.floor("value").alias("insert_length"))
    g = consensus.consensus(b, ["user_id", "cluster_id", "notation"])
    one = F.lit("chr")
    g = g.withColumn("sv_length", consensus.sv_length(F.col("notation"), one, one, F.col("start"), F.col("end"), F.col("mean_insert")))
    g = consensus.without_weak_single_breakends(g, ["user_id", "cluster_id"])
    g = g.filter(consensus.long_enough(F.col("sv_length"), one, one, 30) | F.col("notation").isin(*consensus.SINGLE))
    return g.select("user_id", "cluster_id", "notation", "start", "end", "source", "n_reads", "n_rows", "sv_length")


_COVERAGE = f"""{EVENTS},
r AS (SELECT user_id, pos // {HOUR} AS s, (pos + floor(value * 60000000)::BIGINT) // {HOUR} AS t FROM e),
d AS (SELECT user_id, bin, count(*) AS depth FROM (SELECT user_id, unnest(range(s, t)) AS bin FROM r WHERE t > s) GROUP BY user_id, bin)"""


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = events(spark, sf_dir).select("user_id", F.col("pos").alias("s"), (F.col("pos") + F.floor(F.col("value") * 60_000_000)).alias("t"))
    return coverage.coverage(reads, ["user_id"], "s", "t", HOUR)


@query(f"WITH {_COVERAGE} SELECT user_id, bin, depth FROM d")
def coverage_difference_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depths(spark, sf_dir)


@query(f"""
WITH {_COVERAGE},
b AS (SELECT user_id, event_id, pos, pos // {HOUR} AS bin, event_id % 7 AS support FROM e WHERE event_type = 'error')
SELECT b.user_id, b.event_id, coalesce(x.depth, 0) AS dp_before, coalesce(y.depth, 0) AS dp_at, coalesce(z.depth, 0) AS dp_after,
       CASE WHEN coalesce(y.depth, 0) = 0 THEN 0.0 ELSE least(1.0, round(support / y.depth::DOUBLE, 3)) END::DOUBLE AS af
FROM b LEFT JOIN d x ON x.user_id = b.user_id AND x.bin = b.bin - 1 LEFT JOIN d y ON y.user_id = b.user_id AND y.bin = b.bin LEFT JOIN d z ON z.user_id = b.user_id AND z.bin = b.bin + 1
""")
def depth_af_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = events(spark, sf_dir).filter("event_type = 'error'").select("user_id", "event_id", "pos", (F.col("event_id") % 7).alias("support"))
    at = coverage.depth_at(b, _depths(spark, sf_dir), ["user_id"], "pos", HOUR)
    return at.select("user_id", "event_id", "dp_before", "dp_at", "dp_after", coverage.allele_fraction(F.col("support"), F.col("dp_at")).alias("af"))


_PAIRS = f"""{EVENTS},
m AS (SELECT x.user_id, x.event_id AS call_id, y.event_id AS truth_id, abs(x.pos - y.pos) AS distance FROM e x JOIN e y ON x.user_id = y.user_id AND abs(x.pos - y.pos) <= {HOUR}
      WHERE x.event_id % 2 = 0 AND y.event_id % 2 = 1)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    calls = e.filter("event_id % 2 = 0").select("user_id", F.col("event_id").alias("call_id"), F.col("pos").alias("call_pos"))
    truth = e.filter("event_id % 2 = 1").select("user_id", F.col("event_id").alias("truth_id"), F.col("pos").alias("truth_pos"))
    return evaluate.within(calls, truth, ["user_id"], "call_pos", "truth_pos", HOUR).select("user_id", "call_id", "truth_id", "distance")


@query(f"WITH {_PAIRS} SELECT user_id, call_id, truth_id, distance FROM m")
def range_join_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"""
WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY distance, truth_id) AS k FROM m)
SELECT user_id, call_id, truth_id, distance FROM r WHERE k = 1
""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest(_pairs(spark, sf_dir), "call_id", "truth_id")


@query()
def exclusive_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.exclusive_nearest(_pairs(spark, sf_dir), ["user_id"], "call_id", "truth_id")


@query(f"""
WITH {_PAIRS}, k AS (SELECT count(DISTINCT call_id) AS tp, count(DISTINCT truth_id) AS found FROM m),
n AS (SELECT tp, (SELECT count(*) FROM e WHERE event_id % 2 = 0) - tp AS fp, (SELECT count(*) FROM e WHERE event_id % 2 = 1) - found AS fn FROM k)
SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 3) AS "precision", round(tp / (tp + fn)::DOUBLE, 3) AS recall,
       round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / ((tp / (tp + fp)::DOUBLE) + (tp / (tp + fn)::DOUBLE)), 3) AS f_measure FROM n
""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _pairs(spark, sf_dir).agg(F.countDistinct("call_id").alias("tp"), F.countDistinct("truth_id").alias("found"))
    n = events(spark, sf_dir).agg(F.count_if(F.col("event_id") % 2 == 0).alias("calls"), F.count_if(F.col("event_id") % 2 == 1).alias("truths"))
    one = m.withColumn("_", F.lit(1)).join(n.withColumn("_", F.lit(1)), "_")
    return evaluate.precision_recall(one.select("tp", (F.col("calls") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("found")).alias("fn")))


@query(f"""
WITH {EVENTS}, x AS (SELECT event_id, event_id % 9 AS tumour_read_support, event_id % 3 AS normal_read_support, value AS tumour_af FROM e)
SELECT event_id, CASE WHEN tumour_read_support >= 5 AND normal_read_support <= 0 THEN 1 ELSE 0 END AS somatic, CASE WHEN normal_read_support >= 1.5 AND tumour_af <= 250.5 THEN 1 ELSE 0 END AS germline FROM x
""")
def min_max_params_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = events(spark, sf_dir).select("event_id", (F.col("event_id") % 9).alias("TUMOUR_READ_SUPPORT"), (F.col("event_id") % 3).alias("NORMAL_READ_SUPPORT"), F.array("value", "value").alias("TUMOUR_AF"))
    params = {"somatic": {"MIN_TUMOUR_READ_SUPPORT": 5, "MAX_NORMAL_READ_SUPPORT": 0}, "germline": {"MIN_NORMAL_READ_SUPPORT": 1.5, "MAX_TUMOUR_AF": 250.5}}
    got = classify.by_params(x, params, arrays=frozenset({"TUMOUR_AF"}))
    mark = lambda n: F.array_contains("categories", f"PASSED_{n.upper()}").cast("int").alias(n)
    return got.select("event_id", mark("somatic"), mark("germline"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as variant edges: lines 1 and 2, 3 and 4, ... of an order are mates; an odd last one has none."""
    li, n = load(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    edge = n.cast("string")
    key = F.col("l_orderkey").cast("string")
    q, d = F.col("l_quantity"), F.col("l_discount")
    return li.select(
        F.concat(key, F.lit("_"), edge).alias("ID"), F.concat(key, F.lit("_"), (n - 1 + n % 2 * 2).cast("string")).alias("MATEID"),
        (F.col("l_orderkey") % 25).alias("TUMOUR_READ_SUPPORT"), (F.col("l_orderkey") % 3).alias("NORMAL_READ_SUPPORT"),
        (q % 10).alias("ORIGIN_STARTS_STD_DEV"), (q % 7).alias("END_STARTS_STD_DEV"), (q + 20).alias("ORIGIN_MAPQ_MEAN"), (q + 25).alias("END_MAPQ_MEAN"),
        (q * 1.5).alias("ORIGIN_EVENT_SIZE_STD_DEV"), (q * 1.2).alias("END_EVENT_SIZE_STD_DEV"), (q * 60).alias("END_EVENT_SIZE_MEDIAN"),
        (d * 5).alias("TUMOUR_AF"), (F.col("l_tax") * 5).alias("NORMAL_AF"), (F.col("l_partkey") % 6).alias("CLUSTERED_READS_NORMAL"), (F.col("l_partkey") % 4 - 1).cast("int").alias("pred"), (F.col("l_suppkey") % 11 == 0).alias("amplified"),
    )


_VARIANTS = """v AS (SELECT l_orderkey || '_' || l_linenumber AS "ID", l_orderkey || '_' || (l_linenumber - 1 + l_linenumber % 2 * 2) AS mateid, l_orderkey % 25 AS t, l_orderkey % 3 AS n, l_quantity % 10 AS osd, l_quantity % 7 AS esd,
  l_quantity + 20 AS omq, l_quantity + 25 AS emq, l_quantity * 1.5::DOUBLE AS oss, l_quantity * 1.2::DOUBLE AS ess, l_quantity * 60 AS emed, l_discount * 5 AS taf, l_tax * 5 AS naf, l_partkey % 6 AS cn,
  (l_partkey % 4 - 1)::INTEGER AS pred, l_suppkey % 11 = 0 AS amplified FROM lineitem)"""


@query(f"""
WITH {_VARIANTS},
o AS (SELECT *, n = 0 AND t >= 7 AND osd <= 50 AND esd <= 50 AND omq >= 40 AND emq >= 40 AND oss <= 60 AND ess <= 60 AND taf >= 0.1 AND cn <= 3 AS own FROM v)
SELECT a."ID" AS "ID", a.own OR (a."ID" LIKE '%\\_1' ESCAPE '\\' AND coalesce(b.own, false)) AS somatic FROM o a LEFT JOIN o b ON a.mateid = b."ID"
""")
def pacbio_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.with_mates(_variants(spark, sf_dir), classify.pacbio_somatic(), "somatic").select("ID", "somatic")


@query(f"""
WITH {_VARIANTS}, x AS (SELECT *, (osd + 1) * (oss + 1) AS ou, (esd + 1) * (ess + 1) AS eu, ess / emed AS eh FROM v)
SELECT "ID", n = 0 AND t > 7 AND CASE WHEN t > 12 AND ou <= 15 THEN eh <= 0.025 WHEN t > 12 AND eu <= 30 THEN true ELSE eu <= 10 END AS strict,
       coalesce(t <> 0 AND n / t::DOUBLE < 0.1 AND osd < 150 AND eh < 3 AND CASE WHEN "ID" LIKE '%1' THEN t > 25 ELSE t > 5 END, false) AS lenient FROM x
""")
def legacy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = _variants(spark, sf_dir), F.col
    eh: Column = classify.heterogeneity(c("END_EVENT_SIZE_STD_DEV"), c("END_EVENT_SIZE_MEDIAN"))
    strict = classify.legacy_strict(c("TUMOUR_READ_SUPPORT"), c("NORMAL_READ_SUPPORT"), c("ORIGIN_STARTS_STD_DEV"), c("ORIGIN_EVENT_SIZE_STD_DEV"), c("END_STARTS_STD_DEV"), c("END_EVENT_SIZE_STD_DEV"))
    tumour = F.when(c("TUMOUR_READ_SUPPORT") != 0, c("TUMOUR_READ_SUPPORT"))
    lenient = classify.legacy_lenient(tumour, c("NORMAL_READ_SUPPORT"), c("ORIGIN_STARTS_STD_DEV"), eh, c("ID").endswith("1"))
    return v.select("ID", strict(eh).alias("strict"), lenient.alias("lenient"))


@query(f"""
WITH {_VARIANTS},
m AS (SELECT a.*, coalesce(b.pred, a.pred) AS mp, coalesce(b.taf, a.taf) AS maf, coalesce(b.amplified, a.amplified) AS mamp FROM v a LEFT JOIN v b ON a.mateid = b."ID")
SELECT "ID", CASE WHEN pred = 1 OR mp = 1 THEN CASE WHEN t < 7 OR t < n THEN 4 WHEN taf < 0.2 AND maf < 0.2 AND NOT (amplified OR mamp) THEN 5 WHEN taf < 0.2 AND maf < 0.2 THEN pred ELSE 1 END
  WHEN pred = 2 AND mp = 2 THEN CASE WHEN n < 7 THEN 4 WHEN naf < 0.2 THEN 5 ELSE 2 END WHEN pred = 0 OR mp = 0 THEN 0
  WHEN pred <> mp THEN CASE WHEN pred < 0 AND mp < 0 THEN -2 ELSE pred END ELSE pred END::INTEGER AS class FROM m
""")
def mate_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _variants(spark, sf_dir).select("ID", "MATEID", "pred", F.col("TUMOUR_READ_SUPPORT").alias("tumour"), F.col("NORMAL_READ_SUPPORT").alias("normal"), F.col("TUMOUR_AF").alias("af"), F.col("NORMAL_AF").alias("normal_af"), "amplified")
    return classify.reconcile_model_classes(v, 7, 0.2).select("ID", "class")


_POINTS = f"""{EVENTS},
s AS (SELECT user_id, event_id AS segment, pos, round_even(value / 100, 0)::BIGINT AS cn FROM e WHERE event_type = 'purchase'),
b AS (SELECT *, lag(cn) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM s),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR (p <> 0 AND cn <> p) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM b),
g AS (SELECT user_id, run, min(pos) AS run_start, arg_min(segment, pos) AS segment FROM r GROUP BY user_id, run),
cp AS (SELECT * FROM (SELECT user_id, run_start, lead(run_start) OVER (PARTITION BY user_id ORDER BY run) AS run_end, segment FROM g) WHERE run_end IS NOT NULL)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("segment_id"), F.col("pos").alias("start"), (F.col("value") / 100).alias("copy_number"))
    return classify.change_points(s, ["user_id"])


@query(f"WITH {_POINTS} SELECT user_id, run_start, run_end, segment FROM cp")
def changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir)


@query(f"""
WITH {_POINTS},
x AS (SELECT user_id, event_id AS variant_id, pos, floor(value)::BIGINT AS support FROM e WHERE floor(value) >= 7 AND event_id % 4 = 0 AND event_id % 5 < 3),
n AS (SELECT x.*, cp.segment, cp.run_start FROM x JOIN cp ON x.user_id = cp.user_id AND (abs(pos - run_start) <= {6 * HOUR} OR abs(pos - run_end) <= {6 * HOUR})),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY support DESC, variant_id) AS k FROM n),
l AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY run_start DESC) AS j FROM t WHERE k = 1)
SELECT variant_id, user_id, segment, support FROM l WHERE j = 1
""")
def cna_rescue_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x = events(spark, sf_dir).select("user_id", i.alias("variant_id"), "pos", F.floor("value").alias("support"), (i % 4).alias("normal"), (i % 5).alias("clustered"))  # all events; the operator says which are eligible
    got = classify.rescue_by_copy_number(x, _points(spark, sf_dir), ["user_id"], "pos", 6 * HOUR, "support", 7, "normal", "clustered")
    return got.select("variant_id", "user_id", "segment", "support")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.04 THEN l_linenumber || 'S' ELSE '' END || l_quantity::BIGINT || 'M' || l_linenumber || 'I' || (l_partkey % 90) || 'D' || l_quantity::BIGINT || '=' || CASE WHEN l_discount > 0.05 THEN (l_suppkey % 50) || 'S' ELSE '' END AS cigar FROM lineitem)
SELECT l_orderkey, l_linenumber, list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1), lambda x: x::BIGINT))::BIGINT AS query, list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: x::BIGINT))::BIGINT AS reference,
       coalesce(nullif(regexp_extract(cigar, '^([0-9]+)S', 1), ''), '0')::INTEGER AS left_clip, coalesce(nullif(regexp_extract(cigar, '([0-9]+)S$', 1), ''), '0')::INTEGER AS right_clip,
       CASE WHEN l_partkey % 90 > 30 THEN 1 ELSE 0 END AS long_deletions FROM c
""")
def cigar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("long").cast("string")
    text = F.concat(
        F.when(F.col("l_tax") > 0.04, F.concat(s("l_linenumber"), F.lit("S"))).otherwise(""), s("l_quantity"), F.lit("M"), s("l_linenumber"), F.lit("I"), (F.col("l_partkey") % 90).cast("string"), F.lit("D"),
        s("l_quantity"), F.lit("="), F.when(F.col("l_discount") > 0.05, F.concat((F.col("l_suppkey") % 50).cast("string"), F.lit("S"))).otherwise(""),
    )
    ops = cigar.operations(F.col("cigar"))
    c = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("cigar")).select("l_orderkey", "l_linenumber", ops.alias("ops"))
    left, right = cigar.clipping(F.col("ops"), F.lit(False))
    return c.select(
        "l_orderkey", "l_linenumber", cigar.consumed_query(F.col("ops")).alias("query"), cigar.consumed_reference(F.col("ops")).alias("reference"), left.cast("int").alias("left_clip"), right.cast("int").alias("right_clip"),
        F.size(F.filter(cigar.events_of(F.col("ops"), F.lit(30)), lambda e: e["kind"] == "DEL")).alias("long_deletions"),
    )


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey AS a, l_partkey AS b, ['+-', '++', '-+', '--', '<INS>', '+'][l_orderkey % 6 + 1] AS n FROM lineitem),
k AS (SELECT *, 'chr1:' || a AS s, 'chr2:' || b AS e FROM x)
SELECT l_orderkey, l_linenumber, CASE n WHEN '+-' THEN 'A[' || e || '[ ]' || s || ']C' WHEN '++' THEN 'A]' || e || '] C]' || s || ']' WHEN '-+' THEN ']' || e || ']A C[' || s || '[' WHEN '--' THEN '[' || e || '[A [' || s || '[C' WHEN '<INS>' THEN '<INS>' ELSE '.A' END AS alts FROM k
""")
def alt_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.element_at(F.array(*[F.lit(x) for x in ("+-", "++", "-+", "--", "<INS>", "+")]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    alts = notation.alt_alleles(n, F.lit("chr1"), F.col("l_suppkey"), F.lit("chr2"), F.col("l_partkey"), F.lit("A"), F.lit("C"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(alts, " ").alias("alts"))


@query(f"""
WITH {_PAIRS}
SELECT call_id, concat_ws(chr(9), 'chr' || user_id, call_id::VARCHAR, call_id::VARCHAR, 'chr' || user_id, (CASE WHEN call_id = truth_id THEN call_id + 1 ELSE truth_id END)::VARCHAR, (CASE WHEN call_id = truth_id THEN call_id + 1 ELSE truth_id END)::VARCHAR,
  'ID_' || call_id || '|' || distance || 'bp|TUMOUR_' || call_id % 7 || '/NORMAL_' || call_id % 3 || '|+-') AS line, truth_id FROM m
""")
def bedpe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, c = _pairs(spark, sf_dir), F.col
    chrom = F.concat(F.lit("chr"), c("user_id").cast("string"))
    line = notation.bedpe_line(chrom, c("call_id"), chrom, c("truth_id"), c("call_id"), c("distance"), c("call_id") % 7, c("call_id") % 3, F.lit("+-"))
    return m.select("call_id", line.alias("line"), "truth_id")



@query(f"""
WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY distance, truth_id) AS k FROM m),
c AS (SELECT event_id AS call_id, event_id // 4 * 4 + (event_id + 2) % 4 AS mate FROM e WHERE event_id % 2 = 0),
l AS (SELECT c.call_id, mate, r.truth_id AS v, r.distance AS d, CASE WHEN r.truth_id IS NULL THEN 'NOT_IN_COMPARISON' ELSE 'SOMATIC' END AS label FROM c LEFT JOIN r ON r.call_id = c.call_id AND k = 1)
SELECT a.call_id, coalesce(a.v, -1) AS "LABEL_VARIANT_ID", coalesce(a.d, -1) AS "DISTANCE_TO_MATCH", CASE WHEN a.label = 'NOT_IN_COMPARISON' AND b.label = 'SOMATIC' THEN 'MATE_SOMATIC' ELSE a.label END AS "LABEL" FROM l a LEFT JOIN l b ON a.mate = b.call_id
""")
def label_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = events(spark, sf_dir).filter("event_id % 2 = 0").select(F.col("event_id").alias("call_id"), F.expr("event_id div 4 * 4 + (event_id + 2) % 4").alias("mate"))
    found = evaluate.labelled(calls, evaluate.nearest(_pairs(spark, sf_dir), "call_id", "truth_id"), "call_id", "truth_id", "SOMATIC")
    return evaluate.inherit_from_mates(found, "call_id", "mate").select("call_id", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("LABEL_VARIANT_ID", "DISTANCE_TO_MATCH")], "LABEL")


@query(f"""
WITH {_CLUSTERED}, q AS (SELECT event_id // 2 AS r, max(value) AS q FROM c GROUP BY event_id // 2), s AS (SELECT count(*) AS n, max(pos) - min(pos) AS w FROM c GROUP BY user_id, cluster_id)
SELECT count(*) AS n_clusters, round(avg(n), 6) AS mean_size, median(n) AS median_size, max(n) AS max_size, round(avg(w), 3) AS mean_width, round((SELECT avg(q) FROM q), 6) AS mean_mapq, round((SELECT median(q) FROM q), 6) AS median_mapq FROM s
""")
def cluster_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clustered(spark, sf_dir).withColumn("read_name", F.expr("event_id div 2"))
    got = clustering.run_stats(c, ["user_id", "cluster_id"], "read_name", "value", "pos")
    return got.select("n_clusters", F.round("mean_size", 6).alias("mean_size"), "median_size", "max_size", F.round("mean_width", 3).alias("mean_width"), F.round("mean_mapq", 6).alias("mean_mapq"), F.round("median_mapq", 6).alias("median_mapq"))
