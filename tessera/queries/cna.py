"""Queries on copy numbers: bins, counts, smoothing, segments, alleles and the purity and ploidy fit.

Suppliers and users stand for chromosomes, order lines for reads, sites and intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import inflation_factor, log2, search_space
from tessera.operators import alleles, bins, fit, segment, smooth
from tessera.plans.params import CnaParams
from tessera.queries.registry import EVENTS, events, load, query

_CONTIGS = "g AS (SELECT s_suppkey AS contig, (1000 + s_suppkey * 37 % 5000)::BIGINT AS length FROM supplier)"


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("contig"), (1000 + F.col("s_suppkey") * 37 % 5000).alias("length"))


_TILES = f"""{_CONTIGS},
b AS (SELECT DISTINCT contig, length, start FROM (SELECT contig, length, unnest(range(1, length + 1, 500)) AS start FROM g UNION ALL
      SELECT contig, length, l_partkey * 3 AS start FROM lineitem JOIN g ON l_suppkey = contig WHERE l_discount = 0.1 AND l_partkey * 3 BETWEEN 1 AND length)),
t AS (SELECT contig, start, coalesce(lead(start) OVER (PARTITION BY contig ORDER BY start) - 1, length) AS "end" FROM b)"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    breaks = load(spark, sf_dir, "lineitem").filter("l_discount = 0.1D").select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") * 3).alias("start"))
    return bins.tile(_contigs(spark, sf_dir), 500, breaks)


@query(f'WITH {_TILES} SELECT contig, start, "end" FROM t')
def bin_tiling_with_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir)


@query(f'WITH {_CONTIGS}, w AS (SELECT contig, length, unnest(range(1, length + 1, 700)) AS start FROM g) SELECT contig, start, least(start + 700, length + 1) AS "end" FROM w')
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.windows(_contigs(spark, sf_dir), 700)


@query(f"""
WITH {_TILES},
y AS (SELECT l_suppkey AS contig, l_partkey * 2 AS s, l_partkey * 2 + l_quantity::BIGINT AS e FROM lineitem),
o AS (SELECT t.contig, start, "end", sum(least("end", e) - greatest(start, s) + 1) AS n FROM t JOIN y ON t.contig = y.contig AND s <= "end" AND start <= e GROUP BY ALL)
SELECT t.contig, t.start, t."end", 100.0::DOUBLE * coalesce(n, 0) / (t."end" - t.start + 1) AS overlap FROM t LEFT JOIN o ON o.contig = t.contig AND o.start = t.start AND o."end" = t."end"
""")
def overlap_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") * 2).alias("start"), (F.col("l_partkey") * 2 + F.col("l_quantity").cast("long")).alias("end"))
    return bins.overlap_percent(_tiles(spark, sf_dir), y, ["contig"], 500)


@query("""
WITH r AS (SELECT l_suppkey, l_orderkey % 20000 AS rs, l_orderkey % 20000 + l_quantity::BIGINT * 10 AS re FROM lineitem),
b AS (SELECT l_suppkey, rs, re, unnest(range(greatest(rs // 100 - 1, 0), re // 100 + 2)) AS bin FROM r)
SELECT l_suppkey, bin, count(*) AS n_reads FROM b WHERE (rs >= bin * 100 + 1 AND rs < (bin + 1) * 100) OR (re > bin * 100 + 1 AND re <= (bin + 1) * 100) GROUP BY l_suppkey, bin
""")
def read_bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_orderkey") % 20000
    r = load(spark, sf_dir, "lineitem").select("l_suppkey", s.alias("rs"), (s + F.col("l_quantity").cast("long") * 10).alias("re"))
    return bins.reads_per_bin(r, ["l_suppkey"], "rs", "re", 100)


_COUNTS = f"{EVENTS}, k AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS tumour, count(*) FILTER (event_type = 'signup') AS normal FROM e GROUP BY user_id)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type").isin("view", "click")).alias("tumour"), F.count_if(F.col("event_type") == "signup").alias("normal"))


@query(f"WITH {_COUNTS}, r AS (SELECT *, log2(tumour / normal::DOUBLE) AS r FROM k WHERE tumour <> 0 AND normal <> 0) SELECT user_id, round(r - (SELECT median(r) FROM r), 6) AS log2r FROM r")
def log2_normalise_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.normalise_matched(_counts(spark, sf_dir)).select("user_id", F.round("log2r", 6).alias("log2r"))


@query(f"WITH {_COUNTS} SELECT user_id, round(log2(tumour / (SELECT median(tumour) FROM k WHERE tumour <> 0)), 6) AS log2r FROM k WHERE tumour <> 0")
def log2_normalise_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.normalise_self(_counts(spark, sf_dir)).select("user_id", F.round("log2r", 6).alias("log2r"))


@query(f"""
WITH {EVENTS}, d AS (SELECT event_type, abs(log2(value) - lead(log2(value)) OVER (PARTITION BY event_type ORDER BY pos, event_id)) AS d FROM e),
k AS (SELECT event_type, d, row_number() OVER (PARTITION BY event_type ORDER BY d) AS k, round_even(0.95::DOUBLE * count(*) OVER (PARTITION BY event_type), 0) AS keep FROM d WHERE d IS NOT NULL)
SELECT event_type, round(sum(d * d) / (2 * max(keep)) * {inflation_factor(0.025)!r}::DOUBLE, 6) AS variance FROM k WHERE k <= keep GROUP BY event_type
""")
def trimmed_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("x", log2(F.col("value")))
    return smooth.trimmed_variance(e, ["event_type"], "x", ["pos", "event_id"]).select("event_type", F.round("variance", 6).alias("variance"))


@query(f"""
WITH {EVENTS}, x AS (SELECT event_type, event_id, pos, log2(value) AS x FROM e),
w AS (SELECT *, list_concat(coalesce(list(x) OVER (PARTITION BY event_type ORDER BY pos, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []), coalesce(list(x) OVER (PARTITION BY event_type ORDER BY pos, event_id ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING), [])) AS nb,
        median(x) OVER (PARTITION BY event_type ORDER BY pos, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m FROM x)
SELECT event_id, round(CASE WHEN len(list_filter(nb, lambda v: abs(x - v) <= 0.5)) > 0 OR len(nb) = 0 THEN x WHEN x > list_max(nb) THEN m + 0.25 WHEN x < list_min(nb) THEN m - 0.25 ELSE x END, 6) AS smoothed FROM w
""")
def smooth_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"x": log2(F.col("value")), "o": F.lit(0.5), "s": F.lit(0.25)})
    return smooth.smooth_outliers(e, ["event_type"], "x", ["pos", "event_id"], 10, "o", "s").select("event_id", F.round("smoothed", 6).alias("smoothed"))


_BINS = f"""{EVENTS},
b AS (SELECT user_id, 'u' || user_id || '_seg' || (event_id // 700) AS seg_id, event_id * 10 AS start, event_id * 10 + event_id % 9 + 1 AS "end", log2(value / 245) AS seg_log2r, event_id, event_type FROM e)"""


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return events(spark, sf_dir).select("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_seg"), F.expr("event_id div 700").cast("string")).alias("seg_id"), (i * 10).alias("start"), (i * 10 + i % 9 + 1).alias("end"), log2(F.col("value") / 245).alias("seg_log2r"), "event_id", "event_type")


_SEGMENTS = f"""{_BINS},
s AS (SELECT user_id, seg_id, min(start) AS start, max("end") AS "end", count(*) AS bin_count, sum("end" - start)::BIGINT AS sum_of_bin_lengths, sum("end" - start) / (SELECT median("end" - start) FROM b) AS weight,
        pow(2.0::DOUBLE, arg_min(seg_log2r, start)) AS relative_cn FROM b GROUP BY user_id, seg_id)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.collapse_segments(_bins(spark, sf_dir), ["user_id"])


@query(f'WITH {_SEGMENTS} SELECT user_id, seg_id, start, "end", bin_count, sum_of_bin_lengths, round(weight, 6) AS weight, round(relative_cn, 6) AS relative_cn FROM s')
def segment_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).withColumns({"weight": F.round("weight", 6), "relative_cn": F.round("relative_cn", 6)})


@query(f"""
WITH {_BINS}, m AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 END AS sv FROM b),
k AS (SELECT *, coalesce(sum(sv) OVER (PARTITION BY user_id, seg_id ORDER BY start), 0) AS k FROM m),
x AS (SELECT *, CASE WHEN k = 0 THEN seg_id ELSE seg_id || '-SV' || k::BIGINT END AS split_id FROM k)
SELECT user_id, split_id, count(*) AS n_bins, round(median(seg_log2r), 6) AS seg_log2r FROM x GROUP BY user_id, split_id
""")
def sv_split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bins(spark, sf_dir)
    x = fit.split_at_breakpoints(b, b.filter("event_type = 'error'").select("user_id", F.col("start").alias("pos")), ["user_id"])
    return x.groupBy("user_id", "split_id").agg(F.count(F.lit(1)).alias("n_bins"), F.round(F.median("seg_log2r"), 6).alias("seg_log2r"))


#: The production grid: 81 x 351 points.
_PURITY, _PLOIDY = CnaParams().cellularity, CnaParams().ploidy
_GRID = f"""{_SEGMENTS},
pu AS (SELECT unnest({search_space(*_PURITY)}::DOUBLE[]) AS purity, unnest(range({len(search_space(*_PURITY))}))::INTEGER AS i),
pl AS (SELECT unnest({search_space(*_PLOIDY)}::DOUBLE[]) AS ploidy, unnest(range({len(search_space(*_PLOIDY))}))::INTEGER AS j),
f AS (SELECT i, j, purity, ploidy, ploidy + (relative_cn - 1) * (ploidy + 2 / purity - 2) AS cn, weight, start FROM s, pu, pl),
d AS (SELECT i, j, purity, ploidy, sqrt(sum(pow(abs(cn - round_even(cn, 0)), 2) * weight) / sum(weight)) AS distance FROM f GROUP BY ALL)"""


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.grid_distances(_segments(spark, sf_dir), fit.grid(spark, search_space(*_PURITY), search_space(*_PLOIDY)))


@query(f"WITH {_GRID} SELECT i, j, purity, ploidy, round(distance, 9) AS distance FROM d")
def grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fits(spark, sf_dir).withColumn("distance", F.round("distance", 9))


_MINIMA = f"""{_GRID},
r AS (SELECT *, min(distance) OVER (PARTITION BY j ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS r FROM d),
n AS (SELECT *, min(r) OVER (PARTITION BY i ORDER BY j RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS least FROM r),
m AS (SELECT i, j, purity, ploidy, distance FROM n WHERE distance <= least)"""


@query(f"WITH {_MINIMA} SELECT i, j, round(distance, 9) AS distance FROM m")
def local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.local_minima(_fits(spark, sf_dir)).select("i", "j", F.round("distance", 9).alias("distance"))


@query(f"""
WITH {_MINIMA}, c AS (SELECT * FROM m WHERE distance < (SELECT min(distance) * 1.25 FROM m))
SELECT i, j, round_even(distance, 3) AS distance, row_number() OVER (ORDER BY round_even(distance, 3), ploidy, purity)::INTEGER AS rank FROM c
""")
def rank_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.rank_solutions(fit.within_scale(fit.local_minima(_fits(spark, sf_dir)))).select("i", "j", "distance", "rank")


@query(f"""
WITH {_MINIMA}, c AS (SELECT i, j FROM m WHERE distance < (SELECT min(distance) * 1.25 FROM m)),
x AS (SELECT f.*, round_even(f.cn, 0) + 0.0::DOUBLE AS state FROM f JOIN c USING (i, j)),
p AS (SELECT i, j, sum(CASE WHEN cn <= 0 THEN weight ELSE 0 END) / sum(weight) AS prop_zero, sum(CASE WHEN round(abs(cn - state), 9) < 0.25 THEN weight ELSE 0 END) / sum(weight) AS prop_whole FROM x GROUP BY i, j),
t AS (SELECT i, j, state, row_number() OVER (PARTITION BY i, j ORDER BY count(*) DESC, min(start)) AS k FROM x GROUP BY i, j, state),
o AS (SELECT i, j, max(CASE WHEN k = 1 THEN state END) AS mode, max(CASE WHEN k = 2 THEN state END) AS second FROM t GROUP BY i, j)
SELECT i, j, round(prop_zero, 6) AS prop_zero, round(prop_whole, 6) AS prop_whole, mode, second FROM p JOIN o USING (i, j) WHERE prop_zero <= 0.9 AND prop_whole >= 0.4 AND (second IS NULL OR abs(mode - second) <= 1)
""")
def acceptable_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = fit.within_scale(fit.local_minima(_fits(spark, sf_dir)))
    out = fit.acceptable(_segments(spark, sf_dir).withColumn("ord", F.col("start")), fits, 0.9, 0.4)
    return out.select("i", "j", F.round("prop_zero", 6).alias("prop_zero"), F.round("prop_whole", 6).alias("prop_whole"), "mode", "second")


@query()
def purity_ploidy_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked solutions over all points of the production grid."""
    p = CnaParams()
    return fit.fit_purity_ploidy(_segments(spark, sf_dir).withColumn("ord", F.col("start")), p.cellularity, p.ploidy)


@query(f"""
WITH {_CONTIGS}, s AS (SELECT contig, start, least(start + 399, length) AS "end", 0.5::DOUBLE + (start % 1000) / 500.0::DOUBLE AS r FROM (SELECT contig, length, unnest(range(1, length + 1, 400)) AS start FROM g)),
b AS (SELECT s.contig, s.start, 0.5::DOUBLE + avg(abs(0.5::DOUBLE - l_discount * 5)) AS baf, count(*) AS n_sites FROM s JOIN lineitem ON l_suppkey = contig AND l_partkey * 2 BETWEEN start AND "end" GROUP BY s.contig, s.start),
c AS (SELECT s.contig, s.start, coalesce(n_sites, 0) AS n_sites, baf, r, (0.8::DOUBLE - 1 + r * (1 - baf) * (2 * (1 - 0.8::DOUBLE) + 0.8::DOUBLE * 2.1::DOUBLE)) / 0.8::DOUBLE AS a, (0.8::DOUBLE - 1 + r * baf * (2 * (1 - 0.8::DOUBLE) + 0.8::DOUBLE * 2.1::DOUBLE)) / 0.8::DOUBLE AS z, 2.1::DOUBLE + (r - 1) * (2.1::DOUBLE + 2 / 0.8::DOUBLE - 2) AS t FROM s LEFT JOIN b ON b.contig = s.contig AND b.start = s.start)
SELECT contig, start, n_sites, round(baf, 6) AS mean_baf, round_even(CASE WHEN baf IS NOT NULL THEN greatest(a, 0.0::DOUBLE) END, 4) AS minor_cn, CASE WHEN baf IS NULL THEN round_even(greatest(t, 0.0::DOUBLE), 4) ELSE round_even(round_even(greatest(a, 0.0::DOUBLE), 4) + round_even(greatest(z, 0.0::DOUBLE), 4), 4) END AS copy_number FROM c
""")
def baf_minor_major_cn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bins.windows(_contigs(spark, sf_dir), 400).select("contig", "start", (F.col("end") - 1).alias("end"), (F.lit(0.5) + (F.col("start") % 1000) / F.lit(500.0)).alias("relative_cn"))
    snps = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") * 2).alias("pos"), (F.col("l_discount") * 5).alias("af_0"))
    baf = fit.segment_baf(fit.snps_in_segments(snps, s, ["contig"], 400), ["contig", "start"])
    out = fit.absolute_segments(s.join(baf, ["contig", "start"], "left"), 0.8, 2.1)
    return out.select("contig", "start", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), F.round("mean_baf", 6).alias("mean_baf"), "minor_cn", "copy_number")


_BASES = "b AS (SELECT l_suppkey AS contig, l_partkey AS pos, ['A', 'c', 'G', 't', 'N', 'AC'][(l_orderkey + l_linenumber) % 6 + 1] AS base FROM lineitem)"


@query(f"""
WITH {_BASES}, c AS (SELECT contig, pos, {", ".join(f"count(*) FILTER (upper(base) = '{x}') AS {x}" for x in "ACGTN")} FROM b GROUP BY contig, pos),
r AS (SELECT *, ['A', 'C', 'G', 'T'][pos % 4 + 1] AS ref, ['C', 'G', 'T', 'A'][pos % 4 + 1] AS alt FROM c),
f AS (SELECT *, CASE ref WHEN 'A' THEN A WHEN 'C' THEN C WHEN 'G' THEN G ELSE T END AS own, CASE alt WHEN 'A' THEN A WHEN 'C' THEN C WHEN 'G' THEN G ELSE T END AS other FROM r)
SELECT contig, pos, ref, alt, A, C, G, T, N, round(own / (own + other)::DOUBLE, 6) AS af_0, contig || '_' || (pos // 500 * 500) AS block_id FROM f WHERE A + C + G + T + N >= 3 AND own + N < A + C + G + T + N AND own + other > 0
""")
def allele_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda x, i: F.element_at(F.array(*[F.lit(v) for v in x]), (i + 1).cast("int"))
    b = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos"), pick(("A", "c", "G", "t", "N", "AC"), (F.col("l_orderkey") + F.col("l_linenumber")) % 6).alias("base"))
    sites = b.select("contig", "pos").distinct().withColumns({"ref": pick("ACGT", F.col("pos") % 4), "alt": pick("CGTA", F.col("pos") % 4)})
    counts = alleles.allele_counts(sites, alleles.base_counts(b, ["contig", "pos"]), ["contig", "pos"], 500)
    out = alleles.site_filter(counts.filter("af_0 IS NOT NULL"), "ref", 3)
    return out.select("contig", "pos", "ref", "alt", *"ACGTN", F.round("af_0", 6).alias("af_0"), "block_id")


_BLOCKS = """s AS (SELECT l_suppkey AS block_id, l_partkey AS pos, l_quantity AS dp, 0.5::DOUBLE + l_discount * 4 AS af_0, 0.5::DOUBLE - l_tax * 5 AS af_1 FROM lineitem),
u AS (SELECT block_id, af_0 AS af FROM s UNION ALL SELECT block_id, af_1 FROM s),
k AS (SELECT block_id, (pow(skewness(af), 2) + 1) / (kurtosis(af) + 3 * pow(count(*) - 1, 2) / ((count(*) - 2) * (count(*) - 3))) AS bc FROM u GROUP BY block_id),
b AS (SELECT block_id, count(*) AS n, max(pos) - min(pos) AS length, avg(dp) AS mean_dp, bc FROM s JOIN k USING (block_id) GROUP BY block_id, bc)"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("block_id"), F.col("l_partkey").alias("pos"), F.col("l_quantity").alias("dp"), (F.lit(0.5) + F.col("l_discount") * 4).alias("af_0"), (F.lit(0.5) - F.col("l_tax") * 5).alias("af_1"))


@query(f"WITH {_BLOCKS} SELECT block_id, n, length, round(mean_dp, 6) AS mean_dp, round(bc, 6) AS bc FROM b")
def block_bimodality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.block_summary(_sites(spark, sf_dir)).select("block_id", "n", "length", F.round("mean_dp", 6).alias("mean_dp"), F.round("bc", 6).alias("bc"))


@query(f"""
WITH {_BLOCKS}, t AS (SELECT block_id FROM b ORDER BY bc DESC, block_id LIMIT 10),
h AS (SELECT block_id, median(CASE WHEN af > 0.5 THEN af END) AS hi, median(CASE WHEN af < 0.5 THEN af END) AS lo FROM u JOIN t USING (block_id) GROUP BY block_id)
SELECT round(avg(((1 - 2 * (1 - hi)) + (1 - 2 * lo)) / 2), 6) AS cellularity FROM h
""")
def cellularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sites(spark, sf_dir)
    return fit.cellularity(s, fit.block_summary(s)).select(F.round("cellularity", 6).alias("cellularity"))


@query()
def block_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.block_modes(_sites(spark, sf_dir))


@query()
def cbs_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = events(spark, sf_dir).select(F.col("event_type").alias("contig"), F.col("pos").alias("start"), "event_id", log2(F.col("value")).alias("log2r"))
    return segment.segment_profiles(b).select("contig", "start", "event_id", "seg_id", "seg_log2r")
