"""The registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tessera.llm import context_mixing, html_extract, license_scan, mixing, near_dup, quality_rules, sp_codec, suffix_dedup, topk, warc
from tessera.llm.common import scratch_path, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup_groups(table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode_documents(table(spark, sf_dir, "documents"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_documents(table(spark, sf_dir, "documents"))


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_profile(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch_path(spark, "warc"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_context_mixing": op4_context_mixing,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_html_min_cut": op7_html_min_cut,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_exact_top_k": op10_exact_top_k,
}

_STOPS = ", ".join("'" + v.replace("'", "''") + "'" for x in quality_rules.STOP_WORDS for v in (x, x.capitalize()))

_TEMPLATES = ", ".join("(%d, '%s', %d, [%s], [%s]::INTEGER[])" % (i, n, s, ", ".join(f"'{g}'" for g in gr), ", ".join(map(str, c))) for i, n, s, gr, c in sorted({r[1]: (r[1], r[2], r[3], r[4], r[5]) for r in license_scan.template_rows()}.values(), key=lambda r: r[0]))

ORACLE: dict[str, str] = {
    "op5_poisson_mixing": f"""
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
r AS (SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM s WHERE size > 0) * (SELECT sum(size) FROM s) / size AS rate FROM s),
j AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS j FROM r),
p AS (SELECT source, rate, j, -rate + sum(CASE WHEN j = 0 THEN 0 ELSE ln(rate) - ln(j::DOUBLE) END) OVER (PARTITION BY source ORDER BY j) AS lp FROM j),
c AS (SELECT source, rate, j, sum(exp(lp)) OVER (PARTITION BY source ORDER BY j) AS c FROM p),
d AS (SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.rate, count(*) AS n FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source WHERE c.c < d.u GROUP BY ALL),
e AS (SELECT *, unnest(range(1, n + 1))::INTEGER AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, copy, round(rate, 9) AS rate, ('0x' || substr(md5('{mixing.SEED}:' || doc_id || ':' || copy), 1, 13))::BIGINT AS shuffle_key FROM e
""",
    "op6_license_scan": f"""
WITH t(id, license_id, size, grams, counts) AS (VALUES {_TEMPLATES}),
x AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS x FROM documents),
u AS (SELECT doc_id, unnest(list_distinct(list_concat([x], regexp_split_to_array(x, '\\n[ \\n]*\\n'), string_split(x, chr(10))))) AS x FROM x),
w AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(x, '[ \\n]+'), lambda y: y <> '') AS w FROM u),
a AS (SELECT doc_id, array_to_string(w, ' ') AS passage, len(w) - 1 AS n, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS a FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, license_id, passage, 2.0::DOUBLE * list_sum(list_transform(range(1, len(grams) + 1), lambda i: least(counts[i], len(list_filter(a, lambda y: y = grams[i])))))::DOUBLE / (n + size) AS dice
      FROM a JOIN t ON least(n, size) >= {license_scan.THRESHOLD} / (2 - {license_scan.THRESHOLD}) * greatest(n, size) - 1e-9)
SELECT doc_id, license_id, round(max(dice), 6) AS dice, count(DISTINCT passage) AS n_passages FROM m WHERE dice >= {license_scan.THRESHOLD} - 1e-12 GROUP BY doc_id, license_id
""",
    "op8_quality_rules": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text,
        list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l FROM t),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a WHERE len(w) >= 5),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n FROM g),
d AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM k WHERE n > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n_repeat_words FROM d GROUP BY doc_id),
c AS (SELECT a.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
        len(regexp_extract_all(text, '\\p{{Lu}}'))::BIGINT AS n_capitals,
        len(list_filter(w, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM a LEFT JOIN r ON r.doc_id = a.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {" OR ".join(r.sql() for r in quality_rules.RULES)}) AS kept FROM b
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
        CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to FROM m
""",
    "op10_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
