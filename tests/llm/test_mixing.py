import hashlib
import math
from collections import Counter

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string, _rate int"


def copies(rate, name):
    u = int(hashlib.md5(f"{mixing.SEED}:{name}".encode()).hexdigest()[:13], 16) / 2**52
    k, lp, c = 0, -rate, math.exp(-rate)
    while c < u:
        k += 1
        lp += math.log(rate) - math.log(k)
        c += math.exp(lp)
    return k


def test_copies_follow_the_inverse_poisson_distribution(spark):
    rows = [(i, "x" * (i % 40), ("a", "b", None)[(i % 10 > 5) + (i % 10 > 8)], "c", 1) for i in range(600)] + [(5, "y" * 5, "a", "c", 1), (None, "z" * 9, "b", "c", 1), (None, None, "b", None, None), (900, "", "empty", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA).drop("copy", "_rate").withColumnRenamed("doc_id", "id")
    size = Counter()
    for r in rows:
        size[r[2]] += len(r[1] or "")
    w = {s: v**0.5 for s, v in size.items()}
    rate = {s: w[s] / sum(w.values()) * sum(size.values()) / size[s] if size[s] else 1.0 for s in size}
    want = Counter()
    for r in rows:
        for k in range(copies(rate[r[2]], hashlib.md5((r[1] or "").encode()).hexdigest() if r[0] is None else r[0])):
            want[(r[0], r[1], r[2], k + 1)] += 1
    got = mixing.mix_sources(df, id_col="id")
    assert got.columns == ["id", "text", "source", "copy", "rate", "shuffle_key"]
    assert Counter(map(tuple, got.drop("rate", "shuffle_key").collect())) == want
    keys = [r[0] for r in got.select("shuffle_key").coalesce(1).collect()]
    assert keys != sorted(keys) or got.rdd.getNumPartitions() == 1


def test_given_weights_large_rates_and_empty_tables(spark):
    rows = [(i, "x" * 10, "big" if i % 50 else "small", "c", 1) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(df, {"small": 0.9, "big": 0.1}, budget=40.0, prefix="m_")
    n = Counter(r[0] for r in got.select("source").collect())
    assert abs(n["small"] - 36_000) < 800 and abs(n["big"] - 4_000) < 300
    assert "copy" in got.columns and "m_copy" in got.columns
    assert {r[0] for r in mixing.mix_sources(df, {"small": 1.0}, prefix="m_").select("source").distinct().collect()} == {"small"}
    assert mixing.mix_sources(df.limit(0), prefix="m_").count() == 0


def test_tables_of_large_rates_are_short_and_right(spark):
    import math

    from tessera.llm import mixing as m

    rates = spark.createDataFrame([("a", 0.0), ("b", 0.3), ("c", 25.0), ("d", 1e5)], "_source string, _rate double")
    got = {r["_source"]: r for r in m.poisson_tables(rates).collect()}
    assert got["a"]["_cdf"] == [1.0] and got["b"]["_low"] == 0
    for s, rate in (("b", 0.3), ("c", 25.0), ("d", 1e5)):
        total, low = 0.0, got[s]["_low"]
        for j, c in enumerate(got[s]["_cdf"]):
            total += math.exp((low + j) * math.log(rate) - rate - math.lgamma(low + j + 1))
            assert math.isclose(c, total, rel_tol=1e-6, abs_tol=1e-12)
    assert len(got["d"]["_cdf"]) < 30 * math.sqrt(1e5)


def test_long_texts_are_replicated_whole(spark):
    df = spark.createDataFrame([(i, "word " * (200_000 if i == 1 else 3), "s") for i in range(4)], "doc_id long, text string, source string")
    out = mixing.mix_sources(df, {"s": 1.0}, budget=3.0).collect()
    assert {len(r["text"]) for r in out} <= {1_000_000, 15}
