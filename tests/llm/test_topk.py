import numpy as np

from tessera.llm import topk

LONG = (1 << 63) - 1


def brute(rows, q, k):
    items = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    out = []
    for i, v in items:
        if i in q:
            s = sorted((-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(v, y, strict=True)))), j) for j, y in items if j != i and len(y) == len(v))[:k]
            out += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s)]
    return sorted(out)


def test_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 320)]  # more equal ones than k, in several blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r[0], r[1]) for r in df.collect()]
    q = df.filter("vec_id % 50 = 0")
    for pivots in (0, 3):
        got = sorted(map(tuple, topk.top_k(df, q, 5, block_rows=16, n_pivots=pivots).collect()))
        assert got == brute(rows, {r[0] for r in q.collect()}, 5)


def test_repeated_ids_are_candidates_and_never_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, df.filter("vec_id = 3"), 9).collect()]
    assert sorted(got) == brute(rows, {3}, 9)
    assert {r[2] for r in topk.top_k(df, df, 9).collect() if r[0] == 1} == {2, 3}


def test_bounds_spare_candidates_and_lose_none(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    rows = [(i, [float(a) for a in v / np.linalg.norm(v)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.filter("vec_id % 100 = 0")
    r = topk.elimination(df, q).first()
    assert r["candidates"] == 3000 * 30 and 0 < r["evaluated"] < 0.5 * r["candidates"]
    assert sorted(map(tuple, topk.top_k(df, q).collect())) == brute(rows, set(range(0, 3000, 100)), 5)


def test_pivots_bound_every_score():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(200, 12)))
    for n in (1, 5, 12):
        p = topk.Pivots(x[:50], n)
        t = p.distances(x)
        bound, score = topk.upper_bounds(p, t, t), x @ x.T
        assert (bound >= score).all()
        size = (x * x).sum(1)
        for j in range(t.shape[1]):  # as tight as any single pivot
            one = (size[:, None] + size[None] - (t[:, j][:, None] - t[:, j][None]) ** 2) / 2
            assert (bound <= one + 2e-6 * (1 + size[:, None] + size[None])).all()


def test_huge_values_are_exact_or_the_nearest_long(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [2e5, 3e5]), (4, [2e5, 1.0]), (5, [1e-3, 1e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, df, 5).collect())) == brute(rows, set(range(6)), 5)


def test_unsound_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 2.0], 7), (1, None, 7), (2, [float("nan"), 1.0], 7), (3, [float("inf"), 1.0], 7), (4, [None, 1.0], 7), (5, [0.5, 0.25], 7), (6, [1.0], 7), (None, [1.0, 1.0], 7), (7, [], 7), (8, [], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long")
    got = sorted(map(tuple, topk.top_k(df, df, 5).collect()))
    assert got == [(0, 1, 5, 256 * 128 + 512 * 64), (5, 1, 0, 256 * 128 + 512 * 64), (7, 1, 8, 0), (8, 1, 7, 0)]
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0
