import random
import re

from tessera.llm import near_dup as nd


def shingles(t, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
    ids = sorted(x for x in sets if x is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    rows, i = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.choice([1, 3, 4, 8, 40, 90, 200]))]
        for _ in range(rng.choice([1, 1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8]) if len(w) > 20 else 0):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w) if rng.random() < 0.5 else "\n ".join(w).upper() if "é" not in "".join(w) else "\t".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


def check(spark, rows, k=4, percent=80):
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, n int, rep string")
    got = nd.near_dup_groups(df, k, percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    size = {}
    for i, t in rows:
        size.setdefault(i, set()).add(len(shingles(t, k)))
    for r in got:
        assert r["n_shingles"] in size[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    return df, want


def test_matches_brute_force(spark):
    for seed in (0, 1):
        check(spark, corpus(seed))


def test_chains_and_one_large_group(spark):
    rng = random.Random(4)
    base = [f"w{j}" for j in range(100)]
    rows = []
    for i in range(150):  # copies that drift: few are near the smallest id
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(100)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    step = list(base)
    for i in range(150, 190):  # a chain: each is near the next only
        step[(i * 37) % 100] = f"y{i}"
        rows.append((i, " ".join(step)))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d"), (8, "A b\nC d"), (9, "x " * 30_000), (10, "x " * 40_000), (11, "z" * 100_000), (12, "a b c d"), (12, "a b c d"), (13, "q r s t"), (13, "one")]
    df, want = check(spark, rows)
    assert want[5] == 4 and want[12] == 7 and want[10] == 9 and want[13] == 4
    kept = nd.near_dedup(df, 4)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 9, 11]
    assert nd.near_dup_groups(df.limit(0)).count() == 0
    assert nd.near_dedup(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (2, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_dup_groups(null).collect()), key=repr) == [(2, 2, True), (2, 2, True), (3, 2, False), (None, None, True), (None, None, True)]
    assert nd.near_dedup(null).count() == 3


def test_sketch_estimates(spark):
    import numpy as np

    from tessera.llm import shingles as sh

    rng = np.random.default_rng(3)
    for j in (0.8, 0.9):
        inter = int(1000 * 2 * j / (1 + j))
        est = []
        for _ in range(60):
            x = rng.integers(0, 1 << 52, 2000 - inter, dtype=np.uint64)
            sets = [np.sort(x[:1000]), np.sort(x[1000 - inter :])]
            m = nd.min_hashes(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
            s = nd.odd_sketches(m)
            d = int(np.bitwise_count(s[0] ^ s[1]).sum())
            est.append(1 + nd.SKETCH_BITS / (4 * nd.SAMPLES) * np.log(1 - 2 * d / nd.SKETCH_BITS))
        assert abs(np.mean(est) - j) < 0.03 and min(est) > nd.LEAST_ESTIMATE
    assert sh.SET_BITS == 52
