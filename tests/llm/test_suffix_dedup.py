import random
import re

from tessera.llm import suffix_dedup as sd

L, K = 10, 3


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows):
    where = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for p in range(len(w) - L + 1):
                where.setdefault(tuple(w[p : p + L]), []).append((i, p))
    out = {}
    for i, t in rows:
        if i is None:
            continue
        w, gone = words(t), set()
        for p in range(len(w) - L + 1):
            first = min(where[tuple(w[p : p + L])])
            if first[0] < i or first < (i, p):
                gone |= set(range(p, p + L))
        out[i] = (len(w), gone)
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    common = [[word() for _ in range(rng.choice([9, 10, 11, 14, 30, 60]))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += [word() for _ in range(rng.randint(0, 25))]
            if rng.random() < 0.5:
                c = rng.choice(common)
                a, b = sorted(rng.sample(range(len(c) + 1), 2)) if rng.random() < 0.4 else (0, len(c))
                w += c[a:b]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(200 + i, rows[i][1]) for i in range(8)] + [(300, " ".join(["na"] * 70)), (301, " ".join(["na"] * 35)), (302, " ".join("abcdefgh" * 9))]
    rng.shuffle(rows)
    return rows


def test_minimisers_match_brute_force():
    import numpy as np

    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 7, 8, 43):
        key = rng.integers(0, 9, 200).astype(np.uint64)
        assert sd.minimisers(key, width).tolist() == [i + int(np.argmin(key[i : i + width])) for i in range(200 - width + 1)]


def test_spans_match_brute_force(spark):
    for seed in (0, 1):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n int, keys string")
        want = brute(rows)
        got, where = {}, {}
        for r in sd.repeated_passages(df, L, K).collect():
            got.setdefault(r["doc_id"], []).append(r)
            assert r["n_words"] == r["end"] - r["start"] >= L
        for i, t in rows:
            w = words(t)
            for p in range(len(w) - L + 1):
                where.setdefault(tuple(w[p : p + L]), set()).add(i)
        text = dict(rows)
        assert got.keys() == {i for i, (_, gone) in want.items() if gone}
        for i, found in got.items():
            assert {x for r in found for x in range(r["start"], r["end"])} == want[i][1], i
            w = words(text[i])
            if text[i] not in [t for j, t in rows if j < i]:
                first = {min(where[tuple(w[p : p + L])]) for r in found for p in range(r["start"], r["end"] - L + 1)}
                assert {x for r in found for x in r["first_doc_ids"]} <= first and first - {i} <= {x for r in found for x in r["first_doc_ids"]}
        cut = {r["doc_id"]: r for r in sd.dedup_passages(df, L, K).collect()}
        for i, (n, gone) in want.items():
            left = [x for j, x in enumerate(words(text[i])) if j not in gone]
            assert (i not in cut) == (not left and bool(gone))
            if i in cut:
                assert words(cut[i]["text"]) == left and (gone or cut[i]["text"] == text[i])
                assert (cut[i]["n"], cut[i]["keys"]) == (1, "c")


def test_odd_rows(spark):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n "), (4, p), (5, "x y " + p + " z"), (5, "x y " + p + " z"), (None, p), (None, p), (6, "long " * 30_000), (7, "q" * 100_000), (8, p.upper())]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string")
    got = sorted((r["doc_id"], r["n_words"], r["first_doc_ids"]) for r in sd.repeated_passages(df).collect())
    assert got == [(5, 60, [4]), (6, 29_999, [6])]
    cut = sorted(((r["doc_id"], (r["text"] or "")[:20], r["spans"]) for r in sd.dedup_passages(df).collect()), key=repr)
    assert (5, "x y z", "c") in cut and (None, p[:20], "c") in cut and len(cut) == len(rows)
    assert sd.repeated_passages(df.limit(0)).count() == 0 and sd.dedup_passages(df.limit(0)).count() == 0
