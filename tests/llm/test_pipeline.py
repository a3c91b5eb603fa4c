import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
from tessera.llm import mixing, sp_codec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus():
    rng = random.Random(2)
    stop = ["the", "of", "and", "to", "in", "is"]
    word = lambda: rng.choice(stop) if rng.random() < 0.2 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    shared = [word() for _ in range(70)]
    rows = []
    for i in range(90):
        w = [word() for _ in range(rng.randint(30, 160))]
        if i % 9 == 0:
            at = rng.randrange(len(w))
            w[at:at] = shared
        rows.append((i, " ".join(w), "en", f"s{i % 3 if i % 4 else 0}"))
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(10)]
    for i in range(10):
        w = rows[20 + i][1].split()
        w[3] = "changed"
        rows.append((120 + i, " ".join(w), "en", "s2"))
    rows += [(140, None, "en", "s0"), (141, "", None, None), (142, "ALL!! LOUD!! " * 30, "en", "s0"), (143, "the $$$ of *** " * 20, "en", "s1"), (144, "few words", "en", "s1")]
    return [(*r, len(r[1] or "")) for r in rows]


def expected(rows):
    """Brute force of all stages; rejected documents are those of ids 140 and above."""
    docs = {r[0]: (r[1], r[3]) for r in rows if r[0] < 140}
    sets = {i: {tuple(words(t.lower())[j : j + 5]) for j in range(len(words(t)) - 4)} for i, (t, _) in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = {i: d for i, d in docs.items() if find(i) == i}
    where = {}
    for i, (t, _) in docs.items():
        w = words(t)
        for p in range(len(w) - 49):
            where.setdefault(tuple(w[p : p + 50]), []).append((i, p))
    cut = {}
    for i, (t, s) in docs.items():
        w, gone = words(t), set()
        for p in range(len(w) - 49):
            if min(where[tuple(w[p : p + 50])]) < (i, p):
                gone |= set(range(p, p + 50))
        left = [x for j, x in enumerate(w) if j not in gone]
        if left or not gone:
            cut[i] = (left, s)
    # what separates a removed passage goes with it, so that one space stands between words, or ends a text
    size = Counter()
    text = {}
    for i, (left, s) in cut.items():
        whole = docs[i][0]
        joined = " ".join(left)
        text[i] = joined if len(left) == len(words(whole)) or not whole.endswith(" ".join(words(whole)[-1:])) or (left and left[-1] == words(whole)[-1]) else joined + " "
        size[s] += len(text[i])
    weight = {s: v**0.5 for s, v in size.items()}
    out = Counter()
    for i, (_, s) in cut.items():
        rate = weight[s] / sum(weight.values()) * sum(size.values()) / size[s]
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, lp, c = 0, -rate, math.exp(-rate)
        while c < u:
            k += 1
            lp += math.log(rate) - math.log(k)
            c += math.exp(lp)
        if k:
            out[i] = k
    return out, text


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want, text = expected(rows)
    assert Counter(r["doc_id"] for r in got) == want
    v = sp_codec.load()
    assert all(sp_codec.decode(v, r["ids"]) == text[r["doc_id"]] and r["round_trip"] for r in got)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "c") for r in corpus()], SCHEMA + ", copy int, bands string")
    for empty in (False, True):
        docs = df.limit(0) if empty else df
        for _, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, str(tmp_path))
            assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
            assert out.count() == 0 if empty else out.count() > 0
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0) == empty
