import random

import pytest

from tessera.llm import sp_codec as sc

TEXTS = [None, "", " ", "  two  spaces ", "a", "Hello wörld\n\tnext\r\n line", "▁literal ▁▁ marks▁", "日本語 テキスト 🙂 x", "\x00\x01", "the " * 5000 + "end", "x" * 20_000, "naïve   café"]


@pytest.fixture(scope="module")
def vocabulary():
    return sc.load()


def small(pieces, crossing=False):
    scores = {p: (s, i) for i, (p, s) in enumerate(pieces.items())}
    n = len(pieces)
    return sc.Vocabulary([*pieces, *[f"<0x{b:02X}>" for b in range(256)]], scores, list(range(n, n + 256)), n, frozenset())


def brute(v, text):
    best = [(0, [])] + [None] * len(text)
    for e in range(1, len(text) + 1):
        options = [(best[b][0] + v.fixed[text[b:e]][0], [*best[b][1], v.fixed[text[b:e]][1]]) for b in range(max(0, e - v.longest), e) if text[b:e] in v.scores]
        c = text[e - 1]
        if c not in v.scores:
            raw = c.replace("▁", " ").encode()
            options.append((best[e - 1][0] + v.floor * len(raw), [*best[e - 1][1], *[v.bytes_[x] for x in raw]]))
        best[e] = max(options, key=lambda o: o[0])
    return best[-1]


def total(v, ids):
    score = {i: s for s, i in v.fixed.values()}
    return sum(score.get(i, v.floor) for i in ids)


def test_round_trip_and_best_path(vocabulary):
    for t in TEXTS:
        ids = sc.encode(vocabulary, t)
        assert sc.decode(vocabulary, ids) == (t or "")
        if t and "▁" not in t and len(t) < 3000:
            assert total(vocabulary, ids) == brute(vocabulary, ("▁" + t.replace(" ", "▁")))[0]


@pytest.mark.parametrize("crossing", [False, True])
def test_small_vocabularies(crossing):
    rng = random.Random(5)
    for _ in range(150):
        pieces = {c: -rng.uniform(1, 6) for c in "ab▁"[: rng.randint(2, 3)]}
        for _ in range(rng.randint(1, 10)):
            p = "".join(rng.choice("ab") for _ in range(rng.randint(2, 6)))
            pieces[("▁" if rng.random() < 0.3 else "") + p + ("▁a" if crossing and rng.random() < 0.3 else "")] = -rng.randint(1, 9)
        v = small(pieces)
        t = "".join(rng.choice("ab ") if rng.random() < 0.95 else "é" for _ in range(rng.randint(0, 60)))
        ids = sc.encode(v, t)
        assert sc.decode(v, ids) == t
        if t:
            assert (total(v, ids), ids) == brute(v, "▁" + t.replace(" ", "▁"))


def test_rows(spark, vocabulary):
    rows = [(i, t, [1], "c") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, "c"), (None, TEXTS[5], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n_ids string")
    got = sc.encode_documents(df)
    out = got.collect()
    assert [(r["doc_id"], list(r["ids"]), r["n_ids"]) for r in out] == [(r[0], e := sc.encode(vocabulary, r[1]), len(e)) for r in rows]
    assert all(r["round_trip"] for r in out)
    assert [r["text"] for r in sc.decode_documents(got).collect()] == [r[1] or "" for r in rows]
    assert sc.encode_documents(df.limit(0)).count() == 0


def streamed(v, text):
    """Ids by the search that goes one character at a time."""
    codes = [ord(c) for c in " " + text]
    out = []
    for end, n in sc.stream(v, codes):
        got = v.fixed.get(sc._letters(codes[end - n : end]))
        out += [got[1]] if got else [v.bytes_[b] for b in chr(codes[end - 1]).encode()]
    return out


def test_stretches_in_step_equal_one_character_at_a_time(vocabulary, monkeypatch):
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("etaoinshrdluéß,.-") for _ in range(rng.randint(1, 14))) for _ in range(900))
    want = streamed(vocabulary, text)
    assert sc.encode(vocabulary, text) == want
    for slice_, longest in ((300, 300), (300, 20), (40, 100_000)):  # long texts in parts, long stretches alone
        monkeypatch.setattr(sc, "SLICE", slice_)
        monkeypatch.setattr(sc, "LONGEST", longest)
        assert sc.encode(vocabulary, text) == want
        assert sc.encode(vocabulary, text.replace(" ", "")) == streamed(vocabulary, text.replace(" ", ""))


def test_ids_are_committed_when_paths_meet():
    v = small({"a": -3.0, "b": -3.0, "ab": -4.0, "aba": -4.5, "▁": -1.0})
    used = []

    def codes():
        for i, c in enumerate("ab ab abab " * 50):
            used.append(i)
            yield ord(c)

    for end, _ in sc.stream(v, codes()):
        assert len(used) <= end + 12 or len(used) == 550  # not at the end of the text alone


def test_a_run_without_meeting_paths_is_encoded_in_linear_time():
    v = small({"a": -3.0, "aa": -4.0, "aaa": -5.0, "▁": -1.0})
    ids = sc.encode(v, "a" * 400_000)
    assert len(ids) == 1 + 133_334 and sc.decode(v, ids) == "a" * 400_000


def test_most_words_get_the_pieces_of_merging(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sc.MODEL)
    words = "the quick brown fox jumps over a lazy dog while many other animals watch from nearby fields and rivers".split()
    same = sum(sc.encode(vocabulary, w) == sp.encode(w) for w in words)
    assert same >= 0.8 * len(words)
