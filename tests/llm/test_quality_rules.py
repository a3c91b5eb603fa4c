import re

from tessera.llm import quality_rules as qr

TEXTS = [
    None, "", "   \n\t ", "one", "the cat of the dog and the " * 3, "a b c d e f g h i j", "x\ny\nx\nz\n\n x\nthe of and to is it on at",
    "the same five words here now the same five words here and the same five words here", "b a" * 7, "a a a a a a a a a a a a", "  w\x1dx \x0b y z",
    "IT!! IS!! ALL!! CAPITALS!! HERE!! AND!! LOUD!! TO!! READ!! OUT!! NOW!!", "### $$$ %%% the of and to is it", "the cat sat on the mat while it was in the sun and a dog ran by",
    "word " * 20_000, "the " + "x" * 100_000,
]


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {j for i, x in enumerate(g) if g.count(x) > 1 for j in range(i, i + 5)} if len(g) < 5000 else set(range(len(w)))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def test_counts(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], 1, None)], "doc_id long, text string, n_words int, _words string")
    got = qr.quality_profile(df.drop("n_words", "_words")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    for r in got:
        assert tuple(r)[1:7] == brute(TEXTS[4 if r[0] is None else r[0]]), TEXTS[r[0]]
    assert {r[0] for r in got if r["kept"]} == {13}
    kept = qr.quality_filter(df)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.collect()) == [13]
    assert qr.quality_filter(df.limit(0)).count() == 0
