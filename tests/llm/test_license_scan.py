from collections import Counter

from tessera.llm import license_scan as ls

MIT = ls.TEMPLATES[2][1]
TEXTS = {
    1: None, 2: "", 3: "MIT", 4: "words\nReleased under the MIT license!\nmore words", 5: MIT, 6: "intro\n\n" + MIT.replace(" ", "\n", 20) + "\n\nend of text",
    7: "LICENSED under the Apache License -- version 2.0", 8: "nothing to see here at all, the license of the software", 9: "a " * 50_000 + "\nLicensed under CC BY-NC 4.0.\n" + "b" * 100_000,
    10: "Released under the MIT License. " * 3, 11: "Released under the the MIT License.\nReleased under the MIT License.",
}


def brute(text):
    low = (text or "").lower()
    best = {}
    import re

    passages = {tuple(ls.normal_words(x)) for x in [low, *re.split(r"\n\s*\n", low), *low.split("\n")]}
    for p in passages:
        a = Counter(zip(p, p[1:]))
        for name, t in ls.TEMPLATES:
            w = ls.normal_words(t)
            b = Counter(zip(w, w[1:]))
            if len(p) > 1 and (d := 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))) >= ls.THRESHOLD - 1e-12:
                best[name] = max(best.get(name, 0), round(d, 6))
    return best


def test_matches_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in TEXTS.items()] + [(4, TEXTS[4], "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string, n int")
    got = {(r["doc_id"], r["license_id"]): r["dice"] for r in ls.license_scan(df).collect()}
    assert got == {(i, n): d for i, t in TEXTS.items() for n, d in brute(t).items()}
    assert {(4, "MIT"), (5, "MIT"), (6, "MIT"), (7, "Apache-2.0"), (9, "CC-BY-NC-4.0"), (11, "MIT")} <= got.keys()
    assert ls.license_scan(df.limit(0)).count() == 0
