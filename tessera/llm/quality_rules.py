"""Quality rules: one threshold table compiled into one projection of built-in expressions.

Null, empty and blank texts have zero of everything and fail the base rule (fewer than 10 words).
Repeated rows are judged alike. Only the id and text columns are read; other columns, whatever
their names, pass through :func:`quality_filter` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, own_prefix, words

#: Frequent function words of the four languages; a text needs a few of any of them.
STOP_WORDS = (
    "the of and to in is that it for on was with as be at this are from or an a "
    "der die das und in den von zu mit ist auf für ein eine des dem im nicht auch sich "
    "le la les de et des un une du en que qui dans pour est au sur pas par plus "
    "el la los las de y que en un una por con para del se no es su al como"
).split()


@dataclass(frozen=True)
class Rule:
    """A text is rejected when ``numerator * 100 > percent * denominator`` (``above``) or ``<`` (else)."""

    name: str
    numerator: str
    denominator: str
    percent: int
    above: bool = True

    def sql(self, prefix: str = "") -> str:
        return f"100 * ({prefix}{self.numerator}) {'>' if self.above else '<'} {self.percent} * {prefix}{self.denominator}"


#: Symbols a word, capitals, stop words (with one granted, so that short texts pass), equal lines, length of words.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 10),
    Rule("shouting", "n_capitals", "word_chars", 40),
    Rule("no_stop_words", "n_stop_words + 1", "n_words", 2, above=False),
    Rule("equal_lines", "n_dup_lines", "n_lines", 50),
    Rule("long_words", "word_chars", "n_words", 1500),
    Rule("short_words", "word_chars", "n_words", 200, above=False),
)
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def _repeat_words(h: Column, n: Column) -> Column:
    """Words that lie in a window of 5 words which the text holds twice or more. ``h``: hashes of its words.

    Texts whose windows all differ (most) stop at a hash set. In the others windows are sorted once
    by (hash, place); equal neighbours are the repeated ones, and the union of their spans is the
    sum of the gaps between their places, each at most 5.
    """
    hashes = let(h, lambda v: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(v, i, WINDOW))))
    same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    twice = lambda s: F.transform(F.filter(s, lambda x, k: same(F.get(s, k + 1), x) | same(F.get(s, k - 1), x)), lambda x: x["i"])
    covered = lambda d: F.aggregate(F.transform(d, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(d, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    ranked = lambda v: F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    count = let(hashes, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(let(F.sort_array(let(ranked(v), twice)), covered)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(count)


def quality_profile(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with counts of its text, ``base_failed`` and ``kept``. ``prefix`` keeps clear of names in use."""
    p = lambda name: prefix + name
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    stops = sorted({v for x in STOP_WORDS for v in (x, x.capitalize())})
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    w, n, found = F.col(p("_words")), F.col(p("n_words")), lambda regex: (F.size(F.split(text, regex, -1)) - 1).cast("long")
    out = docs.withColumns({p("_words"): words(F.col(f"`{text_col}`")), p("_lines"): lines})
    out = out.withColumns(
        {
            p("n_words"): F.size(w).cast("long"),
            p("word_chars"): F.length(F.array_join(w, "")).cast("long"),
            p("n_symbols"): found(r"[#*$%&|<>]"),
            p("n_capitals"): found(r"\p{Lu}"),
            p("n_lines"): F.size(p("_lines")).cast("long"),
            p("n_dup_lines"): (F.size(p("_lines")) - F.size(F.array_distinct(p("_lines")))).cast("long"),
            p("n_stop_words"): F.size(F.filter(w, lambda x: x.isin(stops))).cast("long"),
            p("_hashes"): F.transform(w, lambda x: F.xxhash64(x)),
        }
    ).drop(p("_words"), p("_lines"))
    out = out.withColumn(p("n_repeat_words"), _repeat_words(F.col(p("_hashes")), n.cast("int")).cast("long")).drop(p("_hashes"))
    out = out.withColumn(p("base_failed"), (n < MIN_WORDS) | (F.col(p("n_repeat_words")) * 100 > n * MAX_REPEAT_PERCENT))
    broken = F.col(p("base_failed"))
    for r in RULES:
        broken = broken | F.expr(r.sql(prefix))
    return out.withColumn(p("kept"), ~broken)


#: Columns that :func:`quality_profile` adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_stop_words", "n_repeat_words", "base_failed", "kept")


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with the columns of ``docs``."""
    prefix = own_prefix(docs)
    return quality_profile(docs, text_col, prefix).filter(F.col(prefix + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
