"""Repeated passages by a sparse suffix array.

A passage is repeated where ``length`` words or more, equal as words, occur elsewhere: in a document of a
smaller id, or earlier in the same one. Words are runs of bytes other than white space, in their own case.

1. Suffixes are retained only at minimiser positions: of the ``k``-word prefixes that begin in a window of ``window`` words, the one of
   the least hash. Every passage of ``length`` words selects one in its first ``window`` words, by its words
   alone, so equal passages retain suffixes at equal places, with ``length - window + 1`` words or more to the right: about one word in 13.
2. Suffixes whose first ``length - window + 1`` words (by a 64-bit hash, counted with partial counts on the map side) occur once in the corpus end here.
3. The others are sorted, in ranges over all partitions, by the words that follow, and once more by the words that precede them, read backwards.
   Each is compared with its neighbours in both orders, over partition edges too: the longest common prefixes tell how far any
   match of it can extend to the right and to the left. Suffixes that cannot extend to ``length`` words end here. Ranges are cut by
   (words, id, place), so that copies of one common passage spread over many tasks.
4. What is repeated, and where it first occurs, needs more than neighbours: a passage may have its left part from one suffix and its right part
   from another, and the first document need not be next to it in either order. So each stretch of ``length`` words within the extent of a suffix is
   compared by a 64-bit hash of its words with those of all others.

Documents whose word sequences are equal are first reduced to the smallest id; the others repeat it as a whole.
Null, empty and short texts (below ``length`` words) hold no passage. Rows of one id are one document: they do not
repeat each other. Rows of a null id are left alone. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as sh
from tessera.llm.common import flag_maybe_in, maybe_in, own_prefix, spread, stage
from tessera.session import ship

U = np.uint64
LENGTH, PREFIX, WINDOW = 50, 8, 25
SPANS = "array<struct<start: bigint, end: bigint, first: array<bigint>>>"
_SALT = U(0x9E3779B97F4A7C15)
_R = int(np.random.default_rng(11).integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1


def minimisers(key: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` keys, the place of its least one (the leftmost of equals)."""
    n = len(key) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, span = np.arange(len(key)), 1
    while span * 2 <= width:
        a, b = at[:-span], at[span:]
        at = np.where(key[b] < key[a], b, a)
        span *= 2
    a, b = at[:n], at[width - span : width - span + n]
    return np.where(key[b] < key[a], b, a)


def stretch_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every stretch of ``length`` word hashes, by one running sum."""
    up = np.full(len(h) + 1, U(_R), U)
    up[0] = 1
    up = np.cumprod(up, dtype=U)
    down = np.full(len(h) + 1, U(pow(_R, -1, 1 << 64)), U)
    down[0] = 1
    down = np.cumprod(down, dtype=U)
    run = np.concatenate([np.zeros(1, U), np.cumsum(h * up[:-1], dtype=U)])
    n = len(h) - length + 1
    return sh.mix((run[length:] - run[:n]) * down[:n]) if n > 0 else np.empty(0, U)


def _window(length: int, k: int) -> int:
    return max(1, min(WINDOW, length - k + 1))


def _selected(h: np.ndarray, rows: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all stretches within a row, the place each selects, and at every place a hash of the words that all who select it share."""
    if len(h) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    key = np.zeros(len(h) - k + 1, U)
    for j in range(k):
        key += h[j : j + len(key)] * sh._COEF[j]
    key = sh.mix(key + _SALT)
    window = _window(length, k)
    at = minimisers(key, window)
    starts = np.flatnonzero(rows[: len(h) - length + 1] == rows[length - 1 :])
    return starts, at[starts], stretch_hashes(h, length - window + 1)


def _samples(docs: DataFrame, length: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, f1, f2, keys: each row's words, their fingerprint, and the prefix hashes of its retained suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in sh.each_slice(batch.column(1)):
                h, rows, *_ = sh.word_hashes(data, offsets, lower=False)
                count = np.bincount(rows, minlength=b - a)
                first = np.concatenate([[0], np.cumsum(count)])
                place = (np.arange(len(h)) - first[rows]).astype(U)
                prints = []
                for salt in (U(3), U(5)):
                    s = np.concatenate([np.zeros(1, U), np.cumsum(sh.mix(h * salt + sh.mix(place + salt)), dtype=U)])
                    prints.append((s[first[1:]] - s[first[:-1]]).view(np.int64))
                _, at, key = _selected(h, rows, length, k)
                at = np.unique(at)
                begins = np.searchsorted(rows[at], np.arange(b - a + 1)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(begins), pa.array(key[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count, pa.int64()), pa.array(prints[0]), pa.array(prints[1]), keys], ["id", "n", "f1", "f2", "keys"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    return rows.mapInArrow(run, "id long, n long, f1 long, f2 long, keys array<long>")


def _suffixes(texts: DataFrame, length: int, k: int) -> DataFrame:
    """id, pos, key, right, left: the retained suffixes whose key is among the row's ``keys``, with what follows and what precedes their shared words
    (four bytes of a word's hash each, none beyond the text)."""
    width = _window(length, k) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0), batch.column(2)
            values, bounds = wanted.values.to_numpy(zero_copy_only=False), wanted.offsets.to_numpy()
            for a, b, data, offsets in sh.each_slice(batch.column(1)):
                h, rows, *_ = sh.word_hashes(data, offsets, lower=False)
                _, at, key = _selected(h, rows, length, k)
                at = np.unique(at)
                own = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                known = set(zip(own.tolist(), values[bounds[a] : bounds[b]].tolist(), strict=True))
                at = at[np.array([(r, x) in known for r, x in zip(rows[at].tolist(), key[at].view(np.int64).tolist(), strict=True)], bool)] if len(at) else at
                if not len(at):
                    continue
                short = (h >> U(32)).astype(np.uint32) | np.uint32(1)  # 0 stands for no word
                of = rows[at]

                def words(places: np.ndarray, short=short, rows=rows, of=of) -> pa.Array:
                    inside = (places >= 0) & (places < len(short))
                    x = np.where(inside, short[np.where(inside, places, 0)], 0)
                    x[rows[np.where(inside, places, 0)] != of[:, None]] = 0
                    return pa.array([r.tobytes() for r in np.ascontiguousarray(x.astype(">u4"))], pa.binary())

                right = words(at[:, None] + (length - width) + np.arange(width)[None])
                left = words(at[:, None] - 1 - np.arange(width)[None])
                first = np.searchsorted(rows, np.arange(b - a))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + of)), pa.array((at - first[of]).astype(np.int32)), pa.array(key[at].view(np.int64)), right, left], ["id", "pos", "key", "right", "left"])

    return texts.mapInArrow(run, "id long, pos int, key long, right binary, left binary")


def common_words(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words rows have in common from the first on; 0 is no word."""
    return np.cumprod((x == y) & (x != 0), axis=1).sum(1)


def neighbour_extents(suffixes: DataFrame, side: str, name: str) -> DataFrame:
    """id, pos, ``name``: the most words that a suffix has in common, on one side of the shared ones, with a neighbour in the order of that side.

    Partitions are ranges of that order. Their first and last rows, two a partition, meet on the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None
        names = ["kind", "part", "key", "words", "id", "pos", "best"]

        def rows(kind: int, b: pa.RecordBatch, best: np.ndarray) -> pa.RecordBatch:
            n = len(b)
            words = b.column(1) if kind else pa.nulls(n, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), b.column(0), words, b.column(2), b.column(3), pa.array(best.astype(np.int32))], names)

        zero = np.zeros(1, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.select(["key", side, "id", "pos"])
            if held is None:
                yield rows(1, batch.slice(0, 1), zero)
            else:
                batch = pa.Table.from_batches([held[0], batch]).combine_chunks().to_batches()[0]
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(len(batch), -1)
            key = np.asarray(batch.column(0))
            same = common_words(x[1:], x[:-1]) * (key[1:] == key[:-1])
            best = np.maximum(np.append(same, 0), np.insert(same, 0, held[1] if held else 0))
            yield rows(0, batch.slice(0, len(batch) - 1), best[:-1])
            held = batch.slice(len(batch) - 1), best[-1]
        if held is not None:
            yield rows(0, held[0], np.array([held[1]]))
            yield rows(2, held[0], zero)

    spark = suffixes.sparkSession
    order = ["key", side, "id", "pos"]
    got = suffixes.select(*order).repartitionByRange(spread(spark), *order).sortWithinPartitions(*order)
    got = stage(got.mapInArrow(run, "kind int, part int, key long, words binary, id long, pos int, best int"), f"sa-{name}")
    edges = sorted(((r["part"], r["kind"], r["key"], bytes(r["words"]), r["id"], r["pos"]) for r in got.filter("kind > 0").collect()), key=lambda r: r[:2])
    more: list[tuple[int, int, int]] = []
    for a, b in zip(edges, edges[1:], strict=False):
        if a[0] != b[0] and a[2] == b[2]:
            n = int(common_words(*(np.frombuffer(x[3], ">u4")[None] for x in (a, b)))[0])
            more += [(*x[4:], n) for x in (a, b)]
    out = got.filter("kind = 0").select("id", "pos", "best")
    if more:
        out = out.unionByName(spark.createDataFrame(more, "id long, pos int, best int"))
    return out.groupBy("id", "pos").agg(F.max("best").alias(name))


def _stretches(texts: DataFrame, length: int, k: int) -> DataFrame:
    """id, start, hash, again: the stretches within the extents (from, to) of the row's suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0), batch.column(2)
            begins, ends = (np.asarray(wanted.values.field(n)) for n in ("from", "to"))
            bounds = wanted.offsets.to_numpy()
            for a, b, data, offsets in sh.each_slice(batch.column(1)):
                h, rows, *_ = sh.word_hashes(data, offsets, lower=False)
                hashes = stretch_hashes(h, length)
                first = np.searchsorted(rows, np.arange(b - a + 1))
                for r in range(b - a):
                    own = slice(bounds[a + r], bounds[a + r + 1])
                    size = first[r + 1] - first[r]
                    mark = np.zeros(size + 2, np.int64)
                    lo, hi = begins[own].astype(np.int64), np.minimum(ends[own].astype(np.int64), size) - length + 1
                    able = hi > lo
                    np.add.at(mark, lo[able], 1)
                    np.add.at(mark, hi[able], -1)
                    where = np.flatnonzero(np.cumsum(mark)[: max(0, size - length + 1)] > 0)
                    if not len(where):
                        continue
                    x = hashes[first[r] + where]
                    _, index = np.unique(x, return_index=True)
                    again = np.ones(len(x), bool)
                    again[index] = False
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), ids[a + r].as_py()), pa.int64()), pa.array(where.astype(np.int32)), pa.array(x.view(np.int64)), pa.array(again)], ["id", "start", "hash", "again"])

    return texts.mapInArrow(run, "id long, start int, hash long, again boolean")


def _merged(length: int):
    """Spans that stretches cover, from their starts, each with the documents in which its stretches first occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first", pa.list_(pa.int64()))]))
        for batch in batches:
            out = []
            for hits in batch.column(1):
                at = hits.values.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
                first = hits.values.field("first").to_numpy(zero_copy_only=False)
                order = np.argsort(at, kind="stable")
                at, first = at[order], first[order]
                new = np.concatenate([[True], at[1:] > at[:-1] + length])
                begins = np.flatnonzero(new)
                ends = np.append(begins[1:], len(at))
                out.append([{"start": int(at[a]), "end": int(at[b - 1]) + length, "first": np.unique(first[a:b]).tolist()} for a, b in zip(begins, ends, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["id", "spans"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = PREFIX, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(samples, spans): spans has (id, spans) for documents that repeat something: word offsets [start, end) and, as
    ``first``, the documents in which parts of the span first occur."""
    samples = stage(_samples(docs, length, k, id_col, text_col), "sa-samples")
    # documents of equal words: all but the smallest id repeat it
    long_ = samples.filter(f"n >= {length}")
    equal = long_.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("most"))
    equal = stage(equal.filter("rep < most").drop("most"), "sa-equal")
    copies = stage(long_.join(equal, ["f1", "f2", "n"]).filter("id > rep").select("id", "n", "rep").distinct(), "sa-copies")

    # retained suffixes whose first words have equals
    suffixes = long_.select("id", "keys").join(copies.select("id").distinct(), "id", "left_anti").select("id", F.explode("keys").alias("key"))
    found = stage(suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "sa-prefixes")
    own = stage(suffixes.join(found, "key").distinct().groupBy("id").agg(F.collect_list("key").alias("keys")), "sa-own")

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sorted_ = stage(_suffixes(maybe_in(texts, "id", own, "id").join(own, "id"), length, k), "sa-suffixes")
    shared = length - _window(length, k) + 1
    reach = neighbour_extents(sorted_, "right", "r").join(neighbour_extents(sorted_, "left", "l"), ["id", "pos"]).filter(F.col("l") + F.col("r") + shared >= length)
    extent = F.struct((F.col("pos") - F.col("l")).alias("from"), (F.col("pos") + shared + F.col("r")).alias("to"))
    own = stage(reach.groupBy("id").agg(F.collect_list(extent).alias("extents")), "sa-extents")
    stretches = stage(_stretches(maybe_in(texts, "id", own, "id").join(own, "id"), length, k), "sa-stretches")
    twice = stretches.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first")).filter("c > 1").drop("c")
    gone = stretches.join(stage(twice, "sa-twice"), "hash").filter("again OR id > first").select("id", "start", "first")
    spans = gone.groupBy("id").agg(F.collect_list(F.struct("start", "first")).alias("hits")).mapInArrow(_merged(length), f"id long, spans {SPANS}")
    whole = copies.groupBy("id").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("rep")).alias("rep"))
    whole = whole.select("id", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.col("rep").alias("first"))).alias("spans"))
    return samples, stage(spans.join(whole.select("id"), "id", "left_anti").unionByName(whole), "sa-spans")


def repeated_passages(docs: DataFrame, length: int = LENGTH, k: int = PREFIX, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, n_words, first_doc_ids: a row for each passage that its document repeats.

    ``start`` and ``end`` are word offsets; ``first_doc_ids`` are the documents in which parts of the passage first occur, its
    own among them where it repeats itself. Documents that repeat nothing have no row.
    """
    samples, spans = repeated_spans(docs, length, k, id_col, text_col)
    out = samples.select("id", "n").distinct().join(spans, "id").select("id", "n", F.explode("spans").alias("s")).filter("s.start < n")
    end = F.least("s.end", "n")
    return out.select(F.col("id").alias("doc_id"), F.col("s.start").alias("start"), end.alias("end"), (end - F.col("s.start")).alias("n_words"), F.col("s.first").alias("first_doc_ids")).distinct()


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what separates them from the next word goes with them."""
    data = np.frombuffer(text.encode(), np.uint8)
    _, _, starts, _ = sh.word_hashes(data, np.array([0, len(data)]), lower=False)
    raw, out, at = data.tobytes(), [], 0
    for a, b in spans:
        if a >= len(starts):
            break
        out.append(raw[at : starts[a]])
        at = starts[b] if b < len(starts) else len(raw)
    return b"".join([*out, raw[at:]]).decode()


def dedup_passages(docs: DataFrame, length: int = LENGTH, k: int = PREFIX, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each repeated passage left only where it first occurs; rows left without a word go."""
    _, spans = repeated_spans(docs, length, k, id_col, text_col)
    ship(docs.sparkSession)
    p = own_prefix(docs)
    flagged = flag_maybe_in(docs, id_col, spans, "id", p + "maybe")  # texts that surely stay whole are not shuffled
    both = flagged.filter(F.col(p + "maybe")).drop(p + "maybe").join(spans.toDF(p + "id", p + "spans"), F.col(id_col) == F.col(p + "id"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.schema.get_field_index(text_col), batch.schema.get_field_index(p + "spans")
            out = []
            for text, spans in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist(), strict=True):
                out.append(cut_spans(text, [(s["start"], s["end"]) for s in spans]) if text and spans else text)
            cols = [pa.array(out, batch.schema.field(i).type) if c == i else batch.column(c) for c in range(batch.num_columns)]
            keep = pa.array([not s or bool(t.strip(" \t\n\x0b\f\r")) for t, s in zip(out, batch.column(j).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(keep).drop_columns([p + "spans"])

    both = both.drop(p + "id")
    whole = flagged.filter(~F.col(p + "maybe")).select(*[F.col(f"`{c}`") for c in docs.columns])
    return both.mapInArrow(run, both.drop(p + "spans").schema).unionByName(whole)
