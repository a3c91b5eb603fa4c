"""Language-model scores by online logistic mixing of context bit predictors.

A text is coded as bytes and an end mark; each byte becomes the bits of its path in the Huffman tree of the two bytes
before it, so that about three bits stand for a byte. Each bit is predicted

* by the corpus, in the contexts of the last two to five bytes: how often either value followed there in the training texts,
* by the text itself, in the context of the last four bytes: hashed slots with check bits, which begin empty and adapt after
  every bit.

The log odds of all are combined with weights that a gate selects (how often the two longest contexts were seen), and a last stage corrects
the sum by its size. A text is cut into blocks of ``BLOCK`` bytes; each begins with the corpus inputs' weights that were learned from all training texts, with
the bytes before it as its contexts, with empty slots at a fixed weight, and with no corrections. It adds weights and corrections of its own, which
follow the gradient of the coding cost after every bit. Blocks of a batch advance in step, as numpy operations. The score is the log10 probability of all bits.

Corpus counts are a distributed table that grows with the corpus: texts are dealt into parts of some megabytes; a
part sends its distinct byte grams with its counts to the buckets of their contexts, which sum them over all parts and
send back the predictions for each part's grams. Keys are the bytes themselves, so nothing collides. A part gets the counts of all
*other* parts: training texts are never predicted from themselves, and the weights are learned as they are used. Texts held out have parts of
their own and get the counts of all training texts.

The corpus inputs' weights are learned from every byte of every training text. Where a bucket answers a training part it knows each gram, how often the
part has it, and all its predictions: that is all a logistic regression needs, gate by gate. Each bucket expands the coding cost of its grams about the
weights found so far, to second order; the sums of these expansions, 14 numbers a gate and bucket, give the weights.

Beside it stands the unigram base of lower-cased tokens (words and one end a text), with exact counts of all
training tokens: those of the most frequent tokens (a bounded number) reach the texts by broadcast, those
of the others by a join. Tokens are told apart by 64-bit hashes.

Training texts are those whose id's CRC-32 modulo ``folds`` is not 0. Null texts are empty: one end. A null id counts
as an empty name and is held out. Repeated rows count as often as they occur and are scored alike. With no training texts every count is 0 and
only the text's own slots predict. Texts of any length are scored whole. Only the two named columns are read, so others may have any names.
"""

from __future__ import annotations

import contextlib
import ctypes
import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shingles as sh
from tessera.llm.common import scoped, spread, stage
from tessera.session import ship

U, U32 = np.uint64, np.uint32
#: Bytes of text in a part, on average; parts to a bucket; the least number of training parts.
PART, PARTS_A_BUCKET, LEAST_PARTS = 16_000_000, 4, 8
END_BYTE = 255
END_TOKEN = np.array([0x5EED_0F_E17D], np.uint64)
MOST_COMMON = 1 << 18
SLICE = 1_000_000
#: Bytes and number of texts that advance in step together, and bytes of a block of a text.
BATCH, BATCH_ROWS, BLOCK = 3 << 19, 2000, 1024
#: Rows that Spark hands to Python at once; a part's are joined there.
ARROW_ROWS = 2000
#: Bits of the longest path in a tree; trees of two bytes before, and how often those occur.
CODE, MOST_TREES, TREE_LEAST = 20, 2048, 512
ORDERS = (3, 4, 5)
LONGEST = ORDERS[-1]
#: Bytes before that name the slots which the text itself fills, and slots of a block.
OWN, SLOTS = 4, 2048
GRADES = np.array([1, 2, 3, 6, 16, 64, 256])
GATES, INPUTS, SIZES = 64, 1 + len(ORDERS) + 1, 33
PRIOR, STEP = 0.3, 1 / 12
#: Grams that teach at once; Newton steps on a bucket's first; what holds a gate's weights where they start (as much as about one bit seen).
TEACH, FIRST_STEPS, RIDGE = 1 << 17, 4, 1000.0
RATE, SIZE_RATE = 0.02, 0.02
_GRAM_MIX = U(0x9E3779B97F4A7C15)


def huffman(counts: np.ndarray) -> list[tuple[int, int]]:
    """(path, length) of each of 256 symbols; rare ones count as 2^-13 of all, so that no path is longer than CODE."""
    least = max(float(counts.sum()), 1.0) / (1 << 13)
    heap = [(max(float(w), least), s) for s, w in enumerate(counts)]
    heapq.heapify(heap)
    children, new = {}, 256
    while len(heap) > 1:
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[new] = (a, b)
        heapq.heappush(heap, (wa + wb, new))
        new += 1
    out, todo = [(0, 0)] * 256, [(heap[0][1], 0, 0)]
    while todo:
        n, path, length = todo.pop()
        if n < 256:
            out[n] = path, length
        else:
            todo += [(child, 2 * path + bit, length + 1) for bit, child in enumerate(children[n])]
    return out


class Code:
    """Paths of bytes by the two bytes before, and what these alone predict.

    ``triples``: ascending (byte, byte before, byte before that) as grams of order 2, with ``counts``. Of the two bytes before, those that occur
    ``TREE_LEAST`` times have a tree of their own (the ``MOST_TREES`` most frequent of them); others share that of the one byte before.
    ``path`` is left-justified in CODE bits; ``odds`` are for the branch taken, at every step of every path.
    """

    def __init__(self, triples: np.ndarray, counts: np.ndarray):
        two, byte = (triples & U(0xFFFF)).astype(np.int64), (triples >> U(16)).astype(np.int64)
        often = np.bincount(two, weights=counts, minlength=65536)
        own = np.argsort(-often, kind="stable")[:MOST_TREES]
        own = np.sort(own[often[own] >= TREE_LEAST])
        self.tree = (np.arange(65536) >> 8).astype(np.int32)
        self.tree[own] = 256 + np.arange(len(own))
        table = np.zeros((256 + len(own), 256))
        np.add.at(table, (two >> 8, byte), counts)
        mine = self.tree[two] >= 256
        np.add.at(table, (self.tree[two[mine]], byte[mine]), counts[mine])
        paths = [p for row in table for p in huffman(row)]
        self.length = np.array([n for _, n in paths], np.int64)
        self.path = np.array([p << (CODE - n) for p, n in paths], np.int64)
        key = np.repeat(np.arange(len(table)), 256) << CODE | self.path
        order = np.argsort(key)
        node, branch = path_counts(key[order], self.length[order], table.ravel()[order].astype(np.int64))
        self.begin = np.cumsum(self.length) - self.length
        begin = np.cumsum(self.length[order]) - self.length[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = np.repeat(begin[rank], self.length) + _inner(self.length)
        self.odds = graded(node[at], branch[at])[0]

    def of(self, g: np.ndarray, order: int) -> np.ndarray:
        """Where in the tables the byte of each gram is, after the bytes before it."""
        two = ((g >> U(8 * (order - 2))) & U(0xFFFF)).astype(np.int64)
        return (self.tree.take(two).astype(np.int64) << 8) + (g >> U(8 * order)).astype(np.int64)


def _inner(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def path_counts(key: np.ndarray, length: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair (context and path in ``key``, ascending) and each step of its path: how often its node was passed, and how
    often its branch was taken. One pair's steps after the other's."""
    begin = np.cumsum(length) - length
    node, branch = np.zeros(int(length.sum()), np.int64), np.zeros(int(length.sum()), np.int64)
    rows = np.arange(len(key))
    for d in range(int(length.max(initial=0)) + 1):
        rows = rows[length[rows] >= d]
        k = key[rows] >> (CODE - d)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        total = np.repeat(np.add.reduceat(counts[rows], first), np.diff(first, append=len(k)))
        if d:
            branch[begin[rows] + d - 1] = total
        on = length[rows] > d
        node[begin[rows[on]] + d] = total[on]
    return node, branch


def graded(node: np.ndarray, branch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds for the branch taken, in steps of STEP from 128, and the grade of how often the node was seen."""
    odds = np.log((branch + PRIOR) / (node - branch + PRIOR))
    return (np.clip(np.rint(odds / STEP), -127, 127) + 128).astype(np.uint8), np.searchsorted(GRADES, node, side="right").astype(np.uint8)


def with_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each row followed by the end mark, which no UTF-8 text holds."""
    n = len(offsets) - 1
    own = np.ones(len(data) + n, bool)
    own[offsets[1:] + np.arange(n)] = False
    out = np.full(len(own), END_BYTE, np.uint8)
    out[own] = data
    return out, offsets + np.arange(n + 1)


def grams(x: np.ndarray, offsets: np.ndarray, order: int = LONGEST) -> np.ndarray:
    """At every byte: the byte, then the one before it, and so on back, end marks before a row; the byte in the highest place."""
    begins, sizes = offsets[:-1], np.diff(offsets)
    held = np.full(len(x) + 8, END_BYTE, np.uint8)
    held[8:] = x
    out = np.ndarray(len(x), "<u8", held, 1, (1,)) >> U(8 * (7 - order))  # the eight bytes that end at each
    for i in range(order):
        out[begins[sizes > i] + i] |= U((1 << (8 * (order - i))) - 1)  # END_BYTE has all bits set
    return out


def distinct_grams(g: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct grams and how often each occurs. ``g`` is overwritten."""
    if weights is None:
        g.sort()
    else:
        order = np.argsort(g)
        g, weights = g[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    counts = np.diff(first, append=len(g)) if weights is None else np.add.reduceat(weights, first) if len(g) else weights
    return g[first], counts


def shorter(g: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a lower order, and where each begins among ascending grams of the longest."""
    h = g >> U(8 * (LONGEST - order))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], first


def bucket_of(h: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Grams that share the last two bytes before meet in a bucket."""
    before = (h >> U(8 * (order - 2))) & U(0xFFFF)
    return (((before + U(1)) * _GRAM_MIX) >> U(40)).astype(np.int64) % buckets


def pair_keys(h: np.ndarray, order: int, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Context and path of each gram as one number, and the path's length."""
    context = (h & U((1 << (8 * order)) - 1)).astype(np.int64)
    of = code.of(h, order)
    return context << CODE | code.path[of], code.length[of]


def _counted(docs: DataFrame) -> DataFrame:
    """kind, key, c: training tokens (kind 0, by hash) and grams of a byte and two before (kind 1), each task's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_, times = [], []
        keys, sums, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inverse, weights=np.concatenate(sums)).astype(np.int64)

        def rows(k: np.ndarray, c: np.ndarray, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(c)], ["kind", "key", "c"])

        n = 0
        for batch in batches:
            n += len(batch)
            for _, _, data, offsets in sh.each_slice(batch.column(0), SLICE):
                x, off = with_ends(data, offsets)
                g, t = distinct_grams(grams(x, off, 2))
                grams_.append(g)
                times.append(t)
                if len(grams_) == 64:
                    g, t = distinct_grams(np.concatenate(grams_), np.concatenate(times))
                    grams_, times = [g], [t]
                k, c = np.unique(sh.word_hashes(data, offsets)[0], return_counts=True)
                keys.append(k)
                sums.append(c)
                held += len(k)
                if held > 2_000_000:
                    k, c = merged()
                    keys, sums, held = [k], [c], len(k)
                    if held > 1_500_000:
                        yield rows(k, c, 0)
                        keys, sums, held = [], [], 0
        if keys:
            yield rows(*merged(), 0)
        if n:
            yield rows(END_TOKEN, np.array([n]), 0)
            yield rows(*distinct_grams(np.concatenate(grams_), np.concatenate(times)), 1)

    return docs.mapInArrow(run, "kind int, key long, c long")


def _packed(a: np.ndarray) -> bytes:
    kind = "u1" if (m := int(a.max(initial=0))) < 256 else "u2" if m < 65536 else "u8"
    return kind.encode() + zlib.compress(a.astype(kind).tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[2:]), b[:2].decode()).astype(np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, by planes of bytes."""
    planes = np.ascontiguousarray(np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T)
    return len(keys).to_bytes(8, "little") + zlib.compress(planes.tobytes(), 1)


def _unpacked_keys(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(zlib.decompress(b[8:]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U)[:, 0], dtype=U)


def _each_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Stretches of rows that are alike in the first column."""
    part, held = None, []
    for batch in batches:
        p = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if p[a] != part and held:
                yield part, held
                held = []
            part = int(p[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield part, held


def _give_back() -> None:
    """Return freed memory to the system: Python workers go on from stage to stage, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _joined(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The rows of some batches in one, or few where a column is too long; without what else those batches held."""
    out = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    held.clear()
    return out


@contextlib.contextmanager
def _arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Smaller batches between Spark and Python for the queries run within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _part_grams(held: list[pa.RecordBatch], column: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a part's texts and their counts."""
    keys, sums = [], []
    for batch in held:
        for _, _, data, offsets in sh.each_slice(batch.column(column), BATCH):
            k, c = distinct_grams(grams(*with_ends(data, offsets)))
            keys.append(k)
            sums.append(c)
            if sum(map(len, keys)) > 4_000_000 and len(keys) > 1:
                k, c = distinct_grams(np.concatenate(keys), np.concatenate(sums))
                keys, sums = [k], [c]
    return distinct_grams(np.concatenate(keys), np.concatenate(sums))


def _asked(texts: DataFrame, buckets: int) -> DataFrame:
    """For each part of the texts and bucket: the part's grams and how often each occurs in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _each_part(batches):
            learn = not held[0].column(1)[0].as_py()  # a part is of one kind
            keys, counts = _part_grams(_joined(held), 2)
            bucket = bucket_of(keys, LONGEST, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            at = [(j, order[a:b]) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([j for j, _ in at], pa.int32()), pa.array([part] * len(at), pa.int64()), pa.array([_packed_keys(keys[i]) for _, i in at], pa.binary()), pa.array([_packed(counts[i] if learn else np.zeros(len(i), np.int64)) for _, i in at], pa.binary())],
                ["bucket", "part", "keys", "counts"],
            )

    return texts.mapInArrow(run, "bucket int, part long, keys binary, counts binary")


class Regression:
    """Logistic regression of the bits of paths on what the corpus predicts, gate by gate: the sum of second-order expansions of the coding cost."""

    def __init__(self):
        n = INPUTS - 1
        self.start = Weights().mix[:n].T.astype(float)
        self.curve, self.pull = np.zeros((GATES, n, n)), np.zeros((GATES, n))
        self.seen = False

    def weights(self, curve: np.ndarray | float = 0.0, pull: np.ndarray | float = 0.0) -> np.ndarray:
        curve, pull = self.curve + curve + RIDGE * np.eye(INPUTS - 1), self.pull + pull + RIDGE * self.start
        return np.linalg.solve(curve, pull[..., None])[..., 0]

    def teach(self, keys: np.ndarray, counts: np.ndarray, odds: list[np.ndarray], grades: list[np.ndarray], code: Code) -> None:
        """Grams of a part, how often each occurs there, and on the paths of each order's grams the odds and grades by all other parts."""
        begins = []
        for order in ORDERS:
            h, first = shorter(keys, order)
            _, size = pair_keys(h, order, code)
            begins.append(np.repeat(np.cumsum(size) - size, np.diff(first, append=len(keys))))
        for c in range(0, len(keys), TEACH):
            s = slice(c, c + TEACH)
            at = code.of(keys[s], LONGEST)
            length = code.length[at]
            of, d = np.repeat(np.arange(len(at)), length), _inner(length)
            places = [b[s].take(of) + d for b in begins]
            gate = (grades[-2].take(places[-2]) << np.uint8(3)) | grades[-1].take(places[-1])
            by = np.argsort(gate, kind="stable")
            y = np.empty((INPUTS - 1, len(by)), np.float32)
            y[0] = code.odds.take((code.begin[at].take(of) + d).take(by))
            for i, (odd, place) in enumerate(zip(odds, places, strict=True), 1):
                y[i] = odd.take(place.take(by))
            y -= np.float32(128)
            self._add(y, counts[s].take(of.take(by)).astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=GATES))]))

    def _add(self, y: np.ndarray, times: np.ndarray, cuts: np.ndarray) -> None:
        w = self.weights()
        for _ in range(1 if self.seen else FIRST_STEPS):
            curve, pull = np.zeros_like(self.curve), np.zeros_like(self.pull)
            for g, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if b > a:
                    x, n = y[:, a:b], times[a:b]
                    q = 1 / (1 + np.exp(np.clip(np.einsum("i,ij->j", w[g].astype(np.float32), x), -30, 30)))  # how far the probability is from 1
                    curve[g] = np.einsum("ij,kj->ik", x * (q * (1 - q) * n), x)
                    pull[g] = curve[g] @ w[g] + np.einsum("ij,j->i", x, q * n)
            w = self.weights(curve, pull)
        self.curve += curve
        self.pull += pull
        self.seen = True

    def packed(self) -> bytes:
        return np.concatenate([self.curve.ravel(), self.pull.ravel()]).tobytes()

    def add_packed(self, b: bytes) -> None:
        x = np.frombuffer(b)
        self.curve += x[: self.curve.size].reshape(self.curve.shape)
        self.pull += x[self.curve.size :].reshape(self.pull.shape)


def _answered(asked: DataFrame, code: Code) -> DataFrame:
    """part, bucket, keys, data: the part's grams, and what the counts of all other parts predict on their paths, order by order; and, in one row of each
    bucket that has training texts, what their grams there teach the weights."""
    shared = asked.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for bucket, held in _each_part(b.select(["bucket", "part", "keys", "counts"]) for b in batches):
            parts, keys, counts = ([x for b in held for x in b.column(i).to_pylist()] for i in range(1, 4))
            own = [(_unpacked_keys(k), _unpacked(n)) for k, n in zip(keys, counts, strict=True)]
            every, total = distinct_grams(np.concatenate([k for k, _ in own]), np.concatenate([n for _, n in own]))
            odds, grades = ([[] for _ in own] for _ in range(2))
            for order in ORDERS:
                h, first = shorter(every, order)
                key, length = pair_keys(h, order, c)
                by = np.argsort(key)
                key, length = key[by], length[by]
                node, branch = path_counts(key, length, np.add.reduceat(total, first)[by])
                begin = np.cumsum(length) - length
                for i, (k, n) in enumerate(own):
                    h, first = shorter(k, order)
                    mine, size = pair_keys(h, order, c)
                    by = np.argsort(mine)
                    mine, size = mine[by], size[by]
                    less_node, less_branch = path_counts(mine, size, np.add.reduceat(n, first)[by])
                    at = np.repeat(begin[np.searchsorted(key, mine)], size) + _inner(size)
                    odd, grade = graded(node[at] - less_node, branch[at] - less_branch)
                    # back to the order of the part's grams
                    back = np.empty(len(by), np.int64)
                    back[by] = np.arange(len(by))
                    own_begin = np.cumsum(size) - size
                    at = np.repeat(own_begin[back], size[back]) + _inner(size[back])
                    odds[i].append(odd[at])
                    grades[i].append(grade[at])
            taught = Regression()
            for (k, n), x, y in zip(own, odds, grades, strict=True):
                if n.any():
                    taught.teach(k, n, x, y, c)
            taught = [taught.packed() if taught.seen else None] + [None] * (len(parts) - 1)
            data = [zlib.compress(np.concatenate(x + y).tobytes(), 1) for x, y in zip(odds, grades, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int64()), pa.array([bucket] * len(parts), pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary()), pa.array(taught, pa.binary())],
                ["part", "bucket", "keys", "data", "taught"],
            )

    rows = asked.repartition(spread(asked.sparkSession), "bucket").sortWithinPartitions("bucket", "part")
    return rows.mapInArrow(run, "part long, bucket int, keys binary, data binary, taught binary")


class Predictions:
    """What is known of each step of the path of each of a part's grams: 64 bits, a byte of log odds (signed, in steps of STEP) for the code and each order,
    one with the gate and above it the bit, one with the bit as 1 or -1, eleven bits for the slot and five to check it."""

    def __init__(self, answers: Iterable[tuple[np.ndarray, np.ndarray | None]], code: Code):
        """``answers``: ascending grams of each bucket with the odds and grades on their paths, order by order, or None where the corpus knows nothing."""
        keys, begins, words, n = [], [], [], 0
        for k, data in answers:
            w, begin = self._words(k, data, code)
            keys.append(k)
            begins.append(begin + n)
            words.append(w)
            n += len(w)
        self.words = np.concatenate(words)
        del words
        self._place(np.concatenate(keys), np.concatenate(begins))

    def _place(self, keys: np.ndarray, begin: np.ndarray) -> None:
        """A table of where each gram's steps begin. A gram times an odd number, modulo 2^48, is its place and what tells it apart there, so nothing collides;
        that and the number of the try share the upper half of an entry."""
        self.bits, left = max(20, int(2 * len(keys)).bit_length()), np.arange(len(keys))
        while len(left):
            self.table, left = np.zeros(1 << self.bits, U), np.arange(len(keys))
            for t in range(1, self.tries()):
                at, mark = self._try(keys[left] * _GRAM_MIX, t)
                entry = (mark << U(32)) | begin[left].astype(U)
                free = self.table.take(at) == 0
                self.table[at[free]] = entry[free]
                left = left[self.table.take(at) != entry]
                if not len(left):
                    break
            else:
                self.bits += 1

    def tries(self) -> int:
        return min(64, 1 << (self.bits - 16))

    def _try(self, h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and mark of mixed grams at the ``t``-th try, the first with ``t`` = 1."""
        rest = U(48 - self.bits)
        mark = h & U((1 << int(rest)) - 1)
        at = (h >> rest) & U((1 << self.bits) - 1)
        if t > 1:
            at += U(t - 1) * (mark | U(1))
            at &= U((1 << self.bits) - 1)
        mark |= U(t) << rest
        return at.view(np.int64), mark

    @staticmethod
    def _words(keys: np.ndarray, data: np.ndarray | None, code: Code) -> tuple[np.ndarray, np.ndarray]:
        at = code.of(keys, LONGEST)
        length = code.length[at]
        of = np.repeat(np.arange(len(keys)), length)
        d = _inner(length)
        path = code.path[at].take(of)
        words = code.odds.take(code.begin[at].take(of) + d).astype(U)
        bit = ((path >> (CODE - 1 - d)) & 1).astype(U)
        words |= (bit << U(6) | (U(255) - U(254) * bit) << U(8)) << U(8 * (INPUTS - 1))
        del bit
        node = ((path >> (CODE - d)) | (1 << d)).astype(U)
        del path
        before = ((keys >> U(8 * (LONGEST - OWN))) & U((1 << (8 * OWN)) - 1)) * _GRAM_MIX
        node ^= before.take(of)
        node *= U(0xBF58476D1CE4E5B9)
        node >>= U(48)
        words |= node << U(48)
        del node
        gate, used = np.zeros(len(d), np.uint8), 0
        for i, order in enumerate(ORDERS, 1):
            h, first = shorter(keys, order)
            _, size = pair_keys(h, order, code)
            n, places = int(size.sum()), np.repeat(np.cumsum(size) - size, np.diff(first, append=len(keys))).take(of) + d
            if data is None:
                odds, grades = np.full(n, 128, np.uint8), np.zeros(n, np.uint8)
            else:
                odds, grades = data[used : used + n], data[len(data) // 2 + used : len(data) // 2 + used + n]
            used += n
            words |= odds.take(places).astype(U) << U(8 * i)
            if i >= len(ORDERS) - 1:
                gate <<= np.uint8(3)
                gate |= grades.take(places)
        words |= gate.astype(U) << U(8 * (INPUTS - 1))
        words ^= U(0x80808080)
        return words, np.cumsum(length) - length

    def steps(self, g: np.ndarray) -> np.ndarray:
        """Where the steps of each of the grams begin."""
        h = g * _GRAM_MIX
        at, mark = self._try(h, 1)
        entry = self.table.take(at)
        out = (entry & U(0xFFFFFFFF)).view(np.int64)
        left = np.flatnonzero((entry >> U(32)) != mark)
        for t in range(2, self.tries()):
            if not len(left):
                break
            at, mark = self._try(h.take(left), t)
            entry = self.table.take(at)
            out[left] = (entry & U(0xFFFFFFFF)).view(np.int64)
            left = left[(entry >> U(32)) != mark]
        if len(left):
            raise RuntimeError("the texts of a part changed between two reads")
        return out


class Weights:
    """What blocks begin with: weights of each gate, in the units of the inputs, that of the slots alike for all gates, and corrections by size."""

    def __init__(self):
        self.mix = np.full((INPUTS, GATES), 0.3, np.float32)
        self.mix[: INPUTS - 1] *= np.float32(STEP)
        self.sizes = np.zeros(SIZES, np.float32)


def _bits_in_step(x: np.ndarray, offsets: np.ndarray, code: Code, found: Predictions) -> tuple[np.ndarray, ...]:
    """What is known of all bits of all blocks, first bits first; how many blocks are left at each step; and the row and number of bits of each block, largest first."""
    g = grams(x, offsets)
    length = np.empty(len(x), np.uint8)
    for c in range(0, len(x), 1 << 16):
        length[c : c + (1 << 16)] = code.length.take(code.of(g[c : c + (1 << 16)], LONGEST))
    bit_at = np.zeros(len(x) + 1, np.int64)
    np.cumsum(length, out=bit_at[1:])
    pieces = np.maximum(1, -(-np.diff(offsets) // BLOCK))
    row = np.repeat(np.arange(len(offsets) - 1), pieces)
    begin = offsets[row] + BLOCK * _inner(pieces)
    sizes = np.diff(bit_at[begin], append=bit_at[-1])
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(row), np.int64)
    rank[order] = np.arange(len(row))
    active = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    at_step = np.concatenate([[0], np.cumsum(active)])
    out = np.empty(int(bit_at[-1]), U)
    edges = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(x), 1 << 15)), len(begin)))
    begin = np.append(begin, len(x))
    for a, b in zip(edges, edges[1:], strict=False):  # whole blocks of some bytes together, that stay in cache
        s, bits, n = slice(begin[a], begin[b]), sizes[a:b], bit_at[begin[a]]
        steps = np.arange(bit_at[begin[b]] - n)
        place = at_step.take(steps - np.repeat(bit_at[begin[a:b]] - n, bits))
        place += np.repeat(rank[a:b], bits)
        steps += np.repeat(found.steps(g[s]) - (bit_at[s] - n), length[s])
        out[place] = found.words.take(steps)
    return out, active, row[order], sizes[order]


def _states() -> tuple[np.ndarray, np.ndarray]:
    """Log odds of a slot's state, and the state after each bit: up to 14 of either bit, the other halved when it is refuted."""
    pairs = [(a, b) for a in range(15) for b in range(15)]
    number = {p: i for i, p in enumerate(pairs)}
    odds = np.array([np.log((b + 0.4) / (a + 0.4)) for a, b in pairs], np.float32)
    fall = lambda n: n if n <= 2 else n // 2 + 1
    after = [number[p] for a, b in pairs for p in ((min(a + 1, 14), fall(b)), (fall(a), min(b + 1, 14)))]
    return odds, np.array(after, np.uint16)


_ODDS, _AFTER = _states()
#: What a slot holds is twice its state (9 bits) and 5 bits that differ from the wanted check; another context's slot is empty. With the bit in the lowest
#: place it tells the log odds for that bit, in steps of STEP, and what the slot holds after it, the bit still in its place.
_HELD_ODDS, _HELD_AFTER = np.zeros(1 << 14, np.float32), np.tile(_AFTER[:2], 1 << 13)
_HELD_ODDS[: len(_AFTER)] = np.stack([-_ODDS, _ODDS], 1).ravel() / np.float32(STEP)
_HELD_AFTER[: len(_AFTER)] = _AFTER
_HELD_AFTER = _HELD_AFTER << np.uint16(1) | np.tile(np.array([0, 1], np.uint16), 1 << 13)
#: Bits whose known parts are unpacked at once, that stay in cache, and steps whose probabilities are multiplied before a logarithm is taken.
UNPACK, MULTIPLY = 1 << 14, 16
_TOP, _NONE, _MIDDLE, _FAR, _ONE = (np.array(x, np.float32) for x in (SIZES - 0.5, 0, SIZES / 2, 30, 1))


def costs(x: np.ndarray, offsets: np.ndarray, code: Code, found: Predictions | None, start: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs of the probabilities of rows of bytes with end marks, and how many bits each row has.

    A block's weights are those of the gate plus its own, which begin at zero (that of the slots at the start) and follow the gradient after each bit.
    What the gate's weights alone give is known for many bits at once. Sums and a block's own weights are held with the other sign: as log odds against the branch taken.
    """
    if found is None:
        found = Predictions([(distinct_grams(grams(x, offsets))[0], None)], code)
    words, active, row, sizes = _bits_in_step(x, offsets, code, found)
    n = len(row)
    gates, corrections = np.ascontiguousarray(-start.mix[: INPUTS - 1].T), np.tile(start.sizes, n)
    own = np.zeros((INPUTS, n), np.float32)
    own[INPUTS - 1] = -start.mix[INPUTS - 1, 0] * np.float32(STEP)  # all inputs in steps of STEP
    slots = np.zeros(n * SLOTS, np.uint16)
    slots_of, sizes_of = np.arange(n) * SLOTS, np.arange(n) * SIZES
    rate = np.array(RATE * STEP * STEP, np.float32)
    total, odds_of_all, v = np.zeros(n), np.ones(n), np.empty((INPUTS, n), np.float32)
    at_step = np.concatenate([[0], np.cumsum(active)])
    first = 0
    while first < len(active):
        last = max(first + 1, int(np.searchsorted(at_step, at_step[first] + UNPACK, side="right")) - 1)
        known = words[at_step[first] : at_step[last]]
        y = np.empty((INPUTS, len(known)), np.float32)
        corpus = known.astype(U32).view(np.int8).astype(np.float32).reshape(-1, INPUTS - 1)
        y[: INPUTS - 1] = corpus.T
        sign = known.view(np.int8)[INPUTS::8].astype(np.float32)
        twice, taught = sign * np.float32(-2), sign * np.float32(SIZE_RATE)
        slot_of = (known >> U(53)).view(np.int64)
        gate = ((known >> U(8 * (INPUTS - 1))) & U(GATES - 1)).view(np.int64)
        corpus *= gates.take(gate, axis=0)
        base = corpus[:, 0] + corpus[:, 1]
        for i in range(2, INPUTS - 1):
            base += corpus[:, i]
        checks = (((known >> U(39)) & U(31 << 9)) | ((known >> U(38)) & U(1))).astype(np.uint16)  # and the bit
        at = 0
        for i, a in enumerate(active[first:last].tolist(), first):
            s = slice(at, at + a)
            at += a
            slot = slot_of[s]
            slot += slots_of[:a]
            held = slots.take(slot)
            held ^= checks[s]
            state = held.astype(np.intp)
            inputs = y[:, s]
            _HELD_ODDS.take(state, out=inputs[INPUTS - 1], mode="clip")
            w = own[:, :a]
            z = np.einsum("ij,ij->j", w, inputs)
            z += base[s]
            side = z * twice[s]
            side += _MIDDLE
            np.minimum(side, _TOP, out=side)
            np.maximum(side, _NONE, out=side)
            size = side.astype(np.intp)
            size += sizes_of[:a]
            now = corrections.take(size)
            z -= np.multiply(sign[s], now, out=side)
            np.minimum(z, _FAR, out=z)
            q = np.exp(z, out=z)
            one = q + _ONE
            odds_of_all[:a] *= one
            q /= one  # how far the probability is from 1
            now += np.multiply(q, taught[s], out=side)
            corrections[size] = now
            q *= rate
            w -= np.multiply(inputs, q, out=v[:, :a])
            held = _HELD_AFTER.take(state)
            held ^= checks[s]
            slots[slot] = held
            if i % MULTIPLY == MULTIPLY - 1:
                total -= np.log(odds_of_all)
                odds_of_all.fill(1)
        first = last
    total -= np.log(odds_of_all)
    return np.bincount(row, weights=total, minlength=len(offsets) - 1), np.bincount(row, weights=sizes, minlength=len(offsets) - 1)


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    got = [(a, sh.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in sh.slices(offsets)]
    return np.concatenate([h for _, (h, *_) in got]), np.concatenate([of + a for a, (_, of, *_) in got])


def token_table(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log10(c + 0.1) in an open table of four tries; what finds no place is left out (and joined instead)."""
    size = 1 << max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
    table, logs = np.zeros(size, U), np.zeros(size)
    left = np.flatnonzero(keys != 0)
    for t in range(4):
        at = ((keys[left] >> U(40 - 13 * t if t < 3 else 7)) % U(size)).astype(np.int64)
        free = np.flatnonzero(table[at] == 0)
        _, first = np.unique(at[free], return_index=True)
        take = free[first]
        table[at[take]] = keys[left[take]]
        logs[at[take]] = np.log10(counts[left[take]] + 0.1)
        left = np.delete(left, take)
    return table, logs


def token_places(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in the table, and whether it is there."""
    at = ((h >> U(40)) % U(len(table))).astype(np.int64)
    found = table.take(at) == h
    for t in range(1, 4):
        left = np.flatnonzero(~found)
        again = ((h[left] >> U(40 - 13 * t if t < 3 else 7)) % U(len(table))).astype(np.int64)
        hit = table.take(again) == h[left]
        at[left[hit]] = again[hit]
        found[left[hit]] = True
    found &= h != 0
    return at, found


def _common_tokens(tokens: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the tokens above a count that no more than ``most`` reach."""
    grade = F.floor(8 * F.log2("c")).cast("int")
    by = sorted(map(tuple, tokens.groupBy(grade.alias("g")).agg(F.count(F.lit(1))).collect()), reverse=True)
    least, n = None, 0
    for g, c in by:
        if n + c > most:
            break
        least, n = g, n + c
    if least is None:
        return np.empty(0, U), np.empty(0, np.int64)
    got = tokens.filter(grade >= least).select("key", "c").toArrow().combine_chunks()
    return np.asarray(got["key"]).view(np.uint64), np.asarray(got["c"])


def _by_part(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """A part's answers, then its texts in the order of hashed ids."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    both = answers.select("part", F.lit(0).alias("kind"), "bucket", "keys", "data", none(kind).alias("doc_id"), none("boolean").alias("held_out"), none("string").alias("text"))
    both = both.union(texts.select("part", F.lit(1), F.lit(0), none("binary"), none("binary"), "doc_id", "held_out", "text"))
    return both.repartition(spread(texts.sparkSession), "part").sortWithinPartitions("part", "kind", "bucket", F.xxhash64("doc_id", "text"))


def _split(held: list[pa.RecordBatch]) -> tuple[list[tuple[bytes, bytes]], list[pa.RecordBatch]]:
    """Grams and predictions of a part's buckets, and its texts."""
    answers, texts = [], []
    for batch in held:
        n = int(np.count_nonzero(np.asarray(batch.column(1)) == 0))
        answers += zip(batch.column(3)[:n].to_pylist(), batch.column(4)[:n].to_pylist(), strict=True)
        if n < len(batch):
            texts.append(batch.slice(n))
    held.clear()  # nothing of a part stays while the next one is read
    return answers, _joined(texts)


def _learned(answers: DataFrame) -> Weights:
    """Weights from all training texts: the sums of what the buckets were taught."""
    sums = Regression()
    for b in sorted(bytes(r["taught"]) for r in answers.select("taught").filter("taught IS NOT NULL").collect()):  # a row a bucket
        sums.add_packed(b)
    out = Weights()
    out.mix[: INPUTS - 1] = sums.weights().T
    return out


def _scored(texts: DataFrame, answers: DataFrame, model: dict) -> DataFrame:
    """Every text with its scores."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def scored(answers: list[tuple[bytes, bytes]], rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        found = Predictions(((_unpacked_keys(k), np.frombuffer(zlib.decompress(data), np.uint8)) for k, data in answers), m["code"])
        answers.clear()
        for batch in rows:
            for a, b, data, offsets in sh.each_slice(batch.column(7), BATCH, BATCH_ROWS):
                n = b - a
                h, of = _words_of(data, offsets)
                at, known = token_places(m["keys"], h)
                words, base = np.bincount(of, minlength=n), np.bincount(of[known], weights=m["logs"][at[known]], minlength=n).astype(float)
                rare, begins = h[~known], np.searchsorted(of[~known], np.arange(n + 1)).astype(np.int32)
                x, off = with_ends(data, offsets)
                score = costs(x, off, m["code"], found, m["weights"])[0] / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(5).slice(a, n), batch.column(6).slice(a, n), pa.array(words + 1), pa.array(np.bincount(of[known], minlength=n)), pa.array(base), pa.array(score, pa.float64()), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(begins), pa.array(rare.view(np.int64)))],
                    ["doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "rare"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        for _, held in _each_part(batches):
            answers, rows = _split(held)
            if rows:
                yield from scored(answers, rows)
            del answers, rows
            _give_back()

    return _by_part(texts, answers).mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, rare array<long>")


@scoped
def score_documents(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row."""
    spark = docs.sparkSession
    ship(spark)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    held = F.crc32(name.cast("binary")) % folds == 0
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learn = rows.filter("NOT held_out").select("text")

    counts = stage(_counted(learn).groupBy("kind", "key").agg(F.sum("c").alias("c")), "lm-counts")
    tokens = counts.filter("kind = 0").select("key", "c")
    total = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    got = counts.filter("kind = 1").select("key", "c").toArrow()  # three bytes: 2^24 rows at most, some ten thousand in most corpora
    code = Code(np.asarray(got["key"].combine_chunks()).astype(U), np.asarray(got["c"].combine_chunks()))

    by_kind = {r["held_out"]: r["n"] for r in rows.groupBy("held_out").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}
    n_train, n_held = max(LEAST_PARTS, -(-by_kind.get(False, 0) // part_bytes)), max(1, -(-by_kind.get(True, 0) // part_bytes))
    buckets = max(1, (n_train + n_held) // PARTS_A_BUCKET)
    dealt = F.xxhash64(F.col("doc_id").cast("string"), "text")
    texts = rows.withColumn("part", F.when(F.col("held_out"), n_train + F.pmod(dealt, F.lit(n_held))).otherwise(F.pmod(dealt, F.lit(n_train))))
    parts = texts.select("part", "held_out", "text").repartition(spread(spark), "part").sortWithinPartitions("part")
    with _arrow_rows(spark, ARROW_ROWS):
        answers = stage(_answered(_asked(parts, buckets), code), "lm-answers")
    keys, logs = token_table(*_common_tokens(tokens, MOST_COMMON))
    model = {"code": code, "keys": keys, "logs": logs, "weights": _learned(answers)}
    with _arrow_rows(spark, ARROW_ROWS):
        scored = stage(_scored(texts, answers, model).withColumn("row", F.monotonically_increasing_id()), "lm-scored")

    # the end token is common or, in tiny corpora, not; it is looked up here
    end = tokens.filter(F.col("key") == F.lit(int(END_TOKEN.view(np.int64)[0]))).first()
    ends = int(end["c"]) if end else 0
    rare = scored.select("row", F.explode("rare").alias("key")).join(tokens, "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.1)).alias("more"), F.sum((F.col("c") > 0).cast("long")).alias("also"))
    out = scored.drop("rare").join(rare, "row", "left")
    below = float(np.log10(total["n"] + 0.1 * (total["v"] + 1)))
    n_known = F.col("known") + F.coalesce("also", F.lit(0)) + int(ends > 0)
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + float(np.log10(ends + 0.1)) - F.col("n_tokens") * below
    return out.select(
        "doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(int(total["n"])).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
