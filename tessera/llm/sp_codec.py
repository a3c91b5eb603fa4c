"""SentencePiece encoding by streaming Viterbi, and decoding.

The vocabulary comes from a SentencePiece model file; its path is a parameter, and the driver broadcasts the
pieces (a table bounded by the vocabulary). Encoding finds the segmentation of the greatest total score, in fixed point; of
equal ones that whose last piece is longer.

The search goes along a text and keeps the scores of the boundaries within the longest piece, in a ring. Backpointers
form a tree; a boundary that leaves the ring without a child is cut off, and when the committed boundary has left the
ring and has one child, all surviving paths meet in that child: its id is committed. Boundaries that no piece of
the text spans are met by all paths, so a text is cut at such places into stretches of about ``STRETCH`` characters, and the
stretches of a batch advance in step, as numpy operations (:func:`advance`). A stretch that finds no such place in
``LONGEST`` characters goes through the same search one character at a time (:func:`stream`).

Scores of unigram models are used as they stand. BPE models have merge ranks instead: a rank r counts as -log(r + 500), so
that an earlier merge always scores above a later one and fewer pieces mostly above more; some 86 % of
words get the pieces that merging gives, and the number of ids differs by 1 to 2 %. Characters without a piece become byte pieces
(or the unknown piece where the model has none), at a score below every path of known pieces. What the model file
says of a leading space and of normalisation is followed; a text that normalisation changes does not decode to itself.

Null and empty texts have no ids. A literal U+2581 in a text is written as bytes, so that decoding returns the text
exactly. Texts of any length are encoded whole, in memory of a few hundred bytes for each character of a stretch. Repeated
rows are encoded alike; an empty table gives none. Only the two named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as sh
from tessera.session import ship

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANK_OFFSET = 500
#: Characters of a stretch, of a batch of stretches, and of the longest stretch that is searched in step with others.
STRETCH, SLICE, LONGEST = 32, 160_000, 160_000
_FIXED = 1 << 20
_NONE = -(1 << 61)
_END, _SIGN = 0x110000, 0x110001  # after each text; a literal U+2581


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: dict[str, tuple[float, int]]
    bytes_: list[int] | None
    unknown: int
    silent: frozenset[int]
    prefix: bool = True
    normaliser: bytes | None = None  # the model, where it changes texts
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.scores), default=1)
        self.floor = round((min((s for s, _ in self.scores.values()), default=0.0) - 10.0) * _FIXED)
        self.fixed = {p: (round(s * _FIXED), i) for p, (s, i) in self.scores.items()}
        self.byte_of = {i: b for b, i in enumerate(self.bytes_ or ())}
        self._trie()
        text = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)

    def _trie(self) -> None:
        """Letters, and children of each prefix in tables that are tried one after the other."""
        letters = {c: k for k, c in enumerate(sorted({c for p in self.scores for c in p}), 1)}
        self.letter = np.zeros(_SIGN + 1, np.int32)
        for c, k in letters.items():
            self.letter[ord(c)] = k
        self.letter[ord(" ")], self.letter[ord(SPACE)] = letters.get(SPACE, 0), letters.get(SPACE, 0)
        self.letter[[_END, _SIGN]] = 0
        nodes: dict[str, int] = {"": 0}
        for p in self.scores:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.node_score, self.node_id = np.full(len(nodes), _NONE, np.int64), np.full(len(nodes), -1, np.int32)
        for p, (s, i) in self.fixed.items():
            self.node_score[nodes[p]], self.node_id[nodes[p]] = s, i
        keys = np.array([nodes[p[:-1]] << 24 | letters[p[-1]] for p in nodes if p], np.int64)
        to = np.array([k for p, k in nodes.items() if p], np.int32)
        self.tables: list[tuple[np.ndarray, np.ndarray, int]] = []
        while len(keys):
            bits = max(4, int(len(keys) * 8 - 1).bit_length())
            at = self._slot(keys, bits)
            _, first = np.unique(at, return_index=True)
            table, value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            table[at[first]], value[at[first]] = keys[first], to[first]
            self.tables.append((table, value, bits))
            rest = np.delete(np.arange(len(keys)), first)
            keys, to = keys[rest], to[rest]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * bits)) >> np.uint64(64 - bits)).astype(np.int64)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The prefix one letter longer; -1 where no piece begins so."""
        keys = node.astype(np.int64) << 24 | letter
        out, left = np.full(len(keys), -1, np.int32), None
        for table, value, bits in self.tables:
            k = keys if left is None else keys[left]
            at = self._slot(k, bits)
            hit = table.take(at) == k
            found = value.take(at[hit])
            if left is None:
                out[hit] = found
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = found
                left = left[~hit]
        return out


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        v = shift = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << shift
            shift += 7
            if c < 128:
                return v

    while i < len(b):
        key = number()
        kind, n = key & 7, 0
        if kind == 0:
            yield key >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, b[i : i + n]
        i += n


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    raw_model = sp.serialized_model_proto()
    spec = {f: dict(_fields(v)) for f, v in _fields(raw_model) if f in (2, 3)}
    trainer, norm = spec.get(2, {}), spec.get(3, {})  # model_type is field 3 of the trainer's; 2 is BPE
    changes = bool(norm.get(2)) or norm.get(4, 1) == 1  # a character map, or runs of spaces made one
    n = sp.get_piece_size()
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    byte = [i for i in range(n) if sp.is_byte(i)]
    normal = [i for i in range(n) if i not in special and not sp.is_byte(i)]
    raw = [sp.get_score(i) for i in normal]
    if trainer.get(3) == 2:  # merge ranks
        rank = {i: r for r, i in enumerate(sorted(normal, key=lambda i: -sp.get_score(i)))}
        raw = [-math.log(rank[i] + RANK_OFFSET) for i in normal]
    scores = {sp.id_to_piece(i): (s, i) for i, s in zip(normal, raw, strict=True)}
    by_value = {int(sp.id_to_piece(i)[3:5], 16): i for i in byte}
    return Vocabulary(
        [sp.id_to_piece(i) for i in range(n)], scores, [by_value[b] for b in range(256)] if len(by_value) == 256 else None, sp.unk_id(), frozenset(special),
        norm.get(3, 1) == 1, raw_model if changes else None,
    )


def _letters(codes: Iterable[int]) -> str:
    """Text as pieces spell it; a literal U+2581 is a character that no piece holds."""
    return "".join(SPACE if c == ord(" ") else "\ud800" if c == _SIGN else chr(c) for c in codes)


def stream(v: Vocabulary, codes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """(end, length) of the pieces of the best segmentation of some code points, each as soon as all surviving paths agree on it.

    Holds the last characters and scores, as many as the longest piece, and the paths since the committed boundary."""
    size, text, end = v.longest, "", 0
    ring: list[int] = [_NONE] * size  # scores of boundaries, by place modulo the longest piece
    ring[0] = 0
    back: dict[int, int] = {}
    children: dict[int, set[int]] = {0: set()}
    root = 0
    for end, code in enumerate(codes, 1):
        text = (text + _letters((code,)))[-size:]
        best, length = _NONE, 1
        for n in range(min(size, end), 0, -1):
            got = v.fixed.get(text[-n:])
            s = got[0] if got else v.floor * _byte_length(int(code)) if n == 1 else None
            if s is not None and (s := s + ring[(end - n) % size]) > best:
                best, length = s, n
        ring[end % size] = best
        back[end], children[end] = end - length, set()
        children[end - length].add(end)
        gone = end - size
        while gone > root and not children[gone]:
            del children[gone]
            parent = back.pop(gone)
            children[parent].discard(gone)
            gone = parent
            if gone > end - size:
                break
        while root <= end - size and len(children[root]) == 1:
            (child,) = children.pop(root)
            yield child, child - root
            root = child
            back.pop(child)
    path = []
    while end > root:
        path.append((end, end - back[end]))
        end = back[end]
    yield from reversed(path)


def _byte_length(code: int) -> int:
    return 3 if code == _SIGN else len(chr(code).encode()) if code != ord(" ") else 1


def matches(v: Vocabulary, codes: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each length the (last character, score, id) of all pieces in the text, and for each place before a character
    whether a piece spans it. Nothing matches over an end mark. Ids of -1 are written as bytes."""
    n = len(codes)
    letter = v.letter.take(codes)
    out = []
    span = np.zeros(n + 1, np.int64)
    at, node = np.flatnonzero(letter), None
    for length in range(1, v.longest + 1):
        if length == 1:
            node = v.child(np.zeros(len(at), np.int32), letter[at])
        else:
            inside = at + (length - 1) < n
            at, node = at[inside], node[inside]
            node = v.child(node, letter[at + (length - 1)])
        alive = node >= 0
        at, node = at[alive], node[alive]
        if not len(at):
            break
        got = v.node_id.take(node)
        whole = got >= 0
        last = at[whole] + (length - 1)
        out.append((last, v.node_score.take(node[whole]), got[whole]))
        if length > 1:
            span[at[whole] + 1] += 1  # one piece of a length begins at a place, and one ends there
            span[last + 1] -= 1
    single = np.zeros(n, bool)
    if out:
        single[out[0][0]] = True
    rest = np.flatnonzero(~single & (codes != _END))
    if len(rest):
        c = np.where(codes[rest] == _SIGN, ord(SPACE), codes[rest])
        width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        more = rest, v.floor * width, np.full(len(rest), -1, np.int32)
        out[:1] = [tuple(np.concatenate(x) for x in zip(out[0], more, strict=True)) if out else more]
        order = np.argsort(out[0][0])
        out[0] = tuple(x[order] for x in out[0])
    return out, np.cumsum(span)[:n] > 0


def advance(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_codes: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last character, length) of the pieces of all stretches, in order: the streaming search over all of them in step."""
    longest, n = len(found), len(starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = longest.bit_length()
    mask = (1 << bits) - 1
    first = starts + np.arange(n)  # boundaries: one more than characters in each stretch
    total = int(first[-1] + sizes[-1] + 1)
    length, children, child = np.zeros(total, np.int16), np.zeros(total, np.int32), np.zeros(total, np.int64)
    done = np.zeros(total, bool)
    order = np.argsort(-sizes, kind="stable")
    begin, zero, left = starts[order], first[order], sizes[order]
    root = zero.copy()
    ring = np.full((4 * longest, n), _NONE, np.int64)
    ring[longest - 1], k = 0, 0  # the window is ring[k : k + longest]
    steps = int(left[0])
    active = np.searchsorted(-left, -np.arange(steps), side="left")  # stretches longer than each step
    # scores with lengths, by [longest - length], laid out step by step
    at_step = np.concatenate([[0], np.cumsum(active)])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    place = np.full(n_codes, -1, np.int64)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place[np.repeat(starts, sizes) + inner] = at_step[inner] + np.repeat(rank, sizes)
    score = np.full((longest, int(at_step[-1])), _NONE, np.int64)
    for i, (last, value, _) in enumerate(found):
        to = place[last]
        own = to >= 0
        score[longest - 1 - i, to[own]] = (value[own] << bits) + (i + 1)
    for t in range(steps):
        a = int(active[t])
        best = (ring[k : k + longest, :a] + score[:, at_step[t] : at_step[t] + a]).max(0)
        size = best & mask
        if k + longest == len(ring):
            ring[: longest - 1] = ring[k + 1 :]
            k = -1
        ring[k + longest, :a] = best - size
        k += 1
        now = zero[:a] + (t + 1)
        length[now] = size
        parent = now - size
        children[parent] += 1
        child[parent] ^= now
        if t + 1 < longest:
            continue
        out = now - longest
        x = out.copy()
        dead = np.flatnonzero((children.take(x) == 0) & (x > root[:a]))
        while len(dead):
            gone = x[dead]
            parent = gone - length[gone]
            children[parent] -= 1
            child[parent] ^= gone
            x[dead] = parent
            dead = dead[(children[parent] == 0) & (parent > root[dead])]
        go = np.flatnonzero((children.take(root[:a]) == 1) & (root[:a] <= out))
        while len(go):
            to = child[root[go]]
            done[to] = True
            root[go] = to
            go = go[(children[to] == 1) & (to <= out[go])]
    end = zero + left
    go = np.flatnonzero(end > root)
    while len(go):
        done[end[go]] = True
        end[go] -= length[end[go]]
        go = go[end[go] > root[go]]
    at = np.flatnonzero(done)
    of = np.searchsorted(first, at, side="right") - 1
    return starts[of] + (at - first[of]) - 1, length[at].astype(np.int64)


def _flat_ids(v: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts, each of which ends with an end mark, and for each id the character that it ends with."""
    found, spanned = matches(v, codes)
    ends = codes == _END
    free = ~spanned & ~ends
    free[0] = not ends[0] if len(free) else False
    must = np.flatnonzero(free & np.concatenate([[True], ends[:-1]]))
    # cuts: where each text begins, and the first free place after every STRETCH characters
    places = np.flatnonzero(free)
    some = np.searchsorted(places, np.arange(0, len(codes), STRETCH))
    cuts = np.union1d(must, places[some[some < len(places)]])
    stop = np.flatnonzero(ends)
    sizes = np.minimum(np.append(cuts[1:], len(codes)), stop[np.searchsorted(stop, cuts)]) - cuts
    alone = sizes > LONGEST
    last, length = advance(found, len(codes), cuts[~alone], sizes[~alone])
    for a, n in zip(cuts[alone], sizes[alone], strict=True):
        got = np.array(list(stream(v, codes[a : a + n])), np.int64).reshape(-1, 2)
        last, length = np.concatenate([last, a + got[:, 0] - 1]), np.concatenate([length, got[:, 1]])
    if alone.any():
        order = np.argsort(last)
        last, length = last[order], length[order]
    out = np.empty(len(last), np.int32)
    for i, (ends_, _, ids) in enumerate(found, 1):
        of = np.flatnonzero(length == i)
        out[of] = ids[np.searchsorted(ends_, last[of])]
    rest = np.flatnonzero(out < 0)
    if not len(rest):
        return out, last
    if v.bytes_ is None:
        out[rest] = v.unknown
        return out, last
    raw = [(SPACE if c == _SIGN else chr(c)).encode() for c in codes[last[rest]].tolist()]
    count = np.ones(len(out), np.int64)
    count[rest] = [len(b) for b in raw]
    at = np.cumsum(count) - count
    many = np.repeat(out, count)
    where = np.repeat(at[rest], count[rest]) + np.concatenate([np.arange(len(b)) for b in raw])
    many[where] = np.array(v.bytes_, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
    return many, np.repeat(last, count)


def encode_batch(v: Vocabulary, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, row after the last, their ids in one array, and how many each row has."""
    data, offsets = sh.buffers(texts)
    for a, b in sh.slices(offsets, SLICE):
        raw = data[offsets[a] : offsets[b]]
        places = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets[a : b + 1] - offsets[a]]
        plain = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        plain[plain == ord(SPACE)] = _SIGN
        n = b - a
        lead = (np.diff(places) > 0) & v.prefix
        begins = places[:-1] + np.arange(n) + np.cumsum(lead) - lead  # where a row begins, its leading space included
        sizes = np.diff(places) + lead
        codes = np.full(len(plain) + n + int(lead.sum()), _END, np.int64)
        codes[begins[lead]] = ord(" ")
        codes[np.arange(len(plain)) + np.repeat(begins + lead - places[:-1], np.diff(places))] = plain
        ends = begins + sizes
        ids, last = [], []
        # one long text is searched in parts that meet at places which no piece spans
        at, step = 0, 2 * SLICE
        while at < len(codes):
            to = min(len(codes), at + step)
            if to < len(codes):
                look = max(at, to - SLICE // 4)
                safe = np.flatnonzero(~matches(v, codes[look : to + v.longest])[1][: to - look])
                safe = safe[safe > v.longest] + look  # pieces from before the look are not seen
                if len(safe):
                    to = int(safe[-1])
                else:  # no such place near: a longer part
                    step *= 2
                    continue
            part = codes[at:to]
            if to < len(codes) and part[-1] != _END:
                part = np.append(part, _END)
            if len(part) > 4 * SLICE:  # a stretch that nothing divides; in little memory
                ids_, last_ = _streamed(v, part)
            else:
                ids_, last_ = _flat_ids(v, part)
            ids.append(ids_)
            last.append(last_ + at)
            at, step = to, 2 * SLICE
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        last_all = np.concatenate(last) if last else np.empty(0, np.int64)
        yield a, b, flat, np.searchsorted(last_all, ends) - np.searchsorted(last_all, begins)


def _streamed(v: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids and their last characters, one character at a time."""
    out, last, a = [], [], 0
    for stop in np.flatnonzero(codes == _END).tolist():
        for end, n in stream(v, codes[a:stop]):
            got = v.fixed.get(_letters(codes[a + end - n : a + end]))
            raw = (SPACE if codes[a + end - 1] == _SIGN else chr(int(codes[a + end - 1]))).encode()
            own = [got[1]] if got else [v.bytes_[b] for b in raw] if v.bytes_ else [v.unknown]
            out += own
            last += [a + end - 1] * len(own)
        a = stop + 1
    return np.array(out, np.int32), np.array(last, np.int64)


def decode_batch(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows' ids, and where each row's begin, and the end. A row's leading space, where the model adds one, is left out."""
    size = v.text_at[ids + 1] - v.text_at[ids]
    ends = np.cumsum(size)
    at = np.repeat(v.text_at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    out = v.text[at]
    offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    if v.prefix:
        begins = offsets[:-1][np.diff(offsets) > 0]
        drop = begins[out[begins] == 32]
        keep = np.ones(len(out), bool)
        keep[drop] = False
        out = out[keep]
        offsets = offsets - np.searchsorted(drop, offsets)
    return out, offsets


def encode(v: Vocabulary, text: str | None) -> list[int]:
    return [i for _, _, ids, _ in encode_batch(v, pa.array([text], pa.string())) for i in ids.tolist()]


def decode(v: Vocabulary, ids) -> str:
    """The text of ids; exact for what :func:`encode` made with byte pieces."""
    return decode_batch(v, np.array(list(ids), np.int64), np.array([len(ids)]))[0].tobytes().decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model: str | Vocabulary = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids, round_trip: the ids of each text, and whether they decode to it exactly."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model) if isinstance(model, str) else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, normalise = shared.value, None
        if v.normaliser is not None:
            import sentencepiece

            normalise = sentencepiece.SentencePieceProcessor(model_proto=v.normaliser).normalize
        for batch in batches:
            given = texts = batch.column(1)
            if normalise is not None:  # the library's form has the leading space and signs for spaces
                texts = pa.array([None if t is None else normalise(t).replace(SPACE, " ").removeprefix(" " if v.prefix else "") for t in texts.to_pylist()], pa.string())
            data, offsets = sh.buffers(given)
            for a, b, ids, counts in encode_batch(v, texts):
                got, at = decode_batch(v, ids, counts)
                want = data[offsets[a] : offsets[b]]
                sizes = np.diff(offsets[a : b + 1])
                same = sizes == np.diff(at)
                if len(got) != len(want) or not np.array_equal(got, want):
                    same &= np.array([np.array_equal(got[at[r] : at[r + 1]], data[offsets[a + r] : offsets[a + r + 1]]) for r in range(b - a)], bool)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_ids long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str | Vocabulary = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each list of ids; null lists give an empty text."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load(model) if isinstance(model, str) else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(shared.value, x.as_py() or ()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
