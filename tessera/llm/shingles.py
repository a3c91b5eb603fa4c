"""Word and shingle hashes of batches of texts, as whole-array numpy operations.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash comes from sums
of its bytes' random values times powers of an odd number, modulo 2^64, so that one running sum over a batch
serves all words. A shingle of k words hashes its words' hashes; the sets that are compared hold 52 bits of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 500_000
SET_BITS = 52
_rng = np.random.default_rng(20_240_601)
_P = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_COEF = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.empty(0, U), np.empty(0, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all 64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, SLICE + 1)
        for i, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            a = np.full(m, U(p), U)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=U)
    out = _powers[0][:n], _powers[1][:n]
    if len(_powers[0]) > 8_000_000:  # after a giant text
        _powers[:] = [np.empty(0, U), np.empty(0, U)]
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets in them; null rows are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE, rows: int = 4000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, a longer row alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1, a + rows, n)
        b = max(b, a + 1)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, row, start and end byte of every word of some rows; ``offsets`` are from the first row's."""
    n = len(data)
    if not n:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)  # a word can't run over the start of a row
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = powers(n)
    run = np.empty(n + 1, U)
    run[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up, out=run[1:])
    h = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return h, rows, starts, ends


def shingle_hashes(h: np.ndarray, rows: np.ndarray, n_rows: int, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """hash and row of every shingle of k words; with ``whole`` a row of fewer words is one shingle."""
    out = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k):
        out += h[j : j + len(out)] * _COEF[j]
    same = rows[: len(out)] == rows[k - 1 :] if len(out) else np.empty(0, bool)
    got, of = mix(out[same]), rows[: len(out)][same]
    if whole and len(h):
        count = np.bincount(rows, minlength=n_rows)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            s = np.zeros(len(short), U)
            for j in range(k - 1):
                at = first[short] + j
                has = j < count[short]
                s[has] += h[at[has]] * _COEF[j]
            got, of = np.concatenate([got, mix(s + _COEF[63] * count[short].astype(U))]), np.concatenate([of, short])
    return got, of


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (52 bits) of each row, sorted, one row after the other; and where each row begins.

    ``len(offsets) - 1`` is at most 4,096: a row's number and its shingle share one 64-bit word in the sort.
    """
    h, rows, *_ = word_hashes(data, offsets)
    n_rows = len(offsets) - 1
    s, of = shingle_hashes(h, rows, n_rows, k)
    key = np.sort((of.astype(U) << U(SET_BITS)) | (s >> U(64 - SET_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    of = (key >> U(SET_BITS)).astype(np.int64)
    begins = np.searchsorted(of, np.arange(n_rows + 1))
    return key & U((1 << SET_BITS) - 1), begins


def each_slice(texts: pa.Array, limit: int = SLICE, rows: int = 4000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffers(texts)
    for a, b in slices(offsets, limit, rows):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
