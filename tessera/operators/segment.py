"""Circular binary segmentation of copy-number profiles, with seeded permutation tests."""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import anscombe
from tessera.session import ship


def best_arc(x: np.ndarray) -> tuple[float, int, int]:
    """The arc whose mean differs most from the rest: its statistic, first and last place."""
    s = x - x.mean()
    np.cumsum(s, out=s)
    lo, hi = int(np.argmin(s)), int(np.argmax(s))
    a, b = sorted((lo, hi))
    span = b - a
    if span == 0 or span == len(x):
        return 0.0, 0, len(x)
    return float((s[b] - s[a]) ** 2 * len(x) / (span * (len(x) - span))), a + 1, b + 1


def _split(x: np.ndarray, shuffles: int, p: float, rng: np.random.Generator) -> tuple[int, int] | None:
    n = len(x)
    found, a, b = best_arc(x)
    if n < 2 or b - a == n or found == 0.0:
        return None
    if a < 5:
        a = 0
    if n - b < 5:
        b = n
    over, allowed, y = 0, shuffles * p, x.copy()
    for _ in range(shuffles):
        rng.shuffle(y)
        over += best_arc(y)[0] >= found
        if over > allowed:
            return None
    return (a, b) if b - a < n else None


def circular_segments(x: np.ndarray, shuffles: int, p: float, least: int, rng: np.random.Generator) -> list[int]:
    """Starts of segments and the end. Pieces wait on a stack, so that depth is no concern."""
    cuts, todo = {0, len(x)}, [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2 * least:
            continue
        got = _split(x[lo:hi], shuffles, p, rng)
        if got is None:
            continue
        a, b = lo + got[0], lo + got[1]
        inner = sorted({lo, a, b, hi})
        if any(v - u < least for u, v in zip(inner, inner[1:], strict=False)):
            continue
        cuts |= {a, b}
        todo += list(zip(inner, inner[1:], strict=False))
    return sorted(cuts)


def validated(x: np.ndarray, cuts: list[int], shuffles: int, p: float, rng: np.random.Generator) -> list[int]:
    """Cuts whose two sides differ more than shuffles of them do, but for the share ``p``."""
    kept = [cuts[0]]
    for i in range(1, len(cuts) - 1):
        a, m, b = kept[-1], cuts[i], cuts[i + 1]
        y = x[a:b].copy()
        stat = lambda v: abs(v[: m - a].mean() - v[m - a :].mean())  # noqa: B023, E731
        found, over = stat(y), 0
        for _ in range(shuffles):
            rng.shuffle(y)
            over += stat(y) >= found
            if over >= p * shuffles:
                break
        if over < p * shuffles:
            kept.append(m)
    return [*kept, cuts[-1]]


def _pair_difference(s: np.ndarray, rank: int) -> float:
    """The difference of this rank (from 0) among all pairs of sorted values, by bisection over the numbers there are."""
    k = len(s)
    i = np.arange(k)
    low, high = 0, int(np.float64(s[-1] - s[0]).view(np.int64))  # not negative, so that their bits sort as they do
    while low < high:
        mid = (low + high) // 2
        t = np.int64(mid).view(np.float64)
        a, b = i.copy(), np.full(k, k - 1)  # the last partner within t lies between
        while (a < b).any():
            m = (a + b + 1) // 2
            near = s[m] - s <= t
            a, b = np.where(near, m, a), np.where(near, b, m - 1)
        if int((a - i).sum()) > rank:
            high = mid
        else:
            low = mid + 1
    return float(np.int64(low).view(np.float64))


def pair_quantile(values: list[float], quantile: float) -> float:
    """The quantile of all pairs' differences, as ``np.quantile`` has it; the pairs of many values are not laid out."""
    s = np.sort(np.asarray(values, float))
    k = len(s)
    if k <= 1000 or not np.isfinite(s).all():
        i, j = np.triu_indices(k, 1)
        return float(np.quantile(np.abs(s[i] - s[j]), quantile))
    at = quantile * (k * (k - 1) // 2 - 1)
    t = at - int(at)
    a = _pair_difference(s, int(at))
    b = _pair_difference(s, int(at) + 1) if t else a
    return a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)


def merged(x: np.ndarray, cuts: list[int], quantile: float) -> list[int]:
    """Neighbours whose medians differ by no more than the quantile of all pairs' differences become one, left to right."""
    if len(cuts) <= 2:
        return cuts
    med = [float(np.median(x[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    limit = pair_quantile(med, quantile)
    out, level = [cuts[0]], med[0]
    for i in range(1, len(med)):
        if abs(med[i] - level) <= limit:
            level = float(np.median(x[out[-1] : cuts[i + 1]]))
        else:
            out.append(cuts[i])
            level = med[i]
    return [*out, cuts[-1]]


def segment_profiles(bins: DataFrame, contig: str = "contig", start: str = "start", log2r: str = "log2r", shuffles: int = 1000, p_seg: float = 0.05, p_val: float = 0.01, least: int = 5, quantile: float = 0.2, seed: int = 1) -> DataFrame:
    """``bins`` with seg_id ``<contig>_seg<i>`` and the segment's median log2 ratio.

    Each contig's profile is one task's: of its bins, at 10 kb some tens of thousands, Python holds two numbers each. The
    rows themselves are sorted by Spark and wait in a file beside its own. The random numbers are seeded by contig and
    ties in ``start`` broken by the other columns, so that results do not depend on partitions or retries.
    """
    ship(bins.sparkSession)
    kinds = dict(bins.dtypes)
    ties = [F.col(f"`{c}`") for c, t in kinds.items() if c not in (contig, start) and "map<" not in t and "variant" not in t]
    rows = bins.withColumn("_x", anscombe(F.col(log2r))).repartition(F.col(contig)).sortWithinPartitions(contig, start, *ties)

    def levels(name: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
        cuts = merged(x, validated(x, circular_segments(x, shuffles, p_seg, least, rng), shuffles, p_val, rng), quantile)
        number = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        return number, pd.Series(y).groupby(number).median().to_numpy()

    def whole(name: str, spool, xs: list[np.ndarray], ys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, y = np.concatenate(xs), np.concatenate(ys)
        xs.clear()
        ys.clear()
        number, level = levels(name, x, y)
        del x, y
        spool.seek(0)
        done = 0
        with pa.ipc.open_stream(spool) as stream:
            for b in stream:
                n = number[done : done + b.num_rows]
                done += b.num_rows
                seen, which = np.unique(n, return_inverse=True)
                ids = pa.array([f"{name}_seg{i + 1}" for i in seen], pa.string()).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(level[n], pa.float64())], [*b.schema.names, "seg_id", "seg_log2r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        folder = folder if os.path.isdir(folder) else None
        name, spool, sink, xs, ys = None, None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            code = pc.fill_null(batch.column(contig).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for a, b in zip(edges, edges[1:], strict=False):
                piece = batch.slice(a, b - a)
                here = str(piece.column(contig)[0].as_py())
                if here != name:
                    if spool is not None:
                        sink.close()
                        yield from whole(name, spool, xs, ys)
                        spool.close()
                    name, spool = here, tempfile.TemporaryFile(dir=folder)
                    sink = pa.ipc.new_stream(spool, piece.drop_columns(["_x"]).schema)
                xs.append(np.array(piece.column("_x").to_numpy(zero_copy_only=False), float))
                ys.append(np.array(piece.column(log2r).to_numpy(zero_copy_only=False), float))
                sink.write_batch(piece.drop_columns(["_x"]))
        if spool is not None:
            sink.close()
            yield from whole(name, spool, xs, ys)
            spool.close()

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", seg_id string, seg_log2r double"
    return rows.mapInArrow(run, schema)
