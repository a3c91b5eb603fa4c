"""Exact top-k search by inner product: a stored pivot table bounds every score, and bounds eliminate candidates.

Components are scaled to integers, ``floor(256 x)``. Vectors that are null or hold a null or a non-finite component take
no part, nor do rows of a null id; vectors meet only those of their own length (empty ones score 0). Ties go to the
smaller id. Rows that repeat an id are all candidates of others and all queries; a query never meets a row of its own id.
A score beyond a long counts as the nearest long. An empty table gives no rows. Only the two named columns are read, so
other columns may have any names.

1. Pivots come from the data: of a sample (the ``SAMPLE`` rows of the least hashed ids, a documented bound; it decides speed, never
   results) each next pivot is the vector farthest from the span of those before it.
2. The pivot table is computed once and stored: each vector with its distances to the origin and to all pivots. Vectors
   are laid out in blocks by their nearest pivot; a block knows the least and greatest distance to each pivot.
3. Distances to pivots tell where a vector lies in the pivots' span and how far off it. Two such places give the greatest lower
   bound of the distance that all pivots together allow (no single pivot's ``|d(q,p) - d(x,p)|`` exceeds it), hence an upper
   bound of the score.
4. A query first meets the block it lies in. Its k-th best score there goes with it to the blocks that it
   cannot rule out by their distances. In a block candidates are evaluated in the order of their bounds until the k-th
   best score exceeds the next bound; it is carried on from chunk to chunk.

Vectors are dealt once; of queries only the rows (and a threshold) are copied to blocks. :func:`elimination` reports
how many candidates the bounds spared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import scoped, spread, stage
from tessera.session import ship

SCALE = 256
PIVOTS = 48
SAMPLE = 4096
BLOCK_ROWS, MOST_BLOCKS = 4096, 2048
CHUNK = 4096
#: Squared norms from here on could take an inner product beyond the whole numbers that a double holds.
HUGE = float(1 << 50)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Pivots:
    """Pivots of one dimension, and the map from distances to coordinates in their span."""

    def __init__(self, sample: np.ndarray, most: int = PIVOTS):
        rest = sample.copy()
        chosen, basis, first = [], [], 0.0
        for _ in range(min(most, sample.shape[1])):
            far = (rest * rest).sum(1)
            i = int(far.argmax()) if len(far) else -1
            if i < 0 or far[i] <= max(1e-4 * first, 1e-9):
                break
            first = first or float(far[i])
            unit = rest[i] / np.sqrt(far[i])
            chosen.append(sample[i])
            basis.append(unit)
            rest = rest - np.outer(rest @ unit, unit)
        self.points = np.array(chosen).reshape(len(chosen), sample.shape[1])
        self.sizes = (self.points * self.points).sum(1)
        # <x, p> = coordinates . (basis . p), a triangular system
        self.solve = np.linalg.inv(np.array(basis).reshape(len(chosen), -1) @ self.points.T) if chosen else np.zeros((0, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To the origin, then to each pivot."""
        size = (x * x).sum(1)
        far = size[:, None] + self.sizes[None] - 2 * x @ self.points.T
        return np.sqrt(np.maximum(np.concatenate([size[:, None], far], 1), 0))

    def places(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates in the span, distance off it, squared norm."""
        size = t[:, 0] ** 2
        at = ((size[:, None] + self.sizes[None] - t[:, 1:] ** 2) / 2) @ self.solve
        return at, np.sqrt(np.maximum(size - (at * at).sum(1), 0)), size


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, float).reshape(len(lists), width)


def upper_bounds(p: Pivots, tq: np.ndarray, tx: np.ndarray) -> np.ndarray:
    """queries x vectors: no score exceeds it. Half of |q|^2 + |x|^2 - (least distance)^2, with room for rounding."""
    aq, rq, sq = p.places(tq)
    ax, rx, sx = p.places(tx)
    out = aq @ ax.T
    out += rq[:, None] * rx[None]
    out += 1e-6 * (1 + sq[:, None] + sx[None])
    return out


def exact(q: np.ndarray, x: np.ndarray) -> int:
    return min(_MOST, max(_LEAST, sum(int(a) * int(b) for a, b in zip(q, x, strict=True))))


class Best:
    """The best k of a query so far."""

    __slots__ = ("ids", "scores", "least", "k", "evaluated")

    def __init__(self, k: int, least: float):
        self.ids, self.scores, self.k, self.least, self.evaluated = np.empty(0, np.int64), np.empty(0, np.int64), k, least, 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        self.evaluated += len(ids)
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        best = np.lexsort((ids, ~scores))[: self.k]
        self.ids, self.scores = ids[best], scores[best]
        if len(best) == self.k:
            self.least = max(self.least, float(self.scores[-1]))


def meet(best: Best, q_id: int, q: np.ndarray, q_huge: bool, bound: np.ndarray | None, x_ids: np.ndarray, x: np.ndarray, x_huge: np.ndarray) -> None:
    """Evaluate the vectors of a chunk in the order of their bounds, until none can come in."""
    always = x_huge if not q_huge else np.ones(len(x_ids), bool)
    able = ~always if bound is None else ~always & (bound >= best.least)
    odd = np.flatnonzero(always & (x_ids != q_id))
    if len(odd):
        best.add(x_ids[odd], np.array([exact(q, x[i]) for i in odd], np.int64))
    order = np.flatnonzero(able & (x_ids != q_id))
    if bound is not None:
        order = order[np.argsort(-bound[order], kind="stable")]
    at, step = 0, max(32, 4 * best.k) if bound is not None else max(1, len(order))
    while at < len(order) and (bound is None or bound[order[at]] >= best.least):
        c = order[at : at + step]
        if bound is not None:
            c = c[bound[c] >= best.least]
        best.add(x_ids[c], (x[c] @ q).astype(np.int64))
        at, step = at + step, step * 2


def _prepared(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # doubles of 2^52 or more are whole; floor() of Spark gives a long and would cut them off
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    scaled = F.transform(v, lambda x: whole(F.greatest(F.least(x.cast("double") * SCALE, F.lit(1e300)), F.lit(-1e300))))
    return df.filter(sound).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def _with_distances(rows: DataFrame, pivots: dict[int, Pivots]) -> DataFrame:
    """id, v, t, cell, huge. ``cell``: the nearest pivot, numbered over all dimensions; -1 without pivots."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p_all = shared.value
        begin, at = {}, 0
        for dim, p in sorted(p_all.items()):
            begin[dim], at = at, at + len(p.points)
        for batch in batches:
            lists = batch.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(dims):
                rows_ = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows_))
                x = matrix(part.column(1), int(dim))
                with np.errstate(over="ignore", invalid="ignore"):
                    huge = ~((x * x).sum(1) < HUGE)
                p = p_all.get(int(dim))
                t = np.zeros((len(x), 1 + (len(p.points) if p else 0)))
                cell = np.full(len(x), -1)
                if p is not None:
                    t[~huge] = p.distances(x[~huge])
                    if len(p.points):
                        cell[~huge] = begin[int(dim)] + t[~huge, 1:].argmin(1)
                offsets = np.arange(len(x) + 1, dtype=np.int32) * t.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(t.ravel())), pa.array(cell, pa.int32()), pa.array(huge)], ["id", "v", "t", "cell", "huge"])

    return rows.mapInArrow(run, "id long, v array<double>, t array<double>, cell int, huge boolean")


def _block_ranges(table: DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Blocks that can be ruled out, with the least and greatest distances of theirs. A row a block: a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            blocks, widths = np.asarray(batch.column(0)), np.diff(batch.column(1).offsets.to_numpy())
            for b in np.unique(blocks):
                rows_ = np.flatnonzero(blocks == b)
                t = matrix(batch.column(1).take(pa.array(rows_)), int(widths[rows_[0]]))
                lo, hi = t.min(0), t.max(0)
                if (key := (int(b), t.shape[1])) in found:
                    lo, hi = np.minimum(lo, found[key][0]), np.maximum(hi, found[key][1])
                found[key] = lo, hi
        if found:
            blocks = [b for b, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([list(x) for x, _ in found.values()], pa.list_(pa.float64())), pa.array([list(x) for _, x in found.values()], pa.list_(pa.float64()))], ["block", "lo", "hi"])

    part = table.filter("cell >= 0").select("block", "t").mapInArrow(run, "block int, lo array<double>, hi array<double>")
    fold = lambda c, f: F.reduce(F.collect_list(c), F.first(c), lambda a, x: F.zip_with(a, x, f))
    got = part.groupBy("block").agg(fold("lo", lambda a, b: F.least(a, b)).alias("lo"), fold("hi", lambda a, b: F.greatest(a, b)).alias("hi")).collect()
    return np.array([r["block"] for r in got], np.int64), [np.array(r["lo"]) for r in got], [np.array(r["hi"]) for r in got]


def _searched(asked: DataFrame, table: DataFrame, pivots: dict[int, Pivots], k: int) -> DataFrame:
    """query_id, vec_id, score: the best k of each block for the queries sent to it; and per (query, block) a row
    without vec_id that counts ``seen`` and ``evaluated`` candidates. ``asked``: block, id, v, t, huge, least."""
    shared = table.sparkSession.sparkContext.broadcast(pivots)
    out = "query_id long, vec_id long, score long, seen long, evaluated long"

    def results(queries: dict) -> Iterator[pa.RecordBatch]:
        q, v, s, seen, ev = [], [], [], [], []
        for dim in queries.values():
            for i, b in zip(dim["ids"], dim["best"], strict=True):
                q += [i] * (1 + len(b.ids))
                v += [None, *b.ids.tolist()]
                s += [None, *b.scores.tolist()]
                seen += [dim["seen"], *[None] * len(b.ids)]
                ev += [b.evaluated, *[None] * len(b.ids)]
        if q:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, v, s, seen, ev)], ["query_id", "vec_id", "score", "seen", "evaluated"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, queries = None, {}
        for batch in batches:
            blocks, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            dims = np.diff(batch.column(3).offsets.to_numpy())
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != block:
                    yield from results(queries)
                    block, queries = blocks[a], {}
                for dim in np.unique(dims[a:b]):
                    rows_ = a + np.flatnonzero(dims[a:b] == dim)
                    part = batch.take(pa.array(rows_))
                    ids, huge = np.asarray(part.column(2)), np.asarray(part.column(5).to_numpy(zero_copy_only=False), bool)
                    x = matrix(part.column(3), int(dim))
                    p = shared.value.get(int(dim))
                    t = matrix(part.column(4), 1 + (len(p.points) if p else 0))
                    if kinds[a] == 0:
                        least = np.asarray(part.column(6).to_numpy(zero_copy_only=False), float)
                        had = queries.setdefault(int(dim), {"ids": [], "v": [], "t": [], "huge": [], "best": [], "seen": 0})
                        had["ids"] += ids.tolist()
                        had["v"].append(x)
                        had["t"].append(t)
                        had["huge"] += huge.tolist()
                        had["best"] += [Best(k, y) for y in least]
                    elif (had := queries.get(int(dim))) is not None:
                        for key in ("v", "t"):
                            had[key] = [np.concatenate(had[key])] if len(had[key]) > 1 else had[key]
                        for c in range(0, len(ids), CHUNK):
                            part_ids, px, ph = ids[c : c + CHUNK], x[c : c + CHUNK], huge[c : c + CHUNK]
                            had["seen"] += len(part_ids)
                            for f in range(0, len(had["ids"]), 256):
                                bound = upper_bounds(p, had["t"][0][f : f + 256], t[c : c + CHUNK]) if p is not None else None
                                for j in range(f, min(f + 256, len(had["ids"]))):
                                    meet(had["best"][j], had["ids"][j], had["v"][0][j], had["huge"][j], None if bound is None else bound[j - f], part_ids, px, ph)
        yield from results(queries)

    x = table.select("block", F.lit(1).alias("kind"), "id", "v", "t", "huge", F.lit(None).cast("double").alias("least"))
    both = asked.select("block", F.lit(0).alias("kind"), "id", "v", "t", "huge", "least").unionByName(x)
    return both.repartition(spread(table.sparkSession), "block").sortWithinPartitions("block", "kind").mapInArrow(run, out)


def _routed(queries: DataFrame, blocks: list[tuple[int, int]], ranges: tuple, pivots: dict[int, Pivots]) -> DataFrame:
    """Queries once for each block that may hold better than ``least``, their own (``block``) left out."""
    shared = queries.sparkSession.sparkContext.broadcast((blocks, ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_blocks, (known, lo, hi) = shared.value
        by_width: dict[int, list[int]] = {}
        for i, x in enumerate(lo):
            by_width.setdefault(len(x), []).append(i)
        mixed = np.array([b for b, cell in all_blocks if cell < 0], np.int64)
        for batch in batches:
            own, t_all, huge, least = np.asarray(batch.column(0)), batch.column(3), np.asarray(batch.column(4).to_numpy(zero_copy_only=False), bool), np.asarray(batch.column(5).to_numpy(zero_copy_only=False), float)
            rows_, targets = [], []
            for i in range(len(batch)):
                t = np.asarray(t_all[i].values)
                can = np.array(by_width.get(len(t), []), np.int64)
                if len(can) and not huge[i]:
                    far = np.maximum(np.maximum(np.stack([lo[j] for j in can]) - t, t - np.stack([hi[j] for j in can])), 0).max(1)
                    most = np.array([hi[j][0] for j in can])
                    bound = (t[0] ** 2 + most**2 - far**2) / 2 + 1e-6 * (1 + t[0] ** 2 + most**2)
                    can = can[bound >= least[i]]
                to = np.concatenate([known[can] if len(can) else np.empty(0, np.int64), mixed])
                to = to[to != own[i]]
                rows_.append(np.full(len(to), i))
                targets.append(to)
            take = pa.array(np.concatenate(rows_)) if rows_ else pa.array([], pa.int64())
            out = batch.take(take)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(targets) if targets else [], pa.int32()), *out.columns[1:]], schema=batch.schema)

    q = queries.select("block", "id", "v", "t", "huge", "least")
    return q.mapInArrow(run, q.schema)


def _search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, block_rows: int, n_pivots: int) -> DataFrame:
    spark = vectors.sparkSession
    ship(spark)
    x = _prepared(vectors, id_col, vec_col)
    sample = x.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0).to_pylist()
    by_dim: dict[int, list] = {}
    for v in sample:
        if sum(a * a for a in v) < HUGE:
            by_dim.setdefault(len(v), []).append(v)
    pivots = {d: Pivots(np.array(v, float).reshape(len(v), d), n_pivots) for d, v in by_dim.items()}

    table = stage(_with_distances(x, pivots), "topk-table")
    sizes = {r["cell"]: r["count"] for r in table.groupBy("cell").count().collect()}  # a row a pivot
    limit = max(block_rows, -(-sum(sizes.values()) // MOST_BLOCKS))
    dealt, blocks, at = [], [], 0
    for cell, n in sorted(sizes.items()):
        parts = -(-n // limit)
        dealt.append((cell, at, parts))
        blocks += [(at + j, cell) for j in range(parts)]
        at += parts
    layout = spark.createDataFrame(dealt, "cell int, begin int, parts int")
    place = F.col("begin") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    put = lambda df, how: df.join(F.broadcast(layout), "cell", how).withColumn("block", F.coalesce(place, F.lit(-1))).drop("begin", "parts")
    table = stage(put(table, "inner"), "topk-blocks")
    ranges = _block_ranges(table)

    asked = put(_with_distances(_prepared(queries, id_col, vec_col), pivots), "left")
    # ids that repeat are told apart by their vectors; equal rows of an id are one query
    asked = stage(asked.withColumn("least", F.lit(float("-inf"))).dropDuplicates(["id", "v"]), "topk-queries")
    home = stage(_searched(asked.filter("block >= 0"), table, pivots, k), "topk-home")
    so_far = home.filter("vec_id IS NOT NULL").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    so_far = so_far.select(F.col("query_id").alias("id"), F.when(F.col("n") == k, F.col("s").cast("double")).alias("tau"))
    again = asked.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.drop("least").join(so_far, "id", "left").join(again, "id")
    asked = asked.withColumn("least", F.when(F.col("times") == 1, F.coalesce("tau", F.lit(float("-inf")))).otherwise(float("-inf")))
    return home.unionByName(stage(_searched(_routed(asked, blocks, ranges, pivots), table, pivots, k), "topk-far"))


@scoped
def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products over ``vectors``.

    Where several query rows share an id, their results meet under that id and the best ``k`` of them are returned.
    """
    best = _search(vectors, queries, k, id_col, vec_col, block_rows, n_pivots).filter("vec_id IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@scoped
def elimination(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, n_pivots: int = PIVOTS) -> DataFrame:
    """candidates, evaluated: pairs of a query and a vector, and how many of them had their score computed."""
    counts = _search(vectors, queries, k, id_col, vec_col, block_rows, n_pivots).filter("vec_id IS NULL")
    dims = _prepared(vectors, id_col, vec_col).groupBy(F.size("v").alias("d")).count()
    asked = _prepared(queries, id_col, vec_col).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("q"))
    pairs = dims.join(asked, "d").agg(F.coalesce(F.sum(F.col("count") * F.col("q")), F.lit(0)).alias("candidates"))
    return pairs.crossJoin(counts.agg(F.coalesce(F.sum("evaluated"), F.lit(0)).alias("evaluated")))  # one row each
