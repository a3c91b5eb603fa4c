"""Near-duplicate groups: banded MinHash candidates, verified by Odd sketches and then on full sets.

A document's set holds its distinct k-word shingles; with fewer words the whole sequence is its one shingle.
Documents are linked when ``100 * |intersection| >= percent * |union|``; groups are what links connect.
Null, empty and blank texts have empty sets and are linked with nothing. Rows of one id are one document
(a link of either is a link of it). Rows of a null id are linked with nothing and kept. An empty table gives
no rows. Only the two named columns are read.

1. One pass over the texts gives each document its set's size and fingerprint, 128 MinHash samples folded
   into 32 bands of 4, and an Odd sketch: a bitmap in which each sample flips one bit, so that the
   population count of the XOR of two bitmaps estimates how many samples differ.
2. Documents of equal sets are one class; its smallest id stands for it from here on.
3. In a bucket (documents that share a band) all are compared with one hub, never with each other: a
   number of pairs linear in the rows. The sketch discards pairs estimated far below the threshold
   (by over 7 standard deviations), the rest are confirmed on full sets.
   Joins are merge joins at every size: which side is small depends on the data.
4. Links are contracted to components. Buckets that still hold several components are looked at again:
   shingles that no other document there has bound each possible intersection from above, which settles most.
   What remains meets the least edited member as a second hub, and last the members of other
   components that pass the same bounds and that of a parity bitmap of the whole set, whose XOR never counts
   more than the members that differ. So no link between different sets is lost to hubs.

A hub's set meets pairs in the last join, so that it is never copied into a shuffle. Shingles are told apart by 52 bits of hash.

A pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^32 < 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as sh
from tessera.llm.common import flag_maybe_in, maybe_in, own_prefix, stage
from tessera.session import ship

U = np.uint64
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
PARITY_BITS = 2048
#: Pairs whose sketches estimate less are not confirmed: the threshold less 7 standard deviations of the estimate.
LEAST_ESTIMATE = 0.55
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * U(2) + U(1)


def min_hashes(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """rows x SAMPLES: the least value of each sample's function over each row's set; empty rows hold zeros."""
    n = len(begins) - 1
    out = np.zeros((n, SAMPLES), U)
    full = np.flatnonzero(begins[1:] > begins[:-1])
    step, at = 1 << 16, 0
    while at < len(full):  # pieces that stay in cache
        to = max(at + 1, int(np.searchsorted(begins[full], begins[full[at]] + step)))
        rows = full[at:to]
        x = sets[begins[rows[0]] : begins[rows[-1] + 1]]
        firsts = begins[rows] - begins[rows[0]]
        tmp = np.empty_like(x)
        for j in range(SAMPLES):
            np.multiply(x, _A[j], out=tmp)
            np.add(tmp, _B[j], out=tmp)
            out[rows, j] = np.minimum.reduceat(tmp, firsts)
        at = to
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    p = sh.mix(m * _C).reshape(len(m), BANDS, ROWS)
    key = np.zeros((len(m), BANDS), U)
    for r in range(ROWS):
        key = sh.mix(key + p[:, :, r])
    return key


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """rows x SKETCH_BITS/64: the parity of how many samples fall on each bit."""
    bit = (sh.mix(m + _C[None, :] * U(3)) % U(SKETCH_BITS)).astype(np.int64)
    count = np.zeros((len(m), SKETCH_BITS), np.uint8)
    np.add.at(count, (np.repeat(np.arange(len(m)), SAMPLES), bit.ravel()), 1)
    return np.packbits(count & 1, axis=1, bitorder="little").view(np.uint64)


def parities(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """rows x PARITY_BITS/64: the parity of how many members of the whole set fall on each bit.

    Each member that only one of two sets has flips one bit of the XOR, so its population count never
    exceeds the number of such members: a bound, not an estimate.
    """
    n = len(begins) - 1
    count = np.zeros((n, PARITY_BITS), np.uint8)
    np.add.at(count, (np.repeat(np.arange(n), np.diff(begins)), (sh.mix(sets + _C[0]) % U(PARITY_BITS)).astype(np.int64)), 1)
    return np.packbits(count & 1, axis=1, bitorder="little").view(np.uint64)


def fingerprint(sets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: sums of two mixes of its members."""
    out = []
    for salt in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)):
        run = np.concatenate([np.zeros(1, U), np.cumsum(sh.mix(sets * salt + salt), dtype=U)])
        out.append((run[begins[1:]] - run[begins[:-1]]).view(np.int64))
    return out[0], out[1]


def features(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, f1, f2, bands, sketch of each row; bands and sketch are null for empty sets."""

    def lists(x: np.ndarray, has: np.ndarray) -> pa.Array:
        width = x.shape[1]
        offsets = np.concatenate([[0], np.cumsum(np.where(has, width, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x[has]).view(np.int64).ravel()), mask=pa.array(~has))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in sh.each_slice(batch.column(1)):
                sets, begins = sh.shingle_sets(data, offsets, k)
                m, n = min_hashes(sets, begins), np.diff(begins)
                f1, f2 = fingerprint(sets, begins)
                cols = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(f1), pa.array(f2), lists(band_keys(m), n > 0), lists(odd_sketches(m), n > 0)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "f1", "f2", "bands", "sketch"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, set of the documents named in ``ids``; only they are read into shingles again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in sh.each_slice(batch.column(1)):
                sets, begins = sh.shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(sets.view(np.int64)))], ["id", "set"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = stage(ids.select("id").distinct(), "nd-ids")
    rows = maybe_in(rows, "id", ids, "id").join(ids.hint("merge"), "id", "left_semi")
    return rows.mapInArrow(run, "id long, set array<long>")


def _parity_rows(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for a in range(0, len(lists), 512):
                part = lists.slice(a, 512)
                begins = part.offsets.to_numpy()
                x = part.values.to_numpy(zero_copy_only=False)[begins[0] : begins[-1]].view(np.uint64)
                bits = parities(x, begins - begins[0]).view(np.int64)
                offsets = np.arange(len(part) + 1, dtype=np.int32) * bits.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bits.ravel()))], ["rep", "parity"])

    return sets.select("id", "set").mapInArrow(run, "rep long, parity array<long>").dropDuplicates(["rep"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): the least node that it is connected with.

    Each round sends every node to its least neighbour's choice and contracts the edges; at least half
    of the nodes go, so the rounds are few and the tables shrink.
    """
    spark = edges.sparkSession
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "cc-edges")
    roots = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        step = stage(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "cc-step")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("root"))
        step = stage(step.join(jump, "to").select("node", "root"), "cc-jump")
        if roots is None:
            roots = step
        else:
            roots = stage(roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
        left = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = stage(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    return spark.createDataFrame([], "node long, root long") if roots is None else roots


def _estimate(x: Column, y: Column) -> Column:
    """Similarity that two Odd sketches tell: 1 + n/(4 samples) ln(1 - 2 d/n) for d differing bits of n."""
    d = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    return F.when(2 * d >= SKETCH_BITS, F.lit(0.0)).otherwise(1 + SKETCH_BITS / (4 * SAMPLES) * F.log(1 - 2.0 * d / SKETCH_BITS))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``b``, the hub of many, is joined last."""
    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _screen(pairs: DataFrame, slim: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches allow, once each; ``b`` is the hub.

    ``slim`` is a written table, so that nothing but exchange and sort lies below the joins: the pairs of a hot hub can be split.
    """
    pairs = pairs.select("a", "b").distinct()
    both = pairs.join(slim.toDF("a", "na", "sa").hint("merge"), "a").join(slim.toDF("b", "nb", "sb").hint("merge"), "b")
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return both.filter(sizes & (_estimate(F.col("sa"), F.col("sb")) >= LEAST_ESTIMATE)).select("a", "b")


def near_dup_links(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, roots): every row with its class, and the component of every class that is linked."""
    f = stage(features(docs, k, id_col, text_col), "nd-features")
    equal = f.filter("n > 0 AND id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("most"))
    equal = stage(equal.filter("rep < most").drop("most"), "nd-equal")
    rows = stage(f.join(equal.hint("merge"), ["f1", "f2", "n"], "left").withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))).select("id", "n", "rep", "bands", "sketch"), "nd-rows")
    reps = rows.filter("id = rep AND n > 0").select("rep", "n", "bands", "sketch")

    # buckets of two members or more, each with a hub
    band = reps.select("rep", F.explode("bands").alias("bucket"))
    hubs = stage(band.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("most")).filter("hub < most").drop("most"), "nd-hubs")
    members = stage(band.join(hubs.hint("merge"), "bucket"), "nd-members")
    slim = stage(reps.select("rep", "n", "sketch").dropDuplicates(["rep"]), "nd-slim")
    pairs = _screen(members.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")), slim, percent)
    pairs = stage(pairs, "nd-pairs")
    sets = stage(full_sets(docs, members.select(F.col("rep").alias("id")), k, id_col, text_col), "nd-sets")
    twice = stage(rows.filter("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).filter("b < most").drop("most"), "nd-twice")
    same_id = rows.join(twice, "id").select(F.col("rep").alias("a"), "b").filter("a <> b")
    edges = stage(_confirm(pairs, sets, percent).unionByName(same_id), "nd-edges")
    roots = components(edges)

    # buckets that hold several components: members, their components, and what of them others there share
    def unresolved(members: DataFrame, roots: DataFrame) -> DataFrame:
        at = members.join(roots.toDF("rep", "root").hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        at = stage(at, "nd-at")
        open_ = at.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
        return at.join(stage(open_, "nd-open"), "bucket")

    rest = stage(unresolved(members.select("bucket", "rep"), roots), "nd-rest")
    if rest.isEmpty():
        return rows, roots
    ids = rest.select(F.col("rep").alias("id")).distinct()
    token = sets.join(ids.hint("merge"), "id").select("id", F.explode("set").alias("token"))
    lone = token.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    size = reps.select("rep", "n").dropDuplicates(["rep"])
    known = size.join(ids.withColumnRenamed("id", "rep"), "rep").join(lone.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.col("n") - F.coalesce("lone", F.lit(0)))
    known = known.filter(100 * F.col("c") >= percent * F.col("n")).drop("lone")
    known = stage(known.join(_parity_rows(sets.join(ids, "id")), "rep"), "nd-known")
    rest = rest.select("bucket", "rep").join(known, "rep")

    able = lambda c1, n1, c2, n2: (100 + percent) * F.least(c1, c2) >= percent * (n1 + n2)
    found = edges
    # second hub: the member that shares most of its shingles
    part = stage(unresolved(rest, roots), "nd-part")
    if not part.isEmpty():
        best = stage(part.groupBy("bucket").agg(F.max_by(F.struct("rep", "n", "c", "root"), F.col("c") / F.col("n")).alias("h")), "nd-best")
        star = part.drop("parity").join(best, "bucket").filter((F.col("root") != F.col("h.root")) & able(F.col("c"), F.col("n"), F.col("h.c"), F.col("h.n")))
        star = stage(_screen(star.select(F.col("rep").alias("a"), F.col("h.rep").alias("b")), slim, percent), "nd-pairs")
        found = found.unionByName(stage(_confirm(star, sets, percent), "nd-edges"))
        roots = components(found)
        part = stage(unresolved(rest, roots), "nd-part")
    if not part.isEmpty():
        side = lambda i: part.select("bucket", *[F.col(c).alias(c[0] + i) for c in ("n", "c", "root", "parity")], F.col("rep").alias(i))
        x, y = side("a"), side("b")
        differ = F.aggregate(F.zip_with("pa", "pb", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
        on = (x["bucket"] == y["bucket"]) & (F.col("ra") < F.col("rb")) & able(F.col("ca"), F.col("na"), F.col("cb"), F.col("nb"))
        on = on & ((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb")))
        last = stage(x.join(y, on).select("a", "b").distinct(), "nd-pairs")
        if not last.isEmpty():
            found = found.unionByName(stage(_confirm(last, sets, percent), "nd-edges"))
            roots = components(found)
    return rows, roots


def near_dup_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows, roots = near_dup_links(docs, k, percent, id_col, text_col)
    out = rows.select("id", "n", "rep").join(roots.toDF("rep", "root").hint("merge"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "rep", "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group, that of the smallest id; rows of a null id all stay."""
    gone = near_dup_groups(docs, k, percent, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    gone, flag = stage(gone, "nd-gone"), own_prefix(docs) + "maybe"
    flagged = flag_maybe_in(docs, id_col, gone, id_col, flag)  # texts that surely stay are not shuffled
    kept = flagged.filter(~F.col(flag)).unionByName(flagged.filter(F.col(flag)).join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in flagged.columns]))
    again = stage(docs.groupBy(id_col).count().filter(f"count > 1 AND {id_col} IS NOT NULL").select(id_col), "nd-again")
    kept = kept.select(*[F.col(f"`{c}`") for c in docs.columns])
    if again.isEmpty():
        return kept
    once = kept.join(again, id_col, "left_semi").dropDuplicates([id_col])
    return kept.join(again, id_col, "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])
