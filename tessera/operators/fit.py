"""Segments, allele blocks, and the fit of purity and ploidy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import absolute_copy_number, allele_copy_number, rounded, search_space
from tessera.operators.joins import interval_join
from tessera.session import ship


def split_at_breakpoints(bins: DataFrame, breaks: DataFrame, keys: list[str], seg: str = "seg_id", start: str = "start") -> DataFrame:
    """Segments of bins cut where a breakpoint begins a bin: new ids ``<seg>-SV<k>`` until the segment changes.

    ``k`` is the number of rows of ``breaks`` so far: repeated ones count each, and bins that share a start share the id.
    """
    marks = breaks.groupBy(*keys, F.col("pos").alias(start)).agg(F.count(F.lit(1)).alias("_sv"))
    rows = bins.join(marks, [*keys, start], "left")
    order = Window.partitionBy(*keys, seg).orderBy(start)
    rows = rows.withColumn("_sv", F.when(~F.lag(start).over(order).eqNullSafe(F.col(start)), F.col("_sv")))  # once a start
    rows = rows.withColumn("_k", F.coalesce(F.sum("_sv").over(order), F.lit(0)))  # by range, that is with all bins of the start
    return rows.withColumn("split_id", F.when(F.col("_k") == 0, F.col(seg)).otherwise(F.concat(F.col(seg), F.lit("-SV"), F.col("_k").cast("string")))).drop("_sv", "_k")


def collapse_segments(bins: DataFrame, keys: list[str], seg: str = "seg_id", log2r: str = "seg_log2r") -> DataFrame:
    """One row a segment: bins, their length, its weight against the median bin, and relative copy number (of the first bin that has one)."""
    length = F.col("end") - F.col("start")
    mid = bins.agg(F.median(length).alias("_mid"))
    rows = bins.groupBy(*keys, seg).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("bin_count"), F.sum(length).alias("sum_of_bin_lengths"), F.min_by(log2r, F.when(F.col(log2r).isNotNull(), F.col("start"))).alias("_l"))
    return rows.crossJoin(F.broadcast(mid)).withColumns({"weight": F.col("sum_of_bin_lengths") / F.col("_mid"), "relative_cn": F.pow(F.lit(2.0), F.col("_l"))}).drop("_l", "_mid")


def grid(spark: SparkSession, purities: list[float], ploidies: list[float]) -> DataFrame:
    """i, j, purity, ploidy: all points of the search grid, which its parameters bound."""
    rows = [(i, j, float(p), float(q)) for i, p in enumerate(purities) for j, q in enumerate(ploidies)]
    return spark.createDataFrame(rows, "i int, j int, purity double, ploidy double")


#: Width of the cells of relative copy numbers within which sums are taken about the middle.
_CELL = 0.5


def _far_each(r: np.ndarray, w: np.ndarray, origin: np.ndarray, shift: np.ndarray, slope: np.ndarray, squared: bool) -> np.ndarray:
    """Weighted distance from whole numbers at each point, segment by segment."""
    far = np.zeros(len(slope))
    for a in range(0, len(slope), 2048):
        s = slice(a, a + 2048)
        for b in range(0, len(r), 64):  # pieces that stay in cache
            cn = origin[s] + (r[b : b + 64, None] - shift[s]) * slope[s]
            d = np.abs(cn - np.rint(cn))
            far[s] += w[b : b + 64] @ (d * d if squared else d)
    return far


def _far_cell(u: np.ndarray, w: np.ndarray, middle: np.ndarray, slope: np.ndarray, squared: bool) -> np.ndarray:
    """The same for sorted values ``u`` about a middle, where copy numbers are ``middle``; slopes are positive.

    Values that share the nearest whole number, and the side of it, are neighbours: their sum is a polynomial in the
    slope whose coefficients are differences of running sums. These have 64 bits (long double), so that what cancels
    lies below the last digit of a double.
    """
    step, off = (1.0, 0.5) if squared else (0.5, 0.0)
    wide = u.astype(np.longdouble)
    sums = [np.concatenate([[np.longdouble(0)], np.cumsum(wide**k * w)]) for k in range(3 if squared else 2)]
    first, last = (np.floor((middle + x * slope - off) / step) for x in (u[0], u[-1]))
    far = np.zeros(len(slope), np.longdouble)
    before = [x[0] for x in sums]
    for t in range(int((last - first).max()) + 1):
        piece = first + t
        upto = np.where(piece >= last, len(u), np.searchsorted(u, ((piece + 1) * step + off - middle) / slope))
        here = [x[upto] for x in sums]
        part = [x - y for x, y in zip(here, before, strict=True)]
        before = here
        if squared:
            rest = middle - (piece + 1)
            far += rest * rest * part[0] + 2 * rest * slope * part[1] + slope.astype(np.longdouble) ** 2 * part[2]
        else:
            rest = middle - np.floor((piece + 1) / 2)
            far += np.where(piece % 2 == 0, 1, -1) * (rest * part[0] + slope * part[1])
    return far


def far_sums(r: np.ndarray, w: np.ndarray, origin: np.ndarray, shift: np.ndarray, slope: np.ndarray, squared: bool = True) -> np.ndarray:
    """Weighted distance of ``origin + (r - shift) * slope`` from whole numbers at each point.

    Cells of many values are summed over whole numbers, not values; the others, and points of no slope, one by one.
    """
    out = np.zeros(len(slope), np.longdouble)
    flat = ~(slope > 0)
    if flat.any():
        out[flat] = _far_each(r, w, origin[flat], shift[flat], slope[flat], squared)
    if flat.all():
        return out
    origin, shift, slope = origin[~flat], shift[~flat], slope[~flat]
    order = np.argsort(r, kind="stable")
    r, w = r[order], w[order]
    cell = np.floor(r / _CELL)
    edges = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(r)]])
    enough = 24 * (slope.max() * _CELL * (1 if squared else 2) + 2)  # a whole number takes as long as this many values
    alone = ~(np.isfinite(r) & np.isfinite(w))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a < enough or alone[a:b].any():
            alone[a:b] = True
        else:
            c = (cell[a] + 0.5) * _CELL
            out[~flat] += _far_cell(r[a:b] - c, w[a:b], origin + (c - shift) * slope, slope, squared)
    out[~flat] += _far_each(r[alone], w[alone], origin, shift, slope, squared)
    return out


def grid_distances(segments: DataFrame, points: DataFrame, squared: bool = True) -> DataFrame:
    """``points`` with the weighted distance of the segments' absolute copy numbers from whole numbers.

    Each task adds up its segments at all points (bounded by the grid's parameters), a million at a time, and hands on one
    row a point; these sums meet by (i, j). Nothing the size of segments times points is ever made, and but for cells of
    few segments (`far_sums`) the work is that of sorting segments, and of the points for each million of them.
    """
    rows = points.select("i", "j", "purity", "ploidy").collect()  # the grid itself
    shared = segments.sparkSession.sparkContext.broadcast(np.array([tuple(r) for r in rows], float).reshape(-1, 4))
    ship(segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        purity, ploidy = at[:, 2], at[:, 3]
        slope = np.where(purity > 0, ploidy + 2 / np.where(purity > 0, purity, 1) - 2, ploidy)
        origin = np.where(purity > 0, ploidy, 0.0)
        shift = np.where(purity > 0, 1.0, 0.0)
        far, total, any_ = np.zeros(len(at), np.longdouble), 0.0, False
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            nonlocal far
            if held and len(at):
                far += far_sums(*(np.concatenate(x) for x in zip(*held, strict=True)), origin, shift, slope, squared)
            held.clear()

        for batch in batches:
            r, w = (np.array(c.to_numpy(zero_copy_only=False), float) for c in batch.columns)
            ok = ~(np.isnan(r) | np.isnan(w))
            r, w = r[ok], w[ok]
            any_ |= len(r) > 0
            total += w.sum()
            held.append((r, w))
            if sum(len(x) for x, _ in held) >= 1 << 20:
                add()
        add()
        if any_:
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(far.astype(float)), pa.array(np.full(n, total))], ["i", "j", "_far", "_all"])

    part = segments.select(F.col("relative_cn").cast("double"), F.col("weight").cast("double")).mapInArrow(run, "i int, j int, _far double, _all double")
    share = F.sum("_far") / F.sum("_all")
    sums = part.groupBy("i", "j").agg((F.sqrt(share) if squared else share).alias("distance"))
    return points.join(sums, ["i", "j"])


def local_minima(fits: DataFrame) -> DataFrame:
    """Points no further than any of their 8 neighbours in the grid: the minimum over rows, then over columns."""
    rows = Window.partitionBy("j").orderBy("i").rangeBetween(-1, 1)
    cols = Window.partitionBy("i").orderBy("j").rangeBetween(-1, 1)
    near = fits.withColumn("_r", F.min("distance").over(rows)).withColumn("_m", F.min("_r").over(cols))
    return near.filter("distance <= _m").drop("_r", "_m")


def within_scale(fits: DataFrame, scale: float = 1.25) -> DataFrame:
    """Points whose distance is less than ``scale`` times the least, or the least (a perfect fit has distance 0)."""
    least = fits.agg(F.min("distance").alias("_least"))
    return fits.crossJoin(F.broadcast(least)).filter((F.col("distance") < scale * F.col("_least")) | (F.col("distance") == F.col("_least"))).drop("_least")


def acceptable(segments: DataFrame, fits: DataFrame, max_zero: float = 0.1, min_whole: float = 0.5, max_dist_whole: float = 0.25, main_step: float = 1.0) -> DataFrame:
    """Points with few segments at no copies, enough near whole numbers, and the two most frequent states a step apart.

    Of states as frequent as each other the one that comes first along the genome counts; a fit with one state alone passes.
    """
    cn = absolute_copy_number(F.col("relative_cn"), F.col("purity"), F.col("ploidy"))
    both = segments.select("relative_cn", "weight", "ord").crossJoin(F.broadcast(fits)).withColumn("_cn", cn).withColumn("_state", F.rint("_cn"))
    by = fits.columns
    share = both.groupBy(*by).agg((F.sum(F.when(F.col("_cn") <= 0, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("prop_zero"), (F.sum(F.when(F.round(F.abs(F.col("_cn") - F.col("_state")), 9) < max_dist_whole, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("prop_whole"))
    states = both.groupBy(*by, "_state").agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_first"))
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "_first"))
    modes = states.withColumn("_k", k).filter("_k <= 2").groupBy(*by).agg(F.max(F.when(F.col("_k") == 1, F.col("_state"))).alias("mode"), F.max(F.when(F.col("_k") == 2, F.col("_state"))).alias("second"))
    out = share.join(modes, by).filter((F.col("prop_zero") <= max_zero) & (F.col("prop_whole") >= min_whole))
    return out.filter(F.col("second").isNull() | (F.abs(F.col("mode") - F.col("second")) <= main_step))


def rank_solutions(fits: DataFrame, digits: int = 3) -> DataFrame:
    """Rank by rounded distance, then ploidy, then purity."""
    out = fits.withColumn("distance", rounded(F.col("distance"), digits))
    return out.withColumn("rank", F.row_number().over(Window.orderBy("distance", "ploidy", "purity")))


def snps_in_segments(snps: DataFrame, segments: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Heterozygous sites with the segment they lie in."""
    return interval_join(snps, segments, keys, ("pos", "pos"), ("start", "end"), width)


def segment_baf(joined: DataFrame, by: list[str], af: str = "af_0") -> DataFrame:
    """Mean mirrored allele fraction and number of sites of each segment."""
    return joined.groupBy(*by).agg((F.lit(0.5) + F.avg(F.abs(F.lit(0.5) - F.col(af)))).alias("mean_baf"), F.count(F.lit(1)).alias("n_sites"))


def absolute_segments(segments: DataFrame, purity: float, ploidy: float, baf: str | None = "mean_baf") -> DataFrame:
    """Total and minor copy numbers; the total alone where a segment has no allele fractions."""
    r, p, q = F.col("relative_cn"), F.lit(float(purity)), F.lit(float(ploidy))
    total = rounded(F.greatest(absolute_copy_number(r, p, q), F.lit(0.0)), 4)
    if baf is None:
        return segments.withColumn("copy_number", total)
    minor, major = allele_copy_number(r, 1 - F.col(baf), p, q), allele_copy_number(r, F.col(baf), p, q)
    return segments.withColumn("minor_cn", minor).withColumn("copy_number", F.when(F.col(baf).isNull(), total).otherwise(rounded(minor + major, 4)))


def skew_kurtosis(x: Column) -> tuple[Column, Column]:
    """Sample-adjusted skewness and excess kurtosis (type 2); null for too few values."""
    n = F.count(x).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    skew = F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return skew, kurt


def bimodality(x: Column) -> Column:
    """(skewness^2 + 1) / (kurtosis + 3 (n-1)^2 / ((n-2)(n-3)))."""
    n = F.count(x).cast("double")
    skew, kurt = skew_kurtosis(x)
    return F.try_divide(skew * skew + 1, kurt + F.try_divide(3 * (n - 1) * (n - 1), (n - 2) * (n - 3)))


def block_summary(sites: DataFrame, block: str = "block_id") -> DataFrame:
    """n, span, mean depth and bimodality of both allele fractions of each block; few sites or depths out of range are the caller's to filter."""
    stacked = sites.select(block, "pos", "dp", F.explode(F.array("af_0", "af_1")).alias("af"))
    size = sites.groupBy(block).agg(F.count(F.lit(1)).alias("n"), (F.max("pos") - F.min("pos")).alias("length"), F.avg("dp").alias("mean_dp"))
    return size.join(stacked.groupBy(block).agg(bimodality(F.col("af")).alias("bc")), block)


def cellularity(sites: DataFrame, blocks: DataFrame, n_top: int = 10, block: str = "block_id") -> DataFrame:
    """One row: purity from the medians of either half of the allele fractions in the blocks of most bimodality."""
    top = blocks.orderBy(F.desc("bc"), block).limit(n_top).select(block)
    af = sites.join(F.broadcast(top), block).select(block, F.explode(F.array("af_0", "af_1")).alias("af"))
    halves = af.groupBy(block).agg(F.median(F.when(F.col("af") > 0.5, F.col("af"))).alias("hi"), F.median(F.when(F.col("af") < 0.5, F.col("af"))).alias("lo"))
    return halves.agg(F.avg(((1 - 2 * (1 - F.col("hi"))) + (1 - 2 * F.col("lo"))) / 2).alias("cellularity"))


def kde_modes(values: np.ndarray, points: int = 1000, least: float = 0.1, counts: np.ndarray | None = None) -> list[tuple[float, float]]:
    """(place, share) of the modes of a Gaussian density (Scott's bandwidth) that hold ``least`` of its mass or more.

    ``counts`` says how often each value occurs (once, by default).
    """
    values = np.asarray(values, float)
    n = np.ones(len(values)) if counts is None else np.asarray(counts, float)
    known = ~np.isnan(values)
    x, inverse = np.unique(values[known], return_inverse=True)
    n = np.bincount(inverse, n[known], len(x))
    size = n.sum()
    if len(x) < 2:
        return []
    mean = n @ x / size
    width = np.sqrt(n @ (x - mean) ** 2 / (size - 1)) * size**-0.2
    at = np.linspace(x[0] - width, x[-1] + width, points)
    density = np.zeros(points)
    for i in range(0, len(x), 20_000):  # some values at a time, so that memory stays small
        density += np.exp(-0.5 * ((at[:, None] - x[None, i : i + 20_000]) / width) ** 2) @ n[i : i + 20_000]
    turn = np.sign(np.diff(density))
    peaks = [i for i in range(1, points - 1) if turn[i - 1] > 0 and turn[i] <= 0]
    cuts = [0, *[a + int(np.argmin(density[a:b])) for a, b in zip(peaks, peaks[1:], strict=False)], points]
    share = [density[a:b].sum() / density.sum() for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(float(at[p]), float(s)) for p, s in zip(peaks, share, strict=True) if s >= least]


def block_modes(sites: DataFrame, block: str = "block_id", least: float = 0.1) -> DataFrame:
    """block, n_modes of the density of both allele fractions; blocks are windows of bounded size.

    Equal fractions are counted before they come to Python: a block's work is that of its different fractions.
    """
    ship(sites.sparkSession)

    def modes(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf["_af"].to_numpy(float), pdf["_n"].to_numpy(float)
        return pd.DataFrame({block: [pdf[block].iloc[0]], "n_modes": [len(kde_modes(x, least=least, counts=n))]})

    af = sites.select(block, F.explode(F.array(F.col("af_0").cast("double"), F.col("af_1").cast("double"))).alias("_af"))
    counted = af.groupBy(block, "_af").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(block).applyInPandas(modes, f"{block} {dict(sites.dtypes)[block]}, n_modes int")


def fit_purity_ploidy(segments: DataFrame, purity: tuple[float, float, float] = (0.2, 1.0, 0.01), ploidy: tuple[float, float, float] = (1.5, 5.0, 0.01), squared: bool = True) -> DataFrame:
    """Ranked solutions: grid distances, local minima, those near the best, those that are acceptable."""
    points = grid(segments.sparkSession, search_space(*purity), search_space(*ploidy))
    fits = grid_distances(segments, points, squared)
    return rank_solutions(acceptable(segments, within_scale(local_minima(fits))))
