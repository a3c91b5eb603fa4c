"""Numbers: rounding, copy-number conversions, search grids and constants."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half-even rounding of the decimal form; may differ in the last digit from rounding the binary value."""
    return F.bround(x, digits)


def log2(x: Column) -> Column:
    """Logarithm as floating-point arithmetic has it: -Infinity of 0 and NaN below, where Spark's own gives null."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log2(x))


def anscombe(x: Column) -> Column:
    """Variance-stabilised relative copy number of a log2 ratio."""
    return F.sqrt(F.pow(F.lit(2.0), x) + F.lit(0.375))


def absolute_copy_number(relative: Column, purity: Column, ploidy: Column) -> Column:
    return F.when(purity > 0, ploidy + (relative - 1) * (ploidy + 2 / purity - 2)).otherwise(ploidy * relative)


def allele_copy_number(relative: Column, share: Column, purity: Column, ploidy: Column) -> Column:
    """Copies of an allele that makes up ``share`` of the reads, not below 0, to 4 digits."""
    cn = (purity - 1 + relative * share * (2 * (1 - purity) + purity * ploidy)) / purity
    return F.when(cn.isNotNull(), rounded(F.greatest(cn, F.lit(0.0)), 4))


def search_space(low: float, high: float, by: float) -> list[float]:
    """Inclusive grid with as many digits as the step; empty unless ``low`` is less than ``high``."""
    if low >= high:
        return []
    digits = max(len(str(by)) - 2, 0)
    n = math.floor((high - low) / by + 1e-9)
    return [round(low + i * by, digits) for i in range(n + 1)]


def inflation_factor(trim: float, steps: int = 10_001) -> float:
    """What a trimmed variance of normal differences must be multiplied by: 1 over the trimmed second moment."""
    a = NormalDist().inv_cdf(1 - trim)
    width = 2 * a / steps
    at = [-a + (i + 0.5) * width for i in range(steps)]
    return 1 / (sum(x * x * math.exp(-x * x / 2) / math.sqrt(2 * math.pi) for x in at) * width / (1 - 2 * trim))
