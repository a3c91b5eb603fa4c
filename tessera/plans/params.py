"""Defaults of the workflows."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CallParams:
    length: int = 30
    mapq: int = 5
    buffer: int = 10
    insertion_buffer: int = 250
    end_buffer: int = 50
    min_support: int = 3
    min_reads_per_cluster: int = 3
    inv_artefact_distance: int = 200
    keep_inv_artefact: bool = False
    single_bnd: bool = False
    single_bnd_min_length: int = 1000
    single_bnd_max_mapq: int = 5
    coverage_binsize: int = 5


@dataclass(frozen=True)
class CnaParams:
    cn_binsize: int = 10_000
    readcount_mapq: int = 5
    allele_mapq: int = 5
    allele_min_reads: int = 10
    ac_window: int = 1_200_000
    bl_threshold: float = 5.0
    bases_threshold: float = 75.0
    smoothing_level: int = 10
    trim: float = 0.025
    min_segment_size: int = 5
    shuffles: int = 1000
    p_seg: float = 0.05
    p_val: float = 0.01
    quantile: float = 0.2
    ploidy: tuple[float, float, float] = (1.5, 5.0, 0.01)
    cellularity: tuple[float, float, float] = (0.2, 1.0, 0.01)
    cellularity_buffer: float = 0.1
    min_block_size: int = 10
    min_block_length: int = 500_000
