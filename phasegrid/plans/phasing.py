"""From aligned reads to scored windows and consolidated segments, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import tiling, windows
from ..params import CONTIG_KEYS, CYCLE, DICER, DRIFT

WINDOW_COLUMNS = [
    "pos", "freq", "frqw", "frqc", "k", "n", "n_all", "p", "u", "u_all", "maxf", "pos_of_maxf", "eff_strand",
    "eff_pos", "eff_frq", "mid_cyc", "ext_k", "L_bound", "R_bound", "length", "Howell", "Howellb", "Guo",
    "Guo_b", "pval", "pval_b", "Wfreq", "Cfreq", "ratio", "dominant_strand", "contig_frq",
]


def window_candidates(
    reads: DataFrame, cycle: int = CYCLE, dicer: int = DICER, drift: int = DRIFT, weight: str | None = None
) -> DataFrame:
    """Every position that opens a window, with its totals, slots and effector; a row stands for ``weight`` reads."""
    freq = windows.position_frequency(tiling.assign_contigs(reads), dicer, weight)
    total = F.sum("n_reads").over(windows._contig())
    placed = freq.withColumn("contig_frq", total).filter(F.col("pos").isNotNull())
    placed = windows.effector_coordinate(placed, drift)
    placed = windows.window_totals(placed, cycle, dicer)
    return windows.phase_slots(placed, cycle, dicer)


def phased_windows(
    reads: DataFrame, cycle: int = CYCLE, dicer: int = DICER, drift: int = DRIFT, min_windows: int = 10, weight: str | None = None,
    scan_strand: bool = False,
) -> DataFrame:
    """All windows worth reporting, with scores and extended segments.

    Contigs with too few such windows are dropped before the extension, which
    is the expensive step. With ``scan_strand`` there is a column of that name:
    the effector's strand before the extension, on which the window is folded.
    """
    keep = windows.high_potential()
    found = windows.having_min_windows(window_candidates(reads, cycle, dicer, drift, weight), keep, min_windows)
    carried = ["pos", F.col("f").alias("freq"), F.col("w").alias("frqw"), F.col("c").alias("frqc"),
               "k", "n", "n_all", "p", "u", "u_all", "maxf", "Wfreq", "Cfreq", "contig_frq"]
    more = ["scan_strand"] if scan_strand else []
    carried += [F.col("peak_strand").alias(c) for c in more]
    segments = windows.extend_blocks(found, keep, carried, cycle, dicer)
    table = scores.chen_table(reads.sparkSession, cycle)
    out = windows.strand_dominance(windows.scored(segments, table, cycle))
    half = round(dicer * (cycle - 1) / 2)
    return out.withColumn("mid_cyc", F.col("pos") + half).select(*CONTIG_KEYS, *WINDOW_COLUMNS, *more)
