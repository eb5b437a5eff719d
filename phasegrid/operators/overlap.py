"""Reads overlapping a segment.

Reads are summed per (library, chr, place, length) before they meet any
segment, so a pile of equal reads is one row however high it is. Segments and
summed reads are spread over fixed bins and joined on the bin; a pair that shares
several bins is kept in the first one only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_ratio
from ..functions.sequence import reverse_complement
from ..params import DICER
from .windows import times

BIN = 2000

# The sampled places of a read, as 0-based indices from the start or from the end.
SLOTS = {
    "5p1": 0, "5p2": 1, "5p3": 3, "5p4": 4, "5p5": 5,
    "3p1": -1, "3p2": -2, "3p3": -3, "3p4": -4, "3p5": -5,
    "md1": 9, "md2": 10, "md3": 11, "md4": 12, "md5": 13,
}
BASES = ["A", "C", "G", "T"]


def _bins(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor(end / size)))


def overlap_join(segments: DataFrame, reads: DataFrame, bin_size: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs of a segment [L_bound, R_bound] and read rows [pos, pos + len - 1] on one library and chr.

    With ``how="left"`` every (segment, bin) without a pair stays once, its read
    columns NULL.
    """
    s = segments.withColumn("_bin", _bins(F.col("L_bound"), F.col("R_bound"), bin_size)).alias("s")
    r = reads.withColumn("_bin", _bins(F.col("pos"), F.col("pos") + F.col("len") - 1, bin_size)).alias("r")
    first_common = F.greatest(F.floor(F.col("s.L_bound") / bin_size), F.floor(F.col("r.pos") / bin_size))
    pair = (
        (F.col("s.library") == F.col("r.library"))
        & (F.col("s.chr") == F.col("r.chr"))
        & (F.col("s._bin") == F.col("r._bin"))
        & (F.col("r.pos") <= F.col("s.R_bound"))
        & (F.col("r.pos") + F.col("r.len") - 1 >= F.col("s.L_bound"))
        & (F.col("s._bin") == first_common)
    )
    own = [F.col(f"s.`{c}`") for c in segments.columns]
    theirs = [F.col(f"r.`{c}`") for c in reads.columns if c not in ("library", "chr")]
    return s.join(r, pair, how).select(*own, *theirs)


def read_counts(reads: DataFrame, weight: str | None = None) -> DataFrame:
    """Reads per (library, chr, pos, len, flag); a row stands for ``weight`` of them."""
    present = reads.filter(F.col(weight) >= 1) if weight else reads
    return present.groupBy("library", "chr", "pos", "len", "flag").agg(times(F.lit(True), weight).alias("n_reads"))


def letter_totals(reads: DataFrame, dicer: int = DICER, weight: str | None = None) -> DataFrame:
    """Base and slot counts of the reads of exactly ``dicer`` bases, per (library, chr, pos, len).

    The composition uses the stored orientation, the slots use the read's own. A row
    stands for ``weight`` equal reads, none if that is NULL or less than one.
    """
    exact = reads.filter(F.col("len") == dicer)
    if weight:
        exact = exact.filter(F.col(weight) >= 1)
    own = F.when(F.col("flag") == 16, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    placed = exact.withColumn("_own", own)
    aggs = []
    for b in BASES:
        hits = F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(b), F.lit("")))
        aggs.append(F.sum(hits * F.col(weight) if weight else hits).cast("long").alias(f"n_{b}"))
    for slot, at in SLOTS.items():
        letter = F.substring("_own", at + 1 if at >= 0 else at, 1)
        aggs += [times(letter == b, weight).alias(f"n_{slot}{b}") for b in BASES]
    return placed.groupBy("library", "chr", "pos", "len").agg(*aggs)


def _share(count: str, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(round_ratio(F.col(count) * 100, total, 2))


def _totals(segments: DataFrame, reads: DataFrame, key: list[str], columns: list[str], dicer: int, weight: str | None) -> DataFrame:
    """Sums of the read counts per segment, zeros where no read overlaps."""
    summed = letter_totals(reads, dicer, weight).select("library", "chr", "pos", "len", *columns)
    hits = overlap_join(segments.select(*key, "L_bound", "R_bound"), summed, how="left")
    return hits.groupBy(*key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


_BASE_COLUMNS = [f"n_{b}" for b in BASES]
_SLOT_COLUMNS = [f"n_{slot}{b}" for slot in SLOTS for b in BASES]


def _composition() -> list[Column]:
    total = F.col("n_A") + F.col("n_C") + F.col("n_G") + F.col("n_T")
    shares = {b: _share(f"n_{b}", total) for b in BASES}
    gc = F.round(shares["G"] + shares["C"], 2).alias("GC%")
    return [total.alias("total_frq_DicerCall"), *[c.alias(f"{b}%") for b, c in shares.items()], gc]


def _slots() -> list[Column]:
    out = []
    for slot in SLOTS:
        total = F.col(f"n_{slot}A") + F.col(f"n_{slot}C") + F.col(f"n_{slot}G") + F.col(f"n_{slot}T")
        out += [_share(f"n_{slot}{b}", total).alias(f"{slot}{b}") for b in BASES]
    return out


def base_composition(
    segments: DataFrame, reads: DataFrame, key: list[str], dicer: int = DICER, weight: str | None = None
) -> DataFrame:
    """Number of bases in the overlapping reads, and their percentages; zeros where there is no read."""
    return _totals(segments, reads, key, _BASE_COLUMNS, dicer, weight).select(*key, *_composition())


def positional_bases(
    segments: DataFrame, reads: DataFrame, key: list[str], dicer: int = DICER, weight: str | None = None
) -> DataFrame:
    """Percentage of every base at fifteen places of the overlapping reads: sixty columns."""
    return _totals(segments, reads, key, _SLOT_COLUMNS, dicer, weight).select(*key, *_slots())


def read_statistics(
    segments: DataFrame, reads: DataFrame, key: list[str], dicer: int = DICER, weight: str | None = None
) -> DataFrame:
    """``base_composition`` and ``positional_bases`` from one pass over the reads."""
    sums = _totals(segments, reads, key, _BASE_COLUMNS + _SLOT_COLUMNS, dicer, weight)
    return sums.select(*key, *_composition(), *_slots())
