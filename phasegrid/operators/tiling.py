"""Assigning reads to overlapping tiles ("contigs") and choosing among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import OVERLAP, STRIDE


def tile_starts(pos: Column, stride: int = STRIDE, overlap: int = OVERLAP) -> Column:
    """The start of the tile holding ``pos``, and of the one before where both cover it."""
    offset = F.pmod(pos, F.lit(stride))
    own = pos - offset
    shared = (offset <= overlap) & (own >= stride)
    return F.when(shared, F.array(own, own - stride)).otherwise(F.array(own))


def assign_contigs(reads: DataFrame, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """One row per (read, tile); ``tile`` is the tile's start."""
    return reads.withColumn("tile", F.explode(tile_starts(F.col("pos"), stride, overlap)))


def contig_name(chr_: Column, tile: Column, stride: int = STRIDE, overlap: int = OVERLAP) -> Column:
    end = (tile + stride + overlap).cast("string")
    return F.concat(chr_, F.lit("__"), tile.cast("string"), F.lit("_"), end)


def shifted_position(flag: Column, pos: Column) -> Column:
    """Reverse-strand reads are counted two places further; other flags have no place."""
    return F.when(flag == 0, pos).when(flag == 16, pos + 2)


def strand(flag: Column) -> Column:
    return F.when(flag == 0, "W").when(flag == 16, "C")


def keep_contig(reads: DataFrame, chr_: str, tile: int, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """One named contig, as a position range so that the scan can skip the rest."""
    inside = (F.col("chr") == chr_) & F.col("pos").between(tile, tile + stride + overlap)
    return assign_contigs(reads.filter(inside), stride, overlap).filter(F.col("tile") == tile)


def sample_contigs(df: DataFrame, fraction: float, stride: int = STRIDE, seed: int = 12345) -> DataFrame:
    """Keep a fraction of the contigs, each with all of its rows.

    The choice depends on the key alone, so it is the same under any
    partitioning and needs no shuffle.
    """
    digits = F.regexp_extract("chr", "([0-9]+)$", 1).cast("long")
    number = F.coalesce(digits, F.length("chr").cast("long")) * 7919 + (F.col("tile") / stride).cast("long") * 104729
    return df.filter(key_share(number + seed) < fraction)


#: a prime, so that multiples of a key go through all remainders
_PRIME = 2147483647


def key_share(number: Column) -> Column:
    """A number in [0, 1) from a whole number, even over many keys and fine enough for any fraction."""
    mixed = F.pmod(F.pmod(number, F.lit(_PRIME)) * 48271, F.lit(_PRIME))
    return F.pmod(mixed * 69621, F.lit(_PRIME)) / F.lit(float(_PRIME))
