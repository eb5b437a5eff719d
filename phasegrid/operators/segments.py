"""Consolidating windows into segments, and where a segment's parts lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import CONTIG_KEYS, DICER, OVERLAP, STRIDE

_MAXIMA = [
    "k", "n", "n_all", "p", "u", "u_all", "maxf", "pos_of_maxf", "eff_frq", "ext_k", "R_bound", "length",
    "Howell", "Howellb", "Guo", "Guo_b", "Wfreq", "Cfreq", "contig_frq",
]
_MINIMA = ["L_bound", "pval", "pval_b"]
_MODES = ["eff_strand", "dominant_strand"]


def consolidate(windows: DataFrame) -> DataFrame:
    """One row per (contig, effector position).

    Maxima everywhere but for the left bound and the probabilities; the strands
    are the commonest label, the alphabetically first on ties. ``length`` stays
    the longest window segment rather than the consolidated span. With an
    ``mfe`` column its extremes are kept too.
    """
    aggs = [F.max(c).alias(c) for c in _MAXIMA]
    aggs += [F.min(c).alias(c) for c in _MINIMA]
    aggs += [F.mode(F.col(c), True).alias(c) for c in _MODES]
    if "mfe" in windows.columns:
        aggs += [F.max("mfe").alias("max_mfe"), F.min("mfe").alias("min_mfe")]
    kept = windows.filter((F.col("k") > 2) & (F.col("maxf") > 3))
    return kept.groupBy(*CONTIG_KEYS, "eff_pos").agg(*aggs)


def once_per_place(df: DataFrame, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """Each effector position of a library and chromosome once, although overlapping tiles both report it.

    A tile owns the positions from the middle of the overlap at its start to the
    middle of the one at its end, where it sees both sides. Its row stays; a
    position that its owner did not report keeps the row of the other tile. At
    most two tiles cover a position, so a group has two rows, or as many as a
    tile's row is repeated; one of them stays.
    """
    middle = F.col("tile") + overlap // 2
    at = F.col("eff_pos")
    # the first tile has no tile before it
    owned = ((at >= middle) | (F.col("tile") == 0)) & (at < middle + stride)
    first = Window.partitionBy("library", "chr", "eff_pos").orderBy(owned.desc(), "tile")
    return df.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def star_site(df: DataFrame) -> DataFrame:
    """Strand and position of the strand opposite to the effector."""
    return df.withColumns(
        {
            "star_strand": F.when(F.col("eff_strand") == "W", "C").otherwise("W"),
            "star_pos": F.when(F.col("eff_strand") == "C", F.col("eff_pos") + 2).otherwise(F.col("eff_pos") - 2),
        }
    )


# How far the long precursors reach from the effector, and the scan length of a window.
NEAR, FAR, SCAN = 200, 500, 160


def segment_regions(df: DataFrame, dicer: int = DICER) -> DataFrame:
    """Bounds of the effector and of the two long precursors, and the segment's name."""
    e = F.col("eff_pos")
    return df.withColumns(
        {
            "eff_end": e + dicer - 1,
            "near_start": F.greatest(e - NEAR, F.lit(0)),
            "far_end": e + FAR - 1,
            "far_start": F.greatest(e - FAR, F.lit(0)),
            "near_end": e + NEAR - 1,
            "segment": segment_name(F.col("chr"), F.col("L_bound"), F.col("R_bound")),
        }
    )


def segment_name(chr_: Column, left: Column, right: Column) -> Column:
    return F.concat(chr_, F.lit(":"), left.cast("string"), F.lit("-"), right.cast("string"))


def effector_offsets(precursor: Column, effector: Column) -> dict[str, Column]:
    """Distances of the first occurrence from both ends; -1 on the left when absent."""
    left = F.instr(precursor, effector) - 1
    return {"dist_5p": left, "dist_3p": F.length(precursor) - left - F.length(effector)}


def consistent_label(df: DataFrame, key: str = "eff_seq", library: str = "library") -> DataFrame:
    """True where the effector sequence is seen in at least two libraries."""
    seen = df.groupBy(key).agg((F.min(library) != F.max(library)).alias("consistent"))
    return df.join(seen, key, "left")


def annotate_reference(df: DataFrame, loci: DataFrame) -> DataFrame:
    """Left join with known loci by contig; ``Literature`` tells whether one was found."""
    renamed = loci.withColumnRenamed("CONTIG_literature_seen", "CONTIG").withColumn("_known", F.lit(True))
    if "chromosome" in renamed.columns:
        renamed = renamed.drop("chromosome")
    joined = df.join(renamed, "CONTIG", "left")
    return joined.withColumn("Literature", F.coalesce("_known", F.lit(False))).drop("_known")
