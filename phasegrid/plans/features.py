"""Segments with sequences, tails, base statistics, targets, hairpin verdicts and structure columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import genome, hairpin, overlap, segments, significance, structures, tables, targets
from ..operators.tiling import contig_name
from ..params import CONTIG_KEYS, CYCLE, DICER, DRIFT
from ..session import stored
from . import energies
from .phasing import phased_windows

SEGMENT_KEY = [*CONTIG_KEYS, "eff_pos"]


def with_fold(df: DataFrame, columns: dict[str, str], fold_fn: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Hook for an outside folding program: ``fold_fn`` maps a batch of sequences to folds.

    ``columns`` names the new fold column for every sequence column. Batches run
    inside the tasks, wherever the rows are.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.StringType()) for c in columns.values()]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: fold_fn(pdf[seq]) for seq, out in columns.items()})

    return df.mapInPandas(run, schema)


def phased_segments(
    reads: DataFrame, cycle: int = CYCLE, dicer: int = DICER, drift: int = DRIFT, min_windows: int = 10, weight: str | None = None,
    tiles: DataFrame | None = None, tile_size: int = 0, fold: energies.Fold | None = None,
    dedupe: bool = False,
) -> DataFrame:
    """Reads to consolidated segments with adjusted probabilities, tails and votes; a row stands for ``weight`` reads.

    With a genome and a ``fold`` (see ``energies``) windows get the energy of
    the stretch behind them, and segments ``max_mfe`` and ``min_mfe``. With ``dedupe`` a segment that two
    overlapping tiles report counts once, in all statistics too.
    """
    if fold is None:
        windows = phased_windows(reads, cycle, dicer, drift, min_windows, weight)
    else:
        windows = stored(phased_windows(reads, cycle, dicer, drift, min_windows, weight, scan_strand=True), "windows")
        windows = energies.scan_energies(windows, tiles, tile_size, fold)
    # ranks, fits and the vote each need the segments, a small table, but not the reads again
    found = segments.consolidate(windows)
    return significant(stored(segments.once_per_place(found) if dedupe else found, "segments"))


def significant(consolidated: DataFrame) -> DataFrame:
    """FDR for both probabilities, gamma tails and the vote, per library."""
    out = significance.benjamini_hochberg(consolidated, ["library"], "pval", "pval_fdr", "pval_accept")
    out = significance.benjamini_hochberg(out, ["library"], "pval_b", "pvalb_fdr", "pvalb_accept")
    out = significance.gamma_tails(out, ["library"])
    tails = [f"{c}_ccdf" for c in significance.UPPER] + [f"{c}_cdf" for c in significance.LOWER]
    return significance.vote(out, tails)


def with_sequences(rows: DataFrame, tiles: DataFrame, tile_size: int, dicer: int = DICER) -> DataFrame:
    """Effector, opposite strand, segment and both long precursors; rows without sequence are dropped."""
    placed = segments.segment_regions(segments.star_site(rows), dicer)
    strand = F.col("eff_strand")
    wanted = {
        "eff_seq": (F.col("eff_pos"), F.col("eff_end"), strand),
        "star_seq_ifDominantBoth": (F.col("star_pos"), F.col("star_pos") + dicer - 1, F.col("star_strand")),
        "precursor": (F.col("L_bound"), F.col("R_bound"), strand),
        "precursor_200_500": (F.col("near_start"), F.col("far_end"), strand),
        "precursor_500_200": (F.col("far_start"), F.col("near_end"), strand),
    }
    found = genome.fetch_regions(placed, tiles, tile_size, SEGMENT_KEY, wanted)
    offsets = segments.effector_offsets(F.col("precursor"), F.col("eff_seq"))
    return found.withColumns(offsets)


def hairpin_columns(row: DataFrame, profile: str = "def") -> DataFrame:
    """Verdicts for the segment and for both long precursors: nine columns per ``row_id``.

    The three folds of a row become three short rows, so the pair tables and the
    rules are planned and run once.
    """
    kinds = {"": ("prefold", F.col("dist_5p")), "25": ("prefold_200_500", F.lit(200)), "52": ("prefold_500_200", F.lit(500))}
    folds = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f).alias("fold"), at.cast("int").alias("at")) for k, (f, at) in kinds.items()]
    )
    sites = row.select("row_id", F.length("eff_seq").alias("size"), F.inline(folds)).withColumn(
        "site_id", F.concat_ws("|", "row_id", "kind")
    )
    paired = structures.with_pairs(sites, "site_id", "fold")
    judged = hairpin.hairpin_check(paired, F.col("at"), F.col("at") + F.col("size"), profile)
    names = ["hairpin_conclu", "fback_start", "fback_stop"]
    wide = [F.max(F.when(F.col("kind") == k, F.col(n))).alias(n + k) for k in kinds for n in names]
    return judged.select("row_id", "kind", *names).groupBy("row_id").agg(*wide)


def segment_features(
    reads: DataFrame, tiles: DataFrame, tile_size: int, queries: DataFrame, species: str, loci: DataFrame,
    fold_fn: Callable[[pd.Series], pd.Series] | None, cycle: int = CYCLE, dicer: int = DICER, drift: int = DRIFT,
    min_windows: int = 10, fold: energies.Fold | None = None,
) -> DataFrame:
    """The whole way from reads to the feature table; ``reads`` carries sequences.

    The folded segments are written once. Every annotation then reads only the
    columns it needs and comes back by the row's key. With ``fold`` instead of
    ``fold_fn`` the table also has the energies of windows and precursors.
    """
    found = phased_segments(reads, cycle, dicer, drift, min_windows, tiles=tiles, tile_size=tile_size, fold=fold)
    placed = with_sequences(found, tiles, tile_size, dicer)
    if fold is None:
        folded = with_fold(placed, {seq: name for seq, (name, _) in energies.PRECURSOR_FOLDS.items()}, fold_fn)
    else:
        folded = energies.with_folds(placed, energies.PRECURSOR_FOLDS, fold)
    row = stored(
        folded.withColumns(
            {
                "row_id": F.concat_ws("|", *[F.col(k).cast("string") for k in SEGMENT_KEY]),
                "precursor_id": F.sha2("precursor", 256),
                "CONTIG": contig_name(F.col("chr"), F.col("tile")),
            }
        ),
        "folded",
    )
    bases = overlap.read_statistics(row.select(*SEGMENT_KEY, "L_bound", "R_bound"), reads, SEGMENT_KEY, dicer)
    # equal precursors of several libraries are searched once
    distinct = row.groupBy("precursor_id").agg(F.any_value("precursor").alias("precursor"))
    asked = targets.of_species(queries, species)
    hits = targets.best_any_two(distinct, targets.target_runs(distinct, asked, "precursor_id", "precursor"), "precursor_id")
    site = structures.structure_window(row.select("row_id", "precursor", "prefold", "eff_seq"), "precursor", "prefold")
    shapes = structures.structure_features(site, ["row_id"])

    out = (
        row.join(bases, SEGMENT_KEY)
        .join(hits, "precursor_id")
        .join(hairpin_columns(row), "row_id")
        .join(shapes, "row_id")
    )
    # known loci may repeat a contig, and then repeat its rows, so they come last
    annotated = segments.annotate_reference(structures.effector_kmer_table(out).drop("row_id", "precursor_id"), loci)
    return annotated.withColumnsRenamed(tables.published_names(dicer))
