"""Folds and folding energies: of the stretch behind each window, and of the sequences of a segment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import genome
from ..operators.segments import SCAN

#: maps a sequence column to a struct (fold string, mfe double): an expression, or a pandas UDF around an outside program
Fold = Callable[[Column], Column]
#: what tells scanned stretches apart; windows of several libraries and tiles share one
PLACE = ["chr", "pos", "scan_strand"]
# Names of the precursors' folds and energies.
PRECURSOR_FOLDS = {
    "precursor": ("prefold", "premfe"),
    "precursor_200_500": ("prefold_200_500", "premfe_200_500"),
    "precursor_500_200": ("prefold_500_200", "premfe_500_200"),
}


def with_folds(df: DataFrame, columns: dict[str, tuple[str, str]], fold: Fold) -> DataFrame:
    """Add a fold and an energy column for every sequence column of ``columns``, all in one pass over the rows.

    A sequence that is null has null results if ``fold`` gives null or a struct of nulls for it.
    """
    folded = df.select("*", *[fold(F.col(seq)).alias(f"_folded_{i}") for i, seq in enumerate(columns)])
    added = {}
    for i, (structure, energy) in enumerate(columns.values()):
        added[structure] = F.col(f"_folded_{i}.fold").cast("string")
        added[energy] = F.col(f"_folded_{i}.mfe").cast("double")
    return folded.withColumns(added).drop(*[f"_folded_{i}" for i in range(len(columns))])


def scan_energies(windows: DataFrame, tiles: DataFrame, tile_size: int, fold: Fold, scan: int = SCAN) -> DataFrame:
    """Windows with ``scan_seq``, ``scan_fold`` and ``mfe`` of the ``scan`` bases from ``pos`` on, on ``scan_strand``.

    A stretch at the end of its chromosome is shorter; a window whose stretch is
    not in the genome is dropped. Folding is the dear step, so a place shared by
    libraries and tiles is fetched and folded once. ``windows`` is read twice:
    store it if it is not a table yet.
    """
    place = windows.select(*PLACE).distinct()
    first = F.col("pos")
    found = genome.fetch_regions(place, tiles, tile_size, PLACE, {"scan_seq": (first, first + (scan - 1), F.col("scan_strand"))})
    folded = with_folds(found, {"scan_seq": ("scan_fold", "mfe")}, fold)
    return windows.join(folded.select(*PLACE, "scan_seq", "scan_fold", "mfe"), PLACE)
