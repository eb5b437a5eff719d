"""Nucleotide string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Upper-case, complement A/T and C/G, leave other letters, reverse."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def rna_to_dna(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def dna_to_rna(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def count_letters(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are in ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def _from_start(seq: Column, start: int, size: int) -> Column:
    return F.substring(seq, start + 1, size)


def _from_end(seq: Column, last: int, size: int) -> Column:
    """``size`` letters whose last one is ``last`` places before the end (0 = the end)."""
    begin = F.length(seq) - last - size + 1
    taken = F.substring(seq, F.greatest(begin, F.lit(1)), F.least(F.lit(size), begin + size - 1))
    return F.when(begin + size > 1, taken).otherwise("")


def effector_kmers(seq: Column) -> dict[str, Column]:
    """46 mono-, di- and tri-mers at both ends and in the middle, plus one pair column."""
    out: dict[str, Column] = {}
    for size, tail in ((1, ""), (2, "di"), (3, "tri")):
        for i in range(5):
            out[f"eff5p{i + 1}{tail}"] = _from_start(seq, i, size)
        for i in range(5):
            out[f"eff3p{i + 1}{tail}"] = _from_end(seq, i, size)
        for i in range(5):
            out[f"effmd{i + 1}{tail}"] = _from_start(seq, 9 + i, size)
    # a single letter beyond the sequence is missing, a longer slice is just empty
    single = {name: F.nullif(c, F.lit("")) for name, c in out.items() if name[-2:] != "di" and name[-3:] != "tri"}
    out.update(single)
    out["eff5p1_3p3"] = F.concat(single["eff5p1"], single["eff3p3"])
    return out


def motif_count(seq: Column, motif: str) -> Column:
    """Overlapping occurrences of ``motif``."""
    return F.when(F.length(seq) >= len(motif), F.regexp_count(seq, F.lit(f"(?={motif})"))).otherwise(0)
