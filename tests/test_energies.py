"""Folding energies (places folded once, stretches outside of the genome, outside programs as pandas UDFs); segments once."""

import pandas as pd
from pyspark.sql import functions as F

from phasegrid.catalog.segments import hairpin_fold
from phasegrid.operators import segments
from phasegrid.plans import energies

TILES = [("1", 0, "ACGTACGTAC"), ("1", 1, "GGGGCCCCAA"), ("1", 2, "TTT")]


def windows(spark, rows):
    # other columns of a window, one of them with the name of a helper
    frame = spark.createDataFrame(rows, "library string, chr string, tile long, pos long, scan_strand string")
    return frame.withColumn("k", F.lit(3)).withColumn("_folded_9", F.lit("x"))


def plain_fold(seq):
    half = seq[: max(len(seq) - 5, 0) // 2].translate(str.maketrans("ACG", "(((")).replace("T", ".")
    fold = half + "." * (len(seq) - 2 * len(half)) + half[::-1].replace("(", ")")
    return fold, -half.count("(") - 0.25 * sum(c in "GC" for c in seq)


def test_scan_windows(spark):
    tiles = spark.createDataFrame(TILES, "chr string, tile long, seq string")
    rows = [("a", "1", 0, 3, "W"), ("b", "1", 0, 3, "W"), ("a", "1", 5, 3, "W"), ("a", "1", 0, 3, "C"), ("a", "1", 0, 18, "B"),
            ("a", "1", 0, 99, "W"), ("a", "2", 0, 3, "W")]
    got = energies.scan_energies(windows(spark, rows), tiles, 10, hairpin_fold, scan=12)
    genome = "".join(seq for _, _, seq in TILES)
    want = []
    for library, _, tile, pos, strand in rows[:5]:
        seq = genome[pos - 1:pos + 11]
        if strand == "C":
            seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        want.append((library, tile, pos, strand, seq, *plain_fold(seq)))
    # the last two lie outside of the genome; the one at its end is shorter
    assert sorted(tuple(r) for r in got.select("library", "tile", "pos", "scan_strand", "scan_seq", "scan_fold", "mfe").collect()) == sorted(want)
    assert {r.k for r in got.collect()} == {3} and "_folded_9" in got.columns
    assert energies.scan_energies(windows(spark, []), tiles, 10, hairpin_fold).count() == 0


def test_an_outside_program_gives_the_same(spark):
    @F.pandas_udf("fold string, mfe double")
    def outside(seqs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([plain_fold(s) if s is not None else (None, None) for s in seqs], columns=["fold", "mfe"])

    rows = spark.createDataFrame([(1, "ACGTACGTACGTAA", "G" * 300), (2, "ACG", None), (3, "", "TTTTTTT")], "id int, x string, y string")
    columns = {"x": ("x_fold", "x_mfe"), "y": ("y_fold", "y_mfe")}
    a, b = (sorted(map(repr, energies.with_folds(rows, columns, f).collect())) for f in (hairpin_fold, outside))
    assert len(a) == 3 and [x for x in a if "id=2" not in x] == [x for x in b if "id=2" not in x]
    r = next(r for r in energies.with_folds(rows, columns, outside).collect() if r.id == 2)
    assert (r.x_fold, r.x_mfe, r.y_fold, r.y_mfe) == ("...", -0.5, None, None)
    # one pass, one Python node for both columns
    plan = energies.with_folds(rows, columns, outside)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_segments_of_overlapping_tiles_count_once(spark):
    rows = [("a", "1", 0, 5100), ("a", "1", 5000, 5100), ("a", "1", 0, 5200), ("a", "1", 5000, 5200), ("b", "1", 5000, 5100),
            ("a", "1", 0, 5240), ("a", "1", 0, 3), ("a", "2", 0, 5100), ("a", "1", 5000, 5125), ("a", "1", 0, 5125)]
    found = segments.once_per_place(spark.createDataFrame(rows, "library string, chr string, tile long, eff_pos long"))
    # before the middle of the overlap the earlier tile, from it on the later one; a tile that is alone keeps its row
    assert sorted(tuple(r) for r in found.collect()) == sorted(
        [("a", "1", 0, 5100), ("a", "1", 5000, 5200), ("b", "1", 5000, 5100), ("a", "1", 0, 5240), ("a", "1", 0, 3), ("a", "2", 0, 5100),
         ("a", "1", 5000, 5125)])
