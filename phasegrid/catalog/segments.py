"""Segments: consolidation, sequences, significance, overlapping reads, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, genome, overlap, segments, significance, tables, tiling
from ..params import CONTIG_KEYS
from ..plans import energies, features, phasing
from ..session import stored
from .fixtures import TILE, Tables
from .registry import query, view

K = "library string, chr string, tile long"
SK = features.SEGMENT_KEY

# round-half rule of the two-decimal percentages, on exact integers; binary decides decimal ties
def pct(num: str, den: str, scale: int = 100) -> str:
    two = 2 * scale
    return f"""(CASE WHEN {den} = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN ({two} * {num}) % (2 * {den}) = {den}
  THEN ({two} * {num}) // (2 * {den}) + CASE
    WHEN ((floor({num}::DOUBLE / {den} * 1073741824.0::DOUBLE) / 1073741824.0::DOUBLE) * {two} - (2 * (({two} * {num}) // (2 * {den})) + 1))
       + ({num}::DOUBLE / {den} - floor({num}::DOUBLE / {den} * 1073741824.0::DOUBLE) / 1073741824.0::DOUBLE) * {two} > 0 THEN 1
    WHEN ((floor({num}::DOUBLE / {den} * 1073741824.0::DOUBLE) / 1073741824.0::DOUBLE) * {two} - (2 * (({two} * {num}) // (2 * {den})) + 1))
       + ({num}::DOUBLE / {den} - floor({num}::DOUBLE / {den} * 1073741824.0::DOUBLE) / 1073741824.0::DOUBLE) * {two} < 0 THEN 0
    ELSE (({two} * {num}) // (2 * {den})) % 2 END
  ELSE ({two} * {num} + {den}) // (2 * {den}) END)::DOUBLE / {scale} END)"""


MAXIMA = "k n n_all p u u_all maxf pos_of_maxf eff_frq ext_k R_bound length Howell Howellb Guo Guo_b Wfreq Cfreq contig_frq".split()
view("segs", ["phased"], f"""
SELECT library, chr, tile, eff_pos, {', '.join(f'max({c}) AS {c}' for c in MAXIMA)},
  min(L_bound) AS L_bound, min(pval) AS pval, min(pval_b) AS pval_b,
  any_value(es) AS eff_strand, any_value(ds) AS dominant_strand
FROM (SELECT *,
    first_value(eff_strand) OVER (PARTITION BY library, chr, tile, eff_pos ORDER BY ne DESC, eff_strand) AS es,
    first_value(dominant_strand) OVER (PARTITION BY library, chr, tile, eff_pos ORDER BY nd DESC, dominant_strand) AS ds
  FROM (SELECT *, count(*) OVER (PARTITION BY library, chr, tile, eff_pos, eff_strand) AS ne,
          count(*) OVER (PARTITION BY library, chr, tile, eff_pos, dominant_strand) AS nd FROM phased))
GROUP BY library, chr, tile, eff_pos""")
SEG_COLS = f"""{K}, eff_pos long, k long, n long, n_all long, p long, u long, u_all long, maxf long, pos_of_maxf long,
eff_frq long, ext_k long, R_bound long, length long, Howell double, Howellb double, Guo double, Guo_b double,
Wfreq long, Cfreq long, contig_frq long, L_bound long, pval double, pval_b double, eff_strand string,
dominant_strand string""".replace("\n", " ")


def _segs(t: Tables) -> DataFrame:
    return segments.consolidate(phasing.phased_windows(t.reads()))


def _stored_segs(t: Tables) -> DataFrame:
    """Written once, for operators that go over the segments several times."""
    return stored(_segs(t), "segments")


@query("consolidate_segments", SEG_COLS, ["segs"], "SELECT * FROM segs")
def _(t: Tables) -> DataFrame:
    return _segs(t)


@query("star_site", f"{K}, eff_pos long, star_strand string, star_pos long", ["segs"], """
SELECT *, CASE WHEN eff_strand = 'W' THEN 'C' ELSE 'W' END AS star_strand,
  CASE WHEN eff_strand = 'C' THEN eff_pos + 2 ELSE eff_pos - 2 END AS star_pos FROM segs""")
def _(t: Tables) -> DataFrame:
    return segments.star_site(_segs(t))


@query("segment_geometry", f"{K}, eff_pos long, eff_end long, near_start long, far_end long, far_start long, "
       "near_end long, segment string", ["segs"], """
SELECT *, eff_pos + 20 AS eff_end, greatest(eff_pos - 200, 0) AS near_start, eff_pos + 499 AS far_end,
  greatest(eff_pos - 500, 0) AS far_start, eff_pos + 199 AS near_end,
  chr || ':' || L_bound || '-' || R_bound AS segment FROM segs""")
def _(t: Tables) -> DataFrame:
    return segments.segment_regions(_segs(t))


view("whole", ["genome"], """
SELECT chr, string_agg(seq, '' ORDER BY tile) AS g FROM genome GROUP BY chr""")


def _complement(sql: str) -> str:
    return f"reverse(translate(upper({sql}), 'ACGT', 'TGCA'))"


view("starts", ["reads"], "SELECT DISTINCT chr, pos, flag FROM reads")
_REGION = "substr(g, s.pos, 160)"


def region_sql() -> str:
    return f"""SELECT s.chr, s.pos, s.flag, CASE WHEN flag = 16 THEN {_complement(_REGION)} ELSE upper({_REGION}) END AS seq
FROM starts s JOIN whole USING (chr)"""


def _regions(t: Tables, tiles: DataFrame | None = None) -> DataFrame:
    starts = t.reads().select("chr", "pos", "flag").distinct()
    strand = F.when(F.col("flag") == 16, "C").otherwise("W")
    wanted = {"seq": (F.col("pos"), F.col("pos") + segments.SCAN - 1, strand)}
    return genome.fetch_regions(starts, tiles or t.genome_tiles(), TILE, ["chr", "pos", "flag"], wanted)


@query("fetch_region", "chr string, pos long, flag int, seq string", ["starts", "whole"], region_sql())
def _(t: Tables) -> DataFrame:
    return _regions(t)


@query("fetch_region_fasta", "chr string, pos long, flag int, seq string", ["starts", "whole"], region_sql())
def _(t: Tables) -> DataFrame:
    return _regions(t, t.fasta_tiles())


view("segseq", ["segs", "whole"], f"""
SELECT *, CASE WHEN instr(precursor, eff_seq) > 0 THEN instr(precursor, eff_seq) - 1 ELSE -1 END AS dist_5p
FROM (SELECT s.*,
  CASE WHEN eff_strand = 'C' THEN {_complement('substr(g, greatest(eff_pos, 1), eff_pos + 21 - greatest(eff_pos, 1))')}
       ELSE upper(substr(g, greatest(eff_pos, 1), eff_pos + 21 - greatest(eff_pos, 1))) END AS eff_seq,
  CASE WHEN eff_strand = 'W' THEN {_complement('substr(g, greatest(sp, 1), sp + 21 - greatest(sp, 1))')}
       ELSE upper(substr(g, greatest(sp, 1), sp + 21 - greatest(sp, 1))) END AS star_seq,
  CASE WHEN eff_strand = 'C' THEN {_complement('substr(g, greatest(L_bound, 1), R_bound + 1 - greatest(L_bound, 1))')}
       ELSE upper(substr(g, greatest(L_bound, 1), R_bound + 1 - greatest(L_bound, 1))) END AS precursor,
  CASE WHEN eff_strand = 'C' THEN {_complement('substr(g, greatest(eff_pos - 200, 1), eff_pos + 500 - greatest(eff_pos - 200, 1))')}
       ELSE upper(substr(g, greatest(eff_pos - 200, 1), eff_pos + 500 - greatest(eff_pos - 200, 1))) END AS precursor_200_500,
  CASE WHEN eff_strand = 'C' THEN {_complement('substr(g, greatest(eff_pos - 500, 1), eff_pos + 200 - greatest(eff_pos - 500, 1))')}
       ELSE upper(substr(g, greatest(eff_pos - 500, 1), eff_pos + 200 - greatest(eff_pos - 500, 1))) END AS precursor_500_200
FROM (SELECT *, CASE WHEN eff_strand = 'C' THEN eff_pos + 2 ELSE eff_pos - 2 END AS sp FROM segs) s JOIN whole USING (chr))""")


@query("region_tile_join", f"{K}, eff_pos long, eff_seq string, star_seq_ifDominantBoth string, precursor string, "
       "precursor_200_500 string, precursor_500_200 string, dist_5p int, dist_3p int", ["segseq"], """
SELECT *, star_seq AS "star_seq_ifDominantBoth", length(precursor) - dist_5p - length(eff_seq) AS dist_3p FROM segseq""")
def _(t: Tables) -> DataFrame:
    return features.with_sequences(_segs(t), t.genome_tiles(), TILE)


def hairpin_fold(seq: Column) -> Column:
    """Stand-in for an outside folding program: one mirrored stem, an energy from its pairs and the G and C."""
    size = F.length(seq)
    half = F.translate(F.substring(seq, F.lit(1), F.floor(F.greatest(size - 5, F.lit(0)) / 2).cast("int")), "ACGT", "(((.")
    gap = F.repeat(F.lit("."), size - 2 * F.length(half))
    pairs = F.length(half) - F.length(F.replace(half, F.lit("("), F.lit("")))
    strong = size - F.length(F.translate(seq, "GC", ""))
    return F.struct(F.concat(half, gap, F.reverse(F.translate(half, "(", ")"))).alias("fold"), (-pairs - strong * 0.25).cast("double").alias("mfe"))


def fold_sql(seq: str) -> tuple[str, str]:
    """(fold, mfe) of ``hairpin_fold`` for the oracle."""
    half = f"translate(substr({seq}, 1, greatest(length({seq}) - 5, 0) // 2), 'ACGT', '(((.')"
    fold = f"{half} || repeat('.', length({seq}) - 2 * length({half})) || reverse(replace({half}, '(', ')'))"
    pairs = f"length({half}) - length(replace({half}, '(', ''))"
    return fold, f"(-({pairs}) - 0.25 * (length({seq}) - length(translate({seq}, 'GC', ''))))::DOUBLE"


view("scanned", ["phased", "core", "whole"], f"""
SELECT *, {fold_sql("scan_seq")[0]} AS scan_fold, {fold_sql("scan_seq")[1]} AS mfe
FROM (SELECT p.*, c.peak_strand AS scan_strand,
    CASE WHEN c.peak_strand = 'C' THEN {_complement('substr(g, greatest(p.pos, 1), p.pos + 160 - greatest(p.pos, 1))')}
         ELSE upper(substr(g, greatest(p.pos, 1), p.pos + 160 - greatest(p.pos, 1))) END AS scan_seq
  FROM phased p JOIN core c USING (library, chr, tile, pos) JOIN whole USING (chr))
WHERE length(scan_seq) > 0""")


@query("segments_once", SEG_COLS, ["segs"], """
SELECT * FROM segs QUALIFY row_number() OVER (PARTITION BY library, chr, eff_pos ORDER BY
  CASE WHEN (eff_pos >= tile + 125 OR tile = 0) AND eff_pos < tile + 5125 THEN 0 ELSE 1 END, tile) = 1""")
def _(t: Tables) -> DataFrame:
    return segments.once_per_place(_segs(t))


@query("scan_window_energy", f"{K}, pos long, scan_strand string, scan_seq string, scan_fold string, mfe double", ["scanned"],
       "SELECT * FROM scanned")
def _(t: Tables) -> DataFrame:
    windows = stored(phasing.phased_windows(t.reads(), scan_strand=True), "windows")
    return energies.scan_energies(windows, t.genome_tiles(), TILE, hairpin_fold)


@query("segment_energies", f"{SEG_COLS}, max_mfe double, min_mfe double, pval_fdr double, pval_accept boolean", ["bh", "scanned"], """
SELECT * FROM bh JOIN (SELECT library, chr, tile, eff_pos, max(mfe) AS max_mfe, min(mfe) AS min_mfe
  FROM scanned GROUP BY ALL) e USING (library, chr, tile, eff_pos)""")
def _(t: Tables) -> DataFrame:
    return features.phased_segments(t.reads(), tiles=t.genome_tiles(), tile_size=TILE, fold=hairpin_fold)


@query("precursor_energies", f"{K}, eff_pos long, prefold string, premfe double, premfe_200_500 double, premfe_500_200 double", ["segseq"],
       f"""SELECT *, {fold_sql("precursor")[0]} AS prefold, {fold_sql("precursor")[1]} AS premfe,
  {fold_sql("precursor_200_500")[1]} AS premfe_200_500, {fold_sql("precursor_500_200")[1]} AS premfe_500_200 FROM segseq""")
def _(t: Tables) -> DataFrame:
    placed = features.with_sequences(_stored_segs(t), t.genome_tiles(), TILE)
    return energies.with_folds(placed, energies.PRECURSOR_FOLDS, hairpin_fold)


@query("consistent_label", f"{K}, eff_pos long, eff_seq string, consistent boolean", ["segseq"], """
SELECT *, count(DISTINCT library) OVER (PARTITION BY eff_seq) >= 2 AS consistent FROM segseq""")
def _(t: Tables) -> DataFrame:
    return segments.consistent_label(features.with_sequences(_stored_segs(t), t.genome_tiles(), TILE))


view("bh", ["segs"], """
SELECT *, least(1.0, min(raw) OVER (PARTITION BY library ORDER BY pval DESC)) AS pval_fdr,
  coalesce(pval <= max(CASE WHEN pval <= 0.05::DOUBLE * rnk / m THEN pval END) OVER (PARTITION BY library), false) AS pval_accept
FROM (SELECT *, pval * m / rnk AS raw FROM (SELECT *, count(*) OVER (PARTITION BY library) AS m,
        count(*) OVER (PARTITION BY library ORDER BY pval) AS rnk FROM segs))""")
view("bh2", ["bh"], """
SELECT * EXCLUDE (raw, m, rnk), least(1.0, min(raw2) OVER (PARTITION BY library ORDER BY pval_b DESC)) AS pvalb_fdr,
  coalesce(pval_b <= max(CASE WHEN pval_b <= 0.05::DOUBLE * rnk2 / m2 THEN pval_b END) OVER (PARTITION BY library), false) AS pvalb_accept
FROM (SELECT *, pval_b * m2 / rnk2 AS raw2 FROM (SELECT *, count(*) OVER (PARTITION BY library) AS m2,
        count(*) OVER (PARTITION BY library ORDER BY pval_b) AS rnk2 FROM bh))""")


@query("fdr_bh", f"{K}, eff_pos long, pval_fdr double, pval_accept boolean, pvalb_fdr double, pvalb_accept boolean",
       ["bh2"], "SELECT * FROM bh2")
def _(t: Tables) -> DataFrame:
    out = significance.benjamini_hochberg(_stored_segs(t), ["library"], "pval", "pval_fdr", "pval_accept")
    return significance.benjamini_hochberg(out, ["library"], "pval_b", "pvalb_fdr", "pvalb_accept")


SCORES = significance.UPPER + significance.LOWER


@query("gamma_moments", "library string, feature string, shape double, scale double", ["segs"], """
SELECT library, feature, avg(v) * avg(v) / var_pop(v) AS shape, var_pop(v) / avg(v) AS scale
FROM (UNPIVOT (SELECT library, Howell, Howellb, Guo, Guo_b, pval, pval_b FROM segs)
      ON Howell, Howellb, Guo, Guo_b, pval, pval_b INTO NAME feature VALUE v) GROUP BY library, feature""")
def _(t: Tables) -> DataFrame:
    return significance.gamma_moments(_segs(t), ["library"], SCORES)


def _digamma(a: str) -> str:
    z = f"({a} + 8)"
    shifts = " ".join(f"- 1 / ({a} + {i})" for i in range(8))
    return f"(ln({z}) - 0.5::DOUBLE / {z} - 1 / (12 * {z}^2) + 1 / (120 * {z}^4) - 1 / (252 * {z}^6) + 1 / (240 * {z}^8) {shifts})"


def _trigamma(a: str) -> str:
    z = f"({a} + 8)"
    shifts = " ".join(f"+ 1 / (({a} + {i}) ^ 2)" for i in range(8))
    return f"(1 / {z} + 1 / (2 * {z}^2) + 1 / (6 * {z}^3) - 1 / (30 * {z}^5) + 1 / (42 * {z}^7) - 1 / (30 * {z}^9) {shifts})"


view("gfit", ["segs"], f"""
SELECT library, feature, shape, pmean / shape AS scale FROM (
  SELECT library, feature, pmean, list_reduce([(3 - s + sqrt((s - 3) ^ 2 + 24 * s)) / (12 * s), s, s, s, s, s, s],
    lambda a, b: CASE WHEN a - (ln(a) - {_digamma('a')} - b) / (1 / a - {_trigamma('a')}) > 0
                      THEN a - (ln(a) - {_digamma('a')} - b) / (1 / a - {_trigamma('a')}) ELSE a / 2 END) AS shape
  FROM (SELECT library, feature, avg(v) FILTER (v > 0) AS pmean,
          avg(CASE WHEN v > 0 THEN v / pm - 1 - ln(v / pm) END) AS s
        FROM (SELECT *, avg(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY library, feature) AS pm
              FROM (UNPIVOT (SELECT library, Howell, Howellb, Guo, Guo_b, pval, pval_b FROM segs)
                    ON Howell, Howellb, Guo, Guo_b, pval, pval_b INTO NAME feature VALUE v)) GROUP BY library, feature))""")


def _cdf(c: str) -> str:
    a, z = f"a_{c}", f"({c} / b_{c})"
    return f"""CASE WHEN {c} <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum(list_transform(
  range(0, CAST(ceil(greatest(0, {z} - {a}) + 12 * sqrt({a} + {z}) + 200) AS BIGINT)),
  lambda i: exp(({a} + i) * ln({z}) - {z} - lgamma({a} + i + 1))))) END"""


view("tails", ["bh2", "gfit"], f"""
SELECT s.*, {', '.join(f'1 - {_cdf(c)} AS {c}_ccdf' for c in significance.UPPER)},
  {', '.join(f'{_cdf(c)} AS {c}_cdf' for c in significance.LOWER)}
FROM bh2 s JOIN (SELECT library, {', '.join(f"max(shape) FILTER (feature = '{c}') AS a_{c}, max(scale) FILTER (feature = '{c}') AS b_{c}" for c in SCORES)}
  FROM gfit GROUP BY library) g USING (library)""")
TAILS = [f"{c}_ccdf" for c in significance.UPPER] + [f"{c}_cdf" for c in significance.LOWER]
VOTE_SQL = " + ".join(f"coalesce((round({c}, 9) < 0.05)::INT, 0)" for c in TAILS)


@query("gamma_tail", f"{K}, eff_pos long, " + ", ".join(f"{c} double" for c in TAILS), ["tails"], "SELECT * FROM tails")
def _(t: Tables) -> DataFrame:
    return significance.gamma_tails(_stored_segs(t), ["library"])


@query("retained_vote", f"{K}, eff_pos long, vote int", ["tails"], f"SELECT *, {VOTE_SQL} AS vote FROM tails")
def _(t: Tables) -> DataFrame:
    return significance.vote(significance.gamma_tails(_stored_segs(t), ["library"]), TAILS)


@query("phased_segments", SEG_COLS + ", pval_fdr double, pval_accept boolean, pvalb_fdr double, pvalb_accept boolean, "
       + ", ".join(f"{c} double" for c in TAILS) + ", vote int", ["tails"], f"SELECT *, {VOTE_SQL} AS vote FROM tails")
def _(t: Tables) -> DataFrame:
    return features.phased_segments(t.reads())


@query("summary_statistics", "feature string, count long, mean double, std double, min double, q25 double, q50 double, "
       "q75 double, max double", ["segs"], f"""
SELECT feature, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS q25,
  quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS max
FROM (UNPIVOT (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in MAXIMA + ['L_bound', 'pval', 'pval_b', 'eff_pos'])} FROM segs WHERE k > 2)
      ON {', '.join(MAXIMA + ['L_bound', 'pval', 'pval_b', 'eff_pos'])} INTO NAME feature VALUE v) GROUP BY feature""")
def _(t: Tables) -> DataFrame:
    kept = _stored_segs(t).filter(F.col("k") > 2)
    return evaluation.describe(kept, MAXIMA + ["L_bound", "pval", "pval_b", "eff_pos"])


view("hits", ["segs", "reads"], """
SELECT s.library, s.chr, s.tile, s.eff_pos, r.pos, r.len, r.flag, r.n_reads
FROM segs s JOIN (SELECT library, chr, pos, len, flag, count(*) AS n_reads FROM reads GROUP BY ALL) r
  ON r.library = s.library AND r.chr = s.chr AND r.pos <= s.R_bound AND r.pos + r.len - 1 >= s.L_bound""")


@query("interval_overlap_join", f"{K}, eff_pos long, n_reads long, n_places long, n_bases long, n_reverse long", ["hits"], """
SELECT library, chr, tile, eff_pos, sum(n_reads) AS n_reads, count(*) AS n_places, sum(n_reads * len) AS n_bases,
  coalesce(sum(n_reads) FILTER (flag = 16), 0) AS n_reverse FROM hits GROUP BY library, chr, tile, eff_pos""")
def _(t: Tables) -> DataFrame:
    spans = _segs(t).select(*SK, "L_bound", "R_bound")
    pairs = overlap.overlap_join(spans, overlap.read_counts(t.reads()))
    return pairs.groupBy(*SK).agg(
        F.sum("n_reads").alias("n_reads"),
        F.count(F.lit(1)).alias("n_places"),
        F.sum(F.col("n_reads") * F.col("len")).alias("n_bases"),
        F.coalesce(F.sum(F.when(F.col("flag") == 16, F.col("n_reads"))), F.lit(0)).alias("n_reverse"),
    )


view("segreads", ["segs", "alignments"], """
SELECT s.library, s.chr, s.tile, s.eff_pos, r.seq,
  CASE WHEN r.flag = 16 THEN reverse(translate(upper(r.seq), 'ACGT', 'TGCA')) ELSE r.seq END AS own
FROM segs s JOIN alignments r ON r.library = s.library AND r.chr = s.chr AND r.pos <= s.R_bound
  AND r.pos + r.len - 1 >= s.L_bound WHERE r.len = 21""")
SKS = ", ".join(SK)
view("comp", ["segs", "segreads"], f"""
SELECT {SKS}, coalesce(na, 0) AS na, coalesce(nc, 0) AS nc, coalesce(ng, 0) AS ng, coalesce(nt, 0) AS nt,
  coalesce(na + nc + ng + nt, 0) AS tot FROM segs LEFT JOIN (
SELECT {SKS}, {', '.join(f"CAST(sum(length(seq) - length(replace(seq, '{b}', ''))) AS BIGINT) AS n{b.lower()}" for b in 'ACGT')}
FROM segreads GROUP BY ALL) USING ({SKS})""")


@query("base_composition", f"{K}, eff_pos long, total_frq_DicerCall long, A% double, C% double, G% double, T% double, GC% double",
       ["comp"], f"""
SELECT {SKS}, tot AS "total_frq_DicerCall", {', '.join(f'{pct(f"(100 * n{b.lower()})", "tot")} AS "{b}%"' for b in 'ACGT')},
  round("G%" + "C%", 2) AS "GC%" FROM comp""")
def _(t: Tables) -> DataFrame:
    return overlap.base_composition(_segs(t), t.alignments(), SK)


@query("base_composition_counted", f"{K}, eff_pos long, total_frq_DicerCall long, A% double, C% double, G% double, T% double, GC% double",
       ["comp"], f"""
SELECT {SKS}, tot AS "total_frq_DicerCall", {', '.join(f'{pct(f"(100 * n{b.lower()})", "tot")} AS "{b}%"' for b in 'ACGT')},
  round("G%" + "C%", 2) AS "GC%" FROM comp""")
def _(t: Tables) -> DataFrame:
    reads = t.alignments()
    counted = reads.groupBy(*reads.columns).agg(F.count(F.lit(1)).alias("times"))
    return overlap.base_composition(_segs(t), counted, SK, weight="times")


def _slot(at: int) -> str:
    return f"substr(own, {at + 1}, 1)" if at >= 0 else f"substr(own, length(own) + {at + 1}, 1)"


SLOT_COLS = [f"{s}{b}" for s in overlap.SLOTS for b in overlap.BASES]
view("slotcounts", ["segs", "segreads"], f"""
SELECT {SKS}, {', '.join(f'coalesce("{c}", 0) AS "n{c}"' for c in SLOT_COLS)}, coalesce(tot, 0) AS tot
FROM segs LEFT JOIN (SELECT {SKS}, count(*) AS tot,
  {', '.join(f"count(*) FILTER ({_slot(at)} = '{b}') AS " + '"' + s + b + '"' for s, at in overlap.SLOTS.items() for b in overlap.BASES)}
FROM segreads GROUP BY ALL) USING ({SKS})""")


@query("positional_base_matrix", f"{K}, eff_pos long, " + ", ".join(f"{c} double" for c in SLOT_COLS), ["slotcounts"],
       f"""SELECT {SKS}, {', '.join(pct('(100 * "n' + c + '")', "tot") + ' AS "' + c + '"' for c in SLOT_COLS)} FROM slotcounts""")
def _(t: Tables) -> DataFrame:
    return overlap.positional_bases(_segs(t), t.alignments(), SK)


view("contigs", ["contig_reads"], """
SELECT chr || '__' || tile || '_' || (tile + 5250) AS CONTIG, library, count(*) AS n FROM contig_reads GROUP BY ALL""")


def _contigs(t: Tables) -> DataFrame:
    name = tiling.contig_name(F.col("chr"), F.col("tile")).alias("CONTIG")
    return tiling.assign_contigs(t.reads()).groupBy(name, "library").agg(F.count(F.lit(1)).alias("n"))


@query("annotate_reference", "CONTIG string, library string, n long, locus string, Literature boolean",
       ["contigs", "ref_loci"], """
SELECT c.*, r.locus, r.CONTIG_literature_seen IS NOT NULL AS Literature
FROM contigs c LEFT JOIN ref_loci r ON r.CONTIG_literature_seen = c.CONTIG""")
def _(t: Tables) -> DataFrame:
    return segments.annotate_reference(_contigs(t), t.ref_loci())


@query("derive_labels", "CONTIG string, library string, anyhitBool boolean, twohitBool boolean, retained boolean",
       ["contigs", "ref_loci"], """
SELECT c.CONTIG, c.library, c.n % 3 <> 0 AS "anyhitBool", c.n % 2 = 0 AS "twohitBool",
  c.n % 5 >= 2 AND r.CONTIG_literature_seen IS NOT NULL AS retained
FROM contigs c LEFT JOIN ref_loci r ON r.CONTIG_literature_seen = c.CONTIG""")
def _(t: Tables) -> DataFrame:
    marked = segments.annotate_reference(_contigs(t), t.ref_loci()).withColumns(
        {
            "anyhit": F.when(F.col("n") % 3 != 0, "q").otherwise("na"),
            "twohit": F.when(F.col("n") % 2 == 0, "q").otherwise("na"),
            "vote": F.col("n") % 5,
        }
    )
    return tables.derive_labels(marked)


@query("drop_non_features", f"{K}, eff_pos long, k long, n long, n_all long, eff_frq long, ext_k long, length long, "
       "pval double, pval_b double", ["segs"], "SELECT * FROM segs")
def _(t: Tables) -> DataFrame:
    kept = tables.drop_non_features(_segs(t).withColumnRenamed("chr", "chrom"))
    return kept.withColumnRenamed("chrom", "chr")


@query("sort_by_contig", "CONTIG string, library string, n long", ["contigs"],
       "SELECT * FROM contigs ORDER BY CONTIG, library")
def _(t: Tables) -> DataFrame:
    return _contigs(t).orderBy("CONTIG", "library")
