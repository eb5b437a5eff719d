"""Reads, contigs, positions, windows and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import tiling, windows
from ..params import CONTIG_KEYS
from ..plans import phasing
from .fixtures import Tables
from .registry import query, view

K = "library string, chr string, tile long"

view("contig_reads", ["reads"], """
SELECT *, unnest(CASE WHEN pos % 5000 <= 250 AND pos >= 5000 THEN [pos // 5000 * 5000, pos // 5000 * 5000 - 5000]
                      ELSE [pos // 5000 * 5000] END) AS tile FROM reads""")
view("pos_freq", ["contig_reads"], """
SELECT library, chr, tile, CASE flag WHEN 0 THEN pos WHEN 16 THEN pos + 2 END AS pos,
  count(*) FILTER (flag = 0 AND len = 21) AS w, count(*) FILTER (flag = 16 AND len = 21) AS c,
  count(*) FILTER (flag = 0) AS w_all, count(*) FILTER (flag = 16) AS c_all, count(*) AS n_reads
FROM contig_reads GROUP BY ALL""")
view("px", ["pos_freq"], "SELECT *, w + c AS f FROM pos_freq WHERE w + c > 0")
view("slots", ["px"], """
SELECT p.library, p.chr, p.tile, p.pos, q.pos AS q, q.f AS q_freq
FROM (SELECT library, chr, tile, pos, pos + 21 * unnest(range(0, 9)) AS slot FROM px) p
JOIN px q ON q.library = p.library AND q.chr = p.chr AND q.tile = p.tile AND q.pos = p.slot""")
view("near", ["px"], """
SELECT library, chr, tile, pos, f, drift,
  CASE WHEN qw > qc THEN 'W' WHEN qw = qc THEN 'B' ELSE 'C' END AS eff_strand,
  CASE WHEN qw >= qc THEN pw ELSE pc - 2 END AS eff_pos, greatest(qw, qc) AS eff_frq
FROM (SELECT p.library, p.chr, p.tile, p.pos, any_value(p.f) AS f, sum(q.f) - any_value(p.f) AS drift,
        max(q.w) AS qw, max(q.c) AS qc,
        coalesce(arg_max(q.pos, q.w * 1000000 - q.pos) FILTER (q.w > 0), 0) AS pw,
        arg_max(q.pos, q.c * 1000000 - q.pos) FILTER (q.c > 0) AS pc
      FROM px p JOIN px q ON q.library = p.library AND q.chr = p.chr AND q.tile = p.tile
        AND q.pos BETWEEN p.pos - 2 AND p.pos + 2
      GROUP BY p.library, p.chr, p.tile, p.pos)""")
view("core", ["slots", "near"], """
SELECT s.library, s.chr, s.tile, s.pos, s.k, s.slot_sum + n.drift AS p, n.f + n.drift AS maxf, s.peak AS pos_of_maxf,
  n.eff_strand AS peak_strand, n.eff_pos AS peak_eff_pos, n.eff_frq AS peak_eff_frq
FROM (SELECT library, chr, tile, pos, count(*) AS k, sum(q_freq) AS slot_sum,
        arg_max(q, q_freq * 1000000 - q) AS peak
      FROM slots GROUP BY library, chr, tile, pos) s
JOIN near n ON n.library = s.library AND n.chr = s.chr AND n.tile = s.tile AND n.pos = s.peak""")
view("totals", ["px", "pos_freq"], """
SELECT p.library, p.chr, p.tile, p.pos, any_value(p.w) AS frqw, any_value(p.c) AS frqc,
  sum((q.w > 0)::INT + (q.c > 0)::INT) AS n, sum((q.w_all > 0)::INT + (q.c_all > 0)::INT) AS n_all,
  sum(q.w + q.c) AS u, sum(q.w_all) AS Wfreq, sum(q.c_all) AS Cfreq, sum(q.w_all + q.c_all) AS u_all
FROM px p JOIN pos_freq q ON q.library = p.library AND q.chr = p.chr AND q.tile = p.tile
  AND q.pos BETWEEN p.pos AND p.pos + 168
GROUP BY p.library, p.chr, p.tile, p.pos""")
view("potential", ["core"], "SELECT * FROM core WHERE k >= 3 AND maxf >= 4")
view("pairs", ["potential", "px"], """
SELECT p.library, p.chr, p.tile, p.pos, q.pos AS q, q.f, CAST(floor((q.pos - p.pos) / 189.0) AS BIGINT) AS b
FROM potential p JOIN px q ON q.library = p.library AND q.chr = p.chr AND q.tile = p.tile
  AND (q.pos - p.pos) % 21 = 0""")
view("members", ["pairs"], """
SELECT pairs.* FROM pairs JOIN (
  SELECT library, chr, tile, pos, b FROM (
    SELECT library, chr, tile, pos, b,
      row_number() OVER (PARTITION BY library, chr, tile, pos, sign(b) ORDER BY abs(b)) AS nth
    FROM (SELECT library, chr, tile, pos, b FROM pairs GROUP BY ALL HAVING count(*) > 1))
  WHERE b = 0 OR abs(b) = nth) ok USING (library, chr, tile, pos, b)""")
view("extended", ["members", "near"], """
SELECT e.library, e.chr, e.tile, e.pos, e.ext_k, e.L_bound, e.R_bound, e.R_bound - e.L_bound + 1 AS length,
  e.peak AS pos_of_maxf, n.eff_strand, n.eff_pos, n.eff_frq
FROM (SELECT library, chr, tile, pos, count(*) AS ext_k, greatest(min(q) - 21, 0) AS L_bound, max(q) + 21 AS R_bound,
        first(q ORDER BY f DESC, CASE WHEN b = 0 THEN 0 WHEN b > 0 THEN 1 ELSE 2 END, abs(b), q) AS peak
      FROM members GROUP BY library, chr, tile, pos) e
JOIN near n ON n.library = e.library AND n.chr = e.chr AND n.tile = e.tile AND n.pos = e.peak""")
CHEN = """CASE WHEN {k} < 3 THEN 1.0 WHEN {n} > 357 THEN NULL ELSE round(coalesce(list_sum(list_transform(
  range({k}, least(17, {n}) + 1), lambda i: exp(
  lgamma(341) - lgamma({n} - i + 1) - lgamma(341 - {n} + i)
  + lgamma(18) - lgamma(i + 1) - lgamma(18 - i)
  - lgamma(358) + lgamma({n} + 1) + lgamma(358 - {n})))), 0.0), 6) END"""
# C(340, n-i) is 0 beyond 340
CHEN = CHEN.replace("range({k},", "range(greatest({k}, {n} - 340),")
view("scored", ["potential", "totals"], f"""
SELECT c.*, t.frqw, t.frqc, t.n, t.n_all, t.u, t.u_all, t.Wfreq, t.Cfreq,
  CASE WHEN k < 3 THEN 0 ELSE round((k - 2) * ln(1 + 10 * (c.p::DOUBLE / (1 + u))), 2) END AS Howell,
  CASE WHEN k < 3 THEN 0 ELSE round((k - 2) * ln((1 + c.p)::DOUBLE), 2) END AS Howellb,
  CASE WHEN k < 3 THEN 0 ELSE round(maxf::DOUBLE / u * k * ln(c.p::DOUBLE), 2) END AS Guo,
  CASE WHEN k < 3 THEN 0 ELSE round(maxf::DOUBLE / u_all * k * ln(c.p::DOUBLE), 2) END AS Guo_b,
  {CHEN.format(k="CAST(k AS BIGINT)", n="CAST(n AS BIGINT)")} AS pval,
  {CHEN.format(k="CAST(k AS BIGINT)", n="CAST(n_all AS BIGINT)")} AS pval_b,
  round((Wfreq + 0.00001::DOUBLE) / (u_all + 0.00001::DOUBLE), 2) AS ratio
FROM potential c JOIN totals t USING (library, chr, tile, pos)""")
view("phased", ["scored", "extended", "contig_reads"], """
SELECT s.library, s.chr, s.tile, s.pos, s.frqw + s.frqc AS freq, s.frqw, s.frqc, s.k, s.n, s.n_all, s.p, s.u, s.u_all,
  s.maxf, e.pos_of_maxf, e.eff_strand, e.eff_pos, e.eff_frq, s.pos + 84 AS mid_cyc, e.ext_k, e.L_bound, e.R_bound,
  e.length, s.Howell, s.Howellb, s.Guo, s.Guo_b, s.pval, s.pval_b, s.Wfreq, s.Cfreq, s.ratio,
  CASE WHEN s.ratio > 0.8 THEN 'Watson' WHEN s.ratio < 0.2 THEN 'Crick' ELSE 'both' END AS dominant_strand,
  r.contig_frq
FROM scored s JOIN extended e USING (library, chr, tile, pos)
JOIN (SELECT library, chr, tile, count(*) AS contig_frq FROM contig_reads GROUP BY ALL) r USING (library, chr, tile)
QUALIFY count(*) OVER (PARTITION BY s.library, s.chr, s.tile) >= 10""")

WINDOW_COLS = f"""{K}, pos long, freq long, frqw long, frqc long, k long, n long, n_all long, p long, u long,
u_all long, maxf long, pos_of_maxf long, eff_strand string, eff_pos long, eff_frq long, mid_cyc long, ext_k long,
L_bound long, R_bound long, length long, Howell double, Howellb double, Guo double, Guo_b double, pval double,
pval_b double, Wfreq long, Cfreq long, ratio double, dominant_strand string, contig_frq long""".replace("\n", " ")


def _freq(t: Tables) -> DataFrame:
    return windows.position_frequency(tiling.assign_contigs(t.reads())).filter(F.col("pos").isNotNull())


def _found(t: Tables) -> DataFrame:
    return phasing.window_candidates(t.reads())


@query("assign_contigs", "contig string, library string, pos long, n long", ["contig_reads"], """
SELECT chr || '__' || tile || '_' || (tile + 5250) AS contig, library, pos, count(*) AS n
FROM contig_reads GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    tiled = tiling.assign_contigs(t.reads())
    return tiled.groupBy(tiling.contig_name(F.col("chr"), F.col("tile")).alias("contig"), "library", "pos").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("strand_shift", "library string, chr string, strand string, pos long, n long", ["reads"], """
SELECT library, chr, CASE flag WHEN 0 THEN 'W' WHEN 16 THEN 'C' END AS strand,
  CASE flag WHEN 0 THEN pos WHEN 16 THEN pos + 2 END AS pos, count(*) AS n FROM reads GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    place = tiling.shifted_position(F.col("flag"), F.col("pos"))
    return t.reads().groupBy("library", "chr", tiling.strand(F.col("flag")).alias("strand"), place.alias("pos")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("length_filter", "library string, chr string, pos long, n_exact long, n_any long", ["reads"], """
SELECT library, chr, pos, count(*) FILTER (len = 21) AS n_exact, count(*) AS n_any FROM reads GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return t.reads().groupBy("library", "chr", "pos").agg(
        F.count_if(F.col("len") == 21).alias("n_exact"), F.count(F.lit(1)).alias("n_any")
    )


@query("filter_single_contig", f"{K}, pos long, n long", ["contig_reads"], """
SELECT library, chr, tile, pos, count(*) AS n FROM contig_reads WHERE chr = 'chr1' AND tile = 0 GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    one = tiling.keep_contig(t.reads(), "chr1", 0)
    return one.groupBy(*CONTIG_KEYS, "pos").agg(F.count(F.lit(1)).alias("n"))


@query("sample_contigs", f"{K}, n long", ["contig_reads"], """
SELECT library, chr, tile, count(*) AS n FROM contig_reads
WHERE (CAST(regexp_extract(chr, '([0-9]+)$', 1) AS BIGINT) * 7919 + tile // 5000 * 104729 + 12345)
  % 2147483647 * 48271 % 2147483647 * 69621 % 2147483647 / 2147483647.0::DOUBLE < 0.5
GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    kept = tiling.sample_contigs(tiling.assign_contigs(t.reads()), 0.5)
    return kept.groupBy(*CONTIG_KEYS).agg(F.count(F.lit(1)).alias("n"))


@query("position_frequency", f"{K}, pos long, w long, c long, w_all long, c_all long", ["pos_freq"],
       "SELECT * FROM pos_freq WHERE pos IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return _freq(t)


@query("phase_window_join", f"{K}, pos long, q long, q_freq long", ["slots"], "SELECT * FROM slots")
def _(t: Tables) -> DataFrame:
    return windows.phase_window_join(_freq(t))


@query("full_window_join", f"{K}, pos long, u long, Wfreq long, Cfreq long, u_all long", ["totals"],
       "SELECT * FROM totals")
def _(t: Tables) -> DataFrame:
    return windows.window_totals(_freq(t)).filter(F.col("w") + F.col("c") > 0)


@query("drift_join", f"{K}, pos long, drift long", ["near"], "SELECT * FROM near")
def _(t: Tables) -> DataFrame:
    return windows.effector_coordinate(_freq(t)).filter(F.col("f") > 0)


@query("effector_coordinate", f"{K}, pos long, eff_strand string, eff_pos long, eff_frq long", ["near"],
       "SELECT * FROM near")
def _(t: Tables) -> DataFrame:
    return windows.effector_coordinate(_freq(t)).filter(F.col("f") > 0)


@query("phase_p_k_maxf", f"{K}, pos long, p long, k long, maxf long, pos_of_maxf long, peak_strand string, "
       "peak_eff_pos long, peak_eff_frq long", ["core"], "SELECT * FROM core")
def _(t: Tables) -> DataFrame:
    return windows.phase_slots(windows.effector_coordinate(_freq(t)))


@query("window_n_N_u_U", f"{K}, pos long, n long, n_all long, u long, u_all long", ["totals"], "SELECT * FROM totals")
def _(t: Tables) -> DataFrame:
    return windows.window_totals(_freq(t)).filter(F.col("w") + F.col("c") > 0)


@query("strand_dominance", f"{K}, pos long, ratio double, dominant_strand string", ["totals"], """
SELECT library, chr, tile, pos, ratio,
  CASE WHEN ratio > 0.8 THEN 'Watson' WHEN ratio < 0.2 THEN 'Crick' ELSE 'both' END AS dominant_strand
FROM (SELECT *, round((Wfreq + 0.00001::DOUBLE) / (u_all + 0.00001::DOUBLE), 2) AS ratio FROM totals)""")
def _(t: Tables) -> DataFrame:
    totals = windows.window_totals(_freq(t)).filter(F.col("w") + F.col("c") > 0)
    return windows.strand_dominance(totals)


@query("filter_low_potential", f"{K}, pos long, k long, maxf long", ["potential"], "SELECT * FROM potential")
def _(t: Tables) -> DataFrame:
    return windows.phase_slots(windows.effector_coordinate(_freq(t))).filter(windows.high_potential())


@query("having_min_windows", f"{K}, pos long, k long", ["potential"], """
SELECT library, chr, tile, pos, k FROM potential
QUALIFY count(*) OVER (PARTITION BY library, chr, tile) >= 10""")
def _(t: Tables) -> DataFrame:
    keep = windows.high_potential()
    slots = windows.phase_slots(windows.effector_coordinate(_freq(t)))
    return windows.having_min_windows(slots, keep, 10).filter(keep)


def _extended(t: Tables) -> DataFrame:
    slots = windows.phase_slots(windows.effector_coordinate(_freq(t)))
    return windows.extend_blocks(slots, windows.high_potential(), ["pos", "k"])


@query("boundary_extension_join", f"{K}, pos long, ext_k long", ["extended"], "SELECT * FROM extended")
def _(t: Tables) -> DataFrame:
    return _extended(t)


@query("segment_boundaries", f"{K}, pos long, ext_k long, L_bound long, R_bound long, length long", ["extended"],
       "SELECT * FROM extended")
def _(t: Tables) -> DataFrame:
    return _extended(t)


@query("updated_effector", f"{K}, pos long, pos_of_maxf long, eff_strand string, eff_pos long, eff_frq long",
       ["extended"], "SELECT * FROM extended")
def _(t: Tables) -> DataFrame:
    return _extended(t)


@query("score_howell_xia", f"{K}, pos long, Howell double", ["scored"], "SELECT * FROM scored")
def _(t: Tables) -> DataFrame:
    kept = _found(t).filter(windows.high_potential())
    return kept.withColumn("Howell", scores.howell_xia(F.col("p"), F.col("u"), F.col("k")))


@query("score_howell_2007", f"{K}, pos long, Howellb double", ["scored"], "SELECT * FROM scored")
def _(t: Tables) -> DataFrame:
    kept = _found(t).filter(windows.high_potential())
    return kept.withColumn("Howellb", scores.howell_2007(F.col("p"), F.col("k")))


@query("score_chen_pvalue", f"{K}, pos long, pval double, pval_b double", ["scored"], "SELECT * FROM scored")
def _(t: Tables) -> DataFrame:
    kept = _found(t).filter(windows.high_potential())
    table = scores.chen_table(t.spark)
    return scores.with_chen(scores.with_chen(kept, table, "k", "n", "pval"), table, "k", "n_all", "pval_b")


@query("score_guo", f"{K}, pos long, Guo double, Guo_b double", ["scored"], "SELECT * FROM scored")
def _(t: Tables) -> DataFrame:
    kept = _found(t).filter(windows.high_potential())
    k, p, m = F.col("k"), F.col("p"), F.col("maxf")
    return kept.withColumns({"Guo": scores.guo(F.col("u"), k, p, m), "Guo_b": scores.guo(F.col("u_all"), k, p, m)})


@query("phased_windows", WINDOW_COLS, ["phased"], "SELECT * FROM phased")
def _(t: Tables) -> DataFrame:
    return phasing.phased_windows(t.reads())


@query("phased_windows_counted", WINDOW_COLS, ["phased"], "SELECT * FROM phased")
def _(t: Tables) -> DataFrame:
    reads = t.reads()
    return phasing.phased_windows(reads.groupBy(*reads.columns).agg(F.count(F.lit(1)).alias("times")), weight="times")
