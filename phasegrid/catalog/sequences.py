"""Sequence, structure, hairpin and target queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence, structure
from ..operators import hairpin, segments, structures, targets
from ..plans import features
from ..session import stored
from .fixtures import TILE, Tables
from .registry import QUERIES, VIEWS, query, view
from .segments import VOTE_SQL, fold_sql, hairpin_fold, pct


def sql_revcomp(s: str) -> str:
    return f"reverse(translate(upper({s}), 'ACGT', 'TGCA'))"


@query("reverse_complement", "doc_id long, rc string", ["docseq"], f"SELECT doc_id, {sql_revcomp('s')} AS rc FROM docseq")
def _(t: Tables) -> DataFrame:
    return t.docseq().withColumn("rc", sequence.reverse_complement(F.col("s")))


@query("normalize_alphabet", "doc_id long, rna string, dna string", ["docseq"], """
SELECT doc_id, replace(replace(s, 'T', 'U'), 't', 'u') AS rna, replace(replace(s, 'U', 'T'), 'u', 't') AS dna FROM docseq""")
def _(t: Tables) -> DataFrame:
    return t.docseq().withColumns({"rna": sequence.dna_to_rna(F.col("s")), "dna": sequence.rna_to_dna(F.col("s"))})


def _kmer_sql() -> tuple[str, str]:
    cols, parts = [], []
    for size, tail in ((1, ""), (2, "di"), (3, "tri")):
        for i in range(5):
            parts.append(f'eff_seq[{i + 1}:{i + size}] AS "eff5p{i + 1}{tail}"')
            cols.append(f"eff5p{i + 1}{tail}")
        for i in range(5):
            parts.append(f'substr(eff_seq, length(eff_seq) - {i + size - 1}, {size}) AS "eff3p{i + 1}{tail}"')
            cols.append(f"eff3p{i + 1}{tail}")
        for i in range(5):
            parts.append(f'eff_seq[{i + 10}:{i + 9 + size}] AS "effmd{i + 1}{tail}"')
            cols.append(f"effmd{i + 1}{tail}")
    parts.append('eff_seq[1:1] || substr(eff_seq, length(eff_seq) - 2, 1) AS "eff5p1_3p3"')
    cols.append("eff5p1_3p3")
    return ", ".join(f"{c} string" for c in cols), ", ".join(parts)


KMER_COLS, KMER_SQL = _kmer_sql()


@query("effector_kmers", f"seq_id long, {KMER_COLS}", ["folds"], f"SELECT seq_id, {KMER_SQL} FROM folds")
def _(t: Tables) -> DataFrame:
    return structures.effector_kmer_table(t.folds())


view("site", ["folds"], """
SELECT *, substr(precursor, a + 1, b - a) AS site_seq, substr(fold, a + 1, b - a) AS site_fold
FROM (SELECT *, greatest(start - 4, 0) AS a, least(start + length(eff_seq) + 4, length(precursor)) AS b
      FROM (SELECT *, instr(precursor, eff_seq) - 1 AS start FROM folds))""")
view("bulges", ["site"], r"""
SELECT seq_id, start, site_seq, site_fold, length(site_fold) AS n,
  list_transform(regexp_extract_all(site_fold, '\(\.+\(|\)\.+\)|\)\.+\('), lambda x: length(x) - 2) AS bl,
  list_transform(regexp_extract_all(site_fold, '\(\.+\)'), lambda x: length(x) - 2) AS ll,
  list_transform(list_concat(regexp_extract_all(site_fold, '\(\.+\('),
    list_concat(regexp_extract_all(site_fold, '\)\.+\)'), regexp_extract_all(site_fold, '\)\.+\('))),
    lambda x: length(x) - 2) AS b3,
  list_transform(regexp_extract_all(site_fold, '[()]+'), lambda x: length(x)) AS pl,
  translate(site_fold, ')', '(') AS folded
FROM site""")


@query("structure_window", "seq_id long, start int, site_seq string, site_fold string", ["site"], "SELECT * FROM site")
def _(t: Tables) -> DataFrame:
    return structures.structure_window(t.folds())


def _site(t: Tables) -> DataFrame:
    return structures.structure_window(t.folds())


PAIRED = pct("(100 * (n - length(site_fold) + length(replace(site_fold, '.', ''))))", "n")


@query("paired_percentage", "seq_id long, paired_percentage double", ["bulges"],
       f"SELECT seq_id, {PAIRED} AS paired_percentage FROM bulges")
def _(t: Tables) -> DataFrame:
    return _site(t).withColumn("paired_percentage", structure.paired_percentage(F.col("site_fold")))


def _roll(w: int) -> str:
    total = (f"list_sum(list_transform(range(1, n - {w} + 2), lambda i: length(replace(substr(site_fold, i, {w}), '.', ''))))")
    return f"CASE WHEN n >= {w} THEN {pct(f'CAST({total} AS BIGINT)', f'(n - {w} + 1)')} END"


view("rolls", ["bulges"], f"SELECT *, {', '.join(f'{_roll(w)} AS paired_roll{w}' for w in (3, 5, 7))} FROM bulges")


@query("paired_rolling_average", "seq_id long, paired_roll3 double, paired_roll5 double, paired_roll7 double", ["rolls"],
       "SELECT * FROM rolls")
def _(t: Tables) -> DataFrame:
    return _site(t).withColumns(
        {f"paired_roll{w}": structure.paired_rolling_average(F.col("site_fold"), w) for w in (3, 5, 7)}
    )


@query("longest_bulge", "seq_id long, length_longest_bulge int", ["bulges"],
       "SELECT seq_id, coalesce(list_max(b3), 0) AS length_longest_bulge FROM bulges")
def _(t: Tables) -> DataFrame:
    return _site(t).withColumn("length_longest_bulge", structure.longest_bulge(F.col("site_fold")))


@query("longest_loop", "seq_id long, length_longest_loop int", ["bulges"],
       "SELECT seq_id, coalesce(list_max(ll), 0) AS length_longest_loop FROM bulges")
def _(t: Tables) -> DataFrame:
    return _site(t).withColumn("length_longest_loop", structure.longest_loop(F.col("site_fold")))


@query("longest_paired", "seq_id long, longest_paired_length int", ["bulges"],
       "SELECT seq_id, coalesce(list_max(pl), 0) AS longest_paired_length FROM bulges")
def _(t: Tables) -> DataFrame:
    return _site(t).withColumn("longest_paired_length", structure.longest_paired(F.col("site_fold")))


MOTIFS = structure.HOMOTRIPLETS


def _motif(s: str, m: str) -> str:
    run = f"regexp_extract_all({s}, '{m}{m[0]}*')"
    return f"CAST(coalesce(list_sum(list_transform({run}, lambda x: length(x) - 2)), 0) AS INT)"


@query("motif_count", "doc_id long, " + ", ".join(f"NBtriplet{m[0]} int" for m in MOTIFS), ["docseq"],
       f"SELECT doc_id, {', '.join(_motif('s', m) + f' AS NBtriplet{m[0]}' for m in MOTIFS)} FROM docseq")
def _(t: Tables) -> DataFrame:
    return t.docseq().withColumns({f"NBtriplet{m[0]}": sequence.motif_count(F.col("s"), m) for m in MOTIFS})


TRIPLETS = [m + s for m in MOTIFS for s in structure.TRIPLET_SHAPES]


def _located(c: str) -> str:
    return f"CASE WHEN start < 0 THEN -1 ELSE {c} END"


def _triplet(x: str) -> str:
    return (f"length(list_filter(range(1, n - 1), lambda i: substr(site_seq, i, 3) = '{x[:3]}'"
            f" AND substr(folded, i, 3) = '{x[3:]}'))")


def _centre(base: str, shapes: list[str]) -> str:
    listed = ", ".join(f"'{s}'" for s in shapes)
    return (f"length(list_filter(range(1, n - 1), lambda i: substr(site_seq, i + 1, 1) = '{base}'"
            f" AND substr(site_fold, i, 3) IN ({listed})))")


def _count(lst: str, k: int) -> str:
    return f"length(list_filter({lst}, lambda x: x = {k}))"


COUNTERS = {x: _triplet(x) for x in TRIPLETS}
COUNTERS.update({b + ".(.": _centre(b, structure.LONE_PAIR_SHAPES) for b in structure.BASES})
COUNTERS.update({b + "(.(": _centre(b, structure.LONE_BULGE_SHAPES) for b in structure.BASES})
COUNTERS.update({"occ_bulgeAllnt": "length(bl)", **{f"occ_bulge{k}nt": _count("bl", k) for k in range(1, 24)}})
COUNTERS.update({"occ_loopAllnt": "length(ll)", **{f"occ_loop{k}nt": _count("ll", k) for k in range(3, 24)}})


def _counter_query(name: str, columns: list[str]) -> None:
    sql = ", ".join(f'{COUNTERS[c]} AS "{c}"' for c in columns)

    @query(name, "seq_id long, " + ", ".join(f"{c} int" for c in columns), ["bulges"], f"SELECT seq_id, {sql} FROM bulges")
    def _(t: Tables) -> DataFrame:
        seq, fold = F.col("site_seq"), F.col("site_fold")
        made = {
            "triplet_structure_counts": lambda: structure.triplet_structure_counts(structure.triplet_tokens(seq, fold)),
            "lone_pair_counts": lambda: structure.lone_pair_counts(structure.centre_tokens(seq, fold)),
            "lone_bulge_counts": lambda: structure.lone_bulge_counts(structure.centre_tokens(seq, fold)),
            "bulge_histogram": lambda: structure.bulge_histogram(structure.bulge_tokens(fold)),
            "loop_histogram": lambda: structure.loop_histogram(structure.loop_tokens(fold)),
        }[name]()
        return _site(t).select("seq_id", *[c.alias(n) for n, c in made.items()])


_counter_query("triplet_structure_counts", TRIPLETS)
_counter_query("lone_pair_counts", [b + ".(." for b in structure.BASES])
_counter_query("lone_bulge_counts", [b + "(.(" for b in structure.BASES])
_counter_query("bulge_histogram", [c for c in COUNTERS if c.startswith("occ_bulge")])
_counter_query("loop_histogram", [c for c in COUNTERS if c.startswith("occ_loop")])

SUMMARY_COLS = ("paired_percentage double, paired_roll3 double, paired_roll5 double, paired_roll7 double, "
                "length_longest_bulge int, length_longest_loop int, longest_paired_length int, "
                + ", ".join(f"NBtriplet{m[0]} int" for m in MOTIFS))


@query("structure_feature_table", f"seq_id long, {SUMMARY_COLS}, " + ", ".join(f"{c} int" for c in COUNTERS), ["rolls"], f"""
SELECT *, {PAIRED} AS paired_percentage, coalesce(list_max(b3), 0) AS length_longest_bulge,
  coalesce(list_max(ll), 0) AS length_longest_loop, coalesce(list_max(pl), 0) AS longest_paired_length,
  {', '.join(_motif('site_seq', m) + f' AS NBtriplet{m[0]}' for m in MOTIFS)},
  {', '.join(f'{_located(sql)} AS "{c}"' for c, sql in COUNTERS.items())} FROM rolls""")
def _(t: Tables) -> DataFrame:
    return structures.structure_features(_site(t), ["seq_id"])


@query("effector_offsets", "seq_id long, dist_5p int, dist_3p int", ["folds"], """
SELECT seq_id, instr(precursor, eff_seq) - 1 AS dist_5p, length(precursor) - dist_5p - length(eff_seq) AS dist_3p FROM folds""")
def _(t: Tables) -> DataFrame:
    return t.folds().withColumns(segments.effector_offsets(F.col("precursor"), F.col("eff_seq")))


# pair table by depth: the partner of a bracket is the nearest later (earlier) bracket of its level
view("letters", ["folds"], """
SELECT seq_id, place, substr(fold, CAST(place + 1 AS INT), 1) AS ch
FROM (SELECT seq_id, fold, unnest(range(0, length(fold))) AS place FROM folds)""")
view("partners", ["letters"], """
SELECT seq_id, place, CASE WHEN ch = '(' THEN lead(place) OVER (PARTITION BY seq_id, lvl ORDER BY place)
                        ELSE lag(place) OVER (PARTITION BY seq_id, lvl ORDER BY place) END AS partner
FROM (SELECT *, sum(CASE ch WHEN '(' THEN 1 ELSE -1 END) OVER (PARTITION BY seq_id ORDER BY place ROWS UNBOUNDED PRECEDING)
        + CASE ch WHEN ')' THEN 1 ELSE 0 END AS lvl FROM letters WHERE ch <> '.')""")


@query("pair_table", "seq_id long, place int, partner int", ["partners"], "SELECT * FROM partners")
def _(t: Tables) -> DataFrame:
    return structures.pair_table(structures.balanced(t.folds()), "seq_id")


# one arm = the letters beg..end of a fold; shift -1 is the site itself, 0..2 its extensions;
# a site that is not found begins at -1, the last letter
view("arms", ["site"], """
SELECT seq_id, shift, CASE WHEN shift < 0 THEN start ELSE start - shift END AS beg,
  CASE WHEN shift < 0 THEN start + length(eff_seq) ELSE start + length(eff_seq) + 2 - shift END AS fin,
  length(fold) AS n, length(fold) AS size_fold
FROM (SELECT *, unnest([-1, 0, 1, 2]) AS shift FROM site)""")
view("armpairs", ["arms", "partners"], """
SELECT a.seq_id, a.shift, a.beg, a.fin, a.n, a.i, CASE WHEN a.i >= a.n THEN 0 ELSE p.partner END AS partner
FROM (SELECT *, unnest(range(beg, fin + 1)) AS i FROM arms WHERE shift < 0 OR (beg >= 0 AND fin < n)) a
LEFT JOIN partners p ON p.seq_id = a.seq_id AND p.place = CASE WHEN a.i < 0 THEN a.n + a.i ELSE a.i END""")
view("armstats", ["armpairs"], """
SELECT s.*, coalesce(g.gap, 0) AS gap, coalesce(x.asym, 0) AS asym
FROM (SELECT seq_id, shift, any_value(beg) AS beg, any_value(fin) AS fin, any_value(n) AS n,
    count(*) FILTER (partner IS NULL) AS unpaired, count(*) FILTER (partner > i) AS to_right,
    count(*) FILTER (partner < i) AS to_left,
    least(coalesce(first(partner + i - beg ORDER BY i) FILTER (partner IS NOT NULL AND partner + i - beg <> 0),
                   any_value(fin) - any_value(beg) + 1), any_value(n) - 1) AS star_start,
    greatest(coalesce(first(partner - (fin - i) ORDER BY i DESC) FILTER (partner IS NOT NULL AND partner - (fin - i) <> 0), 0), 0) AS star_stop
  FROM armpairs GROUP BY seq_id, shift) s
LEFT JOIN (SELECT seq_id, shift, max(len) AS gap FROM (SELECT seq_id, shift, count(*) AS len FROM (
    SELECT seq_id, shift, i - row_number() OVER (PARTITION BY seq_id, shift ORDER BY i) AS run
    FROM armpairs WHERE partner IS NULL) GROUP BY seq_id, shift, run) GROUP BY seq_id, shift) g USING (seq_id, shift)
LEFT JOIN (SELECT seq_id, shift, sum(greatest((i - pi - 1) - (abs(partner - pp) - 1), 0)) FILTER (i - pi > 1 AND pp <> 0) AS asym
  FROM (SELECT seq_id, shift, i, partner, lag(i) OVER w AS pi, lag(partner) OVER w AS pp
        FROM armpairs WHERE partner IS NOT NULL WINDOW w AS (PARTITION BY seq_id, shift ORDER BY i))
  GROUP BY seq_id, shift) x USING (seq_id, shift)""")


def _paired_sites(t: Tables) -> DataFrame:
    return structures.with_pairs(_site(t), "seq_id")


@query("arm_statistics", "seq_id long, unpaired int, to_right int, to_left int, longest_gap int, asymmetry int, "
       "star_stop int, star_start int", ["armstats"],
       "SELECT *, gap AS longest_gap, asym AS asymmetry FROM armstats WHERE shift = -1")
def _(t: Tables) -> DataFrame:
    stop = F.col("start") + F.length("eff_seq")
    return hairpin.arm_statistics(_paired_sites(t), "seq_id", F.col("start"), stop)


@query("longest_runs", "seq_id long, longest_gap int", ["armstats"],
       "SELECT *, gap AS longest_gap FROM armstats WHERE shift = -1")
def _(t: Tables) -> DataFrame:
    stop = F.col("start") + F.length("eff_seq")
    return hairpin.arm_statistics(_paired_sites(t), "seq_id", F.col("start"), stop)


def _call(p: hairpin.Profile) -> str:
    return f"""CASE WHEN unpaired > {p.max_unpaired} THEN 'NONPAIRING' WHEN to_left > 0 AND to_right > 0 THEN 'MIXED_PAIRING'
  WHEN gap > {p.max_gap} THEN 'MIR_BULGE' WHEN to_left > 0 THEN '3prime' WHEN to_right > 0 THEN '5prime' ELSE '' END"""


def _hairpin_views(name: str, p: hairpin.Profile) -> None:
    view(f"calls_{name}", ["armstats"], f"SELECT *, {_call(p)} AS call FROM armstats")
    view(f"stars_{name}", [f"calls_{name}", "partners"], f"""
SELECT c.seq_id, c.shift, c.call, c.unpaired, c.fin - c.beg + 1 AS arm_size, count(s.i) AS star_size,
  count(s.i) FILTER (s.paired IS NULL) AS star_unpaired,
  coalesce(max(s.gap), 0) AS star_gap
FROM calls_{name} c LEFT JOIN (
  SELECT *, CASE WHEN paired IS NULL THEN count(*) OVER (PARTITION BY seq_id, shift, paired IS NULL, run) ELSE 0 END AS gap
  FROM (SELECT a.seq_id, a.shift, a.i, q.partner AS paired,
          a.i - row_number() OVER (PARTITION BY a.seq_id, a.shift, q.partner IS NULL ORDER BY a.i) AS run
        FROM (SELECT seq_id, shift, unnest(range(star_stop, star_start + 1)) AS i FROM calls_{name} WHERE shift >= 0) a
        LEFT JOIN partners q ON q.seq_id = a.seq_id AND q.place = a.i)) s ON s.seq_id = c.seq_id AND s.shift = c.shift
WHERE c.shift >= 0 GROUP BY ALL""")
    view(f"passed_{name}", [f"stars_{name}"], f"""
SELECT seq_id, arg_max(call, shift) AS final FROM stars_{name}
WHERE call IN ('5prime', '3prime') AND star_size - arm_size < {p.max_size_difference}
  AND star_unpaired <= {p.max_star_unpaired} AND star_gap <= {p.max_star_gap}
  AND (unpaired >= {p.min_unpaired} OR star_unpaired >= {p.min_unpaired}) GROUP BY seq_id""")


def _hairpin_sql(name: str, p: hairpin.Profile) -> str:
    return f"""SELECT seq_id, verdict AS hairpin_conclu,
  CASE WHEN verdict NOT IN ('5prime', '3prime') THEN 0 WHEN call = '5prime' THEN beg ELSE star_stop END AS fback_start,
  CASE WHEN verdict NOT IN ('5prime', '3prime') THEN 0 WHEN call = '5prime' THEN star_start ELSE fin END AS fback_stop
FROM (SELECT *, CASE WHEN call NOT IN ('5prime', '3prime') THEN call
    WHEN CASE WHEN call = '5prime' THEN abs(beg - star_start) ELSE abs(fin - star_stop) END < {p.min_foldback} THEN 'FBACK_SHORT'
    WHEN asym > {p.max_asymmetry} THEN 'MIR_ASSYMETRY' ELSE coalesce(final, 'FAILED_MIR_EXTENSION') END AS verdict
  FROM calls_{name} LEFT JOIN passed_{name} USING (seq_id) WHERE shift = -1)"""


for _name in ("def", "mey"):
    _hairpin_views(_name, hairpin.PROFILES[_name])


def _hairpin_query(query_name: str, profile: str) -> None:
    @query(query_name, "seq_id long, hairpin_conclu string, fback_start int, fback_stop int",
           [f"calls_{profile}", f"passed_{profile}"], _hairpin_sql(profile, hairpin.PROFILES[profile]))
    def _(t: Tables) -> DataFrame:
        stop = F.col("start") + F.length("eff_seq")
        return hairpin.hairpin_check(_paired_sites(t), F.col("start"), stop, profile)


_hairpin_query("hairpin_check", "def")
_hairpin_query("hairpin_check_strict", "mey")


view("qwords", ["queries21"], f"""
SELECT ordinal, name, q_at, substr(rc, CAST(q_at + 1 AS INT), 18) AS word
FROM (SELECT ordinal, name, rc, unnest(range(0, length(rc) - 17)) AS q_at
      FROM (SELECT ordinal, name, {sql_revcomp('seq')} AS rc FROM queries21 WHERE name LIKE 'ath%'))""")
# documents and their reverse complements, so that both strands are searched
view("bothstrands", ["docseq"], f"""
SELECT doc_id * 2 AS doc_id, s FROM docseq UNION ALL SELECT doc_id * 2 + 1 AS doc_id, {sql_revcomp('s')} AS s FROM docseq""")
view("runs", ["bothstrands", "qwords"], """
SELECT doc_id, ordinal, any_value(name) AS name, min(r_at) + 1 AS r_start, min(q_at) + 1 AS q_start,
  count(*) + 17 AS score, min(r_at) + count(*) + 17 AS r_end
FROM (SELECT *, r_at - row_number() OVER (PARTITION BY doc_id, ordinal, r_at - q_at ORDER BY r_at) AS run
      FROM (SELECT doc_id, r_at, substr(s, CAST(r_at + 1 AS INT), 18) AS word
            FROM (SELECT doc_id, s, unnest(range(0, length(s) - 17)) AS r_at FROM bothstrands)) JOIN qwords USING (word))
GROUP BY doc_id, ordinal, r_at - q_at, run""")


def _both_strands(t: Tables) -> DataFrame:
    # the strand is a number beside the text, so that who asks for the keys alone reads no text
    sides = t.docseq().select("doc_id", "s", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    text = F.when(F.col("side") == 0, F.col("s")).otherwise(sequence.reverse_complement(F.col("s")))
    return sides.select((F.col("doc_id") * 2 + F.col("side")).alias("doc_id"), text.alias("s"))


# every word of a target beside the words at the beginnings of a query's three parts; the whole stretch is compared
view("qparts", ["queries21"], f"""
SELECT ordinal, name, rc, q_at, substr(rc, CAST(q_at + 1 AS INT), 6) AS word
FROM (SELECT ordinal, name, rc, unnest([0, length(rc) // 3, 2 * (length(rc) // 3)]) AS q_at
      FROM (SELECT ordinal, name, {sql_revcomp('seq')} AS rc FROM queries21 WHERE name LIKE 'ath%' AND length(seq) >= 18))""")
view("stretches", ["bothstrands", "qparts"], """
SELECT DISTINCT doc_id, ordinal, name, r_at - q_at + 1 AS r_start, r_at - q_at + length(rc) AS r_end, hamming(piece, rc) AS mismatches
FROM (SELECT *, substr(s, CAST(r_at - q_at + 1 AS INT), CAST(length(rc) AS INT)) AS piece
      FROM (SELECT doc_id, s, r_at, substr(s, CAST(r_at + 1 AS INT), 6) AS word
            FROM (SELECT doc_id, s, unnest(range(0, length(s) - 5)) AS r_at FROM bothstrands)) JOIN qparts USING (word)
      WHERE r_at >= q_at AND r_at - q_at + length(rc) <= length(s))
WHERE hamming(piece, rc) <= 2""")


@query("target_mismatch_join", "doc_id long, ordinal long, name string, r_start int, r_end int, mismatches int", ["stretches"], "SELECT * FROM stretches")
def _(t: Tables) -> DataFrame:
    return targets.target_mismatches(_both_strands(t), targets.of_species(t.queries21(), "ath"), "doc_id", "s")


@query("target_search_join", "doc_id long, ordinal long, name string, r_start int, r_end int, q_start int, score int",
       ["runs"], "SELECT * FROM runs")
def _(t: Tables) -> DataFrame:
    return targets.target_runs(_both_strands(t), targets.of_species(t.queries21(), "ath"), "doc_id", "s")


@query("best_any_two_hit", "doc_id long, best_query string, best_score double, anyhit string, twohit string",
       ["bothstrands", "runs"], """
SELECT doc_id, coalesce(bq, '') AS best_query, coalesce(bs, 0) AS best_score, coalesce(anyhit, 'na') AS anyhit,
  coalesce(twohit, 'na') AS twohit
FROM (SELECT doc_id FROM bothstrands) LEFT JOIN (
  SELECT doc_id, first(name ORDER BY score DESC, ordinal) AS bq, max(score) AS bs,
    string_agg(name, ',' ORDER BY ordinal) AS anyhit, string_agg(name, ',' ORDER BY ordinal) FILTER (starts > 1) AS twohit
  FROM (SELECT doc_id, ordinal, name, max(score) AS score, count(DISTINCT r_start) AS starts FROM runs GROUP BY ALL)
  GROUP BY doc_id) USING (doc_id)""")
def _(t: Tables) -> DataFrame:
    both = _both_strands(t)
    runs = targets.target_runs(both, targets.of_species(t.queries21(), "ath"), "doc_id", "s")
    return targets.best_any_two(both, runs, "doc_id")


def mirror_fold():
    """Stand-in for a folding program: the first half mirrored around a loop."""
    arm = str.maketrans({"A": "(", "C": "(", "G": "(", "T": "."})

    def one(seq: str) -> str:
        left = seq[: max((len(seq) - 5) // 2, 0)].translate(arm)
        return left + "." * (len(seq) - 2 * len(left)) + left[::-1].replace("(", ")")

    return lambda seqs: seqs.map(one)


@query("with_fold", "seq_id long, fold string", ["folds"], """
SELECT seq_id, h || repeat('.', n - 2 * length(h)) || reverse(replace(h, '(', ')')) AS fold
FROM (SELECT seq_id, length(precursor) AS n,
        translate(substr(precursor, 1, (length(precursor) - 5) // 2), 'ACGT', '(((.') AS h FROM folds)""")
def _(t: Tables) -> DataFrame:
    return features.with_fold(t.folds().select("seq_id", "precursor"), {"precursor": "fold"}, mirror_fold())


# the same chain of views over the folded segments; a row has three folds, told apart by ``kind``
view("g_site", ["segseq"], """
SELECT *, substr(precursor, a + 1, b - a) AS site_seq, substr(fold, a + 1, b - a) AS site_fold
FROM (SELECT *, greatest(start - 4, 0) AS a, least(start + length(eff_seq) + 4, length(precursor)) AS b,
        concat_ws('|', library, chr, tile, eff_pos, kind) AS seq_id,
        h || repeat('.', length(precursor) - 2 * length(h)) || reverse(replace(h, '(', ')')) AS fold
      FROM (SELECT *, translate(substr(precursor, 1, (length(precursor) - 5) // 2), 'ACGT', '(((.') AS h
            FROM (SELECT library, chr, tile, eff_pos, eff_seq, precursor, dist_5p AS start, '' AS kind FROM segseq
                  UNION ALL SELECT library, chr, tile, eff_pos, eff_seq, precursor_200_500, 200, '25' FROM segseq
                  UNION ALL SELECT library, chr, tile, eff_pos, eff_seq, precursor_500_200, 500, '52' FROM segseq)))""")
view("g_targets", ["g_site"], "SELECT seq_id AS doc_id, precursor AS s FROM g_site WHERE kind = ''")
_CHAIN = ["bulges", "letters", "partners", "arms", "armpairs", "armstats", "calls_def", "stars_def", "passed_def", "runs"]
_BASES = {"site": "g_site", "folds": "g_site", "bothstrands": "g_targets"}


def _over_segments(sql: str) -> str:
    for old, new in {**{n: f"g_{n}" for n in _CHAIN}, **_BASES}.items():
        sql = re.sub(rf"\b{old}\b", new, sql)
    return sql


for _n in _CHAIN:
    _needs, _sql = VIEWS[_n]
    view(f"g_{_n}", [_over_segments(x) for x in _needs], _over_segments(_sql))
view("g_hits", ["g_targets", "g_runs"], _over_segments(QUERIES["best_any_two_hit"].sql))
view("g_hairpin", ["g_calls_def", "g_passed_def"], _over_segments(_hairpin_sql("def", hairpin.PROFILES["def"])))


@query("segment_features", "library string, chr string, tile long, eff_pos long, eff_seq string, precursor string, "
       "vote int, total_frq_DicerCall long, GC% double, 5p1A double, md5T double, Best_miR string, BestScore double, "
       "anyhit string, hairpin_conclu string, fback_start int, fback_stop int, hairpin_conclu25 string, "
       "hairpin_conclu52 string, Literature boolean, eff5p1 string, paired_percentage double, occ_bulgeAllnt int, "
       "occ_loopAllnt int, max_mfe double, min_mfe double, premfe double, premfe_200_500 double, premfe_500_200 double",
       ["scanned", "segseq", "tails", "comp", "slotcounts", "g_site", "g_hits", "g_hairpin", "g_bulges", "ref_loci"], f"""
SELECT s.library, s.chr, s.tile, s.eff_pos, s.eff_seq, s.precursor, {VOTE_SQL} AS vote, c.tot AS "total_frq_DicerCall",
  round({pct("(100 * c.ng)", "c.tot")} + {pct("(100 * c.nc)", "c.tot")}, 2) AS "GC%",
  {pct('(100 * m."n5p1A")', "m.tot")} AS "5p1A", {pct('(100 * m."nmd5T")', "m.tot")} AS "md5T",
  h.best_query AS "Best_miR", h.best_score AS "BestScore", h.anyhit, p0.hairpin_conclu, p0.fback_start, p0.fback_stop,
  p25.hairpin_conclu AS hairpin_conclu25, p52.hairpin_conclu AS hairpin_conclu52,
  r.CONTIG_literature_seen IS NOT NULL AS "Literature", s.eff_seq[1:1] AS eff5p1,
  b.paired AS paired_percentage,
  CASE WHEN b.start < 0 THEN -1 ELSE length(b.bl) END AS "occ_bulgeAllnt",
  CASE WHEN b.start < 0 THEN -1 ELSE length(b.ll) END AS "occ_loopAllnt",
  e.max_mfe, e.min_mfe, {fold_sql("s.precursor")[1]} AS premfe, {fold_sql("s.precursor_200_500")[1]} AS premfe_200_500,
  {fold_sql("s.precursor_500_200")[1]} AS premfe_500_200
FROM segseq s JOIN (SELECT library, chr, tile, eff_pos, max(mfe) AS max_mfe, min(mfe) AS min_mfe FROM scanned GROUP BY ALL) e
  USING (library, chr, tile, eff_pos)
JOIN tails t USING (library, chr, tile, eff_pos)
JOIN comp c USING (library, chr, tile, eff_pos) JOIN slotcounts m USING (library, chr, tile, eff_pos)
JOIN (SELECT library, chr, tile, eff_pos, seq_id FROM g_site WHERE kind = '') k USING (library, chr, tile, eff_pos)
JOIN g_hits h ON h.doc_id = k.seq_id JOIN g_hairpin p0 ON p0.seq_id = k.seq_id
JOIN g_hairpin p25 ON p25.seq_id = k.seq_id || '25' JOIN g_hairpin p52 ON p52.seq_id = k.seq_id || '52'
JOIN (SELECT *, {PAIRED} AS paired FROM g_bulges) b ON b.seq_id = k.seq_id
LEFT JOIN ref_loci r ON r.CONTIG_literature_seen = s.chr || '__' || s.tile || '_' || (s.tile + 5250)""")
def _(t: Tables) -> DataFrame:
    # reads, energies and regions all ask the genome: the texts are laid out once
    genome = stored(t.genome_tiles(), "genome")
    return features.segment_features(
        t.alignments(genome), genome, TILE, t.queries21(), "ath", t.ref_loci(), None, fold=hairpin_fold
    )
