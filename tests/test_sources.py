"""Text sources on hand-written files, and operators on small hand-made tables."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from phasegrid.operators import evaluation, localise, overlap, segments, tables, targets, tiling
from phasegrid.operators.genome import fetch_regions
from phasegrid.plans import localisation
from phasegrid.session import scratch_path
from phasegrid.sources import text
from tests.conftest import rows


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="phasegrid-test-")


def put(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        fh.write(content)
    return path


def sam(flag, chr_, pos, seq):
    return "\t".join(["r1", str(flag), chr_, str(pos), "255", f"{len(seq)}M", "*", "0", "0", seq, "*"]) + "\n"


def test_alignments(spark, folder):
    put(folder, "a.sam", "@HD\tVN:1\n" + sam(0, "1", 5, "ACGT") + sam(16, "2", 9, "GG"))
    put(folder, "b.x.sam", sam(4, "1", 1, "A"))
    put(folder, "a.sam~", sam(0, "9", 9, "AAAA"))
    put(folder, "notes.txt", "nothing")
    put(folder, "empty.sam", "")
    got = sorted(rows(text.read_alignments(spark, folder)))
    assert got == [("a", 0, "1", 5, 4, "ACGT"), ("a", 16, "2", 9, 2, "GG"), ("b.x", 4, "1", 1, 1, "A")]


def test_fasta(spark, folder):
    put(folder, "q.fa", ">ath-1 first\nACG\nTTA\n>oth-2\nGG\n>ath-3\nC\n")
    got = text.read_fasta(spark, folder, "ath").orderBy("ordinal").select("name", "seq")
    assert rows(got) == [("ath-1", "ACGTTA"), ("ath-3", "C")]


def test_malformed_lines(spark, folder):
    path = put(folder, "t.tsv", "CONTIG\ta\tb\nx\t1\t2\ny\t1\nz\t1\t2\t3\nw\t\t\n")
    assert sorted(r["value"].split("\t")[0] for r in text.drop_malformed(spark, path, "CONTIG").collect()) == ["CONTIG", "w", "x"]


def test_table_round_trip(spark):
    df = spark.createDataFrame([("l1", "c", 0, 3), ("l2", "c", 0, 1)], "library string, chr string, tile long, pos long")
    path = scratch_path(spark, "stage")
    text.write_stage(df, path)
    assert sorted(rows(spark.read.parquet(path).select("library", "pos"))) == [("l1", 3), ("l2", 1)]
    assert rows(text.expand_counts(spark.createDataFrame([("A", 2), ("B", 0)], "seq string, n int"))) == [("A",), ("A",)]


def test_fetch_regions(spark):
    genome = "".join(random.Random(1).choice("acgtACGT") for _ in range(95))
    tiles = spark.createDataFrame([("1", i, genome[i * 10 : i * 10 + 10]) for i in range(10)], "chr string, tile long, seq string")
    asked = [(1, "1", 1, 95, "W"), (2, "1", 8, 33, "C"), (3, "1", 90, 400, "B"), (4, "1", 500, 510, "W"), (5, "2", 1, 5, "W"), (6, "1", 0, 4, "W")]
    df = spark.createDataFrame(asked, "id int, chr string, a long, b long, strand string")
    got = fetch_regions(df, tiles, 10, ["id"], {"s": (F.col("a"), F.col("b"), F.col("strand"))})
    up = genome.upper()
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert {r["id"]: r["s"] for r in got.collect()} == {1: up, 2: flip(up[7:33]), 3: up[89:], 6: up[:4]}


def test_overlap_keeps_every_pair_once(spark):
    rng = random.Random(2)
    reads = [("l", "c", rng.randrange(1, 3000), rng.choice([18, 21, 30])) for _ in range(400)]
    spans = [(i, a, a + rng.randrange(0, 900)) for i, a in enumerate(rng.randrange(1, 2600) for _ in range(40))]
    r = spark.createDataFrame(reads, "library string, chr string, pos long, len int")
    s = spark.createDataFrame([(i, "l", "c", a, b) for i, a, b in spans], "id int, library string, chr string, L_bound long, R_bound long")
    want = {i: sum(p <= b and p + n - 1 >= a for _, _, p, n in reads) for i, a, b in spans}
    for size in (7, 100, 5000):
        got = overlap.overlap_join(s, r, size).groupBy("id").count()
        assert dict(rows(got)) == {i: n for i, n in want.items() if n}


def test_base_statistics(spark):
    reads = [("l", "c", 10, 0, 21, "A" * 20 + "C")] * 3 + [("l", "c", 15, 16, 21, "G" + "T" * 20), ("l", "c", 15, 0, 20, "C" * 20)]
    r = spark.createDataFrame(reads, "library string, chr string, pos long, flag int, len int, seq string")
    s = spark.createDataFrame([(1, "l", "c", 30, 40), (2, "l", "c", 900, 950)], "id int, library string, chr string, L_bound long, R_bound long")
    key = ["id", "library", "chr"]
    one, two = overlap.read_statistics(s, r, key).orderBy("id").collect()
    assert one["total_frq_DicerCall"] == 84 and one["A%"] == round(100 * 60 / 84, 2) and one["GC%"] == round(round(100 / 84, 2) + round(300 / 84, 2), 2)
    # the reverse read reads A*20 + C from its own 5' end
    assert one["5p1A"] == 100.0 and one["3p1C"] == 100.0 and one["md5T"] == 0.0
    assert two["total_frq_DicerCall"] == 0 and two["5p1A"] == 0.0


def test_targets_against_brute_force(spark):
    rng = random.Random(3)
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    queries = ["".join(rng.choice("ACGT") for _ in range(21)) for _ in range(6)] + ["A" * 21]
    docs = []
    for i in range(12):
        body = "".join(rng.choice("ACGT") for _ in range(120))
        for _ in range(2):
            piece = flip(rng.choice(queries))[rng.randrange(0, 3) :]
            at = rng.randrange(0, 100)
            body = body[:at] + piece + body[at:]
        docs.append((i, body + "T" * 40 if i == 0 else body))
    want = set()
    for i, s in docs:
        for j, q in enumerate(queries):
            q = flip(q)
            for d in range(-len(q), len(s)):
                run = 0
                for x in range(len(q) + 1):
                    same = x < len(q) and 0 <= d + x < len(s) and q[x] == s[d + x]
                    if not same and run >= 18:
                        want.add((i, j, d + x - run + 1, run))
                    run = run + 1 if same else 0
    t = spark.createDataFrame(docs, "doc int, s string")
    q = spark.createDataFrame([(j, f"q{j}", s) for j, s in enumerate(queries)], "ordinal int, name string, seq string")
    runs = targets.target_runs(t, q, "doc", "s")
    assert {(r["doc"], r["ordinal"], r["r_start"], r["score"]) for r in runs.collect()} == want
    best = {r["doc"]: r for r in targets.best_any_two(t, runs, "doc").collect()}
    assert len(best) == 12 and "q6" in best[0]["twohit"].split(",")


def test_localisation_against_brute_force(spark):
    rng = random.Random(4)
    scores = [(k, p, l, i, round(rng.uniform(-5, 5), 3)) for k in (1, 2) for i, (p, l) in
              enumerate((rng.randrange(0, 30), rng.choice([19, 20, 21, 22, 23, 24])) for _ in range(120))]
    df = spark.createDataFrame(scores, "k int, pos int, len int, ordinal int, score double")
    hits = spark.createDataFrame([(1, 3), (1, 7), (1, 999)], "k int, position int")
    got = {}
    for r in localisation.localise_sites(df, hits, "k").orderBy("k", "place_in_list").collect():
        got.setdefault(r["k"], []).append((r["p"], r["best_sum"], r["end_p"]))
    for k in (1, 2):
        first = {}
        for kk, p, l, _, v in scores:
            if kk == k:
                first.setdefault((p, l), v)
        lens = range(19, 24)
        s = lambda p: round(sum(first.get((p, l), 0) for l in lens), 6)
        e = lambda q: round(sum(first.get((q - l + 1, l), 0) for l in lens), 6)
        listed = []
        for p in sorted({p for p, _ in first}):
            v, l = max(((round(s(p) + e(p + l - 1), 6), -l) for l in lens))
            listed.append((p, v, p - l - 1))
        listed.sort(key=lambda x: (-x[1], x[0]))
        if k == 1:
            listed = ([x for x in listed if x[0] in (3, 7)] + [x for x in listed if x[0] not in (3, 7)])[:6]
        assert got[k] == listed


def test_a_record_larger_than_a_split_becomes_tiles(spark):
    rnd = random.Random(5)
    records = {f"c{k}": "".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, 7, 60, 999, 1000, 25_000]))) for k in range(14)}
    folder = tempfile.mkdtemp(prefix="genome-")
    names = list(records)
    for number, part in enumerate((names[:1], names[1:6], names[6:])):
        with open(os.path.join(folder, f"g{number}.fa"), "w") as f:
            f.write("stray line\n\n" if number == 1 else "")
            for name in part:
                f.write(f">{name} some words\n")
                at, seq = 0, records[name]
                while at < len(seq):
                    n = rnd.choice([1, 59, 60, 61, 200])
                    f.write(seq[at:at + n] + rnd.choice(["\n", " \n", "\r\n", "\n\n"]))
                    at += n
    open(os.path.join(folder, "empty.fa"), "w").close()
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "700")
    small.conf.set("spark.sql.files.openCostInBytes", "1")
    want = {(n, i // 1000): seq[i:i + 1000] for n, seq in records.items() for i in range(0, len(seq), 1000)}
    for session in (small, spark):
        tiles = text.fasta_tiles(session, folder, 1000)
        assert {(r.chr, r.tile): r.seq for r in tiles.collect()} == want and tiles.count() == len(want)
    assert text.fasta_lines(small, folder).select("off").distinct().count() > 300


def test_counted_reads_are_those_written_out(spark):
    from phasegrid.operators import windows
    from phasegrid.plans import phasing

    rnd = random.Random(3)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (21, 21, 21, 22, 19)]
    counted = []
    for _ in range(400):
        s = rnd.choice(seqs)
        counted.append(("l", rnd.choice([0, 16, 4]), "chr1", 1 + 21 * rnd.randint(0, 40) + rnd.choice([0, 0, 0, 1, 2]), len(s), s, rnd.choice([0, 1, 2, 7, None])))
    df = spark.createDataFrame(counted, "library string, flag int, chr string, pos long, len int, seq string, times long")
    written = text.expand_counts(df, count="times")
    segs = spark.createDataFrame([("l", "chr1", 0, 5, 1, 300), ("l", "chr1", 0, 9, 5000, 5100)], "library string, chr string, tile int, eff_pos int, L_bound long, R_bound long")
    for make in (
        lambda d, w: windows.position_frequency(tiling.assign_contigs(d), weight=w),
        lambda d, w: phasing.phased_windows(d, min_windows=1, weight=w),
        lambda d, w: overlap.read_counts(d, w),
        lambda d, w: overlap.read_statistics(segs, d, ["library", "chr", "tile", "eff_pos"], weight=w),
    ):
        a, b = sorted(rows(make(df, "times")), key=repr), sorted(rows(make(written, None)), key=repr)
        assert a == b and a


def test_targets_with_mismatches_are_all_found(spark):
    rnd = random.Random(6)
    queries = [(k, f"q{k}", "".join(rnd.choice("ACGT") for _ in range(rnd.choice([17, 18, 19, 21, 30])))) for k in range(25)]
    queries.append((90, "hot", "A" * 21))
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    docs = [(0, "T" * 300), (1, ""), (2, None)]
    for k in range(3, 30):
        s = "".join(rnd.choice("ACGT") for _ in range(120))
        for _ in range(3):
            site = list(flip(rnd.choice(queries)[2]))
            for at in rnd.sample(range(len(site)), rnd.randint(0, 4)):
                site[at] = rnd.choice("ACGTN")
            at = rnd.choice([0, rnd.randint(0, 90), len(s) - len(site)])
            s = s[:at] + "".join(site) + s[at + len(site):]
        docs.append((k, s.lower() if k % 5 == 0 else s))
    t = spark.createDataFrame(docs, "id int, s string").repartition(4)
    q = spark.createDataFrame(queries, "ordinal int, name string, seq string")
    for m in (0, 1, 2, 3):
        want = set()
        for i, s in docs:
            for o, name, seq in queries:
                rc = flip(seq)
                for at in range(len(s or "") - len(rc) + 1):
                    wrong = sum(x != y for x, y in zip(s.upper()[at:at + len(rc)], rc))
                    if len(rc) >= 18 and wrong <= m:
                        want.add((i, o, name, at + 1, at + len(rc), wrong))
        # the words are sent to all tasks, or salted and shuffled
        found = targets.target_mismatches(t, q, "id", "s", m, sent_bytes=1 << 20 if m % 2 else 0)
        found = found.select("id", "ordinal", "name", "r_start", "r_end", "mismatches").collect()
        assert len(found) == len(want) > 280 and set(map(tuple, found)) == want
    hot = targets.target_mismatches(t, q, "id", "s").filter("ordinal = 90 AND id = 0")
    assert hot.count() == 280


def test_few_places_are_compared_with_a_query(spark):
    """Two parts of a query have to agree, so chance meetings are some 300 here, where one part of a third gave 11,000."""
    rnd = random.Random(8)
    t = spark.createDataFrame([(k, "".join(rnd.choice("ACGT") for _ in range(20_000))) for k in range(10)], "id int, s string")
    q = spark.createDataFrame([(k, f"q{k}", "".join(rnd.choice("ACGT") for _ in range(21))) for k in range(300)], "ordinal int, name string, seq string")
    for sent in (1 << 20, 0):
        assert 100 < targets.mismatch_candidates(t, q, "id", "s", 2, sent_bytes=sent).count() < 1000


def test_places_are_looked_up_by_numbers(spark):
    """joins of words took most of the time; pieces of the text end anywhere, and a letter may be any character."""
    rnd = random.Random(14)
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    queries = [(k, f"q{k}", "".join(rnd.choice("ACGT") for _ in range(n))) for k, n in enumerate((18, 19, 20, 21, 33, 41, 41, 21))]
    docs = []
    for k in range(40):
        s = "".join(rnd.choice("ACGT\n\u00e9") for _ in range(rnd.choice([0, 5, 15, 16, 17, 31, 33])))
        for _, _, seq in rnd.sample(queries, 3):
            site = list(flip(seq))
            for at in rnd.sample(range(len(site)), rnd.randint(0, 3)):
                site[at] = rnd.choice("ACGT\n\u00e9")
            s += "".join(site) + "C" * rnd.randint(0, 2)
        docs.append((k, s))
    t = spark.createDataFrame(docs, "id int, s string").repartition(3)
    q = spark.createDataFrame(queries, "ordinal int, name string, seq string")
    want, pairs = set(), 0
    for i, s in docs:
        # upper case, as the letters of a target are compared
        s = s.upper()
        for o, name, seq in queries:
            rc, size = flip(seq), min(len(seq) // 4, 5)
            for at in range(len(s) - len(rc) + 1):
                here = s[at:at + len(rc)]
                wrong = sum(x != y for x, y in zip(here, rc))
                if wrong <= 2:
                    want.add((i, o, name, at + 1, at + len(rc), wrong))
                alike = sum(here[j * size:(j + 1) * size] == rc[j * size:(j + 1) * size] for j in range(4))
                pairs += alike * (alike - 1) // 2
    for sent in (1 << 20, 0):
        hits = targets.mismatch_candidates(t, q, "id", "s", 2, sent_bytes=sent)
        assert dict(hits.dtypes)["_key"] == "bigint" and hits.count() == pairs
        found = targets.target_mismatches(t, q, "id", "s", sent_bytes=sent).select("id", "ordinal", "name", "r_start", "r_end", "mismatches").collect()
        assert set(map(tuple, found)) == want and len(found) == len(want) > 60


def _site_model(rnd):
    """Weights for some of everything, knots with ties."""
    from phasegrid.operators import sites

    kmers = {}
    for size, tail in ((1, ""), (2, "di"), (3, "tri")):
        for kind in ("eff5p", "eff3p", "effmd"):
            for i in range(1, 6):
                kmers[f"{kind}{i}{tail}"] = {"".join(rnd.choice("ACGT") for _ in range(size)): rnd.random() - 0.5 for _ in range(5)}
    kmers["eff5p1_3p3"] = {"AC": 0.25, "GG": -0.75}
    numeric = {n: (sorted(rnd.choice([0, 1, 2, 3, 5, 8, 20, 55.5]) for _ in range(10)), rnd.random() - 0.5) for n in sites.NUMERIC}
    return sites.SiteModel(kmers, numeric)


def test_candidate_totals_are_sums_over_candidate_rows(spark):
    """Repeats, keys that come twice or are null, letters of several bytes, cut and missing sequences."""
    rnd = random.Random(3)
    data = [(1, "ACGTA" * 12), (1, "G" * 30), (2, "ACG"), (3, None), (4, "A" * 40), (5, ""), (None, "ACGTN" * 9), (6, "C" * 21)]
    data += [(k, "".join(rnd.choice("ACGT\u00e9") for _ in range(rnd.randint(21, 70)))) for k in range(7, 15)]
    data += [(20, (w := "".join(rnd.choice("ACGT") for _ in range(20))) + "T" + w + "A" + w[:19])]
    df = spark.createDataFrame(data, "id int, s string").repartition(3)
    cands = localise.sliding_candidates(df, "id", "s")
    assert all(r.find == r.s.find(r.cand) for r in localise.sliding_candidates(df, "id", "s", carry=["s"]).collect())
    gc = F.length("cand") - F.length(F.translate("cand", "GC", ""))
    want = cands.groupBy("id").agg(
        F.count("*"), F.count_if(F.length("cand") < F.col("len")), F.count_if(F.col("find") < F.col("i")), F.sum("find"), F.sum(gc))
    got = localise.candidate_totals(df, "id", "s", "GC")
    assert got.columns == ["id", *localise.TOTALS]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_sites_are_those_of_columns_made_one_by_one(spark):
    """Every candidate as a row with the columns that ``site_columns`` gives known sites, weighed and ranked by plain code."""
    from phasegrid.operators import sites, structures
    from phasegrid.operators.encode import quantile_scaled

    rnd = random.Random(7)
    model = _site_model(rnd)
    data = [(1, "ACGTA" * 12, "(((((" * 5 + "." * 10 + ")))))" * 5), (2, "ACG", "..."), (3, None, None), (4, "A" * 40, "." * 40), (5, "", "")]
    for k in range(6, 12):
        n = rnd.randint(21, 60)
        data.append((k, "".join(rnd.choice("ACGTN" if k > 7 else "ACGTNXa") for _ in range(n)), "".join(rnd.choice("(..).()") for _ in range(n))))
    pre = spark.createDataFrame(data, "id int, precursor string, fold string").repartition(3)
    cands = localise.sliding_candidates(pre.filter("precursor IS NOT NULL"), "id", "precursor", 21, ["precursor", "fold"]).filter("find = i")
    rows_of = sites.site_columns(structures.structure_window(cands.withColumnRenamed("cand", "eff_seq")), ["id", "i", "len"])
    numbers = [quantile_scaled(F.col(n).cast("double"), k).alias(f"s_{n}") for n, (k, _) in model.numeric.items()]
    score = {}
    for r in rows_of.select("*", *numbers).collect():
        v = sum(w.get(r[c], 0.0) for c, w in model.kmers.items() if r[c] is not None) + sum(w * r[f"s_{n}"] for n, (_, w) in model.numeric.items())
        score.setdefault(r.id, {})[(r.i, r.len)] = round(v, 6)
    want = {}
    for k, found in score.items():
        s = lambda p: round(sum(found.get((p, l), 0) for l in range(19, 24)), 6)
        e = lambda q: round(sum(found.get((q - l + 1, l), 0) for l in range(19, 24)), 6)
        listed = [(p, *max((round(s(p) + e(p + l - 1), 6), -l) for l in range(19, 24))) for p in sorted({p for p, _ in found})]
        want[k] = [(p, pytest.approx(v, abs=2e-6), -l) for p, v, l in sorted(listed, key=lambda x: (-x[1], x[0]))]
    ranked = sites.ranked_starts(pre, model)
    got = {r.id: [(x.p, x.best_sum, x.best_len) for x in r.ranked] for r in ranked.collect()}
    assert {k: v for k, v in got.items() if v} == want and set(got) == {r[0] for r in data}
    predicted = spark.createDataFrame([(4, 3), (6, 0), (6, 2), (6, 99)], "id int, position long")
    cut = {r.id: [x.p for x in r.ranked] for r in localisation.recommended_starts(ranked, "id", predicted).collect()}
    order = [p for p, _, _ in got[6]]
    assert cut[6] == ([p for p in order if p in (0, 2)] + [p for p in order if p not in (0, 2)])[:6]
    assert cut[4] == [p for p, _, _ in got[4]] and cut[1] == [p for p, _, _ in got[1]]
    best = {r.id: (r.predict_start, r.predict_end) for r in localisation.localise_table(pre, "id", model, predicted).collect()}
    assert best[2] == best[3] == best[5] == (None, None) and best[6][0] == cut[6][0]


def test_lists_of_starts_are_not_shuffled(spark):
    """F8: a precursor's list of starts takes some ten times its letters, so proposed starts are joined before it is made."""
    from phasegrid.operators import sites

    rnd = random.Random(12)
    model = _site_model(rnd)
    data = [(k % 7 if k != 9 else None, "".join(rnd.choice("ACGT") for _ in range(60)), "." * 60) for k in range(12)]
    pre = spark.createDataFrame(data, "id int, precursor string, fold string")
    # keys come twice or are null on both sides, starts are proposed twice or are none
    predicted = spark.createDataFrame([(0, 3), (0, 3), (0, 30), (1, 99), (2, 5), (None, 4)], "id int, position long")
    made = localisation.localise_table(pre, "id", model, predicted)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and "Exchange" not in plan[:plan.index("MapInArrow")]
    assert made.columns == ["id", "precursor", "fold", "predict_start", "predict_end", "score"]
    lists = localisation.recommended_starts(sites.ranked_starts(pre, model), "id", predicted)
    best = F.get("ranked", F.lit(0))
    want = lists.select("id", "precursor", best["p"], best["p"] + best["best_len"] - 1, best["best_sum"])
    got = sorted(map(tuple, made.drop("fold").collect()), key=repr)
    assert got == sorted(map(tuple, want.collect()), key=repr) and len(got) == 12
    assert {r[2] for r in got if r[0] == 2} == {5} and {r[2] for r in got if r[0] == 0} <= {3, 30}


def test_precursors_of_one_batch_do_not_change_each_other():
    """A precursor far shorter than the longest of its batch, with and without words that come twice."""
    import numpy as np

    from phasegrid.operators import sites

    rnd = random.Random(11)
    scorer = sites.SiteScorer(_site_model(rnd))
    seqs = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (125, 21, 22, 60, 125, 24)] + ["ACG", "ACGTT" * 25, "", "AX" * 20, "A" * 33]
    folds = ["".join(rnd.choice("(..).()") for _ in s) for s in seqs]
    sizes, *together = scorer.ranked(seqs, folds)
    alone = [scorer.ranked([s], [f]) for s, f in zip(seqs, folds)]
    assert sizes.tolist() == [x[0][0] for x in alone]
    assert all(np.array_equal(got, np.concatenate([x[k] for x in alone])) for k, got in enumerate(together, 1))


def test_a_site_model_is_made_of_known_sites(spark):
    from phasegrid.operators import sites, structures

    rnd = random.Random(8)
    data = [(k, "".join(rnd.choice("ACGT") for _ in range(80)), "." * 80) for k in range(200)]
    df = spark.createDataFrame(data, "id int, precursor string, fold string").withColumn("eff_seq", F.substring("precursor", 31, 21))
    known = sites.site_columns(structures.structure_window(df), ["id"]).withColumn("y", F.col("eff5p1") == "A")
    model, table = localisation.train_site_model(known, "y", ["id"])
    assert table.count() > 500 and sum(map(len, model.kmers.values())) > 400
    heaviest = max(((abs(w), c, k) for c, ws in model.kmers.items() for k, w in ws.items()))
    assert heaviest[1:] == ("eff5p1", "A")


def test_tables(spark):
    ref = spark.createDataFrame([("x", "1", "a"), ("x", "1", "b")], "CONTIG_literature_seen string, chromosome string, locus string")
    df = spark.createDataFrame([("x", 3, "na", "q"), ("y", 5, "q", "na")], "CONTIG string, vote int, anyhit string, twohit string")
    out = tables.derive_labels(segments.annotate_reference(df, ref)).orderBy("CONTIG", "locus")
    assert rows(out.select("CONTIG", "locus", "Literature", "retained", "anyhitBool")) == [
        ("x", "a", True, True, False), ("x", "b", True, True, False), ("y", None, False, False, True)]
    wide = spark.createDataFrame([(1, 2, 3, 4, 5.0, 6, True)], "`CONTIG` int, `pval` int, `Howell >= 3` int, `chr` int, `pval_fdr` double, `u` int, `k` boolean")
    assert tables.drop_non_features(wide).columns == ["CONTIG", "pval", "pval_fdr", "k"]
    both = tables.align_and_union(spark.createDataFrame([(1, 4)], "A int, B int"), spark.createDataFrame([(2, 5, 7)], "A int, B int, C int"))
    assert rows(tables.instances_only(both)) == [(1, 4, 0)]
    top = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "feature string, importance double")
    assert rows(evaluation.top_k(top, 2).select("feature")) == [("c",), ("a",)]
