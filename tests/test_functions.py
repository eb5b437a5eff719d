"""Column expressions against plain Python on random input."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from phasegrid.catalog import fixtures
from phasegrid.functions import sequence, special, structure
from phasegrid.functions.rounding import round_ratio
from phasegrid.operators import encode, evaluation, hairpin, prefix, significance, structures
from tests.conftest import rows


def test_round_ratio_matches_python(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(0, 100 * d + 1), d) for d in range(1, 400) for _ in range(6)]
    pairs += [(100 * v, 32) for v in range(33)] + [(100 * v, 160) for v in range(161)] + [(100 * v, 800) for v in range(801)]
    df = spark.createDataFrame(pairs, "n long, d long")
    for n, d, two, three in rows(df.select("n", "d", round_ratio(F.col("n"), F.col("d"), 2), round_ratio(F.col("n"), F.col("d"), 3))):
        assert (two, three) == (round(n / d, 2), round(n / d, 3)), (n, d)
    assert rows(spark.range(1).select(round_ratio(F.lit(1), F.lit(0)))) == [(None,)]


def test_reverse_complement_is_an_involution(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 40))) for _ in range(50)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    once = sequence.reverse_complement(F.col("s"))
    for s, twice in rows(df.select("s", sequence.reverse_complement(once))):
        assert s == twice
    assert rows(spark.range(1).select(sequence.reverse_complement(F.lit("aacgn")))) == [("NCGTT",)]


def test_kmers(spark):
    s = "ACGTTGCAAGCTAGCTTAGCC"
    df = spark.createDataFrame([(s,), ("ACG",)], "eff_seq string")
    full, short = structures.effector_kmer_table(df).collect()
    assert len(full) == 47
    assert (full["eff5p1"], full["eff3p1"], full["effmd5"], full["eff3p2di"], full["eff3p5tri"], full["eff5p1_3p3"]) == (
        s[0], s[-1], s[13], s[-3:-1], s[-7:-4], s[0] + s[-3])
    assert (short["effmd1"], short["effmd1di"], short["eff3p4"], short["eff3p4di"]) == (None, "", None, "ACG"[-5:-3])


def random_fold(rng, n):
    """A balanced string with stems, bulges and loops."""
    out, depth = [], 0
    for i in range(n):
        choices = ["."] * 2
        if depth < n - i - 1:
            choices += ["("] * 3
        if depth:
            choices += [")"] * 3
        c = ")" if depth and depth >= n - i else rng.choice(choices)
        depth += {"(": 1, ")": -1, ".": 0}[c]
        out.append(c)
    return "".join(out)


def windows(s, w):
    return [s[i : i + w] for i in range(len(s) - w + 1)]


def expected_structure(seq, fold):
    out = {"paired_percentage": round((len(fold) - fold.count(".")) * 100 / len(fold), 2)}
    for w in (3, 5, 7):
        views = windows(fold, w)
        out[f"paired_roll{w}"] = round(sum(w - v.count(".") for v in views) / len(views), 2) if views else None
    runs = lambda *ps: max((len(m) - 2 for p in ps for m in re.findall(p, fold)), default=0)
    out["length_longest_bulge"] = runs(r"\(\.+\(", r"\)\.+\)", r"\)\.+\(")
    out["length_longest_loop"] = runs(r"\(\.+\)")
    out["longest_paired_length"] = max((len(m) for m in re.findall("[()]+", fold)), default=0)
    places = range(len(fold) - 2)
    for base in "ATCG":
        hits = [i for i in places if seq[i : i + 3] == base * 3]
        out[f"NBtriplet{base}"] = len(hits)
        for shape in ["(((", "((.", "(.(", ".((", "..(", ".(.", "(..", "..."]:
            out[base * 3 + shape] = sum(fold[i : i + 3].replace(")", "(") == shape for i in hits)
        mid = [fold[i : i + 3] for i in places if seq[i + 1] == base]
        out[base + ".(."] = sum(m in (".(.", ".).") for m in mid)
        out[base + "(.("] = sum(m in (").)", "(.(", ").(") for m in mid)
    bulges = [len(m) - 2 for m in re.findall(r"\(\.+\(|\)\.+\)|\)\.+\(", fold)]
    loops = [len(m) - 2 for m in re.findall(r"\(\.+\)", fold)]
    out["occ_bulgeAllnt"], out["occ_loopAllnt"] = len(bulges), len(loops)
    out.update({f"occ_bulge{k}nt": bulges.count(k) for k in range(1, 24)})
    out.update({f"occ_loop{k}nt": loops.count(k) for k in range(3, 24)})
    return out


def test_structure_features(spark):
    rng = random.Random(5)
    data = []
    for i in range(150):
        n = rng.randrange(2, 32)
        data.append((i, "".join(rng.choice("AAATCG") for _ in range(n)), random_fold(rng, n), 0))
    df = spark.createDataFrame(data, "id int, site_seq string, site_fold string, start int")
    table = structures.structure_features(df, ["id"])
    assert len(table.columns) == 98
    for r in table.collect():
        want = expected_structure(data[r["id"]][1], data[r["id"]][2])
        assert {k: r[k] for k in want} == want
    lost = structures.structure_features(df.withColumn("start", F.lit(-1)), ["id"]).first()
    assert lost["AAA((("] == -1 and lost["occ_loop23nt"] == -1 and lost["paired_percentage"] is not None


def test_pairs_match_a_stack(spark):
    rng = random.Random(6)
    folds = [random_fold(rng, rng.randrange(1, 80)) for _ in range(60)] + ["))((", "(()"]
    df = spark.createDataFrame(list(enumerate(folds)), "id int, fold string")
    kept = structures.balanced(df)
    assert kept.count() == 60
    for i, fold, pairs in rows(structures.with_pairs(kept, "id").select("id", "fold", "pairs")):
        stack, want = [], [-1] * len(fold)
        for at, c in enumerate(fold):
            if c == "(":
                stack.append(at)
            elif c == ")":
                want[at], want[stack[-1]] = stack[-1], at
                stack.pop()
        assert pairs == want


def test_pairs_stay_inside_the_row(spark):
    """No letter is sorted, shuffled or grouped, whatever the number of folds; rows keep their own pairs."""
    df = spark.createDataFrame([(1, "(())"), (1, "(.)."), (2, "))(("), (3, "(()"), (4, ""), (5, None), (None, "()")], "id int, fold string")
    for made in (structures.with_pairs(df, "id"), structures.pair_table(structures.balanced(df), "id")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Sort", "Window", "Aggregate"))
    got = {(r.id, r.fold): r.pairs for r in structures.with_pairs(df, "id").collect()}
    assert got == {(1, "(())"): [3, 2, 1, 0], (1, "(.)."): [2, -1, 0, -1], (2, "))(("): [-1] * 4, (3, "(()"): [-1, 2, 1],
                   (4, ""): None, (5, None): None, (None, "()"): None}
    assert sorted(tuple(r) for r in structures.pair_table(df.filter("id < 4"), "id").collect()) == [
        (1, 0, 2), (1, 0, 3), (1, 1, 2), (1, 2, 0), (1, 2, 1), (1, 3, 0), (3, 1, 2), (3, 2, 1)]


def test_a_letter_of_a_long_fold_is_not_looked_up_from_its_start(spark):
    """precursors have thousands of letters; walking to each made the work of a fold grow with its square."""
    fold = "((.)" * 700 + "." + "(.))" * 700
    df = spark.createDataFrame([(1, fold)], "id int, fold string")
    made = structures.with_pairs(df, "id")
    assert "substring" not in made._jdf.queryExecution().executedPlan().toString()
    stack, want = [], [-1] * len(fold)
    for at, c in enumerate(fold):
        if c == "(":
            stack.append(at)
        elif c == ")" and stack:
            want[at], want[stack[-1]] = stack[-1], at
            stack.pop()
    assert made.first()["pairs"] == want


def test_gamma_tails_are_dealt_out(spark):
    """a row is few bytes and much work, so rows must not be merged into one task."""
    df = spark.createDataFrame([("l", float(1 + i % 17), 0.5) for i in range(60)], "library string, Howell double, pval double")
    out = significance.gamma_tails(df, ["library"], ["Howell"], ["pval"])
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 60 and len({r["Howell_ccdf"] for r in out.collect()}) == 17


def test_hairpin_goldens(spark):
    long = ("(((((((((((.(((.(((((...((((((...((..((((.(((.((.(((.((((.(((((....((((...(((.(((((...........))))).)))...))))...."
            "))))).)))).))).))..))).))))))..)))).))..))))).))).)))))))))))..")
    cases = [(0, long, 153, 173), (1, "((((((.((((((....).))))).))))))..........", 46, 64), (2, "." * 60, 5, 26),
             (3, "((((((((((((((((((((((((((....))))))))))))))))))))))))))", 2, 20)]
    df = spark.createDataFrame(cases, "id int, fold string, a int, b int")
    got = hairpin.hairpin_check(structures.with_pairs(df, "id"), F.col("a"), F.col("b"))
    out = {r["id"]: (r["hairpin_conclu"], r["fback_start"], r["fback_stop"]) for r in got.collect()}
    assert out[1] == ("FAILED_MIR_EXTENSION", 0, 0)
    assert out[2] == ("NONPAIRING", 0, 0)
    assert out[3] == ("FBACK_SHORT", 0, 0)
    assert out[0] == ("3prime", 1, 173)


def test_hairpin_measures_only_what_a_verdict_hangs_on(spark):
    """half of the rows are judged by their arm alone; the asymmetry and the extensions of such rows are not worked out."""
    folds = ["." * 60, "(" * 26 + "...." + ")" * 26, "((((..((((....))))..))))" * 3, "(" * 40 + "....." + ")" * 40, None]
    df = spark.createDataFrame([(i, f, a, a + 20) for i, f in enumerate(folds) for a in (0, 5, 30, 64)], "id int, fold string, a int, b int")
    made = hairpin.hairpin_check(structures.with_pairs(df, "id"), F.col("a"), F.col("b"))
    plan = made._jdf.queryExecution().analyzed().toString()
    for name in ("_low", "_high", "_asym", "_long0", "_c0", "_star0"):
        made_as = plan[:plan.index(f" AS {name}#")]
        # a measure stands under a condition from its beginning on
        assert made_as.count("CASE WHEN") and made_as.rstrip().endswith("END"), name
    got = {(r.id, r.a): (r.hairpin_conclu, r.fback_start, r.fback_stop) for r in made.collect()}
    assert got[0, 5] == ("NONPAIRING", 0, 0) and got[1, 5][0] == "FBACK_SHORT" and got[4, 0] == (None, 0, 0)
    assert {v[0] for v in got.values()} >= {"NONPAIRING", "FBACK_SHORT"}


def test_gamma_functions(spark):
    cases = [(x, a) for x in (0.01, 0.5, 1.0, 3.0, 12.0, 40.0) for a in (0.3, 1.0, 2.5, 9.0, 30.0)]
    df = spark.createDataFrame(cases, "x double, a double")
    got = df.select("x", "a", special.log_gamma(F.col("a")), special.gamma_cdf(F.col("x"), F.col("a"), F.lit(1.0)))
    for x, a, lg, cdf in rows(got):
        assert lg == pytest.approx(math.lgamma(a), abs=1e-10)
        want = sum(math.exp((a + n) * math.log(x) - x - math.lgamma(a + n + 1)) for n in range(400))
        assert cdf == pytest.approx(want, abs=1e-9)


def test_gamma_fit_recovers_shape(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("l", rng.gammavariate(2.5, 1.5)) for _ in range(4000)], "library string, v double")
    r = significance.gamma_fit(df, ["library"], ["v"]).first()
    assert r["shape"] == pytest.approx(2.5, rel=0.1) and r["scale"] == pytest.approx(1.5, rel=0.1)


def test_benjamini_hochberg(spark):
    rng = random.Random(3)
    data = [(lib, i, round(rng.random() ** 4, 6)) for lib in "ab" for i in range(300)]
    data += [("a", 1000 + i, 0.000012) for i in range(150)]  # one value holds a third of a library
    df = spark.createDataFrame(data, "library string, id int, p double")
    got = {(r["library"], r["id"]): (r["q"], r["ok"]) for r in significance.benjamini_hochberg(df, ["library"], "p", "q", "ok").collect()}
    for lib in "ab":
        mine = sorted([(p, i) for l, i, p in data if l == lib], reverse=True)
        m, low, passed = len(mine), 1.0, max((p for r, (p, _) in enumerate(sorted(mine), 1) if p <= 0.05 * r / len(mine)), default=-1)
        for rank, (p, i) in zip(range(m, 0, -1), mine):
            low = min(low, p * m / rank)
            assert got[(lib, i)][0] == pytest.approx(low, abs=1e-12)
            assert got[(lib, i)][1] == (p <= passed)


def test_exact_quantiles_and_scaling(spark):
    import numpy as np

    rng = random.Random(4)
    a = [rng.choice([0.0, 0.0, 0.0, 1.0, 2.5, rng.random() * 10]) for _ in range(700)]
    b = [5.0] * 700
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    knots = encode.fit_knots(df, ["a", "b"])
    assert knots["a"] == pytest.approx(list(np.percentile(a, np.linspace(0, 100, 10))), abs=1e-12)
    ref, q = np.linspace(0, 1, 10), np.array(knots["a"])
    want = 0.5 * (np.interp(a, q, ref) - np.interp(-np.array(a), -q[::-1], -ref[::-1]))
    want[np.array(a) == q[-1]], want[np.array(a) == q[0]] = 1, 0
    got = df.select(encode.quantile_scaled(F.col("a"), knots["a"]).alias("x"), encode.quantile_scaled(F.col("b"), knots["b"]).alias("y")).collect()
    assert [r["x"] for r in got] == pytest.approx(list(want), abs=1e-9)
    assert {r["y"] for r in got} == {0.0}


def test_roc_area_and_metrics(spark):
    rng = random.Random(8)
    data = [(rng.random() < 0.4, round(rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(data, "y boolean, s double")
    points = evaluation.roc_points(df, "y", "s").collect()
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert sum(r["area"] for r in points) == pytest.approx(want, abs=1e-12)
    counts = spark.createDataFrame([(22, 1000, 0, 78), (0, 0, 0, 0)], "tp long, tn long, fp long, fn long")
    r, zero = evaluation.confusion_metrics(counts).collect()
    assert (r["precision"], r["sensitivity"], r["acc"], r["f1"], r["mcc"]) == (1.0, 0.22, 0.929, 0.361, 0.452)
    assert (zero["precision"], zero["mcc"], zero["acc"]) == (0.0, 0.0, 0.0)


def _normalised_integral(shape, x):
    """P(shape, x) as a ratio of two Simpson sums of the density over twelve deviations."""
    import numpy as np

    sd = shape ** 0.5
    low, high = max(shape - 14 * sd, shape * 1e-12), shape + 14 * sd

    def total(a, b, n=400_001):
        t = np.linspace(a, b, n)
        mu = (t - shape) / shape
        f = np.exp(-shape * (mu - np.log1p(mu)) - np.log(t / shape))
        w = np.full(n, 2.0)
        w[1::2] = 4.0
        w[0] = w[-1] = 1.0
        return float((f * w).sum() * (b - a) / (n - 1) / 3)

    return total(low, min(max(x, low * 1.0000001), high)) / total(low, high)


@pytest.mark.parametrize("shape", [60.0, 300.0, 501.0, 1e4, 1e6, 1e9])
def test_gamma_tails_of_any_shape(spark, shape):
    points = [shape + d * shape ** 0.5 for d in (-4.0, -1.5, -0.3, 0.0, 0.7, 2.0, 5.0)]
    df = spark.createDataFrame([(x,) for x in points], "x double")
    got = df.select(special.gamma_cdf(F.col("x"), F.lit(shape), F.lit(1.0))).collect()
    for (g,), x in zip(got, points):
        assert g == pytest.approx(_normalised_integral(shape, x), abs=2e-9)


def test_gamma_fit_of_nearly_constant_and_constant_columns(spark):
    from phasegrid.operators import significance

    df = spark.createDataFrame([("a", 7.3, 5.0)] * 999 + [("a", 7.31, 5.0)], "library string, near double, same double")
    fit = {r.feature: r for r in significance.gamma_fit(df, ["library"], ["near", "same"]).collect()}
    spread = sum((v / m - 1) ** 2 for v, m in [(7.3, 7.30001)] * 999 + [(7.31, 7.30001)]) / 1000
    assert fit["near"].shape == pytest.approx(1 / spread, rel=1e-2) and fit["same"].shape is None
    tails = significance.gamma_tails(df, ["library"], ["near"], []).filter("near = 7.3").select("near_ccdf").first()
    assert 0.4 < tails[0] < 0.6


def test_fractions_below_a_thousandth(spark):
    from phasegrid.learn import models
    from phasegrid.operators import tiling

    keys = spark.range(1_000_000).select("id", F.lit("chr1").alias("chr"), (F.col("id") * 5000).alias("tile"))
    assert 280 <= tiling.sample_contigs(keys, 0.0004).count() <= 520
    assert 280 <= models.split(keys, "id", 0.0004)[1].count() <= 520


def test_one_hot_of_many_categories(spark):
    df = spark.range(30_000).select("id", F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"))
    long = encode.one_hot(df, ["id"], ["name"])
    assert long.count() == 30_000 and long.filter("id = 7").first().feature == "name_c7"


def test_one_hot_table_has_the_zeros_too(spark):
    df = spark.createDataFrame([(1, "x", True), (2, None, False), (3, "y", True), (3, "y", True)], "id int, a string, b boolean")
    got = sorted((r.id, r.feature, r.value) for r in encode.one_hot_table(df, ["id"], ["a", "b"]).collect())
    want = [(i, f, float(f in (f"a_{a}", f"b_{str(b).lower()}"))) for i, a, b in df.collect() for f in ("a_x", "a_y", "b_true", "b_false")]
    assert got == sorted(want) and len(got) == 16
    assert encode.one_hot_table(df.limit(0), ["id"], ["a", "b"]).count() == 0


def test_features_of_one_name_are_told_apart(spark):
    df = spark.createDataFrame([(1, "b_c", "x"), (0, "z", "c"), (1, "b_c", None)], "y int, a string, a_b string")
    sums = evaluation.feature_sums(encode.entries(df, ["y"], {}, ["a", "a_b"]))
    got = sorted((r.feature, r.col, r.importance) for r in evaluation.feature_evaluation(sums, evaluation.class_totals(df, "y")).collect())
    assert [x[:2] for x in got] == [("a_b_c", "a"), ("a_b_c", "a_b"), ("a_b_x", "a_b"), ("a_z", "a")]


def test_sparse_statistics_are_those_of_the_dense_table(spark):
    import numpy as np

    rnd = random.Random(12)
    data = [(rnd.random() < 0.3, rnd.choice([0.0, rnd.random() * 9, None]), rnd.choice(["p", "q", None, ""])) for _ in range(500)]
    df = spark.createDataFrame(data, "y boolean, v double, c string")
    knots = encode.fit_knots(df, ["v"])
    sums = evaluation.feature_sums(encode.entries(df, [F.col("y").cast("int").alias("y")], knots, ["c"]))
    got = {r.feature: (r.importance, r.correlation) for r in evaluation.feature_evaluation(sums, evaluation.class_totals(df, "y")).collect()}
    y = np.array([r[0] for r in data], float)
    scaled = [r.s or 0.0 for r in df.select(encode.quantile_scaled(F.col("v"), knots["v"]).alias("s")).collect()]
    columns = {"v": np.array(scaled), **{f"c_{k}": np.array([float(r[2] == k) for r in data]) for k in ("p", "q", "")}}
    assert set(got) == set(columns)
    for name, v in columns.items():
        e = np.array([y.mean(), 1 - y.mean()]) * v.sum()
        chi = (((np.array([(v * y).sum(), (v * (1 - y)).sum()]) - e) ** 2) / e).sum()
        assert got[name][0] == pytest.approx(chi, abs=1e-6) and got[name][1] == pytest.approx(np.corrcoef(v, y)[0, 1], abs=1e-6)
    table = evaluation.feature_evaluation(sums, evaluation.class_totals(df, "y"))
    keyed = df.withColumn("id", F.monotonically_increasing_id())
    from phasegrid.operators import localise
    weighed = localise.feature_weights_sparse(encode.entries(keyed, ["id"], knots, ["c"], zeros=True), ["id"], table).collect()
    want = sum(columns[f] * np.prod(got[f]) for f in got)
    assert sorted(r.weighted_sum for r in weighed) == pytest.approx(sorted(want.tolist()), abs=1e-6)


def test_texts_are_cut_in_one_pass(spark, tmp_path):
    rng = random.Random(9)
    text = ["".join(rng.choice("abcdefghij KLM.") for _ in range(n)) for n in (0, 1, 124, 125, 126, 999, 1000, 1001, 2500, 7000)]
    data = [(i, t) for i, t in enumerate(text)] + [(4096, "x" * 3000), (4097, None)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = fixtures.Tables(spark, str(tmp_path))
    bases = {r["doc_id"]: r["s"] for r in t.docseq().filter("s IS NOT NULL").collect()}
    want, genome = {}, {}
    for i, s in sorted(bases.items()):
        want |= {i * 10000 + k: (p * 125)[:125] for k, p in enumerate(s[a:a + 125] for a in range(0, len(s), 125))}
        genome[f"chr{i % 5 + 1}"] = genome.get(f"chr{i % 5 + 1}", "") + s
    assert {r["seq_id"]: r["precursor"] for r in t.folds().collect()} == want
    tiles = {(c, k): s[k * 1000:k * 1000 + 1000] for c, s in genome.items() for k in range(-(-len(s) // 1000))}
    assert {(r["chr"], r["tile"]): r["seq"] for r in t.genome_tiles().collect()} == tiles
    only = spark.createDataFrame([("chr5", 1), ("chr9", 0)], "chr string, tile long")
    assert [(r["chr"], r["tile"], r["seq"]) for r in t.genome_tiles(only).collect()] == [("chr5", 1, tiles["chr5", 1])]
    # a text is not copied to each of its pieces
    for df in (t.folds(), t.genome_tiles()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "posexplode(" in plan and "explode(sequence" not in plan


def test_tokens_are_made_once_a_row(spark):
    df = spark.createDataFrame([("AAATTTT", "(((.)).", 0), (None, "((", 0), ("AC", None, -1)], "site_seq string, site_fold string, start int")
    folded = structure.triplet_tokens(F.col("site_seq"), F.col("site_fold"))
    assert rows(df.select(folded))[0] == ("<AAA(((><TTT.((><TTT((.>",)
    plan = df.select(folded)._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" in plan and "translate(" not in plan and "fold, replace(" in plan.split("lambdafunction")[0]
    assert [r[-1] for r in rows(structures.structure_features(df, []))] == [0, 0, -1]


def test_target_words_are_found_through_anchors(spark):
    """a text gives one row per step of letters, not one per letter, and every shared word is still found, once."""
    from phasegrid.operators import targets
    from phasegrid.operators.targets import STEP, target_runs, word_hits

    rng = random.Random(5)
    texts = {i: "".join(rng.choice("AC") for _ in range(n)) for i, n in enumerate((0, 3, 5, 6, 7, 40, 41, 42, 43, 44, 90, 90))}
    texts[50], texts[51] = "  ACACAC  ", "AA\nCCACCA"
    asked = {i: "".join(rng.choice("GT") for _ in range(n)) for i, n in enumerate((2, 5, 6, 7, 8, 9, 21, 30))}
    df = spark.createDataFrame([*texts.items(), (60, None)], "id int, s string")
    queries = spark.createDataFrame([(i, f"q{i}", s) for i, s in asked.items()], "ordinal int, name string, seq string")
    turned = {i: s.translate(str.maketrans("GT", "CA"))[::-1] for i, s in asked.items()}
    for size in (1, 4, 6, 11, 18):
        got = sorted(rows(word_hits(df, queries, "id", "s", size).select("id", "ordinal", "r_at", "q_at")))
        assert got == sorted((i, j, r, q) for i, s in texts.items() for j, x in turned.items()
                             for r in range(len(s) - size + 1) for q in range(len(x) - size + 1) if s[r : r + size] == x[q : q + size])
    cut = df.filter("id = 10").select(F.explode(targets.anchors(F.col("s"), 18 - STEP + 1, STEP, 18)))
    assert cut.count() == (90 - (18 - STEP + 1)) // STEP + 1 < 90 - 17
    best = {(r["id"], r["ordinal"], r["r_start"], r["r_end"], r["score"]) for r in target_runs(df, queries, "id", "s", 6).collect()}
    for i, s in texts.items():
        for j, x in turned.items():
            for shift in range(-len(x), len(s)):
                line = "".join("=" if 0 <= shift + q < len(s) and s[shift + q] == c else "." for q, c in enumerate(x))
                for m in re.finditer("={6,}", line):
                    assert (i, j, shift + m.start() + 1, shift + m.end(), m.end() - m.start()) in best


def test_keys_of_both_strands_read_no_text(spark, tmp_path):
    """the list of targets was made from the texts; and letters were made twice for each text."""
    from phasegrid.catalog.fixtures import Tables
    from phasegrid.catalog.sequences import _both_strands

    spark.createDataFrame([(1, "abcz"), (2, "..."), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    both = _both_strands(Tables(spark, str(tmp_path)))
    assert "regexp_replace" not in both.select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert both._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert sorted(rows(both)) == [(2, "ACGC"), (3, "GCGT"), (4, "ACGT"), (5, "ACGT"), (6, None), (7, None)]
