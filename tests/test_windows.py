"""Window semantics against a direct twin written from their definition."""

import random

import pytest
from pyspark.sql import functions as F

from phasegrid.functions import scores
from phasegrid.operators import tiling
from phasegrid.plans import phasing
from tests.conftest import rows

C, D, R = 9, 21, 2


def test_tile_starts(spark):
    cases = {1: [0], 5000: [5000, 0], 5100: [5000, 0], 5250: [5000, 0], 10001: [10000, 5000],
             10250: [10000, 5000], 10251: [10000], 285741846: [285740000]}
    df = spark.createDataFrame([(p,) for p in cases], "pos long")
    for p, got in rows(df.select("pos", tiling.tile_starts(F.col("pos")))):
        assert list(got) == cases[p]


def test_score_goldens(spark):
    df = spark.range(1).select(
        scores.howell_xia(F.lit(26), F.lit(20), F.lit(7)),
        scores.howell_2007(F.lit(26), F.lit(7)),
        scores.guo(F.lit(37), F.lit(4), F.lit(14), F.lit(13)),
        scores.howell_xia(F.lit(26), F.lit(20), F.lit(2)),
    )
    assert rows(df) == [(12.97, 16.48, 3.71, 0.0)]
    table = scores.chen_table(spark)
    ks = spark.createDataFrame([(4, 23), (2, 6), (3, 358), (5, 4)], "k int, n int")
    got = {(r["k"], r["n"]): r["p"] for r in scores.with_chen(ks, table, "k", "n", "p").collect()}
    assert got == {(4, 23): 0.017848, (2, 6): 1.0, (3, 358): None, (5, 4): 0.0}


def twin(reads):
    """All windows worth keeping of one contig, straight from the definitions."""
    watson, crick = {}, {}
    for pos, flag, n in reads:
        if n == D:
            side, at = (watson, pos) if flag == 0 else (crick, pos + 2)
            side[at] = side.get(at, 0) + 1
    freq = {q: watson.get(q, 0) + crick.get(q, 0) for q in {*watson, *crick}}

    def site(q):
        best = lambda side: max(((side[x], -x) for x in range(q - R, q + R + 1) if x in side), default=(0, 0))
        (fw, nw), (fc, nc) = best(watson), best(crick)
        return ("W", -nw, fw) if fw > fc else ("B", -nw, fw) if fw == fc else ("C", -nc - 2, fc)

    def slots(x):
        return [q for q in range(x, x + D * (C - 1) + 1, D) if q in freq]

    out = {}
    for p in freq:
        core = slots(p)
        peak = max(core, key=lambda q: (freq[q], -q))
        drift = sum(freq.get(peak + d, 0) for d in range(-R, R + 1) if d)
        if len(core) < 3 or freq[peak] + drift < 4:
            continue
        ahead = range(p, p + D * (C - 1) + 1)
        members = list(core)
        for step in (C * D, -C * D):
            x = p + step
            while len(slots(x)) > 1:
                members += slots(x)
                x += step
        top = max(freq[q] for q in members)
        new_peak = next(q for q in members if freq[q] == top)
        out[p] = (
            len(core), sum(freq[q] for q in core) + drift, freq[peak] + drift,
            sum((q in watson) + (q in crick) for q in ahead), sum(freq.get(q, 0) for q in ahead),
            len(members), max(min(members) - D, 0), max(members) + D, new_peak, *site(new_peak),
        )
    return out


@pytest.mark.parametrize("seed, hot", [(1, 0), (2, 0), (3, 900)])
def test_against_twin(spark, seed, hot):
    rng = random.Random(seed)
    reads = []
    for _ in range(900):
        base = rng.choice([40, 300, 2000]) + D * rng.randrange(60)
        pos = base + (rng.choice([-2, -1, 0, 0, 0, 1, 2]) if rng.random() < 0.7 else rng.randrange(D))
        reads.append((max(pos, 1), rng.choice([0, 0, 16]), rng.choice([21, 21, 21, 20, 24])))
    reads += [(300, 0, 21)] * hot  # one place with half of all reads
    reads = [r for r in reads if r[0] % 5000 > 250 or r[0] < 5000]
    df = spark.createDataFrame([("l", "c", *r) for r in reads], "library string, chr string, pos long, flag int, len int")
    got = phasing.phased_windows(df, min_windows=1).select(
        "pos", "k", "p", "maxf", "n", "u", "ext_k", "L_bound", "R_bound", "pos_of_maxf", "eff_strand", "eff_pos", "eff_frq"
    )
    assert {r[0]: r[1:] for r in rows(got)} == twin(reads)


def test_one_shuffle_after_counting(spark):
    df = spark.createDataFrame([("l", "c", 1, 0, 21)], "library string, chr string, pos long, flag int, len int")
    plan = phasing.phased_windows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
