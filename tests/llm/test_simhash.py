"""Fingerprints bit by bit, links against all pairs, groups against a plain union."""

import random
from collections import defaultdict

import pytest
import xxhash

from phasegrid.llm import common, components, simhash

from .cases import AWKWARD, SCHEMA, awkward, empty


def plain_fingerprint(text, words=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    shingles = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_links_are_all_pairs_within_the_threshold(spark, threshold):
    rnd = random.Random(threshold)
    base = [rnd.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    fps = set(base)
    for x in base:
        for n in (1, 1, 2, 2, 3, 4):
            for _ in range(3):
                y = x
                for b in rnd.sample(range(64), n):
                    y ^= 1 << b
                fps.add(y)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp bigint")
    got = [tuple(r) for r in simhash.links(df, threshold).collect()]
    want = {tuple(sorted((signed[x], signed[y]))) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= threshold}
    assert len(got) == len(set(got)) and set(got) == want


def test_anchors_never_go_to_the_driver(spark):
    """A small table of fingerprints is a large one of anchors; its size on disk says little."""
    plan = simhash.links(spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp bigint"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_anchors_cover_every_word():
    """Each 31-bit word is within 1 of the anchor its syndrome names, and anchors have syndrome 0."""
    rnd = random.Random(5)
    for _ in range(200):
        x = rnd.getrandbits(31)
        s = sum(((x & m).bit_count() % 2) << k for k, m in enumerate(simhash.CHECKS))
        home = x ^ (1 << (s - 1) if s else 0)
        assert all((home & m).bit_count() % 2 == 0 for m in simhash.CHECKS)


def test_components_match_a_union(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5)]
    df = spark.createDataFrame(pairs, "u bigint, v bigint")
    got = dict(tuple(r) for r in components.components(df).collect())
    ends = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {n: r for n, r in roots(ends, [p for p in pairs if p[0] != p[1]]).items()}
    assert components.components(df.limit(0)).count() == 0


def test_awkward_rows_and_groups(spark):
    rows = AWKWARD + [(20 + i, " ".join(f"w{j}" for j in range(400) if j != i), None, None, None) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as fp", "2 as component_id")
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    by = roots(set(fps), [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 2])
    ids = defaultdict(list)
    for (d, *_), f in zip(rows, fps):
        ids[by[f]] += [d] if d is not None else []
    want = sorted(((d, f, min(ids[by[f]], default=None)) for (d, *_), f in zip(rows, fps)), key=repr)
    assert got == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_fingerprints_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in simhash.fingerprints(docs).collect():
        assert r.fp & (1 << 64) - 1 == plain_fingerprint(texts[r.doc_id])


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    words = [tuple((t or "").encode().lower().split()) for _, t, *_ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if words[i] == words[j] or (
        sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    return roots(range(len(rows)), pairs)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.random()}"
    return " ".join(words)


def test_near_copies_keep_one_of_each_group(spark):
    rnd = random.Random(9)
    texts = []
    for g in range(12):
        base = [f"t{g}x{rnd.randrange(10_000)}" if rnd.random() < 0.6 else rnd.choice("the of and to in".split()) for _ in range(300)]
        texts += [" ".join(base), edited(rnd, base, 1), edited(rnd, base, 3), " ".join(base).upper(), edited(rnd, base, 60)]
    big = [f"b{rnd.randrange(10_000)}" for _ in range(500)]
    texts += [edited(rnd, big, rnd.randrange(1, 4)) for _ in range(80)]
    rows = [*AWKWARD, *[(100 + i, t, None, None, None) for i, t in enumerate(texts)]]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in simhash.without_near_copies(df).collect())
    groups = defaultdict(list)
    for i, root in brute_groups(rows).items():
        groups[root].append(rows[i][0] if rows[i][0] is not None else -1)
    want = sorted(min((d for d in g if d >= 0), default=-1) for g in groups.values())
    assert kept == want
    assert simhash.without_near_copies(empty(spark)).count() == 0


def kept_and_wanted(spark, rows):
    """Ids that stay, and those that stay after comparing all pairs."""
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    kept = {r.doc_id for r in simhash.without_near_copies(df).select("doc_id").collect()}
    groups = defaultdict(list)
    for i, root in brute_groups(rows).items():
        groups[root].append(rows[i][0])
    return kept, {min(g) for g in groups.values()}


def test_groups_that_only_other_members_link(spark):
    """Chains of texts, each a step from the one before it and far from the ends, in any order."""
    rnd = random.Random(5)
    texts = []
    for g in range(30):
        words = [f"c{g}x{rnd.randrange(100_000)}" for _ in range(600)]
        for step in range(14):
            words[step * 40:step * 40 + 12] = [f"c{g}s{step}n{k}" for k in range(12)]
            texts.append(" ".join(words))
    rnd.shuffle(texts)
    kept, want = kept_and_wanted(spark, list(enumerate(texts)))
    assert len(want) == 30
    assert kept == want


def similar_pair(rnd, kind, n, share):
    """A text and its edited form of about this similarity: words appended, cut off at the end, or replaced here and there."""
    words = [f"v{rnd.randrange(3000)}" for _ in range(n)]
    a, other = " ".join(words), list(words)
    if kind == "appended":
        other += [f"v{rnd.randrange(3000)}" for _ in range(round(n * (1 / share - 1)))]
    elif kind == "cut":
        other = other[:round(n * share)]
    else:
        while len(shingles(a) & shingles(" ".join(other))) > (share + 0.01) * len(shingles(a) | shingles(" ".join(other))):
            other[rnd.randrange(n)] = f"n{rnd.random()}"
    x, y = shingles(a), shingles(" ".join(other))
    return a, " ".join(other), len(x & y) / len(x | y)


@pytest.mark.parametrize("kind", ["appended", "cut", "replaced"])
def test_similar_texts_are_candidates(kind):
    rnd = random.Random(3)
    pairs = [similar_pair(rnd, kind, rnd.choice([60, 150]), 0.81) for _ in range(200)]
    keys = [[set(simhash.sketch(t, 5)[1]) for t in (a, b)] for a, b, s in pairs if s >= 0.8]
    assert len(keys) > 80
    assert sum(not x & y for x, y in keys) <= 1


def test_similar_texts_are_one_group_whatever_the_edit(spark):
    rnd = random.Random(4)
    texts = [t for kind in ("appended", "cut", "replaced") for _ in range(40) for t in similar_pair(rnd, kind, 200, 0.82)[:2]]
    kept, want = kept_and_wanted(spark, list(enumerate(texts)))
    assert len(want) < 135
    assert kept == want


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    """Without a common least hash, texts whose fingerprints are equal or link are still compared, and judged by their sets."""
    own_keys = simhash.sketch
    monkeypatch.setattr(simhash, "sketch", lambda t, n: (own_keys(t, n)[0], [xxhash.xxh64_intdigest(t) >> 1], own_keys(t, n)[2]))
    rnd = random.Random(11)
    texts = []
    for g in range(8):
        base = [f"f{g}x{rnd.randrange(100_000)}" for _ in range(900)]
        texts += [" ".join(base), edited(rnd, base, 1)]
    hashes = [simhash._hashes(t, 5)[1] for t in texts]
    bits = [((simhash.majority(x) ^ simhash.majority(y)) & (1 << 64) - 1).bit_count() for x, y in zip(hashes[::2], hashes[1::2])]
    df = spark.createDataFrame([(i, simhash.majority(h)) for i, h in enumerate(hashes)], "row bigint, fp bigint")
    got = {tuple(r) for r in simhash.linked(df).collect()}
    assert got == {(2 * g, 2 * g + 1) for g, n in enumerate(bits) if n <= 2} and got
    groups = simhash.near_copies(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA))[1]
    assert groups.filter("row <> keep").count() == len(got)


def test_groups_of_one_hash_are_compared(spark):
    same = spark.range(1, 400_000).selectExpr("id + (id % 7) * (1L << 33) as id").selectExpr("id", "hash(id) as h").groupBy("h").agg({"id": "collect_list"}).toDF("h", "ids")
    one, two = sorted(same.filter("size(ids) > 1").first().ids)[:2]
    shared = spark.createDataFrame([(7, 0, 0), (7, one, 0), (7, two, 0)], "key bigint, row bigint, leader bigint")
    groups = spark.createDataFrame([], "node bigint, component bigint")
    assert [tuple(r) for r in simhash.untried(shared, groups).collect()] == [(one, two)]


@pytest.mark.parametrize("counters", [1, 7, 1 << 12])
def test_rare_shingles_propose_every_similar_pair(spark, monkeypatch, counters):
    """Whatever the counters tell apart, sets of similarity 0.8 meet, and a large group is not compared with itself."""
    monkeypatch.setattr(simhash, "COUNTERS", counters)
    rnd = random.Random(counters)
    sets = []
    for _ in range(25):
        base = [rnd.getrandbits(63) - (1 << 62) for _ in range(rnd.choice([1, 4, 5, 30, 90]))]
        for _ in range(5):
            drop = rnd.randrange(len(base) // 4 + 1)
            sets.append(sorted({*base[drop:], *(rnd.getrandbits(60) for _ in range(rnd.randrange(len(base) // 8 + 1)))}))
    df = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(sets)], "row bigint, set array<bigint>, size bigint")
    cells = simhash._cells(df, 0.8)
    none = spark.createDataFrame([], "node bigint, component bigint")
    got = {tuple(r) for r in simhash.untried(cells, none, 0.8).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j)
            if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    assert want and want <= got
    grouped = spark.createDataFrame([(i, 0) for i in range(60)], "node bigint, component bigint")
    got = {tuple(r) for r in simhash.untried(cells, grouped, 0.8).collect()}
    assert {p for p in want if p[1] >= 60} <= got and not any(b < 60 for _, b in got)


def test_scratch_tables_go_and_results_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_path", lambda _, name: str(tmp_path / f"{name}_{len(list(tmp_path.iterdir()))}"))
    with common.scratch(spark) as outer:
        common.store(spark.range(3), "first")
        with common.scratch(spark) as keep:
            kept = keep(common.store(spark.range(5), "inner").selectExpr("id + 1 as id"), "kept")
        assert kept.count() == 5 and sorted(p.name[:5] for p in tmp_path.iterdir()) == ["first", "kept_"]
        result = outer(kept, "result")
    assert result.count() == 5 and [p.name[:6] for p in tmp_path.iterdir()] == ["result"]


def test_recall_on_the_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = defaultdict(list)
    for i, root in brute_groups(rows).items():
        want[root].append(rows[i][0])
    kept = {r.doc_id for r in simhash.without_near_copies(spark.read.parquet(f"{small}/documents.parquet")).select("doc_id").collect()}
    assert {min(g) for g in want.values()} <= kept
    assert len(kept - {min(g) for g in want.values()}) <= 0.1 * sum(len(g) > 1 for g in want.values())


def test_awkward_columns(spark):
    assert simhash.near_duplicates(awkward(spark)).columns == ["doc_id", "fp", "component_id"]
