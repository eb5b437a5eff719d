"""Trees and proofs against a plain recursion over sorted lists, and against SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from phasegrid.llm import queries
from phasegrid.llm.merkle import Appender, Manifest, fold, levels_of, manifest, tampered_text, witness

from .cases import AWKWARD, SCHEMA, awkward, empty


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def proofs(nodes):
    """Root and, per node, the siblings of each level, by plain recursion."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
    root, above = proofs([H("".join(r)) for r in runs])
    return root, [[(r[:k], r[k + 1:]), *above[i]] for i, r in enumerate(runs) for k in range(len(r))]


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r, leaf(*r)))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subroots, paths = {}, {}
    for lang in order:
        langs[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subroots[lang], paths[lang] = proofs([h for _, h in langs[lang]])
    if not order:
        return []
    root, tops = proofs([subroots[x] for x in order])
    out = []
    for lang, top in zip(order, tops, strict=True):
        for (r, h), path in zip(langs[lang], paths[lang], strict=True):
            steps = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if tampered else r[1]
            folded = leaf(r[0], text, *r[2:])
            for before, after in steps:
                folded = H("".join([*before, folded, *after]))
            out.append((str(r[0]), h, subroots[lang], root, H("".join("".join(a + b) for a, b in steps)), folded, folded == root))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def claimed():
    return {"text": tampered_text()}


def made(sizes):
    rnd = random.Random(1)
    rows, at = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            at += 1
            rows.append((at * 7 % 100_003, rnd.choice(["Some Text", "lower only", None, "ÄÖ Z"]) , lang, rnd.choice(["a", None]), at))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 200, 513])
def test_appended_witnesses_are_those_of_the_recursion(n):
    leaves = [H(str(i)) for i in range(n)]
    tree = Appender(levels_of(n))
    nodes = [tree.append(x) for x in leaves]
    root, paths = proofs(leaves)
    assert tree.finish() == root
    for x, node, path in zip(leaves, nodes, paths, strict=True):
        steps = witness(node, [])
        assert steps == [("".join(a), "".join(b)) for a, b in path]
        assert fold(x, steps) == root and fold(H(x), steps) != root


def test_a_later_sibling_extends_an_earlier_witness():
    tree = Appender(2)
    first, second = tree.append("a"), tree.append("b")
    assert (first.before, first.after) == ("", ["b"]) and (second.before, second.after) == ("a", [])
    tree.append("c")
    assert first.after == ["b", "c"] and second.after == ["c"]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_tiers_of_blocks(spark, depth):
    rows = made({"de": 150, "en": 70, None: 9, "fr": 1, "é": 8, "z": 2, "b": 64, "c": 3, "": 5, "d": 1, "D": 2})
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(manifest(df, Manifest(depth=depth), claimed(), witnesses=False)) == brute(rows)


def test_witnesses_lead_every_row_to_the_root(spark):
    rows = made({"de": 90, "en": 20})
    for r in manifest(spark.createDataFrame(rows, SCHEMA), Manifest(depth=1)).collect():
        assert r.verified and fold(r.leaf, [(s.before, s.after) for s in r.witness]) == r.root == r.folded_root


def test_other_groups_and_fields(spark):
    rows = made({"de": 30, "en": 20})
    df = spark.createDataFrame(rows, SCHEMA)
    got = manifest(df, Manifest(fields=("text", "doc_id"), group="source", order="n_chars"))
    assert got.columns[:2] == ["source", "n_chars"] and got.filter("verified").count() == 50


def test_a_repeated_row_may_make_most_of_a_group(spark):
    rows = made({"de": 40}) + [(5, "Same Text", "de", "a", 9)] * 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(manifest(df, Manifest(depth=2), claimed())) == brute(rows)


def test_awkward_and_empty_tables(spark):
    assert found(manifest(awkward(spark), claimed=claimed())) == brute(AWKWARD)
    none = manifest(empty(spark), claimed=claimed())
    assert none.count() == 0 and none.columns[:3] == ["lang", "doc_id", "pos"]


def test_the_sql_twin():
    rows = AWKWARD + made({"de": 20, None: 3, "en": 1})
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    got = con.sql("SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM (" + queries.ORACLES["op12_merkle_manifest"] + ")").fetchall()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)
