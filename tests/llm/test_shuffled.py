"""Operators that bring rows together: top-k, archives, mixing; and the pipeline."""

import gzip
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phasegrid.llm import mixing, queries, topk, warc

from .cases import AWKWARD, SCHEMA, awkward, empty, plain


def same(got, con, name):
    """The DataFrame's rows against the registered SQL over the views of ``con``."""
    names = sorted(got.columns)
    result = con.execute(queries.ORACLES[name])
    at = [[x[0] for x in result.description].index(c) for c in names]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select(names).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    same(queries.QUERIES[name](spark, small), con, name)


@pytest.mark.parametrize("rows,block", [(7, 4096), (400, 37), (400, 4096)])
def test_top_k_ties_and_blocks(spark, monkeypatch, rows, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "FINALISTS", 3)
    rnd = random.Random(rows)
    data = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(8)]) for i in range(rows)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as score", "'x' as id", "2 as v")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()}
    v = {i: [math.floor(256 * x) for x in e] for i, e in data}
    want = {}
    for q in range(0, rows, 5):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:5]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    assert got == want


def test_top_k_leaves_out_what_is_no_vector(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (5, [nan, 1.0]), (10, None), (15, [None, 1.0]), (1, [inf, 0.0]), (2, [3.0, 1.0]), (3, [1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect())
    assert got == [(0, 1, 2, 256 * 256 * 5), (0, 2, 3, 256 * 256)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r)[:3] for r in topk.top_k(twice, F.col("vec_id") == 0).collect()) == [(0, 1, 1), (0, 2, 1)]


PAGES = [(1, "http://b.example.com/x", "<p>one</p>"), (2, "http://a.example.com/y?q=1#top", "<p>one</p>"), (3, None, "two\r\n\r\nWARC/1.1\r\n"),
         (4, "http://a.example.com/y", None), (5, "http://a.example.com:8080/y", ""), (None, "http://c.example.org", "<p>one</p>"),
         (6, "bad\r\nurl", "é" * 50_000), (6, "bad\r\nurl", "é" * 50_000), (7, "http://[broken", "last"), (None, "u", "only null ids"), (None, "u", "only null ids")]


def test_archives_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 as size", "'x' as digest", "2 as run")
    folder = str(tmp_path / "warc")
    warc.write_archives(df.repartition(3), folder)
    found = warc.runs(spark, folder)
    rows = warc.merged(found, range_rows=4).orderBy("range", "place").collect()
    assert len(rows) == len(PAGES)
    keys = [(r.url_key, r.date, -1 if r.page_id is None else r.page_id) for r in rows]
    assert keys == sorted(keys)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows), key=repr)
    n = 100_000
    assert kinds == sorted([(1, "revisit", 2, 10), (2, "response", None, 10), (3, "response", None, 17), (4, "revisit", 5, 0), (5, "response", None, 0),
                            (None, "revisit", 2, 10), (6, "response", None, n), (6, "response", None, n), (7, "response", None, 4),
                            (None, "response", None, 13), (None, "response", None, 13)], key=repr)
    for r in rows:  # offsets and lengths lead to the record
        with gzip.open(r.run.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert next(warc.parse(f.read(r.length)))[2]["warc-type"] == r.record_type
    assert warc.index(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.index(df, least_bytes=100_001).collect()} == {"response"}


def test_loser_tree_merges_like_sorting():
    rnd = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((rnd.randrange(50), i) for _ in range(rnd.choice([0, 1, 5, 40]))) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_damaged_archives_raise():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse(b"no record"))


SKEWED = [(i, " ".join(["w"] * (1 + i % 7)), None, "hot" if i % 3 else f"s{i % 11}" if i % 5 else None, 1) for i in range(900)] + [
    (5, "again and again", None, "hot", 1), (5, "again and again", None, "hot", 1), (2000, "", None, "void", 0), (2001, None, None, "hot", 0)]


def test_mixing_matches_sql_on_skewed_sources(spark):
    df = spark.createDataFrame(SKEWED, SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    mix = mixing.Mix(range_rows=50)
    same(mixing.draw(df.selectExpr("*", "1 as key", "2 as epoch", "'x' as hash"), mix), con, "op10_mixing")


@pytest.mark.parametrize("mix", [mixing.Mix(entropy=0.99, max_repeats=50.0), mixing.Mix(entropy=1.0, max_repeats=1.5), mixing.Mix(entropy=0.5, budget=2.5)])
def test_mixing_targets(spark, mix):
    totals = spark.createDataFrame([("a", 10_000, 9), ("b", 1_000, 9), ("c", 100, 9), ("d", 5_000, 9)], "key string, tokens bigint, docs bigint")
    rows = mixing.quotas(totals, mix).collect()
    weight = {r.key: r.weight for r in rows}
    assert sum(weight.values()) == pytest.approx(1)
    entropy = -sum(w * math.log(w) for w in weight.values()) / math.log(4)
    repeats = max(r.weight * mix.budget * 16_100 / r.tokens for r in rows)
    natural = -sum(t / 16_100 * math.log(t / 16_100) for t in (10_000, 1_000, 100, 5_000)) / math.log(4)
    assert repeats <= max(mix.max_repeats, mix.budget) + 1e-6
    # either the entropy is met (exactly, unless it holds anyway), or the limit binds
    assert entropy == pytest.approx(max(mix.entropy, natural), abs=1e-6) or repeats == pytest.approx(max(mix.max_repeats, mix.budget), abs=1e-6)


def test_mixing_draws_whole_passes_and_blocks(spark):
    df = spark.createDataFrame([(i, "w " * 10, None, "small" if i < 20 else "large", 1) for i in range(400)], SCHEMA)
    mix = mixing.Mix(entropy=1.0, max_repeats=100.0, block_tokens=400, range_rows=16)
    rows = mixing.draw(df, mix).collect()
    small = [r for r in rows if r.source == "small"]
    assert sum(r.n_tokens for r in small) == 2000 and len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    orders = {e: [r.doc_id for r in sorted(small, key=lambda r: (r.block, r.place)) if r.epoch == e] for e in (0, 1)}
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]
    for b in {r.block for r in rows}:
        inside = [r for r in rows if r.block == b]
        assert sorted(r.place for r in inside) == list(range(len(inside)))
        assert sum(r.n_tokens for r in inside if r.source == "small") <= 210
    assert mixing.draw(df.limit(0)).count() == 0 and mixing.draw(awkward(spark)).count() > 0


def test_mixed_documents_are_whole_rows(spark):
    out = mixing.mixed_documents(spark.createDataFrame(SKEWED, SCHEMA))
    want = mixing.draw(spark.createDataFrame(SKEWED, SCHEMA).withColumn("n", mixing.word_count(F.col("text"))), tokens=F.col("n"))
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")] and abs(out.count() - want.count()) < 30
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in SKEWED}


def test_pipeline_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == names, name
        assert stage(spark, empty(spark), "").count() == 0, name
    done = corpus_pipeline.tokens(spark, docs, "")
    assert done.count() == len(AWKWARD)
    assert corpus_pipeline.near_copies(spark, plain(spark), "").count() == len(AWKWARD) - 4


def test_pipeline_keeps_clean_documents(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, small).join(labels, "doc_id").agg(F.avg(F.col("quality").cast("double")), F.count("*")).first()
    assert good[0] > 0.97 and good[1] >= 0.97 * labels.filter("quality = 1").count()
    out = corpus_pipeline.run(spark, small).collect()
    assert 0 < len(out) <= docs.count() * 1.5 and all(len(r.ids) == 4 * r.n_tokens for r in out)


def test_bounds_of_many_queries_at_once():
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(-40, 41, (900, 6)), axis=0)[:, rng.permutation(6)] + rng.integers(-2, 3, (900, 6))
    lists, ids = topk.Lists(rng.permutation(900).astype(np.int64), values), rng.integers(-40, 41, (300, 6))
    for floor in (-np.inf, 3000.0):
        got = lists.best(ids, np.arange(300), 5, np.full(300, floor))
        for i, (found, score) in enumerate(got):
            want = sorted((-int(values[r] @ ids[i]), int(lists.ids[r])) for r in range(900) if lists.ids[r] != i)[:5]
            assert [x for x in zip((-score).tolist(), found.tolist()) if -x[0] >= floor] == [x for x in want if -x[0] >= floor]
