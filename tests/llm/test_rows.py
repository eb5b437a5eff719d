"""Operators that look at one row at a time: personal data, quality rules, the classifier."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.llm import pii, quality_classifier, quality_rules, queries

from .cases import AWKWARD, SCHEMA, awkward, empty, plain

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])) % 10 == 0
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_on_random_texts():
    rnd = random.Random(2)
    for _ in range(30_000):
        text = "".join(rnd.choice(rnd.choice(["ab@.-", "01+ ()-.", "0123456789", "@a.b1 é"])) for _ in range(rnd.randint(0, 50)))
        assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE] == brute_spans(text)


def test_base_spans_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == brute_spans(texts[r.doc_id])


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" + " " * 400_000, "0" * 9000 + ".1.1.1"):
        pii.spans_of(text)
    assert [s[:3] for s in pii.spans_of("0" * 9000 + "7.1.1.1")] == [("ip", 0, 9007)]


def test_added_kinds_need_checksum_or_context():
    found = [s[0] for s in pii.spans_of('iban DE89 3704 0044 0532 0130 00 AND token = "04dbebab91ab85687d33eeaaf9a" ssn 123-45-6789')]
    assert found == ["iban", "secret", "ssn"]
    assert pii.spans_of("DE88 3704 0044 0532 0130 00 and 04dbebab91ab85687d33eeaaf9a and 123-45-6789 of 4845168114407328") == []
    assert pii.redacted("mail a@b.cd now", pii.spans_of("mail a@b.cd now")) == "mail <EMAIL> now"
    near, far = pii.spans_of("server 1.2.3.4")[0], pii.spans_of("version 1.2.3.4")[0]
    assert near[3] > far[3]


def test_pii_of_awkward_rows(spark):
    got = sorted(((r.doc_id, len(r.spans), r.redacted) for r in pii.find_pii(awkward(spark)).collect()), key=repr)
    assert got == sorted(((d, len(pii.spans_of(t or "")), pii.redacted(t or "", pii.spans_of(t or ""))) for d, t, *_ in AWKWARD), key=repr)
    done = pii.redact(awkward(spark)).collect()
    assert len(done) == len(AWKWARD) and sum(r.text is None for r in done) == 1
    assert next(r for r in done if r.doc_id == 8).text.endswith("<PHONE>")
    assert pii.find_pii(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


def test_quality_rules_match_sql(spark, small):
    con = duckdb.connect()
    # the SQL copies a text's words to each of its windows, so the longest one is left to the edge test
    frame = plain(spark).filter("doc_id is null or doc_id <> 6").unionByName(spark.createDataFrame([
        (50, "a b c d e a b c d e a b c d e x y z " * 4, "en", "s", 1), (51, "same line here\nsame line here\n\nother\nsame line here", "de", "s", 1),
        (52, "the of and to in a is that for it was on " * 6, "EN", "s", 1), (53, "der die und " * 30 + "etwas anderes steht hier", None, "s", 1),
    ], SCHEMA))
    con.register("documents", frame.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    got = quality_rules.quality_rules(frame).withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})
    names = sorted(got.columns)
    result = con.execute(queries.ORACLES["op7_quality_rules"])
    at = [[x[0] for x in result.description].index(c) for c in names]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select(names).collect()), key=repr) == want


def test_quality_rules_edges(spark):
    out = quality_rules.quality_rules(awkward(spark)).collect()
    assert len(out) == len(AWKWARD)
    by = {r.doc_id: r for r in out}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[1].kept and by[2].kept and not by[9].kept and by[6].base_failed
    assert by[3].class_distance is None and by[1].word_distance is None
    assert quality_rules.quality_rules(empty(spark)).count() == 0
    plan = quality_rules.judged(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Join", plan)


def test_texts_without_common_words_are_rejected_by_words_alone(spark):
    """Letters at random in sentences of usual shape; the same with common words between them stays."""
    rnd = random.Random(2)

    def text(common):
        made = [rnd.choice(common) if common and rnd.random() < 0.4 else "".join(rnd.choice("bcdfglmnprst") for _ in range(rnd.randrange(4, 9)))
                for _ in range(300)]
        return " ".join(". ".join(" ".join(made[k:k + 12]).capitalize() for k in range(0, 300, 12)).split(" "))

    langs = [*quality_rules.COMMON_WORDS, None]
    rows = [(i, text(None), lang, "s", 1) for i, lang in enumerate(langs)]
    rows += [(10 + i, text(list(quality_rules.COMMON_WORDS[lang or "en"])), lang, "s", 1) for i, lang in enumerate(langs)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(not r.base_failed and r.class_distance <= 0.13 for r in out.values())
    assert {d: r.kept for d, r in out.items()} == {d: d >= 10 for d in out}


def test_quality_rules_against_labels(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    row = quality_rules.quality_rules(docs).filter("not base_failed").join(labels, "doc_id").agg(
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("clean"),
        F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("junk")).first()
    assert row.clean > 0.99 and row.junk < 0.3


def test_label_model_finds_the_accuracies():
    rnd = np.random.default_rng(3)
    n, right = 40_000, np.array([0.95, 0.9, 0.8, 0.85])
    truth = (rnd.random(n) < 0.8).astype(int)
    votes = np.where(rnd.random((n, 4)) < right, truth[:, None], 1 - truth[:, None])
    votes[rnd.random((n, 4)) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    loose = quality_classifier.Settings(prior_share=0.001)
    model = quality_classifier.fit_labels(patterns, counts.astype(float), loose)
    assert model.good == pytest.approx(0.8, abs=0.03) and model.accuracy() == pytest.approx(right, abs=0.03)
    p = {tuple(x): q for x, q in zip(patterns.tolist(), model.posterior(patterns))}
    guess = np.array([p[tuple(v)] > 0.5 for v in votes.tolist()])
    assert (guess == truth).mean() > 0.93


def test_classifier_against_labels(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    row = quality_classifier.classify(docs).join(labels, "doc_id").agg(
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("clean"),
        F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("junk")).first()
    assert row.clean > 0.97 and row.junk < 0.15


def test_classifier_edges(spark):
    out = quality_classifier.classify(awkward(spark)).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 for r in out)
    same = {r.score for r in out if r.doc_id == 1}
    assert len(same) == 1
    kept = quality_classifier.good_documents(awkward(spark))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in out if r.kept)
    assert quality_classifier.classify(empty(spark)).count() == 0 and quality_classifier.good_documents(empty(spark)).count() == 0
