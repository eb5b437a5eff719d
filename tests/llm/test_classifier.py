"""Every row of the classifier against a plain version: votes, EM document by document, and the scorer in dictionaries."""

import math
import re
from collections import Counter

import pytest
import xxhash

from phasegrid.llm import quality_classifier, queries
from phasegrid.llm.quality_rules import COMMON_WORDS

from .cases import AWKWARD, plain

FIT = quality_classifier.Settings(fit_rounds=60)
COMMON = {w for words in COMMON_WORDS.values() for w in words}
ORDINARY = re.compile(r"[(\"']?[aA0]+([-'._/:@=][aA0]+)*[.,;:!?)\"']{0,2}")


def single(x):
    """The nearest single-precision number: what is stored of a feature."""
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


def shape_of(word):
    out = ""
    for c in word:
        kind = "a" if c in "abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c
        if not (kind in "aA0" and out.endswith(kind)):
            out += kind
    return out


def seen(text):
    """(votes, {bucket: value}) of a text."""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    n = len(words)
    if n == 0:
        return [0] * 6, {xxhash.xxh64_intdigest(b"empty") % 2**18: 1.0}
    shapes = [shape_of(w) for w in words]
    strange = [s for s in shapes if not ORDINARY.fullmatch(s) or len(s) > 1 and s[-1] in "!?" and s[-2] in "!?"]
    upper = sum("A" <= c <= "Z" for c in text)
    lower = sum("a" <= c <= "z" for c in text) + sum(len(c.encode()) for c in text if ord(c) > 127)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    value = {
        "symbols": sum(c in "#*$%&|<>=~^" for c in text) / n,
        "capitals": upper / max(1, upper + lower),
        "variety": len(set(words)) / n ** 0.5,
        "common": len(COMMON & set(words)) / min(n, 100) ** 0.5,
        "odd": len(strange) / n,
        "lines": 1 - len(set(lines)) / len(lines),
    }
    # (good up to or from, bad from or up to, whether it may vote)
    rules = {"symbols": (0.1, 0.4, True), "capitals": (0.2, 0.5, upper + lower >= 20), "variety": (3.5, 2.5, n >= 30),
             "common": (0.7, 0.4, n >= 30), "odd": (0.1, 0.3, True), "lines": (0.1, 0.3, len(lines) >= 3)}
    votes = []
    for name, (good, bad, may) in rules.items():
        x = value[name] if good > bad else -value[name]
        good, bad = (good, bad) if good > bad else (-good, -bad)
        votes.append(-1 if not may else 1 if x >= good else 0 if x <= bad else -1)
    features = Counter()
    for s, k in Counter(shapes).items():
        features["shape " + s] += k / n
    for name, x in value.items():
        step = 0.5 if name == "variety" else 0.1
        features[f"{name} {min(20, int(x / step))} {'long' if n >= 30 else 'short'}"] += 0.5
    features["bias"] += 1.0
    buckets = Counter()
    for name, x in features.items():
        buckets[xxhash.xxh64_intdigest(name.encode()) % 2**18] += x
    return votes, dict(buckets)


def labels_of(votes, settings):
    """The probability of good of each document, by EM over documents."""
    says = [[list(settings.bad_says) for _ in range(6)], [list(settings.good_says) for _ in range(6)]]
    good = settings.good_share
    weight = max(1.0, settings.prior_share * len(votes))

    def posterior():
        found = {}
        for v in set(map(tuple, votes)):
            yes, no = good, 1 - good
            for k, x in enumerate(v):
                if x >= 0:
                    yes *= says[1][k][x]
                    no *= says[0][k][x]
            found[v] = yes / (yes + no)
        return [found[tuple(v)] for v in votes]

    for _ in range(settings.em_rounds):
        q = posterior()
        before = [x for c in says for k in c for x in k] + [good]
        for c, prior in ((0, settings.bad_says), (1, settings.good_says)):
            for k in range(6):
                said = [sum((p if c else 1 - p) for p, v in zip(q, votes) if v[k] == x) for x in (0, 1)]
                says[c][k] = [(said[x] + weight * prior[x]) / (sum(said) + weight) for x in (0, 1)]
        good = (sum(q) + weight * settings.good_share) / (len(votes) + weight)
        if max(abs(a - b) for a, b in zip(before, [x for c in says for k in c for x in k] + [good])) < 1e-9:
            break
    return posterior()


def scores_of(rows, targets, settings):
    """The scorer's probability of each row of {bucket: value}, fitted to all of them."""
    rows = [{b: single(x) for b, x in r.items()} for r in rows]
    used = {b for r in rows for b in r}
    w, grown = dict.fromkeys(used, 0.0), dict.fromkeys(used, 1e-8)

    def probability(r):
        return 1 / (1 + math.exp(-max(-50, min(50, sum(x * w[b] for b, x in r.items())))))

    for _ in range(settings.fit_rounds):
        slope = dict.fromkeys(used, 0.0)
        for r, t in zip(rows, targets):
            miss = probability(r) - t
            for b, x in r.items():
                slope[b] += x * miss
        for b in used:
            g = slope[b] / len(rows) + settings.penalty * w[b]
            grown[b] += g * g
            w[b] -= g / math.sqrt(grown[b])
    return [probability(r) for r in rows]


def test_every_row_equals_the_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionAll(plain(spark).select("doc_id", "text"))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    votes, features = zip(*[seen(t) for _, t in texts])
    labels = labels_of(votes, FIT)
    scores = scores_of(features, labels, FIT)
    want = sorted(((d if d is not None else -1), a, b) for (d, _), a, b in zip(texts, labels, scores))
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.label, r.score, r.kept) for r in quality_classifier.classify(docs, FIT).collect())
    assert len(got) == len(want) > len(AWKWARD)
    for (d, label, score, kept), (e, own_label, own_score) in zip(got, want):
        assert d == e and label == pytest.approx(own_label, abs=1e-7) and score == pytest.approx(own_score, abs=1e-6)
        assert kept == (own_score >= FIT.threshold) or abs(own_score - FIT.threshold) < 1e-6


def test_votes_and_features_of_all_texts(spark, small):
    for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect() + [r for r in plain(spark).select("text").collect()]:
        votes, at, value = quality_classifier.describe(r.text or "")
        own_votes, own = seen(r.text or "")
        assert votes == own_votes and dict(zip(at, value)) == pytest.approx(own)


def test_the_query_is_the_operator(spark, small):
    got = queries.QUERIES["op3_quality_classifier"](spark, small)
    own = quality_classifier.classify(spark.read.parquet(f"{small}/documents.parquet"))
    assert sorted((r.doc_id, r.kept) for r in got.collect()) == sorted((r.doc_id, r.kept) for r in own.collect())
