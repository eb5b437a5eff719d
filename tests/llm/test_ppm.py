"""LM scores against a trie built symbol by symbol."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from phasegrid.llm import ppm


class Trie:
    """Counts of followers of every context up to ``order``, asked as the definition says."""

    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            s = [ppm.START] * order + list(t) + [ppm.END]
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.after[tuple(s[i - k:i])][s[i]] += 1

    def p(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            found = {s: n for s, n in self.after.get(tuple(context[len(context) - k:]), {}).items() if s not in excluded}
            total = sum(found.values()) + len(found)
            if symbol in found:
                return out * found[symbol] / total
            if found:
                out *= len(found) / total
            excluded |= found.keys()
        return out / (ppm.SYMBOLS - len(excluded))

    def score(self, t):
        s = [ppm.START] * self.order + list(t) + [ppm.END]
        return sum(math.log10(self.p(s[i - self.order:i], s[i])) for i in range(self.order, len(s)))


TEXTS = ["the cat sat on the mat", "The cat SAT", "", None, "abababab", "é ü 中", "the cat sat on the mat", " \n\t ", "zzz qqq " * 40,
         *[f"w{i} of the {i * 7 % 13} cats and {i % 5} dogs" for i in range(40)]]


def brute(rows, order):
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    texts = [(t or "").encode().lower() for _, t in rows]
    train = [t for t, h in zip(texts, held) if not h]
    trie, c = Trie(train, order), Counter()
    for t in train:
        c.update([*t.split(), b"\n"])
    n, v = sum(c.values()), len(c)
    out = []
    for (d, _), h, t in zip(rows, held, texts):
        w = [*t.split(), b"\n"]
        out.append((d, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), trie.score(t)))
    return out


@pytest.mark.parametrize("order,chunk", [(4, 1 << 20), (2, 60)])
def test_scores_match_the_trie(spark, order, chunk):
    rows = [(i if i != 7 else None, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as chunk", "1 as score", "2 as n")
    got = sorted((tuple(r) for r in ppm.lm_scores(df, order=order, chunk_bytes=chunk).collect()), key=repr)
    want = sorted(brute(rows, order), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_probabilities_sum_to_one():
    trie = Trie([b"abracadabra", b"abc", b"cab"], 3)
    for context in (b"abr", b"xyz", b"cab", b"zza"):
        assert sum(trie.p(list(context), s) for s in range(ppm.SYMBOLS)) == pytest.approx(1)


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert ppm.lm_scores(none).count() == 0
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    row = ppm.lm_scores(df, held_out=F.lit(True)).first()
    assert row.score == pytest.approx(-3 * math.log10(257)) and row.base_score == pytest.approx(0) and row.n_known == 0


def test_better_than_words_on_held_out_texts(spark, small):
    """Bytes beat the smoothed words where words are new, which is what held-out texts are full of."""
    from pyspark.sql import functions as F

    out = ppm.lm_scores(spark.read.parquet(f"{small}/documents.parquet")).filter("held_out")
    row = out.agg(F.sum("score").alias("s"), F.sum(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).first()
    assert row.n > 0 and row.s / row.t > -9
