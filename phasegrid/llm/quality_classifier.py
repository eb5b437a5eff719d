"""Quality by weak labels: heuristic labellers, their accuracies by EM, a hashed linear scorer.

Each labeller says good (1), bad (0) or nothing (-1) of a document. Expectation
maximisation over the counts of vote patterns (at most 3 ** labellers of them,
whatever the corpus holds) estimates what each labeller says of good and of bad
documents, and the share of good ones. The posterior of a pattern
is the label of its documents. A logistic scorer over hashed word shapes and
statistics is fitted to those labels on a sample whose size is a parameter, and
scores every document, also those of which the labellers say nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, id_text, map_rows, store
from .quality_rules import COMMON_WORDS

LABELLERS = ("symbols", "capitals", "variety", "common", "odd", "lines")
BUCKETS = 1 << 18
_SHAPES = bytes.maketrans(bytes(range(256)), bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)))
_PLAIN = re.compile(rb"[(\"']?[aA0]+(?:[-'._/:@=][aA0]+)*[.,;:!?)\"']{0,2}")
_SHOUT = re.compile(rb".*[!?]{2}")
_SYMBOLS = b"#*$%&|<>=~^"
_COMMON = frozenset(w.encode() for words in COMMON_WORDS.values() for w in words)


@dataclass(frozen=True)
class Settings:
    fit_rows: int = 20_000  # about how many documents the scorer is fitted on; labels and scores cover all
    em_rounds: int = 200
    good_share: float = 0.85  # before any vote
    bad_says: tuple = (0.5, 0.5)  # bad, good: what a labeller that votes says of a bad document, before any vote
    good_says: tuple = (0.01, 0.99)  # the same of a good one
    prior_share: float = 0.05
    fit_rounds: int = 300
    penalty: float = 1e-4
    threshold: float = 0.5  # documents that score less are rejected


def _vote(value: float, good: float, bad: float) -> int:
    """1 on the good side of ``good``, 0 on the bad side of ``bad``, else -1."""
    up = good > bad
    if (value >= good) if up else (value <= good):
        return 1
    return 0 if ((value <= bad) if up else (value >= bad)) else -1


def describe(text: str) -> tuple[list[int], list[int], list[float]]:
    """Votes in the order of LABELLERS, and the hashed features with their values."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0] * len(LABELLERS), [xxhash.xxh64_intdigest(b"empty") % BUCKETS], [1.0]
    kinds = Counter(words)
    shapes = raw.translate(_SHAPES)
    upper, lower = shapes.count(b"A"), shapes.count(b"a")
    for c in (b"a", b"A", b"0"):
        shapes = re.sub(c + b"{2,}", c, shapes)
    shape = Counter(shapes.split())
    odd = sum(k for s, k in shape.items() if not _PLAIN.fullmatch(s) or _SHOUT.fullmatch(s)) / n
    symbols = (len(raw) - len(raw.translate(None, _SYMBOLS))) / n
    capitals = upper / max(1, upper + lower)
    variety = len(kinds) / n ** 0.5
    common = sum(w in kinds for w in _COMMON) / min(n, 100) ** 0.5
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    long = n >= 30
    votes = [
        _vote(symbols, 0.1, 0.4),
        _vote(capitals, 0.2, 0.5) if upper + lower >= 20 else -1,
        _vote(variety, 3.5, 2.5) if long else -1,
        _vote(common, 0.7, 0.4) if long else -1,
        _vote(odd, 0.1, 0.3),
        _vote(repeated, 0.1, 0.3) if len(lines) >= 3 else -1,
    ]
    values: dict[int, float] = {}

    def add(name: bytes, value: float) -> None:
        k = xxhash.xxh64_intdigest(name) % BUCKETS
        values[k] = values.get(k, 0.0) + value

    for s, k in shape.items():
        add(b"shape " + s, k / n)
    size = b"long" if long else b"short"
    for name, value, step in (("symbols", symbols, 0.1), ("capitals", capitals, 0.1), ("odd", odd, 0.1),
                              ("lines", repeated, 0.1), ("common", common, 0.1), ("variety", variety, 0.5)):
        add(f"{name} {min(20, int(value / step))} ".encode() + size, 0.5)
    add(b"bias", 1.0)
    return votes, list(values), list(values.values())


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, votes, at, value) of every row."""

    def make():
        def step(rows):
            votes, at, value = zip(*map(describe, rows["text"]), strict=True) if rows["text"] else ([], [], [])
            return {"doc_id": rows["doc_id"], "votes": list(votes), "at": list(at), "value": list(value)}

        return step

    arrow = pa.schema([("doc_id", pa.int64()), ("votes", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])
    return map_rows(id_text(docs, id_col, text_col), make, "doc_id bigint, votes array<int>, at array<int>, value array<float>", arrow)


@dataclass
class LabelModel:
    """``table[c, k, v]``: chance that labeller k, if it votes, says v of a document of class c (0 bad, 1 good).

    That a labeller says nothing tells nothing: it was not made for such a document.
    """

    table: np.ndarray
    good: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        each = np.arange(patterns.shape[1])
        bad, good = (np.where(patterns >= 0, np.log(self.table[c][each, np.maximum(patterns, 0)]), 0.0).sum(1) for c in (0, 1))
        odds = np.log(self.good) + good - np.log(1 - self.good) - bad
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    def accuracy(self) -> np.ndarray:
        """How often a vote of each labeller is right."""
        return (1 - self.good) * self.table[0, :, 0] + self.good * self.table[1, :, 1]


def fit_labels(patterns: np.ndarray, counts: np.ndarray, settings: Settings = Settings()) -> LabelModel:
    """Expectation maximisation over vote patterns.

    What is known of labellers before any vote, ``prior``, weighs ``prior_share`` of
    the documents: one seldom calls a good document bad, and often misses a bad one
    whose fault is not its own.
    """
    n = patterns.shape[1]
    prior = np.array([settings.bad_says, settings.good_says])[:, None, :].repeat(n, 1)
    weight = max(1.0, settings.prior_share * counts.sum())
    model = LabelModel(prior, settings.good_share)
    for _ in range(settings.em_rounds):
        q = model.posterior(patterns)
        table = np.empty_like(prior)
        for c, w in ((0, (1 - q) * counts), (1, q * counts)):
            said = np.stack([((patterns == v) * w[:, None]).sum(0) for v in (0, 1)], 1)
            table[c] = (said + weight * prior[c]) / (said.sum(1, keepdims=True) + weight)
        good = float((q @ counts + weight * settings.good_share) / (counts.sum() + weight))
        moved = max(np.abs(table - model.table).max(), abs(good - model.good))
        model = LabelModel(table, good)
        if moved < 1e-9:
            break
    return model


def fit_scorer(at: list[list[int]], value: list[list[float]], target: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Weights of the hashed features: logistic loss on probabilities, adaptive gradient steps over all rows."""
    weights = np.zeros(BUCKETS)
    if not len(target):
        return weights
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    used, col = np.unique(np.concatenate([np.asarray(x, np.int64) for x in at]), return_inverse=True)
    x = np.concatenate([np.asarray(v, np.float64) for v in value])
    w, grown = np.zeros(len(used)), np.full(len(used), 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[col], len(at)), -50, 50)))
        gradient = np.bincount(col, x * (p - target)[row], len(used)) / len(at) + penalty * w
        grown += gradient ** 2
        w -= gradient / np.sqrt(grown)
    weights[used] = w
    return weights


@dataclass
class Scorer:
    """A fitted model: weights of the used buckets (at most BUCKETS), and the posterior of each vote pattern seen."""

    places: np.ndarray
    weights: np.ndarray
    labels: dict

    def dense(self) -> np.ndarray:
        full = np.zeros(BUCKETS)
        full[self.places] = self.weights
        return full


def score(full: np.ndarray, at: list[int], value: list[float]) -> float:
    """The probability of good from hashed features."""
    # features are kept as single floats wherever they are stored
    return float(1 / (1 + np.exp(-np.clip(full[at] @ np.asarray(value, np.float32), -50, 50))))


def fit(seen: DataFrame, settings: Settings = Settings()) -> Scorer:
    """Label model over all rows of ``described`` documents, scorer over about ``fit_rows`` of them."""
    # at most 3 ** 6 patterns
    votes = [tuple(r) for r in seen.groupBy("votes").count().collect()]
    patterns = np.array([v for v, _ in votes], np.int64).reshape(len(votes), len(LABELLERS))
    counts = np.array([n for _, n in votes], np.float64)
    model = fit_labels(patterns, counts, settings)
    label = dict(zip(map(tuple, patterns.tolist()), model.posterior(patterns).tolist(), strict=True))
    # a fixed share by hash; the limit only guards the driver and is twice what the share gives
    share = min(1.0, settings.fit_rows / max(1.0, counts.sum()))
    sample = seen.filter(F.pmod(F.xxhash64("doc_id", "at"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * settings.fit_rows)
    rows = sorted(sample.select("votes", "at", "value").collect(), key=repr)
    target = np.array([label[tuple(r.votes)] for r in rows])
    weights = fit_scorer([r.at for r in rows], [r.value for r in rows], target, settings.fit_rounds, settings.penalty)
    used = np.flatnonzero(weights)
    return Scorer(used.astype(np.int32), weights[used], label)


def classify(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, score, kept) of every row: posterior of the weak labels, the scorer's probability of good, verdict.

    A null text is an empty one, which all labellers call bad. Equal texts
    score alike; repeated rows and null ids stay rows of their own; other columns
    go. Empty tables give empty tables.
    """
    seen = store(described(docs, id_col, text_col), "described")
    sent = docs.sparkSession.sparkContext.broadcast(fit(seen, settings))

    def make():
        scorer = sent.value
        full = scorer.dense()

        def step(rows):
            scores = [score(full, a, v) for a, v in zip(rows["at"], rows["value"], strict=True)]
            return {"doc_id": rows["doc_id"], "label": [scorer.labels[tuple(v)] for v in rows["votes"]], "score": scores,
                    "kept": [s >= settings.threshold for s in scores]}

        return step

    arrow = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])
    return map_rows(seen, make, "doc_id bigint, label double, score double, kept boolean", arrow)


def good_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The columns of documents for the rows that ``classify`` keeps, untouched.

    The model is fitted on one pass over the texts and applied in a second one,
    so whole rows are never shuffled or joined.
    """
    fitted = fit(store(described(docs), "described"), settings)
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def make():
        full = sent.value.dense()

        def step(rows):
            keep = []
            for i, t in enumerate(rows["text"]):
                _, at, value = describe(t or "")
                if score(full, at, value) >= settings.threshold:
                    keep.append(i)
            return {c: [v[i] for i in keep] for c, v in rows.items()}

        return step

    kinds = {"bigint": pa.int64(), "string": pa.string()}
    narrow = docs.select(*[F.col(c).cast(k).alias(c) for c, k in DOCUMENT_COLUMNS.items()])
    return map_rows(narrow, make, ", ".join(f"{c} {k}" for c, k in DOCUMENT_COLUMNS.items()), pa.schema([(c, kinds[k]) for c, k in DOCUMENT_COLUMNS.items()]))
