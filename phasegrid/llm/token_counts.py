"""Token counts by rank-synchronous merging of ragged arrays.

The new pre-tokens of a batch lie end to end in one numpy array. A round finds
each sequence's lowest pair rank and merges all its pairs of that rank at once,
left to right where they overlap; sequences without a pair leave. What is left
of a sequence is its count. A merge only makes pairs of higher rank than its
own in vocabularies whose products are used later than they are made, which
``check`` asserts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_vocab import NONE, ByteVocab, Remembered, vocabulary
from .common import id_text, map_rows

#: symbols merged at once
BATCH_SYMBOLS = 1 << 20
BATCH_BYTES = 2 << 20


def check(vocab: ByteVocab) -> None:
    """Merging all pairs of a rank at once equals merging one by one if no pair uses a product of a later rank."""
    rank_of_product = {made: rank for rank, made in enumerate(vocab.product.tolist())}
    for key, rank in vocab.rank_of.items():
        if max(rank_of_product.get(key >> 32, -1), rank_of_product.get(key & 0xFFFFFFFF, -1)) >= rank:
            raise ValueError("a pair ranks before its parts")


def _count(vocab: ByteVocab, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols that survive in each sequence; ``lengths`` are at least 1."""
    counts = lengths.copy()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    ranks = np.full(len(symbols), NONE, np.int32)  # of the pair that begins here

    def rank(at: np.ndarray) -> None:
        at = at[at + 1 < len(symbols)]
        same = owner[at] == owner[at + 1]
        ranks[at[~same]] = NONE
        at = at[same]
        ranks[at] = vocab.ranks(symbols[at], symbols[at + 1])

    rank(np.arange(len(symbols)))
    while len(symbols):
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[start, len(owner)])
        lowest = np.minimum.reduceat(ranks, start)
        counts[owner[start]] = size
        lowest_here = np.repeat(lowest, size)
        live = lowest_here != NONE
        if not live.all():
            symbols, owner, ranks, lowest_here = symbols[live], owner[live], ranks[live], lowest_here[live]
            if not len(symbols):
                break
        hit = np.flatnonzero(ranks == lowest_here)
        first = np.r_[True, np.diff(hit) != 1]  # hits side by side overlap: take every other one
        run = hit[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]
        hit = hit[(hit - run) % 2 == 0]
        symbols[hit] = vocab.product[ranks[hit]]
        stays = np.ones(len(symbols), bool)
        stays[hit + 1] = False
        symbols, owner, ranks = symbols[stays], owner[stays], ranks[stays]
        hit = hit - np.arange(len(hit))
        ranks[hit] = NONE
        rank(np.unique(np.r_[hit, hit[hit > 0] - 1]))
    return counts


def count_pieces(vocab: ByteVocab, pieces: list[str]) -> list[int]:
    """Number of tokens of each pre-token."""
    out, raw, at = [0] * len(pieces), [x.encode() for x in pieces], 0
    while at < len(raw):
        end, total = at, 0
        while end < len(raw) and (end == at or total + len(raw[end]) <= BATCH_SYMBOLS):
            total += len(raw[end])
            end += 1
        lengths = np.fromiter(map(len, raw[at:end]), np.int64, end - at)
        some = np.flatnonzero(lengths)
        counts = _count(vocab, vocab.byte_ids[np.frombuffer(b"".join(raw[at:end]), np.uint8)], lengths[some])
        for i, n in zip(some.tolist(), counts.tolist(), strict=True):
            out[at + i] = n
        at = end
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row.

    A null text is an empty one: no bytes, no tokens. A special string in a text
    is one token. Repeated rows and null ids stay rows of their own; other
    columns go. Empty tables give empty tables.
    """
    text_of = vocabulary(docs.sparkSession, path)
    check(ByteVocab(text_of.value))

    def make():
        vocab = ByteVocab(text_of.value)
        memory = Remembered(vocab, lambda new: count_pieces(vocab, new))

        def step(rows):
            counts = [0] * len(rows["text"])
            for k, found in memory.of(rows["text"], lambda _: 1):
                counts[k] += sum(found)
            return {"doc_id": rows["doc_id"], "n_bytes": [len(x.encode()) for x in rows["text"]], "n_tokens": counts,
                    "over_limit": [n > limit for n in counts]}

        return step

    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return map_rows(id_text(docs, id_col, text_col), make, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
                    arrow, BATCH_BYTES)
