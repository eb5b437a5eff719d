"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token has a tree whose leaves are the ranks of its adjacent pairs,
joined with their places, and whose nodes are minima. The root is the leftmost
pair of the lowest rank. A merge changes three leaves at most, each in
logarithmically many nodes, and the pre-token is done when the root is empty.
Trees of one size are kept as rows of one array and move in step; a long
pre-token has a tree of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_vocab import NONE, ByteVocab, Remembered, vocabulary
from .common import id_text, map_rows

EMPTY = np.int64(np.iinfo(np.int64).max)
#: leaves of the largest trees that move in step; larger ones are merged one by one
STEP_LEAVES = 64
#: tree nodes held at once
STEP_NODES = 1 << 20
#: bytes of text a call works on
BATCH_BYTES = 2 << 20


class _Trees:
    """Minimum trees of equal size for many pre-tokens, as one flat array."""

    def __init__(self, leaves: np.ndarray):
        n, self.width = leaves.shape
        self.nodes = np.full((n, 2 * self.width), EMPTY)
        self.nodes[:, self.width:] = leaves
        k = self.width
        while k > 1:
            self.nodes[:, k // 2:k] = np.minimum(self.nodes[:, k:2 * k:2], self.nodes[:, k + 1:2 * k:2])
            k //= 2
        self.flat = self.nodes.reshape(-1)

    def roots(self) -> np.ndarray:
        return self.nodes[:, 1]

    def put(self, rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
        base, at = rows * (2 * self.width), places + self.width
        self.flat[base + at] = values
        for _ in range(self.width.bit_length() - 1):
            at >>= 1
            below = base + 2 * at
            self.flat[base + at] = np.minimum(self.flat[below], self.flat[below + 1])


def _merge_in_step(vocab: ByteVocab, symbols: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Merge rows of symbols (padded to width + 1 places); places that vanish become -1."""
    n, places = symbols.shape
    sym = np.hstack([symbols, np.full((n, 1), -1, np.int32)])  # the last column takes writes beyond the end
    after = np.minimum(np.arange(1, places + 2), lengths[:, None])  # the place of the next symbol, or the length
    before = np.tile(np.arange(-1, places), (n, 1))

    def leaf(left, right, place):
        rank = vocab.ranks(left, right)
        found = (rank != NONE) & (left >= 0) & (right >= 0)
        return np.where(found, rank.astype(np.int64) * width + place, EMPTY)

    trees = _Trees(leaf(sym[:, :width], sym[:, 1:width + 1], np.arange(width)))
    rows = np.flatnonzero(trees.roots() != EMPTY)
    while len(rows):
        root = trees.roots()[rows]
        place = root % width
        right = after[rows, place]
        beyond = after[rows, right]
        made = vocab.product[root // width]
        sym[rows, place] = made
        sym[rows, right] = -1
        after[rows, place] = beyond
        before[rows, beyond] = place
        ends = beyond >= lengths[rows]
        trees.put(rows, place, np.where(ends, EMPTY, leaf(made, sym[rows, np.where(ends, places, beyond)], place)))
        inner = right < width
        trees.put(rows[inner], right[inner], np.full(inner.sum(), EMPTY))
        left = before[rows, place]
        inner = left >= 0
        trees.put(rows[inner], left[inner], leaf(sym[rows[inner], left[inner]], made[inner], left[inner]))
        rows = rows[trees.roots()[rows] != EMPTY]
    return sym[:, :places]


def _merge_alone(vocab: ByteVocab, symbols: list[int]) -> list[int]:
    """The same for one long pre-token, with a tree of its own."""
    n = len(symbols)
    width = 1 << (n - 1).bit_length()
    none = 1 << 62
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(i: int) -> int:
        rank = vocab.rank_of.get(sym[i] << 32 | sym[after[i]]) if after[i] < n else None
        return none if rank is None else rank * width + i

    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = leaf(i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    while tree[1] != none:
        rank, i = divmod(tree[1], width)
        gone = after[i]
        sym[i], after[i] = int(vocab.product[rank]), after[gone]
        sym[gone] = -1
        if after[i] < n:
            before[after[i]] = i
        put(gone, none)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    return [s for s in sym if s >= 0]


def merge_pieces(vocab: ByteVocab, pieces: list[str]) -> list[bytes]:
    """Ids of each pre-token as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    raw = [x.encode() for x in pieces]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    width = 1
    todo = size > 0
    while width <= STEP_LEAVES and todo.any():
        fit = np.flatnonzero(todo & (size <= width + 1))
        todo[fit] = False
        step = max(1, STEP_NODES // (2 * width))
        for at in range(0, len(fit), step):
            part = fit[at:at + step]
            lengths = size[part]
            inside = np.arange(width + 1) < lengths[:, None]
            symbols = np.full(inside.shape, -1, np.int32)
            symbols[inside] = vocab.byte_ids[np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)]
            merged = _merge_in_step(vocab, symbols, lengths, width)
            left = merged >= 0
            flat = merged[left].astype("<u4").tobytes()
            end = 4 * np.cumsum(left.sum(1))
            start = end - 4 * left.sum(1)
            for i, a, b in zip(part.tolist(), start.tolist(), end.tolist(), strict=True):
                out[i] = flat[a:b]
        width *= 2
    for i in np.flatnonzero(todo).tolist():
        ids = _merge_alone(vocab, vocab.byte_ids[np.frombuffer(raw[i], np.uint8)].tolist())
        out[i] = np.array(ids, "<u4").tobytes()
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) per row; ``ids`` are packed little-endian unsigned 32-bit integers.

    A null text is an empty one and has no ids. Special strings in a text get
    their own ids. Repeated rows and null ids stay rows of their own; other
    columns go. Empty tables give empty tables. Memory follows the longest text.
    """
    text_of = vocabulary(docs.sparkSession, path)

    def make():
        vocab = ByteVocab(text_of.value)
        memory = Remembered(vocab, lambda new: merge_pieces(vocab, new))

        def step(rows):
            ids: list[list[bytes]] = [[] for _ in rows["text"]]
            for k, found in memory.of(rows["text"], lambda i: np.uint32(i).astype("<u4").tobytes()):
                ids[k].append(b"".join(found))
            packed = [b"".join(x) for x in ids]
            return {"doc_id": rows["doc_id"], "n_tokens": [len(x) // 4 for x in packed], "ids": packed}

        return step

    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    return map_rows(id_text(docs, id_col, text_col), make, "doc_id bigint, n_tokens bigint, ids binary", arrow, BATCH_BYTES)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) of packed ids; broken UTF-8 gives U+FFFD, null ids an empty text, unknown ids an error."""
    text_of = vocabulary(encoded.sparkSession, path)

    def make():
        token = ByteVocab(text_of.value).tokens.__getitem__

        def step(rows):
            texts = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace")
                     for x in rows["ids"]]
            return rows | {"text": texts}

        return step

    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])
    narrow = encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_rows(narrow, make, "doc_id bigint, ids binary, text string", arrow, BATCH_BYTES)
