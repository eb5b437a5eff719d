"""Language-model scores by prediction by partial matching over bytes, trained on the corpus.

The model is the trie of byte contexts up to ``order`` with the counts of what
followed them in the training documents. A symbol unseen after a context costs
an escape (as many escapes as distinct followers, method C), then the next
shorter context is asked, whose followers already ruled out are excluded; the
last resort is uniform over what is left. So the probabilities after any
context sum to one over 256 bytes and the end of a text.

The trie of a large corpus fits nowhere. Texts are therefore taken in chunks of
some megabytes; each chunk sends its distinct sequences of ``order`` + 1
symbols, with their training counts, to the tables of the trie and gets back
the code length of just these. What is shuffled is a fraction of the text,
grows with it, and no task holds more than a chunk and its own part of the
model. The same way serves the token counts of the base score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, store

ORDER = 4
END, START = 256, 257
WIDTH = 9  # bits of a symbol in a packed sequence
SYMBOLS = 257  # that can be coded
CHUNK_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
#: stands for the end among words, which hold no white space
END_WORD = "\n"


def _sequences(texts: list[bytes], order: int) -> np.ndarray:
    """Packed sequences of order + 1 symbols, one for each byte and one for the end of each text, in order."""
    size = np.fromiter((order + len(t) + 1 for t in texts), np.int64, len(texts))
    flat = np.full(size.sum(), START, np.int64)
    begin = np.cumsum(size) - size
    inside = np.ones(len(flat), bool)
    for k in range(order):
        inside[begin + k] = False
    end = begin + size - 1
    flat[end] = END
    inside_text = inside.copy()
    inside_text[end] = False
    flat[inside_text] = np.frombuffer(b"".join(texts), np.uint8)
    packed = flat.copy()
    for k in range(1, order + 1):
        packed[k:] |= flat[:-k] << (WIDTH * k)
    return packed[inside]


_PACK = "chunk bigint, doc_id array<bigint>, held_out array<boolean>, size array<bigint>, texts binary"
_PACK_ARROW = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                         ("size", pa.list_(pa.int64())), ("texts", pa.binary())])


def _chunked(docs: DataFrame, held_out: Column, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Lower-case texts in packs of some SLICE_BYTES, compressed; a chunk has consecutive packs of one task."""
    narrow = id_text(docs, id_col, text_col).withColumn("held_out", held_out)

    def run(batches):
        chunk, total, held = TaskContext.get().partitionId() << 32, 0, []
        compress = zstandard.ZstdCompressor(level=3).compress

        def pack():
            ids, flags, texts = zip(*held, strict=True)
            return pa.RecordBatch.from_pydict({
                "chunk": [chunk], "doc_id": [list(ids)], "held_out": [list(flags)], "size": [[len(t) for t in texts]],
                "texts": [compress(b"".join(texts))]}, schema=_PACK_ARROW)

        slice_bytes, pending = min(SLICE_BYTES, chunk_bytes), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pydict()
                for i, h, t in zip(rows["doc_id"], rows["held_out"], rows["text"], strict=True):
                    t = t.encode().lower()
                    if held and pending + len(t) > slice_bytes:
                        yield pack()
                        total, held, pending = total + pending, [], 0
                        if total + len(t) > chunk_bytes:
                            chunk, total = chunk + 1, 0
                    held.append((i, h, t))
                    pending += len(t) + 1
        if held:
            yield pack()

    return narrow.mapInArrow(run, _PACK)


def _unpacked(row: dict) -> list[bytes]:
    data, at, out = zstandard.ZstdDecompressor().decompress(row["texts"]), 0, []
    for n in row["size"]:
        out.append(data[at:at + n])
        at += n
    return out


def _by_chunk(batches) -> Iterator[tuple[int, list[bytes], list[bool]]]:
    """(chunk, texts, held out) of each pack."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            yield row["chunk"], _unpacked(row), row["held_out"]


def _sequence_counts(chunks: DataFrame, order: int) -> DataFrame:
    """(chunk, seq, n): training count of each distinct sequence in a chunk, 0 where only held-out texts have it."""
    arrow = pa.schema([("chunk", pa.int64()), ("seq", pa.int64()), ("n", pa.int64())])

    def run(batches):
        def out(chunk, seq, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(seq), chunk)), pa.array(seq), pa.array(n)], schema=arrow)

        def merged(parts):
            seq, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.zeros(len(seq), np.int64)
            np.add.at(n, where, np.concatenate([p[1] for p in parts]))
            return seq, n

        last, parts = None, []
        for chunk, texts, flags in _by_chunk(batches):
            if parts and chunk != last:
                yield out(last, *merged(parts))
                parts = []
            last = chunk
            for held in (True, False):
                some = [t for t, h in zip(texts, flags, strict=True) if h == held]
                if some:
                    seq, n = np.unique(_sequences(some, order), return_counts=True)
                    parts.append((seq, np.zeros_like(n) if held else n))
            if len(parts) > 8:
                parts = [merged(parts)]
        if parts:
            yield out(last, *merged(parts))

    return chunks.mapInArrow(run, "chunk bigint, seq bigint, n bigint")


def _word_counts(chunks: DataFrame) -> DataFrame:
    """(chunk, word, n): training count of each distinct word in a chunk; the end of a text is END_WORD."""
    arrow = pa.schema([("chunk", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        def out(chunk, counts):
            return pa.RecordBatch.from_pydict(
                {"chunk": [chunk] * len(counts), "word": list(counts), "n": list(counts.values())}, schema=arrow)

        last, counts = None, Counter()
        for chunk, texts, flags in _by_chunk(batches):
            if counts and chunk != last:
                yield out(last, counts)
                counts = Counter()
            last = chunk
            for t, held in zip(texts, flags, strict=True):
                words = [*t.split(), END_WORD.encode()]
                if held:
                    for w in words:
                        counts.setdefault(w, 0)
                else:
                    counts.update(words)
        if counts:
            yield out(last, counts)

    return chunks.mapInArrow(run, "chunk bigint, word binary, n bigint")


def code_lengths(sequences: DataFrame, order: int) -> DataFrame:
    """(seq, log10p) of each distinct sequence from the training counts ``n`` of (seq, n).

    The tables of level k hold sequences of k context symbols and one more. A
    level's row needs only its context's totals and the row one level below.
    """
    levels = [sequences.groupBy("seq").agg(F.sum("n").alias("n"))]
    for k in range(order - 1, -1, -1):
        mask = (1 << WIDTH * (k + 1)) - 1
        levels.append(levels[-1].withColumn("seq", F.col("seq").bitwiseAND(F.lit(mask))).groupBy("seq").agg(F.sum("n").alias("n")))
    seen = F.col("n") > 0
    context = Window.partitionBy(F.shiftright("seq", WIDTH))
    totals = {"t": F.sum("n").over(context), "q": F.sum(seen.cast("bigint")).over(context)}
    below = None
    for k, level in enumerate(reversed(levels)):
        if below is None:  # one context of SYMBOLS rows at most
            rows = level.withColumns(totals)
            rest = F.greatest(F.lit(SYMBOLS) - F.col("q"), F.lit(1)).cast("double")
            rows = rows.withColumn("down", -F.log10(rest))
        else:
            mask = (1 << WIDTH * k) - 1
            low = below.select(F.col("seq").alias("low"), F.col("n").alias("n1"), F.col("t").alias("t1"),
                               F.col("q").alias("q1"), F.col("down").alias("d1"))
            rows = level.withColumn("low", F.col("seq").bitwiseAND(F.lit(mask))).join(low, "low")
            rows = rows.withColumns(totals | {"e": F.sum(F.when(seen, F.col("n1")).otherwise(0)).over(context)})
            left = (F.col("t1") - F.col("e") + F.col("q1") - F.col("q")).cast("double")
            escape = F.when(F.col("q1") > F.col("q"), F.log10(F.try_divide(F.col("q1") - F.col("q"), left))).otherwise(0.0)
            # asked of rows without a count only: what is left is then above zero
            rows = rows.withColumn("down", F.when(F.col("n1") > 0, F.log10(F.try_divide("n1", left))).otherwise(escape + F.col("d1")))
        below = rows.select("seq", "n", "t", "q", "down")
    total = (F.col("t") + F.col("q")).cast("double")
    escape = F.when(F.col("t") > 0, F.log10(F.try_divide("q", total))).otherwise(0.0)
    return below.select("seq", F.when(seen, F.log10(F.try_divide("n", total))).otherwise(escape + F.col("down")).alias("log10p"))


_RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, known double, score double"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                           ("known", pa.float64()), ("score", pa.float64())])


def _scored(order: int):
    def run(texts: pa.Table, model: pa.Table) -> pa.Table:
        of_seq = model.filter(pc.is_valid(model["seq"]))
        seq, cost = of_seq["seq"].to_numpy(), of_seq["value"].to_numpy()
        by = np.argsort(seq)
        seq, cost = seq[by], cost[by]
        of_word = model.filter(pc.is_valid(model["word"]))
        word = dict(zip(of_word["word"].to_pylist(), of_word["value"].to_pylist(), strict=True))
        rows: dict[str, list] = {"doc_id": [], "held_out": []}
        score: list[float] = []
        n_tokens, n_known, known = [], [], []
        end = END_WORD.encode()
        for pack in texts.to_pylist():
            raw = _unpacked(pack)
            rows["doc_id"] += pack["doc_id"]
            rows["held_out"] += pack["held_out"]
            found = cost[np.searchsorted(seq, _sequences(raw, order))]
            size = np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw))
            score += np.add.reduceat(found, np.cumsum(size) - size).tolist()
            for t in raw:
                words = [*t.split(), end]
                values = [v for v in map(word.get, words) if v is not None]
                n_tokens.append(len(words))
                n_known.append(len(values))
                known.append(float(np.sum(values)) if values else 0.0)
        return pa.Table.from_pydict(rows | {"n_tokens": n_tokens, "n_known": n_known, "known": known, "score": score}, schema=_RESULT_ARROW)

    return run


def is_held_out(id_col: str = "doc_id", folds: int = 10) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def lm_scores(docs: DataFrame, order: int = ORDER, held_out: Column | None = None, id_col: str = "doc_id",
              text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` is a boolean column over (doc_id, text); the rows where it is
    not true train the model. A null text is an empty one: one token, its end.
    Repeated rows train and are scored each. Without training rows the model is
    uniform. Other columns go. Empty tables give empty tables. Memory follows
    ``chunk_bytes`` or the longest text.
    """
    if not 1 <= order <= 6:
        raise ValueError("an order of 1 to 6 fits into a packed sequence")
    flag = F.coalesce(is_held_out() if held_out is None else held_out, F.lit(False))
    chunks = store(_chunked(docs, flag, id_col, text_col, chunk_bytes), "chunks")
    words = Window.partitionBy("word")
    counted = store(
        _word_counts(chunks).select("chunk", "word", F.sum("n").over(words).alias("c"),
                                    (F.row_number().over(words.orderBy("chunk")) == 1).alias("first"))
        .filter("c > 0"), "words")
    n, v = counted.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    sequences = store(_sequence_counts(chunks, order), "sequences")
    costs = store(code_lengths(sequences, order), "costs")
    model = sequences.join(costs, "seq").select("chunk", "seq", F.lit(None).cast("binary").alias("word"), F.col("log10p").alias("value"))
    model = model.unionAll(counted.select("chunk", F.lit(None).cast("bigint"), "word", F.log10(F.col("c") + 0.1)))
    out = chunks.groupBy("chunk").cogroup(model.groupBy("chunk")).applyInArrow(_scored(order), _RESULT)
    unknown = F.lit(float(np.log10(0.1)))
    base = F.col("known") + (F.col("n_tokens") - F.col("n_known")) * unknown - F.col("n_tokens") * F.lit(float(np.log10(n + 0.1 * (v + 1))))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
