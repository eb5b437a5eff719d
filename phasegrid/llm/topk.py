"""Exact top-k inner products by no-random-access aggregation.

Rows are cut into blocks; a block keeps, for each dimension, its rows sorted by
that component. A query reads all lists of a block in step, from the end where
its own component makes the products largest, and keeps for each row a lower
and an upper bound of the score: what was read, plus the least or the most that
the unread lists can still give. It stops when so few rows can still reach the
k-th lower bound, or the k-th score of earlier blocks, that their scores are
resolved. Query groups meet row groups in cells, of bounded size on both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
GROUP_BLOCKS = 16
#: parts of the lists after which bounds are compared
DEPTHS = (0.65, 0.8, 1.0)
#: rows that may be left when scores are resolved, besides k
FINALISTS = 32
#: queries whose bounds over a block are held at once
TOGETHER = 256

_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("size", pa.int32()), ("values", pa.binary())])


def _clean(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): whole components; rows with a null id, a null vector or a component that is null or not finite go."""
    x = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull())
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(~bad).select("id", F.transform("x", lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` consecutive rows of a task; shorter vectors end in zeros."""

    def block(number, ids, vectors):
        width = max(map(len, vectors))
        v = np.zeros((len(vectors), width), np.int64)
        for i, x in enumerate(vectors):
            v[i, :len(x)] = x
        return pa.RecordBatch.from_pydict({"block": [number], "ids": [np.asarray(ids, np.int64).tobytes()], "size": [width],
                                           "values": [v.tobytes()]}, schema=_BLOCK)

    def run(batches):
        number, ids, vectors = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size).to_pydict()
                ids += part["id"]
                vectors += part["v"]
                while len(ids) >= size:
                    yield block(number, ids[:size], vectors[:size])
                    number, ids, vectors = number + 1, ids[size:], vectors[size:]
        if ids:
            yield block(number, ids, vectors)

    return rows.mapInArrow(run, "block bigint, ids binary, size int, values binary")


class Lists:
    """A block's rows by component: ``sorted[d]`` has the values of component d from the largest to the smallest."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.dense = values.astype(np.float64)
        self.sorted = -np.sort(-self.dense, axis=0).T

    def bounds(self, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows after ``to`` entries of every list: most and least of a component, for lists read from the largest and from the smallest.

        What was read counts as it is, anything unread as the last entry read or as the end of the list.
        """
        down, up = self.sorted[:, to - 1], self.sorted[:, -to]
        return (np.maximum(self.dense, down), np.minimum(self.dense, up),
                np.where(self.dense >= down, self.dense, self.sorted[:, -1]), np.where(self.dense <= up, self.dense, self.sorted[:, 0]))

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, scores) that can be among the k best and reach its ``floor``, best first, ties to smaller ids.

        The bounds of all queries at a depth are two products of matrices. Where
        earlier blocks have given k scores, the lower bounds of this one are not needed.
        """
        n = len(self.ids)
        width = min(queries.shape[1], self.values.shape[1])
        q = queries[:, :width].astype(np.float64)
        plus, minus = np.maximum(q, 0).T, np.minimum(q, 0).T
        ends = np.maximum(np.abs(self.sorted[:width, 0]), np.abs(self.sorted[:width, -1]))
        slack = 1e-9 * (np.abs(q) @ ends) / max(1, n)  # whole numbers below 2**53 need none
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        open_, done = np.arange(len(q)), 0
        for depth in DEPTHS:
            to = max(done + 1, int(n * depth)) if depth < 1 else n
            if to <= done or not len(open_):
                continue
            done = to
            most_down, most_up, least_down, least_up = (x[:, :width] for x in self.bounds(to))
            itself = self.ids[:, None] == own[open_]
            reach = floor[open_].copy()
            if (new := np.flatnonzero(reach == -np.inf)).size and n >= k:
                at = open_[new]
                lower = least_down @ plus[:, at] + least_up @ minus[:, at]
                lower[itself[:, new]] = -np.inf
                reach[new] = np.partition(lower, n - k, axis=0)[n - k]
            can = most_down @ plus[:, open_] + most_up @ minus[:, open_] + slack[open_] >= reach
            can &= ~itself
            few = can.sum(0) <= (k + FINALISTS if to < n else n)
            for j in np.flatnonzero(few).tolist():
                left, i = np.flatnonzero(can[:, j]), open_[j]
                score = self.values[left][:, :width] @ queries[i, :width]
                by = np.lexsort((self.ids[left], -score))[:k]
                out[i] = self.ids[left][by], score[by]
            open_ = open_[~few]
        return out


_CELL = pa.schema([("query", pa.int64()), ("place", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _cell(k: int):
    def unpack(row):
        ids = np.frombuffer(row["ids"], np.int64)
        return ids, np.frombuffer(row["values"], np.int64).reshape(len(ids), row["size"])

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in _CELL.names}
        asked = [(r["block"], *unpack(r)) for r in queries.to_pylist()]
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for row in blocks.to_pylist():
            lists = Lists(*unpack(row))
            for number, ids, values in asked:
                for at in range(0, len(ids), TOGETHER):
                    some = range(at, min(at + TOGETHER, len(ids)))
                    had = [best.get((number, i)) for i in some]
                    floor = np.array([float(x[1][-1]) if x is not None and len(x[1]) == k else -np.inf for x in had])
                    for i, old, (found, score) in zip(some, had, lists.best(values[at:some.stop], ids[at:some.stop], k, floor), strict=True):
                        if old is not None:
                            found, score = np.r_[old[0], found], np.r_[old[1], score]
                            by = np.lexsort((found, -score))[:k]
                            found, score = found[by], score[by]
                        best[number, i] = found, score
        own_ids = {(number, i): own for number, ids, _ in asked for i, own in enumerate(ids.tolist())}
        for (number, i), (found, score) in best.items():
            out["query"] += [own_ids[number, i]] * len(found)
            out["place"] += [number * QUERY_ROWS + i] * len(found)
            out["vec_id"] += found.tolist()
            out["score"] += score.tolist()
        return pa.Table.from_pydict(out, schema=_CELL)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every query row, all rows but its own being candidates.

    ``queries`` is a condition over ``vectors``. Components are floor(scale * x).
    Ties go to the smaller id. A null vector or id, and a vector with a null or
    non-finite component, takes no part. A shorter vector counts as ending in
    zeros. A row with the query's id is its own. Repeated rows are candidates
    each; query rows that agree in id and vector are one query. Fewer candidates
    than k give them all; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = store(_packed(_clean(vectors, id_col, vector_col, scale), BLOCK_ROWS), "lists")
    asked = _clean(vectors.filter(queries), id_col, vector_col, scale).distinct()
    asked = store(_packed(asked, QUERY_ROWS), "queries")
    blocks = rows.count()
    row_groups = max(-(-blocks // GROUP_BLOCKS), min(blocks, spark.sparkContext.defaultParallelism), 1)
    asked_rows = asked.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 1
    query_groups = max(1, -(-int(asked_rows) // QUERY_ROWS))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.withColumn("rg", dealt(row_groups)).withColumn("qg", every(query_groups))
    right = asked.withColumn("qg", dealt(query_groups)).withColumn("rg", every(row_groups))
    found = left.groupBy("rg", "qg").cogroup(right.groupBy("rg", "qg")).applyInArrow(_cell(k), "query bigint, place bigint, vec_id bigint, score bigint")
    ranked = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", "vec_id", "score")
