"""A Merkle manifest of a dataset, with an inclusion proof of every row.

A leaf is the digest of a row's fields. The leaves of a group ascend by id;
every ``FAN`` consecutive nodes become their parent, the last run of a level
being shorter if need be, until one node remains: the group's subroot. The
subroots, in the order of the groups, make the root in the same way.

Nodes are appended in order (``Appender``). A new node gets the siblings that
are there already as a partial witness; each later sibling that is completed
extends the witnesses of the earlier ones. Witnesses are shared: what a subtree
learns is learnt once for all leaves below it. A task appends one aligned block
of ``FAN ** depth`` nodes; the roots of the blocks are the appends of the next
tier, and so on. Then the tiers are gone through from the top: the witness of
a block's root goes on from that of its leaf, and only digests are kept of it.

Nothing grows with a group: its rows are ranked by range partitions, whatever
group they belong to, and a block has a fixed number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import store

FAN = 8
#: levels of a block by default; 8 ** 4 rows of two digests are less than 1 MB
DEPTH = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    """How many levels lie above ``n`` nodes."""
    levels = 0
    while n > 1:
        n = -(-n // FAN)
        levels += 1
    return levels


class Node:
    """A completed subtree: its digest, and the siblings seen so far, those before it and those after it."""

    __slots__ = ("digest", "before", "after", "parent")

    def __init__(self, value: str, before: str):
        self.digest, self.before = value, before
        self.after: list[str] = []
        self.parent: Node | None = None


class Appender:
    """Appends nodes to a tree of ``levels`` levels; open runs hold the nodes whose parent is not complete."""

    def __init__(self, levels: int):
        self.levels = levels
        self._open: list[list[Node]] = [[] for _ in range(levels + 1)]

    def append(self, value: str, level: int = 0) -> Node:
        run = self._open[level]
        node = Node(value, "".join(n.digest for n in run))
        for earlier in run:
            earlier.after.append(value)
        run.append(node)
        if len(run) == FAN and level < self.levels:
            self._complete(level)
        return node

    def _complete(self, level: int) -> None:
        run, self._open[level] = self._open[level], []
        parent = self.append(digest("".join(n.digest for n in run)), level + 1)
        for n in run:
            n.parent = parent

    def finish(self) -> str:
        """Complete the runs that are shorter, and give the root."""
        for level in range(self.levels):
            if self._open[level]:
                self._complete(level)
        return self._open[self.levels][0].digest


def witness(node: Node, top: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The siblings (those before, those after) of every level from the node on, ``top`` being those above its block."""
    steps = []
    while node.parent is not None:
        steps.append((node.before, "".join(node.after)))
        node = node.parent
    return steps + top


def fold(value: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its witness give."""
    for before, after in steps:
        value = digest(before + value + after)
    return value


def block_levels(n: int, depth: int) -> int:
    """Levels of a block in a tier of ``n`` nodes: all blocks of a tier are as high."""
    return min(depth, levels_of(n))


def leaf_digest(fields: dict[str, Column]) -> Column:
    """sha256 of the fields one after another, each as its byte count, a colon and its value; a null is a dash."""
    parts = []
    for c in fields.values():
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its group from 0, and ``n``, the group's rows; nulls come first.

    Rows are range-partitioned by group and order, so a large group is spread
    over many tasks. Rows equal in ``order`` are told apart by where they were
    read. What a partition has of a group is counted, and the counts before it are added.
    """
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    inside = tied.repartitionByRange(group, *order, "tie").sortWithinPartitions(group, *order, "tie")
    # the identifier counts the rows of a sorted partition in its lower 33 bits
    numbered = store(inside.drop("tie").withColumn("place", F.monotonically_increasing_id()), "merkle_ranked")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    numbered = numbered.withColumns({"part": part, "at": at}).drop("place")
    counts = numbered.groupBy(F.col(group).alias("g"), F.col("part").alias("p")).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("g")
    earlier = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("g", "p", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"),
                           F.sum("rows").over(whole).alias("n"))
    placed = numbered.join(starts, (F.col(group) == F.col("g")) & (F.col("part") == F.col("p")))
    return placed.withColumn("pos", F.col("base") + F.col("at") - F.col("first")).drop("g", "p", "part", "at", "first", "base")


def blocks(nodes: DataFrame, depth: int, name: str) -> DataFrame:
    """(grp, n, block, items) from (grp, n, pos, digest, ...): aligned runs of nodes, in order, stored."""
    size = FAN ** depth
    more = [c for c in nodes.columns if c not in ("grp", "n", "pos", "digest")]
    items = F.array_sort(F.collect_list(F.struct("pos", "digest", *more)))
    return store(nodes.groupBy("grp", "n", F.floor(F.col("pos") / size).alias("block")).agg(items.alias("items")), name)


def _streamed(packed: DataFrame, depth: int, *more: str) -> DataFrame:
    """The rows of the blocks, one block after another and each in order; ``more`` is null but on a block's first row."""
    first = F.col("pos") % FAN ** depth == 0
    wide = packed.select("*", F.inline("items"))
    kept = [c for c in wide.columns if c not in ("items", "steps", "subroot", "root")]
    return wide.select(*kept, *[F.when(first, F.col(c)).alias(c) for c in more])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Consecutive rows of one block, also where it runs on in the next batch."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["grp"], row["block"]) != (rows[0]["grp"], rows[0]["block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def block_roots(packed: DataFrame, depth: int) -> DataFrame:
    """(grp, n, pos, digest) of the next tier: the roots of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            n = rows[0]["n"]
            tree = Appender(block_levels(n, depth))
            for row in rows:
                tree.append(row["digest"])
            made = {"grp": rows[0]["grp"], "n": -(-n // FAN ** depth), "pos": rows[0]["block"], "digest": tree.finish()}
            yield pa.RecordBatch.from_pylist([made], arrow)

    arrow = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.string())])
    rows = _streamed(packed, depth).select("grp", "n", "block", "digest")
    return rows.mapInArrow(run, "grp string, n bigint, pos bigint, digest string")


def _witnessed(rows: list[dict], depth: int) -> Iterator[tuple[dict, list[tuple[str, str]]]]:
    """Every row of a block with its witness up to the root."""
    tree = Appender(block_levels(rows[0]["n"], depth))
    nodes = [tree.append(row["digest"]) for row in rows]
    tree.finish()
    top = [(s["before"], s["after"]) for s in rows[0]["steps"]]
    for row, node in zip(rows, nodes, strict=True):
        yield row, witness(node, top)


def _below(packed: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """The rows of the blocks, the first of each beside the witness of its block's root, the subroot and the root."""
    known = above.select(F.col("grp").alias("g"), F.col("pos").alias("b"), "steps", "subroot", "root")
    joined = packed.join(known, (F.col("grp") == F.col("g")) & (F.col("block") == F.col("b"))).drop("g", "b")
    return _streamed(joined, depth, "steps", "subroot", "root")


def node_witnesses(packed: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """(grp, pos, steps, subroot, root) of the nodes of a tier, from those of the tier above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            made = [{"grp": row["grp"], "pos": row["pos"], "steps": [{"before": a, "after": b} for a, b in steps],
                     "subroot": rows[0]["subroot"], "root": rows[0]["root"]} for row, steps in _witnessed(rows, depth)]
            for at in range(0, len(made), 256):
                yield pa.RecordBatch.from_pylist(made[at:at + 256], arrow)

    arrow = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("steps", pa.list_(_STEP)), ("subroot", pa.string()), ("root", pa.string())])
    schema = "grp string, pos bigint, steps array<struct<before:string,after:string>>, subroot string, root string"
    return _below(packed, above, depth).mapInArrow(run, schema)


def grow(nodes: DataFrame, depth: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks above ``nodes`` (grp, n, pos, digest, ...), lowest first, and (grp, digest) of the last nodes.

    A group that has its subroot already stays one node, which a tier passes on.
    """
    tiers = []
    while True:
        tiers.append(blocks(nodes, depth, f"{name}_{len(tiers)}"))
        nodes = block_roots(tiers[-1], depth)
        if (tiers[-1].agg(F.max("n")).first()[0] or 0) <= FAN ** depth:
            return tiers, nodes.select("grp", "digest")


@dataclass(frozen=True)
class Manifest:
    """What makes a leaf, which tree it belongs to, and its place there."""

    fields: tuple[str, ...] = FIELDS
    group: str = "lang"
    order: str = "doc_id"
    depth: int = DEPTH


def leaves(rows: DataFrame, m: Manifest, claimed: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    """(grp, key, digest, claimed, kept) of every row; ``grp`` orders as the group does, null first."""
    fields = {c: F.col(c) for c in m.fields}
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(m.group).cast("string")), F.lit("-")).alias("grp"),
        F.col(m.order).alias("key"),
        leaf_digest(fields).alias("digest"),
        leaf_digest(fields | claimed).alias("claimed"),
        F.struct(*[F.col(c) for c in keep]).alias("kept"),
    )


def lower_cased(text: Column) -> Column:
    """A-Z of a text as a-z, other letters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def tampered_text(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, lower-cased where 3 divides the crc32 of the id; rows without an id are left alone."""
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, lower_cased(F.col(text_col))).otherwise(F.col(text_col))


_KINDS = {"pos": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string",
          "folded_root": "string", "verified": "boolean", "witness": "array<struct<before:string,after:string>>"}


def manifest(rows: DataFrame, m: Manifest = Manifest(), claimed: dict[str, Column] | None = None,
             witnesses: bool = True) -> DataFrame:
    """(group, order, pos, leaf, subroot, root, proof_sha256, folded_root, verified, witness) of every row.

    The first two bear the names of their columns. ``witness`` lists, from the
    leaf's level to the root, the siblings before and those after, joined; it is
    left out without ``witnesses``. ``proof_sha256`` is the digest of all of them.
    ``claimed`` replaces fields of a copy that is to be verified: ``folded_root``
    is what its leaf gives with the row's witness, and ``verified`` says whether
    that is the root.

    A null field is a value of its own; rows of no group make the first tree,
    rows whose order is null come first in theirs. Repeated rows are leaves of
    their own. An empty table has no rows and no root. Other columns go, whatever
    their names. A text of any length is one digest.
    """
    depth = m.depth
    keep = (m.group, m.order)
    types = {f.name: f.dataType for f in rows.schema.fields}
    made = leaves(rows.select(*dict.fromkeys((*m.fields, *keep))), m, claimed or {}, keep)
    tiers, subroots = grow(ranked(made, "grp", ["key", "digest"]).drop("key"), depth, "merkle_blocks")
    # the subroots are the leaves of the root's tree
    tops = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), "grp", ["of"])
    top_tiers, roots = grow(tops, depth, "merkle_top")
    above = roots.select(
        "grp", F.lit(0).cast("bigint").alias("pos"), F.array().cast(_KINDS["witness"]).alias("steps"),
        F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for tier in reversed(top_tiers):
        above = store(node_witnesses(tier, above, depth), "merkle_top_witness")
    named = top_tiers[0].select(F.inline("items"))
    above = above.select("pos", "steps", "root").join(named, "pos").select(
        F.col("of").alias("grp"), F.lit(0).cast("bigint").alias("pos"), "steps", F.col("digest").alias("subroot"), "root")
    for tier in reversed(tiers[1:]):
        above = store(node_witnesses(tier, above, depth), "merkle_witness")
    columns = [c for c in _KINDS if witnesses or c != "witness"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            subroot, root, out = block[0]["subroot"], block[0]["root"], []
            for row, steps in _witnessed(block, depth):
                folded = fold(row["claimed"], steps)
                found = {"pos": row["pos"], "leaf": row["digest"], "subroot": subroot, "root": root,
                         "proof_sha256": digest("".join(a + b for a, b in steps)), "folded_root": folded, "verified": folded == root}
                if witnesses:
                    found["witness"] = [{"before": a, "after": b} for a, b in steps]
                out.append({**row["kept"], **found})
            for at in range(0, len(out), 256 if witnesses else len(out)):
                yield pa.RecordBatch.from_pylist(out[at:at + 256] if witnesses else out, arrow)

    schema = T.StructType([T.StructField(c, types[c]) for c in keep] + [T.StructField(c, T.DataType.fromDDL(_KINDS[c])) for c in columns])
    arrow = to_arrow_schema(schema)
    return _below(tiers[0], above, depth).select("grp", "n", "block", "pos", "digest", "claimed", "kept", "steps", "subroot", "root").mapInArrow(run, schema)
