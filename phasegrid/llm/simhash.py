"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint has two halves of 32 bits. If two fingerprints differ in
``2 t + 1`` bits or fewer, one of their halves differs in ``t`` or fewer. The
anchors of a half are the words of the Hamming code of length 31, whose
covering radius is 1: every 31-bit word has one anchor within 1. A fingerprint
is at home at that anchor and visits every anchor within 1 + t; so two that
link meet where one of them is at home, and are compared there. Equal
fingerprints are one class before that, so copies never meet each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows, scratch, store
from .components import components

SEED = 42
#: shingles whose bits are counted at once
SLICE = 1 << 16
#: length of the code
BITS = 31
#: parity checks of the Hamming code: bit k of the syndrome covers the places (from 1) whose number has bit k
CHECKS = [sum(1 << (i - 1) for i in range(1, BITS + 1) if i >> k & 1) for k in range(5)]


def fingerprint(text: str, words: int) -> int:
    """A bit is 1 if set in over half the shingle hashes; fewer words are one shingle, none give 0."""
    w = text.encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    else:
        shingles = list(map(b" ".join, zip(*[w[k:] for k in range(words)], strict=False)))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of the hashes of a text's shingles; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        h = hashes[at:at + SLICE]
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; a null text is an empty one."""

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "fp": [fingerprint(t, words) for t in rows["text"]]}

    arrow = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return map_rows(id_text(docs, id_col, text_col), make, "doc_id bigint, fp bigint", arrow)


def _half(fp, k: int):
    return F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit((1 << BITS) - 1))


def _syndrome(x):
    """0 for an anchor, else the place (from 1) to flip for the nearest one."""
    return sum((F.bit_count(x.bitwiseAND(F.lit(m))) % 2) * (1 << k) for k, m in enumerate(CHECKS))


def _flip(place):
    return F.when(place == 0, F.lit(0).cast("bigint")).otherwise(
        F.element_at(F.array(*[F.lit(1 << k).cast("bigint") for k in range(BITS)]), F.greatest(place, F.lit(1)).cast("int")))


def anchors(fps: DataFrame) -> DataFrame:
    """(half, anchor, fp, home): each distinct fingerprint at its home and at every anchor within 2 of it, by half.

    Anchors within 2 of x are x with places i and j flipped where i XOR j is the
    syndrome; place 0 flips nothing, so one of those pairs gives the home.
    """
    x = F.col("x")
    halves = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("half"), _half(F.col("fp"), k).alias("x")) for k in (0, 1)])).alias("h"))
    halves = halves.select("fp", "h.half", "h.x").withColumn("s", _syndrome(x).cast("int"))
    place = F.explode(F.expr(f"if(s = 0, array(0), filter(sequence(0, {BITS}), i -> i < (i ^ s)))"))
    spread = halves.select("fp", "half", "x", "s", place.alias("i"))
    other = F.col("i").bitwiseXOR(F.col("s"))
    return spread.select("half", x.bitwiseXOR(_flip(F.col("i"))).bitwiseXOR(_flip(other)).alias("anchor"), "fp", (F.col("i") == 0).alias("home"))


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b): each pair of distinct fingerprints that differ in 1 to ``threshold`` (at most 3) bits, once."""
    if not 0 <= threshold <= 3:
        raise ValueError("the code's two halves find up to 3 differing bits")
    placed = anchors(fps)
    home = placed.filter("home").select("half", "anchor", F.col("fp").alias("a"))
    visit = placed.select("half", "anchor", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.bit_count(differ.bitwiseAND(F.lit(0xFFFFFFFF)))
    # a pair that the first half finds is not given again by the second
    once = (F.col("half") == 0) & (first <= 1) | (F.col("half") == 1) & (first > 1)
    # fingerprints stored are few bytes, but each is at many anchors: never sent whole to the driver and every task
    return home.hint("merge").join(visit.hint("merge"), ["half", "anchor"]).filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= threshold) & once).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id among all that linked fingerprints reach.

    Texts without words have fingerprint 0 and link like any other; a null text
    is an empty one. Repeated rows each give a row. A null id is no candidate for
    the smallest; where a component has no other, its id is null. Other columns
    go. Empty tables give empty tables.
    """
    fps = store(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = store(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    grouped = components(links(classes.select("fp"), threshold), "a", "b")
    roots = classes.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = store(roots.join(smallest, "root").select("fp", "component_id"), "classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Near copies by similarity: texts whose fingerprints are equal or link are compared first. What lies beyond their two bits is
# found by least hashes of the shingles: each text is compared with the first that it meets at each of them; what is not in
# one group then is compared where rare shingles meet.

#: A text has so many keys, each made of so many least hashes: texts of similarity s share none of the keys with
#: probability (1 - s ** LEAST) ** KEYS, which is 0.00015 at 0.8, 2e-7 at 0.85 and less above
KEYS, LEAST = 48, 8
#: shingles whose hashes are multiplied at once
BLOCK = 128
#: counters of how often shingles occur, by hash; a fixed size whatever the corpus
COUNTERS = 1 << 18
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, KEYS * LEAST), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _hashes(text: str, words: int) -> tuple[bytes, np.ndarray]:
    """(the words, space-joined; hash of each shingle): fewer words are one shingle, none give none."""
    w = text.encode().lower().split()
    if len(w) < words:
        shingles = [b" ".join(w)] if w else []
    else:
        shingles = list(map(b" ".join, zip(*[w[k:] for k in range(words)], strict=False)))
    return b" ".join(w), np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64, len(shingles))


def sketch(text: str, words: int) -> tuple[bytes, list[int], int]:
    """(128-bit hash of the word sequence, KEYS keys of the shingle set, fingerprint); a text without words has no keys."""
    joined, hashes = _hashes(text, words)
    own = xxhash.xxh3_128_digest(joined)
    if not len(hashes):
        return own, [], 0
    least = np.full(KEYS * LEAST, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at:at + BLOCK, None] * _ODD[0]).min(axis=0), out=least)
    keys = _mixed((_mixed(least) * _ODD[1]).reshape(KEYS, LEAST).sum(axis=1, dtype=np.uint64) + np.arange(KEYS, dtype=np.uint64))
    return own, keys.view(np.int64).tolist(), majority(hashes)


def linked(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b): pairs of rows of (row, fp) that tie together all rows whose fingerprints are equal or link.

    Each row with the first of its fingerprint, and the first ones of linked fingerprints.
    """
    first = store(prints.groupBy("fp").agg(F.min("row").alias("first"), F.max("row").alias("last")), "prints")
    same = prints.join(first.filter("first < last").select("fp", "first"), "fp").filter("first < row").select(F.col("first").alias("a"), F.col("row").alias("b"))
    ends = links(first.select("fp"), threshold)
    near = ends.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.unionAll(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def shingle_set(text: str, words: int) -> list[int]:
    """Distinct hashes of the shingles, ascending as signed numbers."""
    return np.unique(_hashes(text, words)[1].view(np.int64)).tolist()


def rare_shingles(shingles: list[int], counts: np.ndarray, similarity: float) -> list[int]:
    """The rarest shingles of a set: two sets of that Jaccard similarity have one of each other's among them.

    A partner holds ``similarity`` of the set at least, so it can miss no more than
    the rest; whatever the order, if it is the same for all sets, one of the first
    ``rest + 1`` of either set is common to both. ``counts``, by hash modulo their
    number, are how often shingles occur.
    """
    h = np.array(shingles, np.int64)
    order = np.lexsort((h, counts[h % len(counts)]))
    # a thousandth guards the product against rounding; a longer beginning is always right
    return h[order[:len(h) - math.ceil(similarity * len(h) - 0.001) + 1]].tolist()


def _sets(texts: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(row, set, size) of the rows asked for. Texts are joined by sorting at every size: both sides grow with the corpus."""

    def make():
        def step(rows):
            sets = [shingle_set(t, words) for t in rows["text"]]
            return {"row": rows["row"], "set": sets, "size": list(map(len, sets))}

        return step

    arrow = pa.schema([("row", pa.int64()), ("set", pa.list_(pa.int64())), ("size", pa.int64())])
    wanted = texts.select("row", "text").join(asked.hint("merge"), "row", "left_semi")
    return map_rows(wanted, make, "row bigint, set array<bigint>, size bigint", arrow)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose shingle sets have that Jaccard similarity."""
    one = sets.select(F.col("row").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("row").alias("b"), F.col("set").alias("y"))
    both = pairs.join(two.hint("merge"), "b").join(one.hint("merge"), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b")


def _cells(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, row, leader, size, place): each row at its rare shingles, rarest first (place from 0); no row leads."""
    bucket = F.pmod("shingle", F.lit(COUNTERS)).cast("int").alias("bucket")
    found = sets.select(F.explode("set").alias("shingle")).groupBy(bucket).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def make():
        return lambda rows: {"row": rows["row"], "size": rows["size"], "keys": [rare_shingles(s, shared.value, similarity) for s in rows["set"]]}

    arrow = pa.schema([("row", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])
    placed = map_rows(sets, make, "row bigint, size bigint, keys array<bigint>", arrow)
    return placed.select(F.posexplode("keys").alias("place", "key"), "row", F.lit(-1).cast("bigint").alias("leader"), "size")


def untried(shared: DataFrame, groups: DataFrame, similarity: float = 0.0) -> DataFrame:
    """(a, b): each pair of rows of (key, row, leader) that share a key and are not in one group, without the leaders' own pairs.

    Groups, of (node, component), are told apart by the component itself; rows without links are groups of their own.
    The members of a key's largest group only meet the others, not each other, so a large group costs as much as it
    has pairs to try.

    With a similarity, ``shared`` has each row's ``size`` and the key's ``place`` in its order too. Similar sets of x
    and y elements have ``similarity / (1 + similarity) * (x + y)`` in common, all of them from their first common
    key on: that bounds how late it comes in either set, and more so in the smaller one.
    """
    if not similarity:
        shared = shared.withColumns({"size": F.lit(0), "place": F.lit(0)})
    marked = shared.filter("leader < row").join(groups.withColumnRenamed("node", "row").hint("merge"), "row", "left").select(
        "key", "row", "size", "place", F.coalesce("component", "row").alias("group"))
    marked = store(marked, "marked")
    held = marked.groupBy("key", "group").agg(F.count("*").alias("n"))
    main = held.groupBy("key").agg(F.max(F.struct("n", "group")).alias("top"), F.count("*").alias("groups")).filter("groups > 1")
    cells = store(marked.join(main.select("key", F.col("top.group").alias("main")), "key").withColumn("is_main", F.expr("group = main")), "cells")
    share = similarity / (1 + similarity)

    def side(rows: DataFrame, suffix: str) -> DataFrame:
        return rows.select("key", *[F.col(c).alias(c + suffix) for c in ("row", "group", "size", "place")])

    # a is the smaller set; a thousandth guards the products against rounding
    early = cells.filter(F.col("place") <= F.col("size") - F.ceil(F.lit(2 * share) * F.col("size") - 0.001))
    meet = side(early.filter("not is_main"), "_a").join(side(cells, "_b").hint("merge"), "key").unionAll(
        side(early.filter("is_main"), "_a").join(side(cells.filter("not is_main"), "_b").hint("merge"), "key"))
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    meet = meet.filter("group_a <> group_b and (size_a < size_b or size_a = size_b and row_a < row_b)").filter(
        (left >= F.lit(share) * (F.col("size_a") + F.col("size_b")) - 0.001) & (F.col("size_a") >= F.lit(similarity) * F.col("size_b") - 0.001))
    return meet.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): the stored rows of ``docs`` with a ``row`` number, and (row, keep) of every row.

    Rows with the same words are copies; different texts link if their shingle
    sets are similar; linked rows are a group, and ``keep`` is the row number of
    its smallest id (null ids last, then the smaller row number). A text without
    words is a copy of any other such text, and links to none else. Texts that
    share neither a key of ``sketch`` nor a fingerprint within two bits with
    another have no partner. The others are first compared with those that their
    fingerprints link them to, and with the smallest text of each of their keys,
    which ties much of a large group together; then all that share one of their rare
    shingles early enough, have sizes that allow it, and are not in one group yet. Every member
    counts there: a group may be linked to another text by any one of them. All
    candidates are judged by their shingle sets.

    Both frames are stored; whatever else was stored on the way is removed.
    """
    rows = store(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    with scratch(docs.sparkSession) as keep:
        return rows, keep(_groups(rows, words, similarity, id_col, text_col), "groups")


def _groups(rows: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    texts = rows.select("row", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).cast("bigint").alias("id"))

    def make():
        def step(part):
            own, keys, fp = zip(*[sketch(t, words) for t in part["text"]], strict=True)
            return {"row": part["row"], "id": part["id"], "own": list(own), "keys": list(keys), "fp": list(fp)}

        return step

    arrow = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("own", pa.binary()), ("keys", pa.list_(pa.int64())), ("fp", pa.int64())])
    sketches = store(map_rows(texts.select("row", "id", "text"), make, "row bigint, id bigint, own binary, keys array<bigint>, fp bigint", arrow), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    classes = store(sketches.groupBy("own").agg(first).select("own", "first", F.col("first.row").alias("row")), "classes")
    spread = sketches.select("row", "keys").join(classes.select("row").hint("merge"), "row", "left_semi").select("row", F.explode("keys").alias("key"))
    # keys of one text propose nothing; the others are few
    ends = spread.groupBy("key").agg(F.min("row").alias("leader"), F.max("row").alias("last")).filter("leader < last").select("key", "leader")
    met = store(spread.join(ends, "key").filter("leader < row").select("row", "leader").distinct(), "met")
    # first pass: texts whose fingerprints are equal or link, and each text with the leaders of its keys
    prints = sketches.filter("size(keys) > 0").select("row", "fp").join(classes.select("row").hint("merge"), "row", "left_semi")
    led = store(linked(prints).unionAll(met.select(F.col("leader").alias("a"), F.col("row").alias("b"))).distinct(), "led")
    sets = led.select(F.col("a").alias("row")).unionAll(led.select(F.col("b").alias("row"))).distinct()
    sets = store(_sets(texts, sets, words), "sets")
    links = store(_similar(led, sets, similarity), "links")
    grouped = components(links, "a", "b")
    # second pass: all that meet at a rare shingle and are not in one group
    more = store(untried(_cells(sets, similarity), grouped, similarity), "candidates")
    final = components(links.unionAll(_similar(more, sets, similarity)), "a", "b")
    named = classes.join(final.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    kept = named.groupBy("component").agg(F.min("first").alias("best")).select("component", F.col("best.row").alias("keep"))
    return sketches.select("row", "own").join(named.select("own", "component"), "own").join(kept, "component").select("row", "keep")


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: see ``near_copies``."""
    rows, groups = near_copies(docs, words, similarity, id_col, text_col)
    stays = groups.filter("row = keep").select("row")
    return rows.join(stays.hint("merge"), "row", "left_semi").drop("row")
