"""Mixing sources by temperature: weights, quotas, and a stream of block permutations.

The share of source s is ``tokens_s ** a`` over the sum of all. The exponent a
is bisected in [0, 1] (0: all alike, 1: as they are) to the largest that still
reaches a target entropy, and raised where a source would be repeated more than
``max_repeats`` times. Each source then has a quota of the budget: whole passes
over its documents, each in an order of its own, and the beginning of one more.
The streams are cut into blocks that hold each source in its share, and each
block is permuted.

No source is ever one task's: a pass is laid out in ranges of the hash that
orders it, some thousand documents each; ranges are summed up first, and only
ranges get running totals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, store

#: halvings of the exponent's interval, and how many of them one job decides
STEPS, DEPTH = 40, 5


@dataclass(frozen=True)
class Mix:
    entropy: float = 0.95  # target, as a share of the entropy of equal weights
    max_repeats: float = 4.0  # passes over a source at most
    budget: float = 1.0  # tokens to draw, as a multiple of all there are
    block_tokens: int = 1 << 20
    range_rows: int = 10_000  # documents of a range, about
    seed: str = "mix"


def word_count(text: Column) -> Column:
    """Words between white space; null counts none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("bigint")


def source_totals(rows: DataFrame) -> DataFrame:
    """(key, tokens, docs) of the sources that have tokens, from (key, n_tokens)."""
    return rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).filter("tokens > 0")


def _bisect(holds, steps: int = STEPS) -> float:
    """The largest point of [0, 1] where ``holds`` is true, if it is true up to a point; 0 if never.

    ``holds(points)`` answers for many points in one job: all midpoints that the
    next DEPTH halvings can ask for.
    """
    low, high = 0.0, 1.0
    if holds([1.0])[0]:
        return 1.0
    for _ in range(0, steps, DEPTH):
        points, spans = [], [(low, high)]
        for _ in range(DEPTH):
            middles = [(a + b) / 2 for a, b in spans]
            points += middles
            spans = [x for (a, b), m in zip(spans, middles, strict=True) for x in ((a, m), (m, b))]
        answer = dict(zip(points, holds(points), strict=True))
        for _ in range(DEPTH):
            middle = (low + high) / 2
            low, high = (middle, high) if answer[middle] else (low, middle)
    return low


def exponent(totals: DataFrame, mix: Mix) -> float:
    """Exponent for the target entropy, raised to what the repetition limit needs."""
    row = totals.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    if not row["n"]:
        return 1.0
    share = F.col("tokens") / F.lit(float(row["t"]))
    target = mix.entropy * math.log(row["n"])

    def sums(points: list[float]):
        asked = []
        for i, a in enumerate(points):
            power = F.pow(share, F.lit(a))
            asked += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(share)).alias(f"l{i}"), F.max(F.pow(share, F.lit(a - 1.0))).alias(f"m{i}")]
        return totals.agg(*asked).select(
            *[(F.log(F.col(f"z{i}")) - F.lit(a) * F.col(f"l{i}") / F.col(f"z{i}") >= target).alias(f"e{i}") for i, a in enumerate(points)],
            *[(F.col(f"m{i}") / F.col(f"z{i}") * mix.budget > mix.max_repeats).alias(f"r{i}") for i, a in enumerate(points)],
        ).first()

    def entropic(points):
        found = sums(points)
        return [found[f"e{i}"] for i in range(len(points))]

    def repeated(points):
        found = sums(points)
        return [found[f"r{i}"] for i in range(len(points))]

    # repetition falls as the exponent grows; at 1 all sources repeat alike, and no exponent helps beyond that
    need = _bisect(repeated)
    return max(_bisect(entropic), need + 2.0 ** -STEPS if 0 < need < 1 else need)


def quotas(totals: DataFrame, mix: Mix) -> DataFrame:
    """(key, tokens, docs, weight, quota, passes, rest): whole passes and the tokens of one more."""
    a = exponent(totals, mix)
    row = totals.agg(F.sum("tokens").alias("t")).first()
    all_tokens = float(row["t"] or 1)
    z = totals.agg(F.sum(F.pow(F.col("tokens") / all_tokens, F.lit(a)))).first()[0] or 1.0
    weight = F.pow(F.col("tokens") / all_tokens, F.lit(a)) / F.lit(float(z))
    # whole tokens; a thousandth lets products that are whole but for rounding stay whole
    quota = F.floor(weight * F.lit(mix.budget * all_tokens) + 0.001).cast("bigint")
    return totals.withColumns({"weight": weight, "quota": quota}).withColumns({
        "passes": F.floor(F.col("quota") / F.col("tokens")).cast("bigint")}).withColumn(
        "rest", F.col("quota") - F.col("passes") * F.col("tokens"))


def draw(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source",
         tokens: Column | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, source, epoch, n_tokens, block, place) of every drawn copy.

    ``epoch`` is the pass over the source, ``block`` the block of the whole stream
    and ``place`` the place in it, from 0. ``tokens`` defaults to the words of the
    text. A null source is a source of its own. A source without any token has
    no weight and is not drawn; an empty document of another source is drawn
    like any. Repeated rows are drawn each; rows that agree in id, source and
    tokens have the same hash and follow one another. Other columns go. An
    empty table gives an empty one.
    """
    count = word_count(F.col(text_col)) if tokens is None else F.coalesce(tokens.cast("bigint"), F.lit(0))
    rows = store(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("key"),
        count.alias("n_tokens")), "tokens")
    plan = store(quotas(source_totals(rows), mix), "quotas")
    small = plan.select("key", "docs", "passes", "rest", "weight")
    copies = rows.join(small, "key").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), "passes")))
    copies = copies.withColumn("hash", F.md5(F.concat_ws("|", F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("epoch").cast("string")).cast("binary")))
    ranges = F.ceil(F.col("docs") / F.lit(mix.range_rows))
    copies = copies.withColumn("range", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint") * ranges / F.lit(float(1 << 32))).cast("bigint"))
    part = ["key", "epoch", "range"]
    before = Window.partitionBy("key", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = copies.groupBy(*part).agg(F.sum("n_tokens").alias("sum")).select(*part, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*part).orderBy("hash", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = copies.withColumn("end", F.sum("n_tokens").over(inside)).join(offsets, part).withColumn("end", F.col("end") + F.col("offset"))
    laid = laid.filter((F.col("epoch") < F.col("passes")) | (F.col("end") <= F.col("rest")))
    # where the copy begins in its source's stream, in blocks of the source's share; tokens are whole numbers
    start = laid.join(plan.select("key", "tokens"), "key").withColumn("start", F.col("epoch") * F.col("tokens") + F.col("end") - F.col("n_tokens"))
    block = F.floor(F.col("start") / F.greatest(F.lit(1), F.ceil(F.col("weight") * mix.block_tokens))).cast("bigint")
    shuffled = Window.partitionBy("block").orderBy(F.md5(F.concat(F.col("hash"), F.lit("|block")).cast("binary")), "doc_id", "n_tokens", "key")
    return start.withColumn("block", block).select("doc_id", "source", "epoch", "n_tokens", "block", (F.row_number().over(shuffled) - 1).cast("bigint").alias("place"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The columns of documents, a row for each drawn copy; which rows are drawn is decided on numbers alone."""
    rows = store(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    narrow = rows.select("row", "source", word_count(F.col("text")).alias("n"))
    copies = draw(narrow, mix, id_col="row", tokens=F.col("n")).select(F.col("doc_id").alias("row"))
    return rows.join(copies, "row").drop("row")
