"""Where short queries pair with long target sequences, without gaps.

A query pairs with a stretch of the target that equals its reverse complement.
A paired run of at least ``min_len`` letters contains a shared word of exactly
that length. Every such word of a target covers an anchor, a shorter word that
begins at a multiple of a fixed step, so an equi-join on anchors finds every run;
the words around an agreeing anchor are then compared, and consecutive ones on
one diagonal merged. No word is ever dropped for being frequent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement

MIN_LEN = 18


def words(seq: Column, size: int) -> Column:
    """All overlapping words of ``size`` letters, in order of their start, in one pass over the text."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def of_species(queries: DataFrame, prefix: str) -> DataFrame:
    return queries.filter(F.col("name").startswith(prefix))


#: letters from one anchor to the next; a longer step makes fewer and shorter, hence commoner, anchors
STEP = 5


def anchors(seq: Column, size: int, step: int, min_len: int) -> Column:
    """Pieces around the places 0, ``step``, 2 ``step`` ... at which a word of ``size`` letters begins, in one pass over the text.

    A piece reaches from ``step`` - 1 letters before its place, blanks before the
    text, as far as a word of ``min_len`` letters from there, or the text's end.
    """
    padded = F.concat(F.lit(" " * (step - 1)), seq)
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{step - 1 + size},{step - 1 + min_len}}})).{{{step}}}"), F.lit(1))


def word_hits(targets: DataFrame, queries: DataFrame, target_id: str, seq: str, min_len: int = MIN_LEN, step: int = STEP) -> DataFrame:
    """Every word of ``min_len`` letters that a target shares with a query: (target, ordinal, name, r_at, q_at), 0-based.

    A word that begins at r covers the first anchor from r on, at most ``step`` - 1
    letters later, and is found at that one alone.
    """
    step = max(1, min(step, min_len // 2))
    size = min_len - step + 1
    asked = queries.select("ordinal", "name", reverse_complement(F.col("seq")).alias("_q")).select(
        "ordinal", "name", "_q", F.posexplode(words(F.col("_q"), size)).alias("_q_at", "word"))
    around_q = F.substring(F.concat(F.lit(" " * (step - 1)), F.col("_q")), F.col("_q_at") + 1, F.lit(step - 1 + min_len))
    asked = asked.select("ordinal", "name", "_q_at", "word", around_q.alias("_around_q"))
    # not the plain posexplode: for that one the planner cuts each text twice, first to see whether there is a piece
    at_anchors = targets.select(target_id, F.posexplode_outer(anchors(F.upper(F.col(seq)), size, step, min_len)).alias("_nth", "_around"))
    scanned = at_anchors.select(target_id, (F.col("_nth") * step).alias("_r_at"), "_around", F.substring("_around", step, size).alias("word"))

    def agrees(back: int) -> Column:
        """Whether the words that begin ``back`` letters before the anchor are whole and equal."""
        ours, theirs = (F.substring(c, step - back, min_len) for c in ("_around", "_around_q"))
        return (F.col("_r_at") >= back) & (F.col("_q_at") >= back) & (F.length(ours) == min_len) & (ours == theirs)

    shared = [F.when(agrees(back), F.lit(back)) for back in range(step)]
    found = scanned.join(asked, "word").select(
        target_id, "ordinal", "name", "_r_at", "_q_at", F.explode(F.array_compact(F.array(*shared))).alias("_back"))
    return found.select(target_id, "ordinal", "name", (F.col("_r_at") - F.col("_back")).alias("r_at"), (F.col("_q_at") - F.col("_back")).alias("q_at"))


def target_runs(targets: DataFrame, queries: DataFrame, target_id: str, seq: str, min_len: int = MIN_LEN) -> DataFrame:
    """Maximal paired runs: (target, ordinal, name, r_start, r_end, q_start, score).

    Starts are 1-based; ``q_start`` counts on the reverse-complemented query and
    the score is the number of paired letters.
    """
    hits = word_hits(targets, queries, target_id, seq, min_len).withColumn("diagonal", F.col("r_at") - F.col("q_at"))
    line = Window.partitionBy(target_id, "ordinal", "diagonal").orderBy("r_at")
    return (
        hits.withColumn("_run", F.col("r_at") - F.row_number().over(line))
        .groupBy(target_id, "ordinal", "diagonal", "_run")
        .agg(
            F.any_value("name").alias("name"),
            (F.min("r_at") + 1).alias("r_start"),
            (F.min("q_at") + 1).alias("q_start"),
            (F.count(F.lit(1)).cast("int") + min_len - 1).alias("score"),
        )
        .withColumn("r_end", F.col("r_start") + F.col("score") - 1)
        .drop("_run", "diagonal")
    )


#: parts that the rows of a target word are dealt into, so that a frequent one is no single task's work
SALTS = 16
#: letters of the longest part; longer ones would be rarer, but each size is a pass over the targets
MAX_PART = 5
#: blocks of a stretch that are compared before its letters are
BLOCKS = 8
#: places of a target that share a piece of its text
PLACES = 16
#: bytes up to which the words of the queries are sent to every task
SENT_BYTES = 64 << 20


def target_mismatches(
    targets: DataFrame, queries: DataFrame, target_id: str, seq: str, mismatches: int = 2, min_len: int = MIN_LEN, sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """Stretches that pair with a whole query but for a few letters: (target, ordinal, name, r_start, r_end, mismatches).

    The diagonals of ``mismatch_candidates`` are compared letter by letter. Queries
    shorter than ``min_len`` and NULL sequences have no stretch; starts are 1-based.
    """
    hits = mismatch_candidates(targets, queries, target_id, seq, mismatches, min_len, sent_bytes)
    # each of few unpaired letters is in one block of letters; blocks are compared in compiled code, letters one by one are not
    size = F.ceil(F.length("_q") / BLOCKS).cast("int")
    unlike = [(F.substring("_s", size * k + 1, size) != F.substring("_q", size * k + 1, size)).cast("int") for k in range(BLOCKS)]
    hits = hits.filter(reduce(Column.__add__, unlike) <= mismatches)
    unpaired = F.size(F.filter(F.sequence(F.lit(1), F.length("_q")), lambda i: F.substring("_s", i, F.lit(1)) != F.substring("_q", i, F.lit(1))))
    start = (F.col("r_at") - F.col("q_at") + 1).alias("r_start")
    compared = hits.select(target_id, "ordinal", "name", start, F.length("_q").alias("_n"), unpaired.alias("mismatches"))
    # several parts of a query may find one stretch
    once = compared.filter(F.col("mismatches") <= mismatches).groupBy(target_id, "ordinal", "r_start").agg(
        F.any_value("name").alias("name"), F.any_value("_n").alias("_n"), F.any_value("mismatches").alias("mismatches"))
    return once.withColumn("r_end", F.col("r_start") + F.col("_n") - 1).drop("_n")


def _key(text: Column, at: Column, gap: Column, size: Column) -> Column:
    """A number for two words of a text, ``gap`` letters apart; joins find numbers several times as fast as words."""
    return F.xxhash64(F.substring(text, at + 1, size), F.substring(text, at + gap + 1, size), gap)


def mismatch_candidates(
    targets: DataFrame, queries: DataFrame, target_id: str, seq: str, mismatches: int, min_len: int = MIN_LEN, sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """Stretches ``_s`` of a target beside the queries ``_q`` that they may pair with, once for each pair of parts that agrees.

    A query of L letters is cut into ``mismatches`` + 2 parts. Were there at most so
    many unpaired letters, two parts are paired throughout, so the pairs of parts
    find every stretch (pigeonhole), and are as rare as words of both their letters.
    If the queries' pairs are few by count, they go to every task and the targets
    stay where they are; else the words of a target are dealt into ``SALTS`` parts
    and those of the queries copied to each. No word is dropped for being frequent.
    """
    parts = mismatches + 2
    if parts > min_len:
        raise ValueError("a query needs two letters more than may be unpaired")
    pairs = [(i, j) for j in range(parts) for i in range(j)]
    usable = queries.filter(F.length("seq") >= min_len)
    size = F.least(F.floor(F.length("seq") / parts), F.lit(MAX_PART)).cast("int")
    known = usable.agg(F.max(F.length("seq")).alias("longest"), F.sum(F.length("seq") + 64).alias("bytes"), F.collect_set(size).alias("sizes")).first()
    longest, few = known["longest"] or 0, (known["bytes"] or 0) * len(pairs) <= sent_bytes
    places = F.inline(F.array(*[F.struct((F.lit(i) * F.col("_size")).alias("q_at"), (F.lit(j - i) * F.col("_size")).alias("gap")) for i, j in pairs]))
    key = _key(F.col("_q"), F.col("q_at"), F.col("gap"), F.col("_size")).alias("_key")
    asked = usable.select("ordinal", "name", reverse_complement(F.col("seq")).alias("_q"), size.alias("_size")).select(
        "ordinal", "name", "_q", "_size", places).select("ordinal", "name", "_q", "_size", "q_at", "gap", key)
    # a piece of the text has ``PLACES`` places and the letters that any query around them can reach; all are cut out in one pass
    padded = F.concat(F.lit(" " * longest), F.upper(F.col(seq)))
    pieces = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{longest + 1},{2 * longest + PLACES - 1}}})).{{1,{PLACES}}}"), F.lit(1))
    inside = F.sequence(F.lit(0), F.least(F.lit(PLACES), F.length("_piece") - longest) - 1)
    at_pieces = targets.select(target_id, F.posexplode(pieces).alias("_nth", "_piece")) if longest else targets.select(
        target_id, F.lit(0).alias("_nth"), F.lit("").alias("_piece")).limit(0)
    sizes = sorted(known["sizes"]) or [1]
    reach = F.expr(f"substring(_piece, _i + {longest + 1}, {sizes[-1] * parts})").alias("_reach")
    at_places = at_pieces.select(target_id, "_nth", "_piece", F.explode(inside).alias("_i")).select(
        target_id, (F.col("_nth") * PLACES + F.col("_i")).alias("r_at"), "_piece", "_i", reach)
    keys = [_key(F.col("_reach"), F.lit(0), F.lit(n * d), F.lit(n)) for n in sizes for d in range(1, parts)]
    scanned = at_places.select(target_id, "r_at", "_piece", "_i", F.explode(F.array(*keys)).alias("_key"))
    around = F.substring("_piece", F.col("_i") + 1, F.lit(2 * longest)).alias("_around")
    if few:
        hits = scanned.join(F.broadcast(asked), "_key").select(target_id, "r_at", around, *asked.columns)
    else:
        copied = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = scanned.select(target_id, "r_at", around, "_key", F.pmod(F.col("r_at"), F.lit(SALTS)).alias("salt"))
        hits = salted.join(copied, ["_key", "salt"])
    # other letters may have the same key
    same = [F.expr(f"substring(_around, {longest + 1} + {at}, _size) = substring(_q, q_at + 1 + {at}, _size)") for at in ("0", "gap")]
    hits = hits.filter(same[0] & same[1])
    hits = hits.filter(F.col("r_at") >= F.col("q_at"))
    return hits.withColumn("_s", F.expr(f"substring(_around, {longest} - q_at + 1, length(_q))")).filter(F.length("_s") == F.length("_q"))


def best_any_two(targets: DataFrame, runs: DataFrame, target_id: str) -> DataFrame:
    """Per target the best query, all hitting queries and those hitting at more than one start.

    The best is the first in query order with the highest score; without hits it
    is '' with score 0, and the lists read 'na'.
    """
    per_query = runs.groupBy(target_id, "ordinal").agg(
        F.any_value("name").alias("name"),
        F.max("score").alias("score"),
        (F.min("r_start") != F.max("r_start")).alias("twice"),
    )

    def listed(keep: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(keep, F.struct("ordinal", "name"))))
        return F.array_join(F.transform(ordered, lambda x: x["name"]), ",")

    found = per_query.groupBy(target_id).agg(
        F.max_by("name", F.struct("score", -F.col("ordinal"))).alias("best_query"),
        F.max("score").cast("double").alias("best_score"),
        listed(F.lit(True)).alias("anyhit"),
        listed(F.col("twice")).alias("twohit"),
    )
    return targets.select(target_id).join(found, target_id, "left").select(
        target_id,
        F.coalesce("best_query", F.lit("")).alias("best_query"),
        F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
        F.coalesce("anyhit", F.lit("na")).alias("anyhit"),
        F.when(F.coalesce("twohit", F.lit("")) == "", "na").otherwise(F.col("twohit")).alias("twohit"),
    )
