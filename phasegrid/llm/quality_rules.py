"""Quality rules by distribution divergence, in SQL expressions alone.

A document is compared with the reference of its language: a histogram of
character classes and a histogram of common words. The distance is that of
Jensen and Shannon (square root of the divergence, logarithm to base 2, so 0 to
1). Documents that are too short for a histogram pass that comparison.

Everything happens inside a row: no shuffle, no Python. A document's work and
memory grow with its own length (a sort of its word windows only where one
repeats).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, store

WINDOW = 5
#: order of the classes of a character histogram; digits are left out, as clean short texts may hold long numbers
CLASSES = ("lower", "upper", "space", "symbol", "punctuation")

# Usual shares in running prose (percent), classes in the order of CLASSES.
PROSE = (80.0, 2.0, 15.5, 0.1, 2.4)
# The commonest words of each language and their usual shares in running prose (percent).
COMMON_WORDS: dict[str, dict[str, float]] = {
    "en": {"the": 6.0, "of": 3.2, "and": 2.8, "to": 2.6, "a": 2.2, "in": 2.0, "is": 1.1, "that": 1.0, "for": 0.9,
           "it": 0.9, "was": 0.8, "on": 0.7, "with": 0.7, "as": 0.7, "be": 0.6, "by": 0.6, "this": 0.5, "are": 0.5},
    "de": {"der": 3.3, "die": 3.2, "und": 2.8, "in": 1.8, "den": 1.2, "von": 1.1, "zu": 1.0, "das": 1.0, "mit": 0.9,
           "sich": 0.9, "des": 0.8, "auf": 0.8, "ist": 0.8, "im": 0.7, "dem": 0.7, "nicht": 0.7, "ein": 0.7, "eine": 0.7},
    "fr": {"de": 4.5, "la": 2.8, "le": 2.3, "et": 2.0, "les": 2.0, "des": 1.8, "en": 1.3, "un": 1.1, "du": 1.1,
           "une": 1.0, "que": 0.9, "est": 0.9, "dans": 0.8, "qui": 0.8, "par": 0.7, "pour": 0.7, "au": 0.6, "sur": 0.6},
    "es": {"de": 5.0, "la": 3.5, "que": 2.7, "el": 2.6, "en": 2.3, "y": 2.2, "a": 1.7, "los": 1.5, "se": 1.1,
           "del": 1.1, "las": 1.0, "un": 0.9, "por": 0.8, "con": 0.8, "no": 0.8, "una": 0.7, "para": 0.6, "su": 0.6},
}


@dataclass(frozen=True)
class Rules:
    """Parameters; ``references`` maps a language to its common words and their percent of all words."""

    references: dict = field(default_factory=lambda: COMMON_WORDS)
    classes: tuple = PROSE
    max_class_distance: float = 0.13
    short_class_distance: float = 0.20  # the same below min_words, where chance has more weight
    max_word_distance: float = 0.35  # a text without any of the words has 0.356 (de) to 0.411 (es)
    min_chars: int = 40  # fewer: no comparison of character classes
    min_words: int = 50  # fewer: no comparison of common words
    fail_words: int = 10  # base rule
    fail_repeat_percent: int = 20  # base rule


def repeated_window_words(words: DataFrame, column: str = "words", out: str = "n_repeat_words") -> DataFrame:
    """Count the words that lie in a WINDOW-word window found twice or more in the same row's array.

    Windows are compared by a 64-bit hash within one document. The hashes are
    sorted only where a distinct count shows a repeat.
    """
    w, n = F.col(column), F.size(column)
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
    # the last places have no whole window
    df = words.withColumn("__h", F.slice(hashes, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))))
    h = F.col("__h")
    placed = F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    )
    df = df.withColumn("__s", placed)
    s = F.col("__s")
    # equal neighbours in hash order are twins; a pair marks both of its places
    pairs = F.filter(
        F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("__p", F.sort_array(F.array_distinct(F.flatten(pairs))))
    p = F.col("__p")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), x + WINDOW) - x)),
        F.lit(0), lambda a, x: a + x,
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("bigint")).drop("__h", "__s", "__p")


def _half(p, m):
    """One term of the divergence; zero shares add nothing."""
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def _distance(ps, qs):
    """Jensen-Shannon distance of two arrays of shares of equal length."""
    terms = F.zip_with(ps, qs, lambda p, q: _half(p, (p + q) / 2) / 2 + _half(q, (p + q) / 2) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _word_distance(reference: dict[str, float]):
    """Distance of the shares of ``reference``'s words, all other words being one more bin."""
    names = F.array(*[F.lit(x) for x in reference])
    shares = [x / 100 for x in reference.values()]
    q = F.array(*[F.lit(x) for x in [*shares, 1 - sum(shares)]])
    n = F.col("n_words").cast("double")
    found = F.filter(F.col("__words"), lambda x: x.isin(list(reference)))

    def shares_of(f):
        known = F.transform(names, lambda x: (F.size(f) - F.size(F.array_remove(f, x))).cast("double") / n)
        return F.concat(known, F.array((n - F.size(f)) / n))

    # the one-element transform evaluates the filter once
    return F.get(F.transform(F.array(found), lambda f: _distance(shares_of(f), q)), F.lit(0))


def quality_rules(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str | None = "lang") -> DataFrame:
    """``judged``, written to the shared folder and read back.

    The optimiser would move a filter on the result below the projections and
    evaluate a text's arrays again for each element; a table of short rows has no
    such trouble.
    """
    return store(judged(docs, rules, id_col, text_col, lang_col), "quality_rules")


def judged(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text",
           lang_col: str | None = "lang") -> DataFrame:
    """One row per row of ``docs``: counts, base rule, distances and verdict.

    A null text has no words and fails the base rule; so does an empty one. A
    null or unlisted language, or ``lang_col=None``, takes the nearest of all references. Repeated
    rows and equal or null ids are rows of their own. Other columns go. Empty tables
    give empty tables. Digits count in no class. Distances are null where a minimum length is not met.
    """
    rules = rules or Rules()
    lang = F.lower(F.col(lang_col).cast("string")) if lang_col else F.lit(None).cast("string")
    df = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"),
        lang.alias("__lang"),
    )
    # each class is removed from what the one before has left, so only the first pass sees the whole text
    rest = "__text"
    for name, pattern in (("lower", r"\p{Ll}+"), ("blank", SPACE), ("letter", r"[\p{Lm}\p{Lo}\p{M}]+"), 
                          ("wide", r"[\p{Z}\p{C}]+"), ("upper", r"[\p{Lu}\p{Lt}]+"), ("digit", r"\p{N}+"), ("base", r"[#*$%&|<>]+"),
                          ("sign", r"\p{S}+")):
        df = df.withColumn(f"__r_{name}", F.regexp_replace(rest, pattern, ""))
        df = df.withColumn(f"__n_{name}", (F.length(rest) - F.length(f"__r_{name}")).cast("bigint"))
        rest = f"__r_{name}"
    df = df.withColumn("__n_punctuation", F.length(rest).cast("bigint"))
    df = df.withColumn("__trim", F.btrim("__text", F.lit(SPACE_CHARS)))
    df = df.withColumn("__words", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(
        F.split("__trim", SPACE)))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    df = df.withColumn("__lines", lines)
    df = df.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": (F.length("__text") - F.col("__n_blank")).cast("bigint"),
        "n_symbols": F.col("__n_base"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "__chars": (F.length("__text") - F.col("__n_digit")).cast("double"),
    })
    df = repeated_window_words(df, "__words")
    kinds = [F.col("__n_lower") + F.col("__n_letter"), F.col("__n_upper"), F.col("__n_blank") + F.col("__n_wide"),
             F.col("__n_base") + F.col("__n_sign"), F.col("__n_punctuation")]
    total = sum(rules.classes)
    df = df.withColumn("base_failed", (F.col("n_words") < rules.fail_words) | (
        100 * F.col("n_repeat_words") > rules.fail_repeat_percent * F.col("n_words")))
    df = df.withColumn("class_distance", F.when(F.col("__chars") >= rules.min_chars, _distance(
        F.array(*[k / F.col("__chars") for k in kinds]), F.array(*[F.lit(x / total) for x in rules.classes]))))
    nearest = [_word_distance(r) for r in rules.references.values()]
    nearest = F.least(*nearest) if len(nearest) > 1 else nearest[0]
    word = F.lit(None).cast("double")
    for name, r in rules.references.items():
        word = F.when(F.col("__lang") == name, _word_distance(r)).otherwise(word)
    known = F.coalesce(F.col("__lang").isin(list(rules.references)), F.lit(False))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= rules.min_words,
                                               F.when(known, word).otherwise(nearest)))
    limit = F.when(F.col("n_words") < rules.min_words, rules.short_class_distance).otherwise(rules.max_class_distance)
    kept = (~F.col("base_failed") & F.coalesce(F.col("class_distance") <= limit, F.lit(True))
            & F.coalesce(F.col("word_distance") <= rules.max_word_distance, F.lit(True)))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     kept.alias("kept"), "class_distance", "word_distance")
