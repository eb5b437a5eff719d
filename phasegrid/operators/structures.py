"""Structure features around an effector site, and the pair table of a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structure as st
from ..functions.sequence import effector_kmers


def structure_window(df: DataFrame, precursor: str = "precursor", fold: str = "fold", effector: str = "eff_seq") -> DataFrame:
    """Add ``start`` (0-based, -1 when absent) and the sequence and fold of the flanked site.

    The site reaches from four letters before the first occurrence to four after
    it, cut to the precursor.
    """
    start = F.instr(F.col(precursor), F.col(effector)) - 1
    a = F.greatest(F.col("start") - st.FLANK, F.lit(0))
    b = F.least(F.col("start") + F.length(effector) + st.FLANK, F.length(precursor))
    return (
        df.withColumn("start", start)
        .withColumns({"_a": a, "_b": b})
        .withColumns(
            {
                "site_seq": F.substring(F.col(precursor), F.col("_a") + 1, F.col("_b") - F.col("_a")),
                "site_fold": F.substring(F.col(fold), F.col("_a") + 1, F.col("_b") - F.col("_a")),
            }
        )
        .drop("_a", "_b")
    )


def effector_kmer_table(df: DataFrame, effector: str = "eff_seq") -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in effector_kmers(F.col(effector)).items()])


def structure_features(df: DataFrame, keep: list[str]) -> DataFrame:
    """97 structure columns in their published order; needs the columns of ``structure_window``.

    The 86 counters are -1 where the effector is not found. All are one projection:
    tokens that several counters name are made once a row, and the generated code is
    split into methods small enough to be compiled. ``least`` passes over NULLs.
    """
    seq, fold = F.col("site_seq"), F.col("site_fold")
    triplets, centres = st.triplet_tokens(seq, fold), st.centre_tokens(seq, fold)
    counters = {
        **st.triplet_structure_counts(triplets),
        **st.lone_pair_counts(centres),
        **st.lone_bulge_counts(centres),
        **st.bulge_histogram(st.bulge_tokens(fold)),
        **st.loop_histogram(st.loop_tokens(fold)),
    }
    lost = F.when(F.col("start") < 0, F.lit(-1))
    located = [F.least(c, lost).alias(n) for n, c in counters.items()]
    return df.select(*keep, *[c.alias(n) for n, c in st.summary_columns(seq, fold).items()], *located)


_PLACES = "array<int>"
_PAIRS = "array<struct<place:int,partner:int>>"


def _once(value: Column, use) -> Column:
    """``use`` of a costly value inside one expression: the planner would evaluate it anew for each mention, or each letter."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _letters(fold: Column) -> Column:
    """The letters as an array: to look one up in the text walks the text from its start."""
    return F.split(fold, "")


def _places(letters: Column, which) -> Column:
    """0-based places of the letters that ``which`` holds for."""
    return F.filter(F.transform(letters, lambda c, i: F.when(which(c), i)), lambda i: i.isNotNull())


def matched(fold: Column) -> Column:
    """(closes, opens, left): places of the closing brackets, the partner of each (-1: none), and opening ones without a partner.

    Brackets are taken by runs of one kind: a run of opening ones goes on the
    stack, a run of closing ones takes as many from its top. Everything stays
    inside the row. NULL for a NULL or empty fold.
    """
    return _once(fold, lambda text: _once(_letters(text), lambda letters: _matched(text, letters)))


def _matched(fold: Column, letters: Column) -> Column:
    none = F.array().cast(_PLACES)
    start = F.struct(F.lit(0).alias("seen"), none.alias("left"), none.alias("partners"))
    runs = F.regexp_extract_all(F.regexp_replace(fold, "[^()]", ""), F.lit(r"\(+|\)+"), F.lit(0))

    def step(opens: Column):
        def merge(s: Column, run: Column) -> Column:
            n, held, up = F.length(run), F.size(s["left"]), F.startswith(run, F.lit("("))
            taken = F.least(n, held)
            top = F.concat(F.reverse(F.slice(s["left"], held - taken + 1, taken)), F.array_repeat(F.lit(-1), n - taken))
            return F.struct(
                F.when(up, s["seen"] + n).otherwise(s["seen"]).alias("seen"),
                F.when(up, F.concat(s["left"], F.slice(opens, s["seen"] + 1, n))).otherwise(F.slice(s["left"], F.lit(1), held - taken)).alias("left"),
                F.when(up, s["partners"]).otherwise(F.concat(s["partners"], top)).alias("partners"),
            )

        return merge

    closes = _places(letters, lambda c: c == ")")
    found = _once(_places(letters, lambda c: c == "("), lambda o: F.aggregate(runs, start, step(o)))
    result = _once(found, lambda s: F.struct(closes.alias("closes"), s["partners"].alias("opens"), s["left"].alias("left")))
    return F.when(F.length(fold) > 0, result)


def _zipped(places: Column, partners: Column) -> Column:
    return F.arrays_zip(places.alias("place"), partners.alias("partner")).cast(_PAIRS)


def balanced(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Rows whose brackets close properly."""
    proper = _once(matched(F.col(fold)), lambda m: (F.size(m["left"]) == 0) & ~F.array_contains(m["opens"], -1))
    return df.filter(F.coalesce(proper, F.col(fold) == ""))


def pair_table(df: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """(key, place, partner) for every bracket of a balanced fold, 0-based."""
    both = _once(matched(F.col(fold)), lambda m: F.concat(_zipped(m["closes"], m["opens"]), _zipped(m["opens"], m["closes"])))
    return df.select(key, F.inline_outer(both)).filter((F.col("place") >= 0) & (F.col("partner") >= 0))


def with_pairs(df: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """Add ``pairs``: the partner of every letter of the fold as one array, -1 where there is none.

    Rows whose key or fold is NULL, or whose fold is empty, have no pairs.
    """

    def every(letters: Column, m: Column) -> Column:
        dots = _places(letters, lambda c: ~c.isin("(", ")"))
        back = F.filter(_zipped(m["opens"], m["closes"]), lambda x: x["place"] >= 0)
        bare = _once(F.concat(m["left"], dots), lambda x: _zipped(x, F.array_repeat(F.lit(-1), F.size(x))))
        return F.sort_array(F.concat(_zipped(m["closes"], m["opens"]), back, bare))["partner"]

    def paired(text: Column) -> Column:
        return _once(_letters(text), lambda letters: _once(_matched(text, letters), lambda m: every(letters, m)))

    pairs = _once(F.col(fold), lambda text: F.when(F.length(text) > 0, paired(text)))
    return df.withColumn("pairs", F.when(F.col(key).isNotNull(), pairs))
