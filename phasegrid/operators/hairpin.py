"""Rules that decide whether a site lies on one arm of a hairpin.

The pair table of each fold is gathered into one array (-1 = unpaired, bounded by
the fold's length); the rules are then expressions on slices of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    max_unpaired: int
    max_star_unpaired: int
    max_size_difference: int
    max_gap: int
    max_star_gap: int
    min_foldback: int
    max_asymmetry: int
    min_unpaired: int
    extension: int


# The published rule profiles.
PROFILES = {
    "def": Profile(6, 6, 3, 3, 3, 54, 2, 1, 2),
    "mey": Profile(4, 5, 3, 2, 3, 60, 2, 1, 2),
    "m18": Profile(4, 5, 3, 2, 3, 60, 2, 1, 2),
}

UNPAIRED = -1


def span(pairs: Column, first: Column, last: Column) -> Column:
    """Partners of the letters first..last inclusive.

    Negative places count from the end of the fold, and a place beyond the end
    counts as paired with place 0.
    """
    n = F.size(pairs)

    def at(i: Column) -> Column:
        place = F.when(i < 0, n + i).otherwise(i)
        return F.when((place >= 0) & (place < n), F.get(pairs, place)).otherwise(F.lit(0))

    return F.when(last >= first, F.transform(F.sequence(first, last), at)).otherwise(F.array().cast("array<int>"))


def unpaired_count(arm: Column) -> Column:
    return F.size(F.filter(arm, lambda x: x == UNPAIRED))


def longest_gap(arm: Column) -> Column:
    """Longest run of unpaired letters."""
    drawn = F.array_join(F.transform(arm, lambda x: F.when(x == UNPAIRED, ".").otherwise("|")), "")
    return F.coalesce(F.array_max(F.transform(F.split(drawn, r"\|"), lambda s: F.length(s))), F.lit(0))


def _indexed(arm: Column) -> Column:
    return F.filter(
        F.transform(arm, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != UNPAIRED
    )


def _partners_right(arm: Column, first: Column) -> Column:
    return F.exists(_indexed(arm), lambda e: e["x"] > first + e["i"])


def _partners_left(arm: Column, first: Column) -> Column:
    return F.exists(_indexed(arm), lambda e: e["x"] < first + e["i"])


def arm_call(arm: Column, first: Column, profile: Profile) -> Column:
    """5prime / 3prime when the arm pairs to one side only, else the first rule it breaks."""
    right, left = _partners_right(arm, first), _partners_left(arm, first)
    return (
        F.when(unpaired_count(arm) > profile.max_unpaired, "NONPAIRING")
        .when(right & left, "MIXED_PAIRING")
        .when(longest_gap(arm) > profile.max_gap, "MIR_BULGE")
        .when(left, "3prime")
        .when(right, "5prime")
        .otherwise("")
    )


def star_bounds(arm: Column, n: Column) -> tuple[Column, Column]:
    """Place range opposite to the arm, unpaired ends included, cut to the fold.

    A bound of exactly 0 is taken as not yet found, so the next paired letter
    decides; without any other the range ends at the arm's length, or starts at 0.
    """
    size = F.size(arm)
    highs = F.filter(F.transform(_indexed(arm), lambda e: e["x"] + e["i"]), lambda v: v != 0)
    lows = F.filter(F.transform(_indexed(arm), lambda e: e["x"] - (size - 1 - e["i"])), lambda v: v != 0)
    top = F.least(F.coalesce(F.get(highs, F.lit(0)), size), n - 1)
    bottom = F.greatest(F.coalesce(F.get(lows, F.size(lows) - 1), F.lit(0)), F.lit(0))
    return bottom, top


def asymmetry(arm: Column) -> Column:
    """Unpaired letters of the arm that have no counterpart on the other side."""
    paired = _indexed(arm)
    following = F.slice(paired, F.lit(2), F.greatest(F.size(paired) - 1, F.lit(0)))
    leading = F.slice(paired, F.lit(1), F.greatest(F.size(paired) - 1, F.lit(0)))

    def surplus(a: Column, b: Column) -> Column:
        bulge = b["i"] - a["i"] - 1
        extra = bulge - (F.abs(b["x"] - a["x"]) - 1)
        return F.when((bulge > 0) & (a["x"] != 0), F.greatest(extra, F.lit(0))).otherwise(0)

    return F.aggregate(F.zip_with(leading, following, surplus), F.lit(0), lambda s, x: s + x)


def arm_statistics(df: DataFrame, key: str, start: Column, stop: Column) -> DataFrame:
    """The measures the rules look at, for the site start..stop itself; needs ``pairs``."""
    arm = df.withColumns({"_beg": start.cast("int"), "_end": stop.cast("int")}).withColumn(
        "_arm", span(F.col("pairs"), F.col("_beg"), F.col("_end"))
    )
    bottom, top = star_bounds(F.col("_arm"), F.size("pairs"))
    ordered = _indexed(F.col("_arm"))
    return arm.select(
        key,
        unpaired_count(F.col("_arm")).alias("unpaired"),
        F.size(F.filter(ordered, lambda e: e["x"] > F.col("_beg") + e["i"])).alias("to_right"),
        F.size(F.filter(ordered, lambda e: e["x"] < F.col("_beg") + e["i"])).alias("to_left"),
        longest_gap(F.col("_arm")).alias("longest_gap"),
        asymmetry(F.col("_arm")).alias("asymmetry"),
        bottom.alias("star_stop"),
        top.alias("star_start"),
    )


def hairpin_check(
    df: DataFrame, start: Column, stop: Column, profile: str = "def",
    names: tuple[str, str, str] = ("hairpin_conclu", "fback_start", "fback_stop"),
) -> DataFrame:
    """Verdict and fold-back bounds for the site start..stop inclusive; needs ``pairs``."""
    rules = PROFILES[profile]
    n, beg, end = F.size("pairs"), F.col("_beg"), F.col("_end")
    staged = df.withColumns({"_beg": start.cast("int"), "_end": stop.cast("int")})
    staged = staged.withColumn("_arm", span(F.col("pairs"), beg, end))
    staged = staged.withColumn("_call", arm_call(F.col("_arm"), beg, rules))
    bottom, top = star_bounds(F.col("_arm"), n)
    # each measure is taken only of rows whose verdict still hangs on it
    called = F.col("_call").isin("5prime", "3prime")
    staged = staged.withColumns({"_low": F.when(called, bottom), "_high": F.when(called, top)})
    five = F.col("_call") == "5prime"
    size = F.when(five, F.abs(beg - F.col("_high"))).otherwise(F.abs(end - F.col("_low")))
    # a size that is not known is not too short
    staged = staged.withColumn("_short", F.coalesce(size < rules.min_foldback, F.lit(False)))
    staged = staged.withColumn("_asym", F.when(called & ~F.col("_short"), asymmetry(F.col("_arm"))))
    open_yet = called & ~F.col("_short") & F.coalesce(F.col("_asym") <= rules.max_asymmetry, F.lit(True))

    passed = []
    for shift in range(rules.extension + 1):
        first, last = beg - shift, end + rules.extension - shift
        long_arm = f"_long{shift}"
        staged = staged.withColumn(
            long_arm, F.when(open_yet & (first >= 0) & (last <= n - 1), span(F.col("pairs"), first, last))
        )
        call = arm_call(F.col(long_arm), first, rules)
        low, high = star_bounds(F.col(long_arm), n)
        extended = F.col(long_arm).isNotNull()
        staged = staged.withColumn(f"_c{shift}", F.when(extended, call))
        staged = staged.withColumn(f"_star{shift}", F.when(F.col(f"_c{shift}").isin("5prime", "3prime"), span(F.col("pairs"), low, high)))
        star = F.col(f"_star{shift}")
        good = (
            F.col(long_arm).isNotNull()
            & F.col(f"_c{shift}").isin("5prime", "3prime")
            & (F.size(star) - F.size(long_arm) < rules.max_size_difference)
            & (unpaired_count(star) <= rules.max_star_unpaired)
            & (longest_gap(star) <= rules.max_star_gap)
            & (
                (unpaired_count(F.col(long_arm)) >= rules.min_unpaired)
                | (unpaired_count(star) >= rules.min_unpaired)
            )
        )
        passed.append(F.when(good, F.col(f"_c{shift}")))

    staged = staged.withColumn("_final", F.coalesce(*reversed(passed)))
    verdict = (
        F.when(~F.col("_call").isin("5prime", "3prime"), F.col("_call"))
        .when(F.col("_short"), "FBACK_SHORT")
        .when(F.col("_asym") > rules.max_asymmetry, "MIR_ASSYMETRY")
        .otherwise(F.coalesce("_final", F.lit("FAILED_MIR_EXTENSION")))
    )
    staged = staged.withColumn(names[0], F.when(F.col("pairs").isNotNull(), verdict))
    ok = F.col(names[0]).isin("5prime", "3prime")
    staged = staged.withColumns(
        {
            names[1]: F.when(ok, F.when(five, beg).otherwise(F.col("_low"))).otherwise(0),
            names[2]: F.when(ok, F.when(five, F.col("_high")).otherwise(end)).otherwise(0),
        }
    )
    inner = ["_beg", "_end", "_arm", "_call", "_low", "_high", "_short", "_asym", "_final"]
    for shift in range(rules.extension + 1):
        inner += [f"_long{shift}", f"_c{shift}", f"_star{shift}"]
    return staged.drop(*inner)
