"""False discovery rate, tail probabilities of a fitted gamma distribution, and the vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..session import spread
from .prefix import running_totals

UPPER = ["Howell", "Howellb", "Guo", "Guo_b"]
LOWER = ["pval", "pval_b"]
STEPS = 1000


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, adjusted: str, accept: str, alpha: float = 0.05) -> DataFrame:
    """Adjusted p-values and acceptance per key.

    Probabilities carry six decimals, so each key has at most a million
    distinct values; those are ranked in buckets of a thousandth, and only the
    few bucket summaries meet in one place.
    """
    counted = df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("cnt"))
    bucketed = counted.withColumn("_bucket", F.floor(F.col(p) * STEPS))
    ranked = running_totals(bucketed, keys, p, ["cnt"]).withColumn(
        "_raw", F.col(p) * F.col("all_cnt") / F.col("cum_cnt")
    )
    ranked = ranked.withColumn("_ok", F.when(F.col(p) <= alpha * F.col("cum_cnt") / F.col("all_cnt"), F.col(p)))
    whole = Window.partitionBy(*keys)
    later = whole.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = ranked.groupBy(*keys, "_bucket").agg(F.min("_raw").alias("_m"), F.max("_ok").alias("_o"))
    tails = per_bucket.select(
        *keys, "_bucket", F.min("_m").over(later).alias("_later"), F.max("_o").over(whole).alias("_limit")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    table = ranked.join(tails, [*keys, "_bucket"]).select(
        *keys,
        p,
        F.least(F.lit(1.0), F.min("_raw").over(inside), F.coalesce("_later", F.lit(1.0))).alias(adjusted),
        F.coalesce(F.col(p) <= F.col("_limit"), F.lit(False)).alias(accept),
    )
    return df.join(table, [*keys, p], "left")


def gamma_moments(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Shape and scale by the method of moments, one row per key and column."""
    return _sufficient(df, keys, columns).select(
        *keys,
        "feature",
        (F.col("mean") * F.col("mean") / F.col("var")).alias("shape"),
        (F.col("var") / F.col("mean")).alias("scale"),
    )


def _sufficient(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    aggs = []
    for c in columns:
        aggs += [
            F.avg(c).alias(f"mean_{c}"),
            F.var_pop(c).alias(f"var_{c}"),
            F.avg(positive(c)).alias(f"pmean_{c}"),
            F.avg(F.log(positive(c))).alias(f"plog_{c}"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"mean_{c}").alias("mean"),
            F.col(f"var_{c}").alias("var"),
            F.col(f"pmean_{c}").alias("pmean"),
            F.col(f"plog_{c}").alias("plog"),
        )
        for c in columns
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def gamma_fit(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Two-parameter maximum likelihood (location 0, zeros left out), one row per key and column.

    ln(mean) - mean(ln x) is the mean of d - ln(1 + d) with d = x / mean - 1,
    which has no cancelling terms; so the data are read twice, for the means and
    for that. A constant column has no spread and gets no shape.
    """
    means = _sufficient(df, keys, columns).select(*keys, "feature", "pmean")
    pick = [F.max(F.when(F.col("feature") == c, F.col("pmean"))).alias(f"_m_{c}") for c in columns]
    wide = means.groupBy(*keys).agg(*pick)
    joined = df.select(*keys, *columns).join(wide, keys)

    def spread(c: str) -> Column:
        d = (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_m_{c}")
        return F.avg(F.when(F.col(c) > 0, d - F.log1p(d))).alias(f"_s_{c}")

    spreads = joined.groupBy(*keys).agg(*[spread(c) for c in columns], *[F.max(f"_m_{c}").alias(f"_m_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"_s_{c}").alias("_s"), F.col(f"_m_{c}").alias("pmean")) for c in columns]
    stats = spreads.select(*keys, F.inline(F.array(*rows)))
    shape = special.gamma_shape(F.col("_s"))
    return stats.withColumn("shape", shape).select(*keys, "feature", "shape", (F.col("pmean") / F.col("shape")).alias("scale"))


def gamma_tails(df: DataFrame, keys: list[str], upper: list[str] = UPPER, lower: list[str] = LOWER) -> DataFrame:
    """Add ``<score>_ccdf`` for the upper scores and ``<p>_cdf`` for the probabilities."""
    fitted = gamma_fit(df, keys, upper + lower)
    pick = []
    for c in upper + lower:
        mine = F.col("feature") == c
        pick += [F.max(F.when(mine, F.col("shape"))).alias(f"_a_{c}"), F.max(F.when(mine, F.col("scale"))).alias(f"_b_{c}")]
    wide = fitted.groupBy(*keys).agg(*pick)
    # few bytes but much work: left to itself the planner would merge the rows into one task
    joined = spread(df.join(wide, keys), *[f"`{c}`" for c in df.columns])

    def cdf(c: str) -> Column:
        return special.gamma_cdf(F.col(c).cast("double"), F.col(f"_a_{c}"), F.col(f"_b_{c}"))

    out = joined.withColumns(
        {**{f"{c}_ccdf": F.lit(1.0) - cdf(c) for c in upper}, **{f"{c}_cdf": cdf(c) for c in lower}}
    )
    return out.drop(*[f"_{x}_{c}" for c in upper + lower for x in "ab"])


def vote(df: DataFrame, columns: list[str], threshold: float = 0.05) -> DataFrame:
    """How many of the tail probabilities are below the threshold; NULL does not count."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce((F.col(c) < threshold).cast("int"), F.lit(0))
    return df.withColumn("vote", total)
