"""Running totals and exact quantiles without sorting everything in one task.

Rows are put into value buckets first. The totals of the buckets are few and
are accumulated on their own; inside a bucket an ordinary window finishes the
work. Bucket limits are plain numbers fixed on the driver before the plan is
made, so every evaluation of the plan assigns rows in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_limits(df: DataFrame, keys: list[str], value: str, n: int = 64) -> DataFrame:
    """Up to ``n`` rising limits per key, as a small local table (keys x n numbers)."""
    probs = [i / n for i in range(1, n)]
    sketch = F.percentile_approx(value, probs, 1000).alias("_limits")
    rows = df.groupBy(*keys).agg(sketch).collect() if keys else df.agg(sketch).collect()
    fields = [f"`{k}` {dict(df.dtypes)[k]}" for k in keys] + ["_limits array<double>"]
    data = [(*[r[k] for k in keys], [float(x) for x in (r["_limits"] or [])]) for r in rows]
    return df.sparkSession.createDataFrame(data, ", ".join(fields))


def with_bucket(df: DataFrame, keys: list[str], value: str, n: int = 64) -> DataFrame:
    limits = bucket_limits(df, keys, value, n)
    if keys:
        placed = df.join(F.broadcast(limits), keys, "left")
    else:
        rows = limits.collect()
        cuts = rows[0]["_limits"] if rows else []
        placed = df.withColumn("_limits", F.array(*[F.lit(c) for c in cuts]).cast("array<double>"))
    below = F.size(F.filter("_limits", lambda x: x < F.col(value)))
    return placed.withColumn("_bucket", F.coalesce(below, F.lit(0)).cast("long")).drop("_limits")


def running_totals(
    bucketed: DataFrame, keys: list[str], value: str, measures: list[str], descending: bool = False
) -> DataFrame:
    """Add ``cum_<measure>`` in the order of ``value`` (the own row included) and ``all_<measure>`` per key.

    ``bucketed`` has one row per (keys, value) and a ``_bucket`` that never
    decreases with ``value``.
    """
    def order(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = whole.orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_b_{m}") for m in measures])
    bases = sums.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_b_{m}").over(before), F.lit(0)).alias(f"_base_{m}") for m in measures],
        *[F.sum(f"_b_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = bucketed.join(bases, [*keys, "_bucket"])
    out = out.withColumns({f"cum_{m}": F.col(f"_base_{m}") + F.sum(m).over(inside) for m in measures})
    return out.drop(*[f"_base_{m}" for m in measures])


def exact_quantiles(long: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per key, NULLs left out: one array ``quantiles``."""
    counted = long.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    ranked = running_totals(with_bucket(counted, keys, value), keys, value, ["cnt"])
    first, last = F.col("cum_cnt") - F.col("cnt"), F.col("cum_cnt") - 1
    picks = []
    for i, q in enumerate(probs):
        at = (F.col("all_cnt") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first <= rank) & (rank <= last), F.col(value))).alias(f"_{side}{i}"))
    picked = ranked.groupBy(*keys).agg(F.max("all_cnt").alias("_n"), *picks)
    values = []
    for i, q in enumerate(probs):
        at = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        values.append(lo + (hi - lo) * (at - F.floor(at)))
    return picked.select(*keys, F.array(*values).alias("quantiles"))
