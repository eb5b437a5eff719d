"""Phasing scores of a window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import CYCLE

MIN_K = 3


def _guarded(k: Column, value: Column) -> Column:
    return F.when(k < MIN_K, F.lit(0.0)).otherwise(F.round(value, 2))


def howell_xia(p: Column, u: Column, k: Column) -> Column:
    return _guarded(k, (k - 2) * F.log(1 + 10 * (p / (1 + u))))


def howell_2007(p: Column, k: Column) -> Column:
    return _guarded(k, (k - 2) * F.log(1 + p.cast("double")))


def guo(total: Column, k: Column, p: Column, maxf: Column) -> Column:
    return _guarded(k, maxf / total * k * F.log(p.cast("double")))


def chen_table(spark: SparkSession, cycle: int = CYCLE) -> DataFrame:
    """Upper hypergeometric tails for every (k, n); the size depends on ``cycle`` only.

    m phase places among 21 m places, n of them used: P(at least k on phase).
    """
    m = 2 * cycle - 1
    rows = []
    for n in range(21 * m + 1):
        whole = math.comb(21 * m, n)
        tail = 0
        by_k = {}
        for i in range(m, MIN_K - 1, -1):
            if i <= n:
                tail += math.comb(20 * m, n - i) * math.comb(m, i)
            by_k[i] = tail / whole
        rows.extend((k, n, round(by_k[k], 6)) for k in range(MIN_K, m + 1))
    return spark.createDataFrame(rows, "k int, n int, p double")


def with_chen(df: DataFrame, table: DataFrame, k: str, n: str, out: str, cycle: int = CYCLE) -> DataFrame:
    """Attach the Chen probability; 1 below k = 3, NULL beyond 21 m used places."""
    m = 2 * cycle - 1
    small = F.broadcast(table.select(F.col("k").alias("_k"), F.col("n").alias("_n"), F.col("p").alias("_p")))
    joined = df.join(small, (F.col(k) == F.col("_k")) & (F.col(n) == F.col("_n")), "left")
    value = (
        F.when(F.col(k) < MIN_K, F.lit(1.0))
        .when(F.col(n) > 21 * m, F.lit(None).cast("double"))
        .when(F.col(k) > m, F.lit(0.0))
        .otherwise(F.col("_p"))
    )
    return joined.withColumn(out, value).drop("_k", "_n", "_p")
