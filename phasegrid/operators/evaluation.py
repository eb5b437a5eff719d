"""Statistics of features, classes and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_ratio
from .encode import feature_name, melt
from .prefix import exact_quantiles, running_totals, with_bucket


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_if(F.col(label)).alias("n_true"), F.count_if(~F.col(label)).alias("n_false"))


def class_totals(df: DataFrame, y: str) -> tuple[int, int]:
    """Rows, and rows of the class: the two numbers through which the zeros of sparse features count."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("int")).alias("s")).first()
    return row["n"], row["s"] or 0


def feature_sums(entries: DataFrame) -> DataFrame:
    """Sums of v, v y and v v of every feature, from its (col, cat, value, y) entries that aren't zero."""
    v, y = F.col("value"), F.col("y").cast("int")
    return entries.groupBy("col", "cat").agg(
        F.sum(v).cast("double").alias("sv"), F.sum(F.when(y == 1, v).otherwise(0)).cast("double").alias("svy"),
        F.sum(v * v).cast("double").alias("svv"),
    )


def _chi2(totals: tuple[int, int]) -> Column:
    n, ones = (F.lit(float(x)) for x in totals)
    o1, o0 = F.col("svy"), F.col("sv") - F.col("svy")
    e1, e0 = ones / n * F.col("sv"), (n - ones) / n * F.col("sv")
    part = lambda o, e: F.when(e > 0, (o - e) * (o - e) / e)
    return part(o1, e1) + part(o0, e0)


def _pearson(totals: tuple[int, int]) -> Column:
    n, ones = (F.lit(float(x)) for x in totals)
    spread_v, spread_y = n * F.col("svv") - F.col("sv") * F.col("sv"), n * ones - ones * ones
    return F.when((spread_v > 0) & (spread_y > 0), (n * F.col("svy") - F.col("sv") * ones) / (F.sqrt(spread_v) * F.sqrt(spread_y)))


def chi2_scores(sums: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """(col, cat, importance): chi-square of non-negative features against a class, from ``feature_sums`` and ``class_totals``."""
    return sums.select("col", "cat", _chi2(totals).alias("importance"))


def point_biserial(sums: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """(col, cat, correlation) of every feature with the 0/1 class; NULL for constant features."""
    return sums.select("col", "cat", _pearson(totals).alias("correlation"))


def feature_evaluation(sums: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """(col, cat, feature, importance, correlation) of every feature that isn't zero everywhere."""
    return sums.select("col", "cat", feature_name(), _chi2(totals).alias("importance"), _pearson(totals).alias("correlation"))


def top_k(evaluation: DataFrame, k: int | str = 100) -> DataFrame:
    """The k most important features; ties by name. ``"all"`` is min(0.8 n, 1000)."""
    if k == "all":
        k = int(min(evaluation.count() * 0.8, 1000))
    return evaluation.orderBy(F.col("importance").desc(), F.col("feature").asc()).limit(k)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric column."""
    long = melt(df, [], columns).filter(F.col("value").isNotNull())
    basic = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quart = exact_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75])
    q = [F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(["q25", "q50", "q75"])]
    return basic.join(quart.select("feature", *q), "feature")


def profile(df: DataFrame, columns: list[str], examples: int = 3) -> DataFrame:
    """Distinct values, the smallest few of them, the largest and the smallest, per column.

    Values are made distinct first, so the number of rows behind one value does
    not matter.
    """
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    values = df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull()).distinct()
    counted = values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )
    # the rank is cut inside every task before the rows of a column meet
    first = Window.partitionBy("feature").orderBy("value")
    smallest = values.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= examples)
    shown = smallest.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("examples"))
    return counted.join(shown, "feature")


def confusion(df: DataFrame, label: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    return df.groupBy(*(keys or [])).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
    )


def _share(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(round_ratio(num, den, 3))


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """Rates at three decimals; 0 where a denominator is 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    d = lambda c: c.cast("double")
    root = F.sqrt(d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn))
    sens = F.when(tp + fn == 0, F.lit(0.0)).otherwise(tp / (tp + fn))
    spec = F.when(tn + fp == 0, F.lit(0.0)).otherwise(tn / (tn + fp))
    return counts.withColumns(
        {
            "precision": _share(tp, tp + fp),
            "sensitivity": _share(tp, tp + fn),
            "specificity": _share(tn, tn + fp),
            "acc": _share(tp + tn, tp + tn + fp + fn),
            "f1": _share(tp * 2, tp * 2 + fp + fn),
            "mcc": F.when(root == 0, F.lit(0.0)).otherwise(F.round((d(tp) * tn - d(fp) * fn) / root, 3)),
            "auc": F.round((sens + spec) / 2, 3),
        }
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """tpr and fpr at every distinct score, highest first, and the area's share of each point.

    The area under the curve is the sum of ``area`` over the points.
    """
    y = F.col(label)
    points = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")
    )
    ranked = running_totals(with_bucket(points, [], "threshold"), [], "threshold", ["pos", "neg"], descending=True)
    before = F.col("cum_pos") - F.col("pos")
    return ranked.select(
        "threshold",
        (F.col("cum_pos") / F.col("all_pos")).alias("tpr"),
        (F.col("cum_neg") / F.col("all_neg")).alias("fpr"),
        (F.col("neg") * (before + F.col("pos") / 2) / (F.col("all_pos") * F.col("all_neg"))).alias("area"),
    )


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population standard deviation over the folds, from (model, metric, fold, value)."""
    return scores.groupBy("model", "metric").agg(
        F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_pop("value"), 3).alias("std")
    )


def rank_models(summary: DataFrame) -> DataFrame:
    order = Window.partitionBy("metric").orderBy(F.col("mean").desc())
    return summary.withColumn("rnk", F.rank().over(order))
