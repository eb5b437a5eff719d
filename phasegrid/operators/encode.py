"""Turning mixed columns into numbers in [0, 1]."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import use_checkpoints
from .prefix import exact_quantiles

N_QUANTILES = 10


def kinds(df: DataFrame, leave_out: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns by type: strings and booleans are categorical."""
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name in leave_out:
            continue
        target = categorical if isinstance(f.dataType, (T.StringType, T.BooleanType)) else numeric
        target.append(f.name)
    return numeric, categorical


def melt(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """(keep..., feature, value) rows in one pass."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))


def fit_knots(df: DataFrame, columns: list[str], n: int = N_QUANTILES) -> dict[str, list[float]]:
    """Exact quantile knots of every column: a few numbers per column."""
    probs = [i / (n - 1) for i in range(n)]
    rows = exact_quantiles(melt(df, [], columns), ["feature"], "value", probs).collect()
    return {r["feature"]: list(r["quantiles"]) for r in rows}


def quantile_scaled(x: Column, knots: list[float]) -> Column:
    """Linear interpolation between the knots, clipped outside.

    On a value that equals several knots the mean of the first and the last of
    them counts; the lowest value is 0 and the highest 1, a constant column is 0.
    """
    last = len(knots) - 1
    ref = [i / last for i in range(len(knots))]
    expr = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= knots[0], F.lit(0.0)).when(x >= knots[last], F.lit(1.0))
    for value in sorted(set(knots)):
        same = [i for i, k in enumerate(knots) if k == value]
        expr = expr.when(x == F.lit(value), F.lit((ref[same[0]] + ref[same[-1]]) / 2))
    for i in range(last):
        a, b = knots[i], knots[i + 1]
        if a < b:
            expr = expr.when(x < F.lit(b), F.lit(ref[i]) + (x - F.lit(a)) / F.lit(b - a) * F.lit(ref[i + 1] - ref[i]))
    return expr


def entries(df: DataFrame, keep: list[str], knots: dict[str, list[float]], columns: list[str], zeros: bool = False) -> DataFrame:
    """(keep..., col, cat, value) of the encoded row where it isn't zero: scaled numbers (``cat`` NULL), a 1 per category.

    One pass over the rows, for any number of categories, none of which is collected.
    Column and category stay apart, as ``a`` + ``b_c`` and ``a_b`` + ``c`` have one
    name. Scaled values have nine decimals, so that their sums are exact in any order.
    With ``zeros`` numeric zeros are rows too, and a row without any value gives one with no column.
    """
    value = "decimal(18,9)"
    numeric = [
        F.struct(F.lit(c).alias("col"), F.lit(None).cast("string").alias("cat"),
                 F.round(quantile_scaled(F.col(f"`{c}`").cast("double"), k), 9).cast(value).alias("value"))
        for c, k in knots.items()
    ]
    hot = [
        F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("cat"),
                 F.when(F.col(f"`{c}`").isNotNull(), F.lit(1)).cast(value).alias("value"))
        for c in columns
    ]
    found = F.filter(F.array(*numeric, *hot), lambda x: x["value"].isNotNull() & (F.lit(zeros) | (x["value"] != 0)))
    return df.select(*keep, (F.inline_outer if zeros else F.inline)(found))


def feature_name() -> Column:
    """The name of an entry's feature: its column, and its category after an underscore."""
    return F.concat_ws("_", "col", "cat").alias("feature")


def one_hot(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """(keep..., feature, value) of each 1 of the one-hot encoding; zeros are not rows."""
    return entries(df, keep, {}, columns).select(*keep, feature_name(), F.col("value").cast("double").alias("value"))


#: parts that the rows of a column are dealt into where they meet its categories
SALTS = 32


def categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, cat) of every category of these columns, as a table."""
    pairs = [F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("cat")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).filter(F.col("cat").isNotNull()).distinct()


def one_hot_table(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """(keep..., feature, value) of every row and category, zeros too; the categories are written once and stay on Spark.

    Rows meet the categories of a column by its name and a part drawn from the row, so neither side is one task's work.
    """
    use_checkpoints(df.sparkSession)
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part")
    known = categories(df, columns).checkpoint().select("col", "cat", parts)
    texts = [F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("_text")) for c in columns]
    part = F.pmod(F.xxhash64(*keep, *[F.col(f"`{c}`") for c in columns]), F.lit(SALTS)).cast("int").alias("_part")
    rows = df.select(*keep, part, F.inline(F.array(*texts)))
    hit = (F.col("_text") == F.col("cat")).cast("double")
    return rows.join(known, ["col", "_part"]).select(*keep, feature_name(), F.coalesce(hit, F.lit(0.0)).alias("value"))


@dataclass
class Encoder:
    """Fitted numbers and the categories that were chosen: small, so it can be kept, reloaded and applied to any table."""

    knots: dict[str, list[float]] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def of(chosen: list[tuple[str, str | None]], knots: dict[str, list[float]]) -> "Encoder":
        """An encoder of the chosen (column, category) features; numbers have no category."""
        shown: dict[str, list[str]] = {}
        for c, v in chosen:
            if v is not None:
                shown.setdefault(c, []).append(v)
        return Encoder({c: knots[c] for c, v in chosen if v is None}, {c: sorted(v) for c, v in shown.items()})

    def feature_names(self) -> list[str]:
        return [*self.knots, *[f"{c}_{v}" for c, values in self.categories.items() for v in values]]

    def columns(self) -> list[Column]:
        """One column per feature, in the order of the names; a column that is missing is NULL."""
        scaled = [quantile_scaled(F.col(f"`{c}`").cast("double"), k) for c, k in self.knots.items()]
        for c, values in self.categories.items():
            text = F.col(f"`{c}`").cast("string")
            scaled += [F.coalesce((text == v).cast("double"), F.lit(0.0)) for v in values]
        return scaled

    def vector(self) -> Column:
        """The row's features as one array, gaps as 0."""
        return F.array(*[F.coalesce(c, F.lit(0.0)) for c in self.columns()]).cast("array<double>")
