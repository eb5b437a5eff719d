"""Column expressions over dot-bracket strings.

Everything is computed inside one row, so a table of structures needs no
shuffle. Counters work on a string of marked tokens: each token is wrapped in
``<`` and ``>``, so removing one token and comparing lengths counts it exactly,
overlapping source windows included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_ratio
from .sequence import motif_count

# Names and ranges of the published structure columns.
HOMOTRIPLETS = ["AAA", "TTT", "CCC", "GGG"]
TRIPLET_SHAPES = ["(((", "((.", "(.(", ".((", "..(", ".(.", "(..", "..."]
BASES = ["A", "T", "C", "G"]
LONE_PAIR_SHAPES = [".(.", ".)."]
LONE_BULGE_SHAPES = [").)", "(.(", ").("]
BULGE_LENGTHS = range(1, 24)
LOOP_LENGTHS = range(3, 24)
ROLLING_WINDOWS = [3, 5, 7]
FLANK = 4

_BULGE = r"\(\.+\(|\)\.+\)|\)\.+\("
_LOOP = r"\(\.+\)"


def dots(fold: Column) -> Column:
    return F.length(fold) - F.length(F.replace(fold, F.lit("."), F.lit("")))


def paired_percentage(fold: Column) -> Column:
    n = F.length(fold)
    return F.when(n == 0, F.lit(0.0)).otherwise(round_ratio((n - dots(fold)) * 100, n, 2))


def paired_rolling_average(fold: Column, window: int) -> Column:
    """Mean number of paired bases per window; NULL when the fold is shorter.

    The j-th letters of all windows form one substring, so ``window`` substrings
    give the total without visiting the windows one by one.
    """
    n = F.length(fold)
    windows = n - window + 1
    unpaired = F.lit(0)
    for j in range(window):
        unpaired = unpaired + dots(F.substring(fold, F.lit(j + 1), windows))
    total = windows * window - unpaired
    return F.when(n == 0, F.lit(0.0)).when(n >= window, round_ratio(total, windows, 2))


def _matches(fold: Column, pattern: str) -> Column:
    return F.regexp_extract_all(fold, F.lit(pattern), F.lit(0))


def _longest(found: Column, trim: int) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda s: F.length(s) - trim)), F.lit(0))


def longest_bulge(fold: Column) -> Column:
    """Longest dot run between brackets that do not close a loop; each kind is scanned alone."""
    kinds = [r"\(\.+\(", r"\)\.+\)", r"\)\.+\("]
    return F.greatest(*[_longest(_matches(fold, p), 2) for p in kinds])


def longest_loop(fold: Column) -> Column:
    return _longest(_matches(fold, _LOOP), 2)


def longest_paired(fold: Column) -> Column:
    return _longest(_matches(fold, "[()]+"), 0)


def count_token(marked: Column, token: str) -> Column:
    token = f"<{token}>"
    removed = F.length(marked) - F.length(F.replace(marked, F.lit(token), F.lit("")))
    return (removed / len(token)).cast("int")


def _triples(seq: Column, fold: Column, make, counted) -> Column:
    """Marked tokens that ``counted`` keeps, at most one per position that starts three consecutive letters.

    Both strings are bound once a row: a lambda would work them out anew for each position.
    """
    n = F.length(seq)
    starts = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))

    def tokens(x: Column) -> Column:
        made = F.transform(starts, lambda i: make(x["seq"], x["fold"], i))
        return F.array_join(F.transform(F.filter(made, counted), lambda t: F.concat(F.lit("<"), t, F.lit(">"))), "")

    return F.get(F.transform(F.array(F.struct(seq.alias("seq"), fold.alias("fold"))), tokens), F.lit(0))


def triplet_tokens(seq: Column, fold: Column) -> Column:
    """Three equal letters and their shape, closing brackets as opening ones; other letters are not counted."""
    folded = F.replace(fold, F.lit(")"), F.lit("("))
    return _triples(seq, folded, lambda s, f, i: F.concat(F.substring(s, i, F.lit(3)), F.substring(f, i, F.lit(3))),
                    lambda t: F.substring(t, 1, 3).isin(HOMOTRIPLETS))


def centre_tokens(seq: Column, fold: Column) -> Column:
    """A letter and the three of the fold around it, where these are a counted shape."""
    return _triples(seq, fold, lambda s, f, i: F.concat(F.substring(s, i + 1, F.lit(1)), F.substring(f, i, F.lit(3))),
                    lambda t: F.substring(t, 2, 3).isin(LONE_PAIR_SHAPES + LONE_BULGE_SHAPES))


def triplet_structure_counts(tokens: Column) -> dict[str, Column]:
    return {m + s: count_token(tokens, m + s) for m in HOMOTRIPLETS for s in TRIPLET_SHAPES}


def _centre_counts(tokens: Column, shapes: list[str], label: str) -> dict[str, Column]:
    out = {}
    for base in BASES:
        total = count_token(tokens, base + shapes[0])
        for shape in shapes[1:]:
            total = total + count_token(tokens, base + shape)
        out[base + label] = total
    return out


def lone_pair_counts(tokens: Column) -> dict[str, Column]:
    return _centre_counts(tokens, LONE_PAIR_SHAPES, ".(.")


def lone_bulge_counts(tokens: Column) -> dict[str, Column]:
    return _centre_counts(tokens, LONE_BULGE_SHAPES, "(.(")


def _length_tokens(fold: Column, pattern: str) -> Column:
    found = _matches(fold, pattern)
    marked = F.transform(found, lambda s: F.concat(F.lit("<"), (F.length(s) - 2).cast("string"), F.lit(">")))
    return F.array_join(marked, "")


def bulge_tokens(fold: Column) -> Column:
    return _length_tokens(fold, _BULGE)


def loop_tokens(fold: Column) -> Column:
    return _length_tokens(fold, _LOOP)


def _histogram(tokens: Column, label: str, lengths) -> dict[str, Column]:
    everything = F.length(tokens) - F.length(F.replace(tokens, F.lit("<"), F.lit("")))
    out = {f"occ_{label}Allnt": everything.cast("int")}
    for n in lengths:
        out[f"occ_{label}{n}nt"] = count_token(tokens, str(n))
    return out


def bulge_histogram(tokens: Column) -> dict[str, Column]:
    return _histogram(tokens, "bulge", BULGE_LENGTHS)


def loop_histogram(tokens: Column) -> dict[str, Column]:
    return _histogram(tokens, "loop", LOOP_LENGTHS)


def summary_columns(seq: Column, fold: Column) -> dict[str, Column]:
    """The eleven columns that describe the window as a whole."""
    out = {"paired_percentage": paired_percentage(fold)}
    for w in ROLLING_WINDOWS:
        out[f"paired_roll{w}"] = paired_rolling_average(fold, w)
    out["length_longest_bulge"] = longest_bulge(fold)
    out["length_longest_loop"] = longest_loop(fold)
    out["longest_paired_length"] = longest_paired(fold)
    for m in HOMOTRIPLETS:
        out[f"NBtriplet{m[0]}"] = motif_count(seq, m)
    return out
