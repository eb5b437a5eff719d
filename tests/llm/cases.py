"""A documents table that has every awkward row, and an empty one with the same columns."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor " * 20_000
AWKWARD = [
    (1, "The cat and the dog sat on the mat, and the bird sang for it.", "en", "a", 61),
    (1, "The cat and the dog sat on the mat, and the bird sang for it.", "en", "a", 61),  # a repeated row
    (2, "the CAT and the dog sat on the mat,\nand the bird sang for it.", None, "b", None),  # a copy in other letters and blanks
    (3, None, "en", None, None),
    (4, "", "xx", "a", 0),
    (5, " \t\n\x0b\x0c\r ", "de", "b", 7),
    (None, "No id here, but some words all the same for the test.", "en", "a", 53),
    (6, LONG, "en", "a", len(LONG)),
    (7, "x" * 5000, "fr", "b", 5000),
    (8, "é ü 中文     emoji \U0001f600 don't we'll <|endoftext|> +1 (212) 555-0100", "es", "c", 60),
    (9, "### *** $$$ &&& ||| <<<", "en", "c", 23),
]
#: names that operators use themselves, or that differ from an input's only in case
EXTRA = ["'x' as kept", "1 as score", "'y' as fp", "2 as component_id", "'z' as row", "3 as tokens", "4 as key", "5 as n_words",
         "6 as ids", "7 as spans", "8 as block", "9 as epoch", "array(1) as at", "'w' as __text"]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3).selectExpr("*", *EXTRA)


def plain(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA).selectExpr("*", *EXTRA)
