"""Awkward tables that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

LONG = "word " * 20_000
AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (5, " \n\t ", None, "b", 3),
    (6, LONG, "en", "b", 1),
    (7, "é ü ñ 日本語 \x00 \u2028 idiot", "fr", "c", 9),
    (None, "a row without an id", "de", None, 2),
    (8, "12345 !!! ???", None, "c", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = ("score", "set_id", "unit", "token", "label", "held_out", "x", "h", "start", "component", "rep", "host", "n")


def awkward(spark, extra=True):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if extra else df


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def labels(spark, rows=((1, 1, 0), (2, 1, 0), (7, 0, 1), (11, 0, 1), (12, 1, 0), (3, None, None), (None, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
