"""Scoring goldens (FIXTURES §6) and Python-vs-Java edge cases."""

import pytest
from pyspark.sql import functions as F

from tabqa.functions import text as T
from tabqa.operators import scoring as O

GOLDENS = [
    ("The Cat.", "cat", 1, 1.0),
    ("12.0", "12", 1, 1.0),
    ("nan", "nan", 0, 0.0),
    ("1d", "1", 0, 0.0),
    ("1_0", "10", 1, 1.0),
    ("", "a", 1, 0.0),
    ("b a b", "b b", 1, 1.0),
    ("x y", "y z", 0, 0.5),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, p, g) for i, (p, g, _, _) in enumerate(GOLDENS)], "id int, pred string, gold string")


def test_exact_match(pairs):
    got = {r.id: r.em for r in pairs.select("id", O.exact_match(F.col("pred"), F.col("gold")).alias("em")).collect()}
    assert got == {i: em for i, (_, _, em, _) in enumerate(GOLDENS)}


def test_f1(pairs):
    got = {r.id: r.f1 for r in O.f1(pairs, ["id"]).collect()}
    want = {i: f1 for i, (_, _, _, f1) in enumerate(GOLDENS)}
    # both-empty after normalisation: the reference's F1 is 0 (no common tokens)
    assert got == want


@pytest.mark.parametrize(
    "s,expected",
    [("1", True), (" -2.5e3 ", True), ("1_000", True), ("1__0", False), ("_1", False), ("1d", False), ("0x10", False),
     ("inf", True), ("-Infinity", True), ("NaN", True), (".5", True), ("5.", True), ("", False), ("1e", False)],
)
def test_is_numeric_matches_python(spark, s, expected):
    def py(x):
        try:
            float(x)
            return True
        except ValueError:
            return False

    assert py(s) == expected
    got = spark.createDataFrame([(s,)], "s string").select(T.is_numeric(F.col("s")).alias("v")).first().v
    assert got == expected


def test_normalize_unicode_words(spark):
    df = spark.createDataFrame([("Théa a l'été, the END!",)], "s string")
    got = df.select(T.normalize(F.col("s")).alias("n")).first().n
    # Python: lower, drop punctuation, \\b(a|an|the)\\b -> ' ', squeeze
    assert got == "théa lété end"
