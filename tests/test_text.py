import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.functions.fuzzy import common_subsequence, token_set_ratio


@pytest.mark.parametrize(
    "name, key",
    [
        ("Sony", "sony"), ("by Sony", "sony"), ("Visit the Sony Store", "sony"), (" SONY  Store ", "sony"), ("Visit the by Sony Store", "sony"),
        ("by Visit the X Store", "visit the x"), ("Store", "store"), ("Apple Store Store", "apple store"),
    ],
)
def test_brand_key(spark, name, key):
    assert spark.range(1).select(text.brand_key(F.lit(name))).first()[0] == key


def test_brand_of(spark):
    rows = [({"Brand": "   "}, "Acme", None), ({"Brand": ""}, " Acme ", "Acme"), ({"Manufacturer": "M"}, "Acme", "M"), (None, None, None), (None, "S", "S")]
    df = spark.createDataFrame(rows, "details map<string,string>, store string, want string")
    assert [(r[0], r[1]) for r in df.select(text.brand_of(F.col("details"), F.col("store")), "want").collect()] == [(r[2], r[2]) for r in rows]


def test_description(spark):
    df = spark.createDataFrame([("T", list("abcdefg"), ["x" * 600, "y"]), (None, None, None)], "t string, f array<string>, d array<string>")
    got = [r[0] for r in df.select(text.description(F.col("t"), F.col("f"), F.col("d"))).collect()]
    assert got == ["T a | b | c | d | e " + "x" * 500, ""]


def brute_subsequence(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_fuzzy():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(2))
        assert common_subsequence(a, b) == brute_subsequence(a, b)
    assert token_set_ratio("sony headphones", "headphones sony pro") == 100
    assert token_set_ratio("", "x") == 0 and token_set_ratio("abc", "xyz") == 0
    assert round(token_set_ratio("a b", "a c"), 3) == round(max(200 * 2 / 6, 200 * 1 / 4), 3)
