import pytest
from pyspark.sql import functions as F

from lexiflume.functions import metrics as M, text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first().r


@pytest.mark.parametrize(("roman", "n"), [("I", 1), ("iv", 4), ("XII", 12), ("xc", 90), ("MCMXCIV", 1994), ("iix", 8), ("", None), ("?", None), (None, None)])
def test_roman(spark, roman, n):
    assert one(spark, roman, X.roman_to_int("t")) == n


def test_numbers_need_an_edge_before_the_keyword(spark):
    text = "Điều 5a, khoản 2 và xđiều 9; ARTICLE. 7 Chương IV chương mới Mục 3"
    assert one(spark, text, X.article_numbers("t")) == [5, 7]
    assert one(spark, text, X.clause_numbers("t")) == [2]
    assert one(spark, text, X.chapter_numbers("t")) == [4]
    assert one(spark, text, X.section_numbers("t")) == [3]


def test_references(spark):
    got = one(spark, "điều 3, điều 4, điều 3, điều 5", X.references("t"))
    assert (got.primary, got.refs) == (3, [4, 3, 5])
    assert one(spark, "điều 3, điều 4, điều 3", X.references("t", F.lit(3))).refs == [4]
    assert one(spark, "nothing", X.references("t")).refs == []


def test_normalisation(spark):
    assert one(spark, " É   x\n", X.normalize("t")) == "é x"
    assert one(spark, "A-b, c!", X.eval_normalize("t")) == "a b c"
    assert one(spark, None, X.tokens("t")) == [] and one(spark, "", X.eval_tokens("t")) == []


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (5, [5]), (55, [55]), (60, [50, 10]), (109, [50, 59]), (160, [50, 50, 50, 10])])
def test_word_windows(spark, n, sizes):
    assert [len(w.split()) for w in one(spark, " ".join(["w"] * n), X.word_windows("t"))] == sizes


def test_lists_and_choices(spark):
    assert one(spark, "1. a\n- \"b\"\n\n* a\nc\nd\ne", X.list_items("t")) == ["a", "b", "c", "d"]
    assert one(spark, "Correct Answer: (B), (A), (B), (F), (C)", X.chosen_letters("t", 5)) == [1, 0]
    assert one(spark, "```\n'q'\nz", X.rewritten("t", F.lit("o"))) == "q" and one(spark, None, X.rewritten("t", F.lit("o"))) == "o"


@pytest.mark.parametrize(("a", "b", "o"), [("x x y", "x y y", 2), ("", "x", 0), ("a b", "a b", 2)])
def test_token_metrics(spark, a, b, o):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(X.eval_tokens("a").alias("a"), X.eval_tokens("b").alias("b"))
    r = df.select(M.overlap(F.col("a"), F.col("b")).alias("o"), M.token_f1(F.col("a"), F.col("b")).alias("f"), M.bleu1(F.col("a"), F.col("b")).alias("bl"), M.rouge_l("a", "b").alias("r")).first()
    n, m = len(a.split()), len(b.split())
    assert r.o == o and r.f == pytest.approx(2 * o / (n + m) if o else 0)


def test_lcs_against_recursion():
    import random
    from functools import cache

    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))

        @cache
        def lcs(i, j, a=a, b=b):
            if i == len(a) or j == len(b):
                return 0
            return 1 + lcs(i + 1, j + 1) if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

        assert M.lcs_length(a, b) == lcs(0, 0)


def test_strips_keep_their_characters(spark):
    """Each strip is trimmed of spaces, never of the digits of its place (0, 1, ...)."""
    text = "0. Begins with its own place 0.\n  1 password=b8a6bab61dc0d1  ;\n21 apples and 32 pears, 2"
    got = spark.createDataFrame([(text,)], "text string").select(X.strips("text").alias("s")).first().s
    assert got == ["Begins with its own place 0.", "1 password=b8a6bab61dc0d1  ;", "21 apples and 32 pears, 2"]
