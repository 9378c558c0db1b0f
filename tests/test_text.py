import random
import re

import pytest
from pyspark.sql import functions as F

from doclake.functions import text as tx
from doclake.functions.tokens import WordTokenizer

SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_white_space_is_what_python_strips():
    assert sorted(tx.WHITESPACE) == sorted(SPACES)


@pytest.mark.parametrize("text", ["".join(SPACES) + "a b" + "".join(SPACES), "", "   \n\n  \t  ", "x"])
def test_strip(spark, text):
    assert one(spark, text, tx.strip(F.col("x"))) == text.strip()


def test_splitting_equals_a_plain_python_reading(spark):
    pick = random.Random(3)
    alphabet = ["a", "Bc", ".", "!", "?", " ", "\n", "\n\n", "\t", "\xa0", "é", "1_2", "-"]
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 60))) for _ in range(300)]
    rows = (
        spark.createDataFrame(list(enumerate(texts)), "i int, x string")
        .select("i", tx.paragraphs(F.col("x")).alias("p"), tx.sentences(F.col("x")).alias("s"), tx.token_count(F.col("x")).alias("n"))
        .collect()
    )
    for row in rows:
        text = texts[row.i]
        paragraphs = [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()]
        assert row.p == paragraphs
        assert row.s == [s.strip() for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()]
        assert row.n == len(re.findall(r"\w+|[^\w\s]", text)) + 2
        assert len(WordTokenizer().starts(text)) + 2 == row.n


def test_last_tokens(spark):
    assert one(spark, "one two-three four ", tx.last_tokens(F.col("x"), 3)) == "-three four "
    assert one(spark, "one two", tx.last_tokens(F.col("x"), 9)) == "one two"
    assert one(spark, "", tx.last_tokens(F.col("x"), 9)) == ""


def test_prefix_and_sizes(spark):
    assert one(spark, " hi\n", tx.prefixed(F.col("x"), "query")) == "query: hi"
    assert one(spark, "abc", tx.approx_tokens(F.col("x"))) == 1
    assert one(spark, "é" * 9, tx.approx_tokens(F.col("x"))) == 2
    with pytest.raises(ValueError):
        tx.prefixed(F.col("x"), "other")
