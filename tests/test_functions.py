"""Text functions on written-out cases."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as fx


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'array<double>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), ("abc", 1), ("a" * 19, 4), ("a" * 401, 100)])
def test_token_count(spark, text, n):
    assert one(spark, fx.token_count("t"), t=text) == n


def test_sentences(spark):
    assert one(spark, fx.sentences("t"), t="One. Two?  Three!\nFour") == ["One.", "Two?", "Three!", "Four"]


def test_index_tokens_keep_repeats_and_drop_stop_words(spark):
    assert one(spark, fx.index_tokens("t"), t="The cat, the CAT; über_x a I don't") == ["cat", "cat", "über_x"]
    assert one(spark, fx.index_tokens("t"), t=None) == []


def test_cache_key_leaves_out_nulls(spark):
    assert one(spark, fx.cache_key("a", "b"), a="x", b=None) == hashlib.sha256(b"x").hexdigest()
    assert one(spark, fx.normal_query("a"), a="  What\n IS  it ") == "what is it"


def test_answers_are_cleaned(spark):
    assert one(spark, fx.without_thoughts("a"), a="<think>x\ny</think> yes ") == "yes"
    assert one(spark, fx.without_fence("a"), a='```json\n{"a": 1}\n```') == '{"a": 1}'


@pytest.mark.parametrize("text,flag", [("1 | 2.5 | -3 | nan", True), ("1 | x", False), ("", False)])
def test_numeric_piece(spark, text, flag):
    assert one(spark, fx.is_numeric_piece("t"), t=text) is flag


@pytest.mark.parametrize("line,flag", [("a | b | c", True), ("a\tb\tc", True), ("aa  bb  cc", True), ("plain words here", False), ("a | b", False)])
def test_table_row(spark, line, flag):
    assert one(spark, fx.is_table_row("t"), t=line) is flag


def test_unit_vector(spark):
    assert one(spark, fx.unit("v"), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, fx.unit("v"), v=[0.0, 0.0]) == [0.0, 0.0]


def test_resolved_score(spark):
    df = spark.createDataFrame([(None, 0.25), (0.5, 0.1), (None, 7.0)], "score double, distance double")
    assert [r[0] for r in df.select(fx.resolved_score(score="score", distance="distance")).collect()] == [0.75, 0.5, 0.0]


def test_file_hash(spark):
    df = spark.createDataFrame([(bytearray(b"ab"),), (bytearray(b"x" * 40000),)], "c binary")
    got = [r[0] for r in df.select(fx.file_hash(F.col("c"))).collect()]
    assert got[0] == hashlib.md5(b"2ab").hexdigest() and got[1] == hashlib.md5(b"40000" + b"x" * 65536).hexdigest()
    assert not math.isnan(len(got))


def test_question_lines_parts_and_checks(spark):
    df = spark.createDataFrame([("- Why?\n2) How?\nNo.\n* When? ",), (None,), ("",), ("a --- b",)], "t string")
    got = [tuple(r) for r in df.select(fx.question_lines("t", 2), fx.summary_parts("t", 3), fx.query_error("t"), fx.shortened("t", 3)).collect()]
    assert got[0][0] == ["Why?", "How?"] and got[1] == (None, None, "empty", None) and got[2][2] == "empty" and got[3][1] == ["a", "b", ""] and got[3][3] == "a -..."


def test_verdicts_are_kept_within_bounds(spark):
    rows = [('```json\n{"relevance": 2, "faithfulness": -1}\n```',), ("no json",), (None,)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "t string").select(fx.verdict("t")).collect()]
    assert got == [(1.0, 0.0, 0.5), (0.5, 0.5, 0.5), (0.5, 0.5, 0.5)]
