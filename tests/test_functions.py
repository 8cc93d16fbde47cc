import datetime
import re

import pytest
from pyspark.sql import functions as F

from querymill.functions import questions, text, time

STRINGS = ["héllo wörld", "a b　c", "日本語 😀x", "allintitle:foo site:bar intitle:x", "a OR OR b", "", "   ", "foo.com", "Foo.BAR", "me@ex.co.uk", "é.é", "bad�", "ANDROID", "SITE:x", "line\nbreak", "isn't it", "x AND y AND z", "ǅ ß", None]


def values(spark, column, strings=STRINGS):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    return [r[1] for r in df.select("i", column(F.col("s"))).orderBy("i").collect()]


def test_lengths_count_code_points(spark):
    assert values(spark, text.char_count) == [None if s is None else len(s) for s in STRINGS]


def test_whitespace_words_as_python_splits(spark):
    got = values(spark, text.whitespace_word_count)
    assert got[:-1] == [len(s.split()) for s in STRINGS[:-1]]


def test_operator_occurrences(spark):
    want = [None if s is None else sum(s.count(o) for o in text.OPERATORS) for s in STRINGS]
    got = values(spark, text.operator_count)
    assert got == want
    assert got[3] == 4  # allintitle: holds intitle:, which counts again


def test_operators_present(spark):
    assert values(spark, text.operators_present)[:-1] == [[o for o in text.OPERATORS if o in s] for s in STRINGS[:-1]]


def test_characters(spark):
    assert values(spark, text.characters)[:-1] == [list(s.replace(" ", "")) for s in STRINGS[:-1]]


def test_flags(spark):
    # fixed values: the patterns as they are published
    mail = re.compile(r"[a-z0-9\w-]+@[a-z0-9\w-]+\.[a-z\.]+")
    url = re.compile(r"(https?://)?[a-z0-9\w-]+\.[a-z\.]+")
    assert values(spark, text.has_email)[:-1] == [bool(mail.findall(s)) for s in STRINGS[:-1]]
    assert values(spark, text.has_url)[:-1] == [bool(url.findall(s)) for s in STRINGS[:-1]]
    assert values(spark, text.has_replacement)[:-1] == ["�" in s for s in STRINGS[:-1]]


def test_tokens(spark):
    assert values(spark, text.tokens, ["isn't it, $5 = nice!", "", "it's"]) == [["isn", "'t", "it", "$", "5", "=", "nice"], [], ["it", "'s"]]


def test_weeks_and_months_as_python_formats(spark):
    days = [datetime.datetime(y, m, d, tzinfo=datetime.timezone.utc) for y in (1999, 2000, 2004, 2023, 2024) for m, d in ((1, 1), (1, 2), (2, 28), (6, 15), (12, 30), (12, 31))]
    df = spark.createDataFrame([(int(d.timestamp()),) for d in days], "t long")
    got = df.select("t", time.week(F.col("t")).alias("w"), time.month(F.col("t")).alias("m"), time.year(F.col("t")).alias("y")).collect()
    for r in got:
        d = datetime.datetime.fromtimestamp(r.t, datetime.timezone.utc)
        assert (r.w, r.m, r.y) == (d.strftime("%Y-%W"), d.strftime("%Y-%m"), d.year)


def test_year_range_is_pushed_to_the_scan(spark, tmp_path):
    spark.createDataFrame([(0,), (1_100_000_000,), (None,)], "t long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(time.year_range(F.col("t"), 2004, 2006))
    assert df.count() == 1
    assert "GreaterThanOrEqual(t," in df._jdf.queryExecution().executedPlan().toString()


def test_month_spine(spark):
    rows = [r.time for r in time.month_spine(spark).collect()]
    assert len(rows) == 228 and rows[0] == "2004-01" and rows[-1] == "2022-12"


@pytest.mark.parametrize(
    ("question", "want"),
    [("who is x", True), ("whosoever is there", True), ("in paris, where is it", True), ("is it raining?", True), ("is it raining", False), ("best pizza", False), ("", False), ("for whom does it work", True),
     ("isn't it open?", True), ("Hello there. Where is the station?", True), ("at home, in bed, what is it", True), ("what", False), ("can't you see?", False)],
)
def test_questions(spark, question, want):
    assert values(spark, questions.is_question, [question]) == [want]


def test_closed_questions(spark):
    assert values(spark, questions.is_closed_question, ["is it raining?", "where is it?", "it rains?", "do you know"]) == [True, False, False, False]


def test_embedding_is_stable_and_of_fixed_length(spark):
    a, b, c = values(spark, text.embedding, ["red river", "red river", ""])
    assert a == b and len(a) == 64 and any(a) and not any(c)
