"""Surveys of raw inputs."""

import datetime as dt

from pyspark.sql import functions as F

from lawloom.functions.redline import flat_redline
from lawloom.operators.surveys import fixed_sample, freshest, mark_survey


def test_marks(spark):
    df = spark.createDataFrame([("a<?x-del <b>?>b<?x-del c?>",), ("<?y?>",), (None,)], "markup string")
    assert {(r.mark, r.n) for r in mark_survey(df, "markup").collect()} == {("x-del", 2), ("y", 1)}


def test_sample_is_fixed(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(90)] + [(0, None)], "g int, k int")
    once, again = (sorted(map(tuple, fixed_sample(d, "k", "g", 5).collect())) for d in (df, df.orderBy(F.rand())))
    assert once == again and len(once) == 15


def test_freshest(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 2))], "day string, at timestamp")
    now = F.lit("2024-01-03 12:00:00").cast("timestamp")
    assert [(r.day, r.stale) for r in freshest(df, "day", "at", now).collect()] == [("b", False)]
    assert [r.stale for r in freshest(df.limit(1), "day", "at", now).collect()] == [True] and freshest(df.limit(0), "day", "at", now).count() == 0


def test_flat_redline():
    made = flat_redline("(a) One two. (b) Three.", "(a) One two. (b) Four.")
    assert made.markdown == "(a) One two.\n(b) ~~Three.~~ *Four.*" and flat_redline("x", "x").identical
