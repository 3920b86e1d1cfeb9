"""The quality gate: metrics of tables held against thresholds.

A check that fails at level ``fail`` blocks publication, one at level ``warn`` is reported.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Check(NamedTuple):
    """``metric`` of ``tbl`` must be ``op`` (>=, <= or =) ``threshold``, or that share of ``of``."""

    name: str
    tbl: str
    metric: str
    op: str
    threshold: float
    of: str | None = None
    level: str = "fail"


def metrics(tables: dict[str, DataFrame], wanted: dict[str, dict[str, Column]]) -> DataFrame:
    """(tbl, metric, value): all metrics of a table in one pass over it."""
    parts = []
    for name, columns in wanted.items():
        wide = tables[name].agg(*[c.cast("double").alias(m) for m, c in columns.items()])
        parts.append(wide.unpivot([], list(columns), "metric", "value").select(F.lit(name).alias("tbl"), "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def gate(spark: SparkSession, measured: DataFrame, checks: list[Check]) -> DataFrame:
    """(name, level, ok, value, needed): the outcome of each check; a metric that is not there fails."""
    table = spark.createDataFrame([tuple(c._replace(threshold=float(c.threshold))) for c in checks], "name string, tbl string, metric string, op string, threshold double, of string, level string")
    value = measured.select("tbl", "metric", "value")
    whole = measured.select("tbl", F.col("metric").alias("of"), F.col("value").alias("total"))
    joined = table.join(value, ["tbl", "metric"], "left").join(whole, ["tbl", "of"], "left")
    needed = F.when(F.col("of").isNull(), F.col("threshold")).otherwise(F.col("threshold") * F.col("total"))
    held = F.when(F.col("op") == ">=", F.col("value") >= needed).when(F.col("op") == "<=", F.col("value") <= needed).otherwise(F.col("value") == needed)
    return joined.select("name", "level", F.coalesce(held, F.lit(False)).alias("ok"), "value", needed.alias("needed"))


def passed(checked: DataFrame) -> bool:
    """Whether nothing fails at level fail."""
    return checked.where("level = 'fail' and not ok").isEmpty()


def not_worse(measured: DataFrame, previous: DataFrame, share: float = 0.98) -> DataFrame:
    """(name, level, ok, value, needed): metrics against those of the version before.

    A metric below ``share`` of what it was fails; one that was not there before is a warning.
    """
    before = previous.select("tbl", "metric", F.col("value").alias("was"))
    joined = measured.join(before, ["tbl", "metric"], "left")
    return joined.select(
        F.concat_ws(".", "tbl", "metric").alias("name"), F.when(F.col("was").isNull(), "warn").otherwise("fail").alias("level"),
        F.coalesce(F.col("value") >= F.col("was") * share, F.lit(False)).alias("ok"), "value", (F.col("was") * share).alias("needed"),
    )


def age_in_days(text: Column, now: Column) -> Column:
    """Days since a time given as text; null where it does not parse, which a check takes as failed."""
    return F.datediff(now, F.substring(text, 1, 10).try_cast("date"))


def era_notes(coverage: DataFrame, rules: list[tuple[str, str]], before: list[tuple[int, str]] | None = None) -> DataFrame:
    """(session_year, note): what a session lacks, from its coverage rows (session_year, key, value).

    ``rules`` are pairs of a key and the note for sessions where its value is 0; ``before`` are
    pairs of a year and the note for sessions that begin before it.
    """
    spark = coverage.sparkSession
    table = spark.createDataFrame(rules, "key string, note string")
    notes = coverage.where(F.col("value").cast("bigint") == 0).join(table, "key").select("session_year", "note")
    if not before:
        return notes
    years = spark.createDataFrame(before, "year int, note string")
    begun = coverage.select("session_year").distinct().withColumn("first", F.substring("session_year", 1, 4).try_cast("int"))
    return notes.unionByName(begun.join(years, F.col("first") < F.col("year")).select("session_year", "note"))
