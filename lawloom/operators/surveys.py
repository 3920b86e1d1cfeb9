"""Surveys of raw inputs: marks in markup, fixed samples, freshness of deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mark_survey(df: DataFrame, markup: str, *, around: int = 200) -> DataFrame:
    """(mark, n, example): processing instructions by name, each with the text around its first one.

    The example is the least of its kind, so that it does not depend on the order of rows.
    """
    name = r"<\?([A-Za-z_][\w.-]*)"
    whole = F.regexp_extract_all(df[markup], F.lit(rf"(?s).{{0,{around}}}{name}.{{0,{around}}}"), F.lit(0))
    names = df.select(F.explode(F.regexp_extract_all(df[markup], F.lit(name), F.lit(1))).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    seen = df.select(F.explode(whole).alias("example")).withColumn("mark", F.regexp_extract("example", name, 1)).groupBy("mark").agg(F.min("example").alias("example"))
    return names.join(seen, "mark", "left")


def fixed_sample(df: DataFrame, key: str, by: str, n: int, *, seed: int = 7) -> DataFrame:
    """(by, key): up to ``n`` rows of each value of ``by``, the same ones on each run with a seed."""
    lot = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    order = Window.partitionBy(by).orderBy(lot, key)
    return df.where(F.col(key).isNotNull()).select(by, key).distinct().withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def freshest(listing: DataFrame, name: str, modified: str, now: Column, *, stale_hours: int = 40) -> DataFrame:
    """(name, modified, stale): the delivery modified last, and whether that is too long ago."""
    last = listing.agg(F.max_by(name, modified).alias(name), F.max(modified).alias(modified))
    hours = (F.unix_timestamp(now) - F.unix_timestamp(modified)) / 3600
    return last.where(F.col(modified).isNotNull()).select(name, modified, (hours > stale_hours).alias("stale"))
