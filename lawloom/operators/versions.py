"""Versions of a document, their predecessors, and chains of lineage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawloom.operators.intervals import as_of


def version_order(number: Column) -> Column:
    """Versions count down, so this ascends from the newest; what is no number comes first, as 0."""
    return F.coalesce(F.regexp_extract(number, r"^\s*([-+]?[0-9]+)", 1).try_cast("bigint"), F.lit(0))


def predecessors(versions: DataFrame, group: str, key: str, number: str) -> DataFrame:
    """(group, key, prior): the next older version of each; null for the oldest."""
    order = Window.partitionBy(group).orderBy(version_order(F.col(number)), key)
    rows = versions.select(group, key, number).where(F.col(group).isNotNull()).distinct()
    return rows.select(group, key, F.lead(key).over(order).alias("prior"))


def pick_version(versions: DataFrame, spec: str | None, *, key: str = "bill_version_id", group: str = "bill_id", number: str = "version_num", date: str = "action_date", action: str = "action") -> DataFrame:
    """The version of each group that a spec names, with how many it fits.

    No spec takes the newest; else an exact id, a version number, a date or its beginning, or a
    phrase in the action, whatever its case. Where several fit, the newest is taken.
    """
    rows = versions.select(group, key, number, date, action).distinct()
    if spec is None:
        fits = F.lit(True)
    else:
        told = spec.strip()
        text = F.date_format(date, "yyyy-MM-dd HH:mm:ss")
        exact = F.col(key) == told
        if re.fullmatch(r"[0-9]+", told):
            fits = exact | (F.col(number) == told)
        elif re.fullmatch(r"[0-9]{4}-[0-9-]*", told):
            fits = exact | text.startswith(told)
        else:
            fits = exact | F.lower(action).contains(told.lower())
    order = Window.partitionBy(group).orderBy(version_order(F.col(number)), key)
    found = rows.where(fits).withColumn("fits", F.count(F.lit(1)).over(Window.partitionBy(group)).cast("int")).withColumn("__n", F.row_number().over(order))
    return found.where("__n = 1").select(group, key, "fits")


def walk(edges: DataFrame, node: str, prior: str, *, most: int = 25) -> DataFrame:
    """(node, last, hops): where each node's chain of ``prior`` ends, or is after ``most`` steps.

    Steps are doubled, so a chain of 25 takes eight joins whatever its length. A node that names
    itself ends its chain; a null prior does so too. Each node must have one edge at most.
    """
    one = edges.where(F.col(prior).isNotNull() & (F.col(node) != F.col(prior))).select(F.col(node).alias("n"), F.col(prior).alias("last"), F.lit(1).alias("hops"))
    powers, done = [one], 1
    while done * 2 <= most:
        powers.append(_then(powers[-1], powers[-1]))
        done *= 2
    total, left = None, most
    for k in range(len(powers) - 1, -1, -1):
        if left >= 1 << k:
            total = powers[k] if total is None else _then(total, powers[k])
            left -= 1 << k
    nodes = edges.select(F.col(node).alias("n")).distinct()
    ends = nodes.join(total, "n", "left")
    return ends.select(F.col("n").alias(node), F.coalesce("last", "n").alias("last"), F.coalesce("hops", F.lit(0)).alias("hops"))


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """Steps of the first and, from where they end, of the second."""
    more = second.select(F.col("n").alias("last"), F.col("last").alias("__last"), F.col("hops").alias("__hops"))
    return first.join(more, "last", "left").select("n", F.coalesce("__last", "last").alias("last"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"))


def resolve_chapters(events: DataFrame, bills: DataFrame, keys: list[str]) -> DataFrame:
    """``events`` with the bill that became each chapter: bill_id, ties (further bills of the chapter).

    ``bills`` has the key columns and bill_id; of several bills of one chapter the first id is
    taken. Events without one have nulls.
    """
    order = Window.partitionBy(*keys).orderBy("bill_id")
    first = bills.select(*keys, "bill_id").distinct().withColumn("__n", F.row_number().over(order)).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy(*keys)) - 1)
    return events.join(first.where("__n = 1").drop("__n"), keys, "left")


def prior_chapter(anchors: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    """For each anchor (on, anchor_id, date, year, chapter) the latest candidate strictly before it.

    Candidates (on, date, year, chapter, cand_id) with a date before the anchor's are ordered by
    (date, year, chapter). Where none has, or the anchor has no date, candidates of a smaller
    (year, chapter) count, of which an anchor with a date takes dateless ones only. Dates are
    times or texts of times. Anchors with a null key have no row, and a candidate without year or
    chapter counts by its date only.

    Both orders are as-of joins, so a busy section is no pair of its anchors and candidates, and
    is split by time.
    """
    key = F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in on]), F.struct(*on))
    when = lambda: F.col("date").cast("timestamp_ntz")
    # (year, chapter) as a time: chapters have six digits, and a year is a slice.
    number = F.timestamp_seconds(F.col("year").cast("bigint") * 1_000_000 + F.col("chapter").cast("bigint")).cast("timestamp_ntz")
    a = anchors.where(key.isNotNull()).select(*on, key.alias("__on"), "anchor_id", when().alias("__date"), number.alias("__number"))
    c = candidates.where(key.isNotNull()).select(key.alias("__on"), when().alias("__date"), number.alias("__number"), F.struct("year", "chapter", "cand_id").alias("__row"))
    dated = as_of(a, c, "__on", "__date", "__row", slice_seconds=366 * 86_400).withColumnRenamed("prior", "__by_date").drop("prior_time")
    left = dated.where("__by_date is null")
    numbered = as_of(left.where("__date is null"), c, "__on", "__number", "__row", slice_seconds=1_000_000).unionByName(as_of(left.where("__date is not null"), c.where("__date is null"), "__on", "__number", "__row", slice_seconds=1_000_000))
    rows = dated.where("__by_date is not null").select(*on, "anchor_id", F.col("__by_date.cand_id").alias("prior")).unionByName(numbered.select(*on, "anchor_id", F.col("prior.cand_id").alias("prior")))
    return rows.where("prior is not null")
