"""Relational idioms of versioned tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = 2_000_000  # words of 64 bits of a map of keys that is sent to the rows


def last_write(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order`` (ascending, nulls first), ties by the other columns.

    It is an aggregate, so rows of a hot key are reduced before they move; columns must be orderable.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max(F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)], F.struct(*rest).alias("row"))).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, "__last.row.*").select(*df.columns)


def first_store(stores: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first store that knows a key; ``store`` is its number from 0. Null keys are one key.

    The decision is one minimum a key, which is joined back.
    """
    rows = reduce(DataFrame.unionByName, [store.withColumn("store", F.lit(n)) for n, store in enumerate(stores)])
    best = rows.groupBy(*keys).agg(F.min("store").alias("__best")).select("__best", *[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(best, same & (F.col("store") == F.col("__best")), "left_semi")


def flagged(df: DataFrame, keys: list[str], present: DataFrame, flag: str) -> DataFrame:
    """``df`` with a flag that tells whether its keys occur in ``present``; null keys do not."""
    known = present.select(*keys).distinct().withColumn(flag, F.lit(True))
    return df.join(known, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def meeting(df: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """``df`` without most rows whose key does not occur in ``present``; no row is moved for that.

    A join with ``present`` must follow, as other rows can stay: keys are looked up by hash in a bit map.
    It has 16 bits a row of ``present``, so one of 16 other rows stays, and MAP words at most, beyond
    which more stay.
    """
    words = min(present.count() // 4, MAP) + 1
    spot = F.pmod(F.xxhash64(key), F.lit(64 * words))
    held = present.select(spot.alias("__spot")).groupBy(F.expr("__spot div 64").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, int(__spot % 64))")).alias("__bits"))
    same = F.expr("__spot div 64 = __word and getbit(__bits, __spot % 64) = 1")
    return df.withColumn("__spot", spot).join(F.broadcast(held), same, "left_semi").drop("__spot")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """(keys, name): the distinct values of each key in the order in which they first occur.

    A value's first place is a minimum, reduced before it moves, so a list is as long as a key has
    distinct values. Null values are left out; ties go to the smaller value.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__first"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", value))), lambda x: x[value]).alias(name))


def ancestors(path: Column, separator: str = ".") -> Column:
    """All paths above a path, and itself, from the top down: a.b.c -> [a, a.b, a.b.c]."""
    steps = F.split(path, f"\\{separator}", -1)
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), separator))


def with_headings(nodes: DataFrame, key: str, path: str, headings: DataFrame, heading_path: str, heading: str) -> DataFrame:
    """(key, hierarchy): the headings above each node, from the top down; levels without one are left out."""
    steps = nodes.select(key, F.posexplode(ancestors(F.col(path))).alias("__depth", "__path"))
    found = steps.join(headings.select(F.col(heading_path).alias("__path"), F.col(heading).alias("__heading")), "__path")
    packed = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__depth", "__heading"))), lambda x: x["__heading"]).alias("hierarchy"))
    return nodes.select(key).join(packed, key, "left").withColumn("hierarchy", F.coalesce("hierarchy", F.array().cast("array<string>")))


def unpivot_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, key, value): one row a metric."""
    return df.unpivot(keys, metrics, "key", "value")
