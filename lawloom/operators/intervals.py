"""Joins that are not on equal keys, planned as equi-joins: containment, bands, nearest, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def leading_number(text: Column) -> Column:
    """The decimal number that a text begins with; null without one."""
    return F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def _level(length: Column) -> Column:
    """The least power of two whose buckets are as long as an interval."""
    return F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(1.0)))), F.lit(0)).cast("int")


def _bucket(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("bigint")


def contained(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, on: list[str]) -> DataFrame:
    """Pairs of a point and a closed range with equal ``on`` columns and low <= point <= high.

    A range falls into at most two buckets of its own power of two; a point has one bucket on each
    level that some range has. So the join is on equal keys however long the ranges are, each pair
    meets once, and hot groups are split by their buckets. Null bounds, points and keys match
    nothing; a range whose end lies before its start is empty. ``points`` and ``ranges`` must not
    share column names besides ``on``.
    """
    spans = ranges.where(F.col(high) >= F.col(low)).withColumn("__level", _level(F.col(high) - F.col(low)))
    spans = spans.withColumn("__bucket", F.explode(F.sequence(_bucket(F.col(low), F.col("__level")), _bucket(F.col(high), F.col("__level")))))
    levels = [r[0] for r in spans.select("__level").distinct().collect()]  # at most one for each power of two
    spots = points.where(F.col(point).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    spots = spots.withColumn("__bucket", _bucket(F.col(point), F.col("__level")))
    met = spots.join(spans, [*on, "__level", "__bucket"])
    return met.where((F.col(low) <= F.col(point)) & (F.col(point) <= F.col(high))).drop("__level", "__bucket")


def band(left: DataFrame, value: str, right: DataFrame, other: str, width: float, on: list[str]) -> DataFrame:
    """Pairs with equal ``on`` columns and 0 < value - other <= width.

    Both sides fall into buckets of ``width``; the left one looks into its own and the one before.
    Nulls match nothing; column names besides ``on`` must differ.
    """
    a = left.withColumn("__bucket", F.explode(F.array(F.floor(F.col(value) / width), F.floor(F.col(value) / width) - 1)))
    b = right.withColumn("__bucket", F.floor(F.col(other) / width))
    gap = F.col(value) - F.col(other)
    return a.join(b, [*on, "__bucket"]).where((gap > 0) & (gap <= width)).drop("__bucket")


def nearest(queries: DataFrame, query: str, value: str, rows: DataFrame, row: str, other: str, on: list[str], k: int, *, width: float = 64.0) -> DataFrame:
    """The ``k`` rows nearest to each query within equal ``on`` columns: (on, query, row, gap, rank).

    Ties go to the smaller ``row``. Rows of a group are numbered in order of ``other``, and so a
    query's nearest ones are k numbers below its place and k above: a join on equal numbers,
    2 k rows a query, however large the group. Of rows with one ``other`` only the k smallest can
    be among them, so no more are kept. Places are counted in slices of ``width``, to which the
    count of the slices before is added, so a hot group is split. Nulls in ``value``, ``other`` and
    the group match nothing; ``query`` and ``row`` must be unique within ``on``.
    """
    least = Window.partitionBy(*on, "__v").orderBy("__row")
    held = rows.select(*on, F.col(row).alias("__row"), F.col(other).cast("double").alias("__v")).where(F.col(other).isNotNull())
    held = held.withColumn("__n", F.row_number().over(least)).where(F.col("__n") <= k).drop("__n").withColumn("__s", F.floor(F.col("__v") / width))
    asked = queries.select(*on, F.col(query).alias("__query"), F.col(value).cast("double").alias("__v")).where(F.col(value).isNotNull()).withColumn("__s", F.floor(F.col("__v") / width))
    sizes = held.groupBy(*on, "__s").agg(F.count(F.lit(1)).alias("__c")).unionByName(asked.select(*on, "__s").distinct().withColumn("__c", F.lit(0).cast("bigint"))).groupBy(*on, "__s").agg(F.sum("__c").alias("__c"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(Window.partitionBy(*on).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    slice_of = Window.partitionBy(*on, "__s")
    placed = held.join(before, [*on, "__s"])
    placed = placed.withColumn("__down", F.col("__before") + F.row_number().over(slice_of.orderBy("__v", F.desc("__row")))).withColumn("__up", F.col("__before") + F.row_number().over(slice_of.orderBy("__v", "__row")))
    places = F.array(F.struct(F.lit(0).alias("__above"), F.col("__down").alias("__place")), F.struct(F.lit(1).alias("__above"), F.col("__up").alias("__place")))
    numbered = placed.withColumn("__p", F.explode(places)).select(*on, "__row", F.col("__v").alias("__other"), "__p.*")
    both = asked.withColumn("__one", F.lit(0)).unionByName(held.drop("__row").withColumn("__query", F.lit(None).cast(asked.schema["__query"].dataType)).withColumn("__one", F.lit(1)))
    inside = both.withColumn("__le", F.sum("__one").over(slice_of.orderBy("__v").rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("__one = 0")
    spots = inside.join(before, [*on, "__s"]).withColumn("__at", F.col("__before") + F.col("__le"))
    wanted = F.transform(F.sequence(F.lit(1 - k), F.lit(k)), lambda d: F.struct(F.when(d > 0, 1).otherwise(0).alias("__above"), (F.col("__at") + d).alias("__place")))
    met = spots.withColumn("__p", F.explode(wanted)).select(*on, "__query", "__v", "__p.*").join(numbered, [*on, "__above", "__place"])
    rank = Window.partitionBy(*on, "__query").orderBy("gap", "__row")
    found = met.withColumn("gap", F.abs(F.col("__v") - F.col("__other"))).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return found.select(*on, F.col("__query").alias(query), F.col("__row").alias(row), "gap", "rank")


def as_of(anchors: DataFrame, candidates: DataFrame, key: str, time: str, value: str, *, slice_seconds: int = 86_400) -> DataFrame:
    """Each anchor with the latest candidate of its key strictly before its time, else null.

    ``time`` is a timestamp of both; ties go to the larger ``value``, which the result holds as
    ``prior`` beside ``prior_time``. Time is cut into slices, within which a running maximum is
    taken, and the last candidate of each slice is carried to the slices after it; so a hot key
    is split by time. Anchors with a null key or time get null; candidates with one are ignored.
    """
    part = lambda t: F.floor(F.unix_micros(F.col(t).cast("timestamp")) / (slice_seconds * 1_000_000))
    known = candidates.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("__k"), part(time).alias("__s"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("__c"))
    asked = anchors.withColumn("__k", F.col(key)).withColumn("__s", part(time))
    both = asked.withColumn("__c", F.lit(None).cast(known.schema["__c"].dataType)).withColumn("__at", F.col(time)).withColumn("__ask", F.lit(True)).unionByName(
        known.withColumn("__at", F.col("__c.t")).withColumn("__ask", F.lit(False)), allowMissingColumns=True
    )
    order = Window.partitionBy("__k", "__s").orderBy(F.unix_micros(F.col("__at").cast("timestamp")))
    inside = both.withColumn("__in", F.max("__c").over(order.rangeBetween(Window.unboundedPreceding, -1))).where("__ask")
    ends = known.groupBy("__k", "__s").agg(F.max("__c").alias("__c"))
    wanted = asked.select("__k", "__s").distinct().withColumn("__c", F.lit(None).cast(known.schema["__c"].dataType)).withColumn("__ask", F.lit(1))
    slices = ends.withColumn("__ask", F.lit(0)).unionByName(wanted)
    carried = slices.withColumn("__before", F.max("__c").over(Window.partitionBy("__k").orderBy("__s").rangeBetween(Window.unboundedPreceding, -1))).where("__ask = 1").select("__k", "__s", "__before")
    joined = inside.join(carried, inside["__k"].eqNullSafe(carried["__k"]) & inside["__s"].eqNullSafe(carried["__s"]), "left")
    prior = F.when(F.col(key).isNotNull() & F.col(time).isNotNull(), F.coalesce("__in", "__before"))
    return joined.select(*[inside[c] for c in anchors.columns], prior["v"].alias("prior"), prior["t"].alias("prior_time"))
