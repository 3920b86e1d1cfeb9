"""What changed between full snapshots of a table, by comparing Merkle trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawloom.plans.durable import cut

FANOUT_BITS = 6


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of the values: equal for equal values only, null being equal to null."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _combined(*of: Column) -> list[Column]:
    """A digest of a set of rows: two 64-bit hashes, combined whatever the order."""
    return [F.bit_xor(F.xxhash64(*of)).alias("x"), F.bit_xor(F.xxhash64(F.lit(0x5BD1E995), *reversed(of))).alias("y")]


def _differing(nodes: DataFrame, pairs: DataFrame, parents: DataFrame | None) -> DataFrame:
    """(prev, cur, bucket) of the nodes that differ between neighbours, below differing parents."""
    sides = []
    for side in ("prev", "cur"):
        own = nodes.join(pairs.withColumn("snap", F.col(side)), "snap").select("prev", "cur", "bucket", "x", "y", F.lit(side).alias("side"))
        if parents is not None:
            own = own.withColumn("parent", F.shiftright("bucket", FANOUT_BITS)).join(parents.withColumnRenamed("bucket", "parent"), ["prev", "cur", "parent"], "left_semi").drop("parent")
        sides.append(own)
    both = reduce(DataFrame.unionByName, sides).groupBy("prev", "cur", "bucket")
    of = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    same = both.agg(*[of(c, s).alias(f"{s}_{c}") for s in ("prev", "cur") for c in ("x", "y")])
    return same.where(~(F.col("prev_x").eqNullSafe(F.col("cur_x")) & F.col("prev_y").eqNullSafe(F.col("cur_y")))).select("prev", "cur", "bucket")


def snapshot_changes(df: DataFrame, snapshot: str, key: str, loaded: str, compared: list[str], *, part: str | None = None, leaf_rows: int = 64) -> DataFrame:
    """(part, key, snapshot, change): keys added, removed or changed against the snapshot before.

    ``part`` names a column, such as a table's name, whose values have snapshots of their own; all
    are compared at once. Without it the result has no such column.

    A row belongs to its ``snapshot`` however late it was loaded. Where a key occurs more than
    once in a snapshot, the row with the latest ``loaded`` counts, a null one being the earliest;
    of rows loaded at once the one with the largest digest does. ``compared`` columns are
    compared as stored and null equals null. Rows without key or snapshot are ignored, as are
    other columns; the first snapshot gives no row, nor does an empty table.

    Keys fall into hash ranges, the leaves of a tree of 64 branches a node with about
    ``leaf_rows`` keys a leaf. The digests of neighbouring snapshots are compared from the root
    down, and rows only in leaves that differ, so like snapshots cost little beyond one pass.
    """
    of = df[part] if part else F.lit("")
    rows = df.where(df[snapshot].isNotNull() & df[key].isNotNull() & of.isNotNull()).select(
        F.struct(of.alias("part"), df[snapshot].alias("at")).alias("snap"), df[key].alias("key"), F.struct(df[loaded].alias("at"), row_digest([df[c] for c in compared]).alias("digest")).alias("row")
    )
    latest = cut(rows.groupBy("snap", "key").agg(F.max("row").alias("row")).select("snap", "key", F.xxhash64("key").alias("h"), F.col("row.digest").alias("digest")))
    size = latest.groupBy("snap").count().agg(F.max("count")).first()[0] or 0
    depth = 1
    while depth < 6 and (1 << FANOUT_BITS * depth) * leaf_rows < size:
        depth += 1
    latest = latest.withColumn("bucket", F.shiftrightunsigned("h", 64 - FANOUT_BITS * depth))

    snaps = latest.select("snap").distinct()  # one row a delivery
    pairs = cut(snaps.select(F.lag("snap").over(Window.partitionBy("snap.part").orderBy("snap.at")).alias("prev"), F.col("snap").alias("cur")).where("prev is not null"))
    levels = [cut(latest.groupBy("snap", "bucket").agg(*_combined(F.col("key"), F.col("digest"))))]
    for _ in range(depth):
        below = levels[-1].withColumn("parent", F.shiftright("bucket", FANOUT_BITS))
        levels.append(cut(below.groupBy("snap", "parent").agg(*_combined(F.col("bucket"), F.col("x"), F.col("y"))).withColumnRenamed("parent", "bucket")))
    differ = None
    for nodes in reversed(levels):
        differ = cut(_differing(nodes, pairs, differ))  # each level's plan is small, however deep the tree

    sides = [
        latest.join(differ.withColumn("snap", F.col(side)), ["snap", "bucket"]).select("prev", "cur", "key", "digest", F.lit(side).alias("side"))
        for side in ("prev", "cur")
    ]
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("digest"))).alias(s + "_digest")
    both = reduce(DataFrame.unionByName, sides).groupBy("prev", "cur", "key").agg(side("prev"), side("cur"))
    change = F.when(F.col("prev_digest").isNull(), "added").when(F.col("cur_digest").isNull(), "removed").when(F.col("prev_digest") != F.col("cur_digest"), "changed")
    names = [F.col("cur.part").alias(part)] if part else []
    return both.select(*names, F.col("key").alias(key), F.col("cur.at").alias(snapshot), change.alias("change")).where("change is not null")
