"""Groups that links form: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.plans.durable import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's larger (or smaller) neighbours are linked to its least neighbour.

    The least neighbour is an aggregate that is joined back, so neighbours are never collected.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = both.join(least, "u")
    moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group): the least node that each linked node can reach; nodes without links have no row.

    Rounds grow with the logarithm of the longest path; each is written to the checkpoint folder.
    Null ends and links of a node to itself are ignored.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct())
    mark = None
    while True:
        edges = cut(_star(_star(edges, True), False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("group"))).distinct()


def grouped(links: DataFrame, members: DataFrame) -> DataFrame:
    """(tbl, key, group, links): each member's group, named by its least key, and its text's links.

    Copies of one text are one group, and a text without links is a group by itself; links count
    different texts. Nothing is expanded into pairs.
    """
    links = links.distinct()
    found = components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("links"))
    rows = members.distinct().join(found.withColumnRenamed("node", "digest"), "digest", "left").join(degree, "digest", "left").withColumn("root", F.coalesce("group", "digest"))
    names = rows.groupBy("tbl", "root").agg(F.min("key").alias("name"))
    return rows.join(names, ["tbl", "root"]).select("tbl", "key", F.col("name").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
