"""Pending changes that touch a section: directly, in a range, or by a unit added nearby."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.operators.intervals import band, contained, leading_number

NEARBY = 100.0


def matches(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """(code, key, ref_id, kind) for each reference that touches a section.

    ``refs`` has ref_id, code, section, is_range, range_end and struct, ``sections`` distinct
    (code, key). The first rule that applies wins: ``direct`` for the same key, also as the start
    of a range or unit; ``range`` for a key between both ends; ``structural_add_nearby`` for a
    unit, not a range, that starts less than or exactly 100 below. Intervals join by buckets.
    """
    known = sections.select("code", "key").distinct().withColumn("num", leading_number(F.col("key")))
    named = refs.select("ref_id", "code", "section", F.col("is_range").alias("ranged"), "range_end", "struct").distinct()
    direct = named.join(known, (named["code"] == known["code"]) & (named["section"] == known["key"])).select(known["code"], "key", "ref_id", F.lit("direct").alias("kind"))
    spans = named.where("ranged").select("ref_id", "code", "section", leading_number(F.col("section")).alias("low"), leading_number(F.col("range_end")).alias("high"))
    ranged = contained(known, "num", spans, "low", "high", ["code"]).where("not(key <=> section)").select("code", "key", "ref_id", F.lit("range").alias("kind"))
    units = named.where("not coalesce(ranged, false) and struct is not null").select("ref_id", "code", "section", leading_number(F.col("section")).alias("low"))
    nearby = band(known, "num", units, "low", NEARBY, ["code"]).where("not(key <=> section)").select("code", "key", "ref_id", F.lit("structural_add_nearby").alias("kind"))
    return direct.unionByName(ranged).unionByName(nearby)
