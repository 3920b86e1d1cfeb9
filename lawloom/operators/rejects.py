"""Rows of escaped delimited files that fail to parse, apart from those that load.

Each distinct value of a checked column is judged once. The invalid ones form a dictionary that
names the rule each breaks, and the reason of a row comes from there.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stand for an escaped backslash, tab and backtick while a line is taken apart: code points that
#: no text may hold.
SLASH, TAB, TICK = "﷐", "﷑", "﷒"
# What an escaped letter stands for; other characters stand for themselves.
ESCAPES = {"0": "\x00", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


class Layout(NamedTuple):
    """Columns of a file in order and the kind of value that some must hold."""

    columns: tuple[str, ...]
    kinds: dict[str, str]


HISTORY = Layout(
    ("bill_id", "bill_history_id", "action_date", "action", "trans_uid", "trans_update", "action_sequence", "action_code", "action_status", "primary_location", "secondary_location", "ternary_location", "end_status"),
    {"bill_history_id": "whole", "action_sequence": "whole", "action_date": "time", "trans_update": "time", "action": "text"},
)
SECTION = Layout(
    ("id", "law_code", "section_num", "op_statutes", "op_chapter", "op_section", "effective_date", "version_id", "division", "title", "part", "chapter", "article", "history", "lob_file", "active_flg", "trans_uid", "trans_update"),
    {"trans_update": "time", "effective_date": "time or null", "op_statutes": "year or null", "active_flg": "flag"},
)
LAYOUTS = {"BILL_HISTORY_TBL.dat": HISTORY, "LAW_SECTION_TBL.dat": SECTION}


def _split(line: Column) -> Column:
    """Fields between unescaped tabs, with stand-ins for escaped characters."""
    safe = F.regexp_replace(line, r"\r\z", "")
    safe = F.replace(safe, F.lit("\\\\"), F.lit(SLASH))
    safe = F.replace(safe, F.lit("\\\t"), F.lit(TAB))
    safe = F.replace(safe, F.lit("\\`"), F.lit(TICK))
    return F.split(safe, "\t", -1)


def _enclosed(field: Column) -> Column:
    return (F.length(field) > 1) & field.startswith("`") & field.endswith("`")


def _badly_quoted(field: Column) -> Column:
    return F.when(field.startswith("`"), ~_enclosed(field)).otherwise(field.contains("`"))


def _decoded(field: Column) -> Column:
    """The value of a field: null, or its text without enclosure and escapes."""
    text = F.when(_enclosed(field), F.substring(field, F.lit(2), F.length(field) - 2)).otherwise(field)
    for letter, meant in ESCAPES.items():
        text = F.replace(text, F.lit("\\" + letter), F.lit(meant))
    text = F.regexp_replace(text, r"(?s)\\(.)", "$1")
    for stand_in, meant in ((TAB, "\t"), (TICK, "`"), (SLASH, "\\")):
        text = F.replace(text, F.lit(stand_in), F.lit(meant))
    return F.when(field.isin("NULL", "\\N"), F.lit(None)).otherwise(text)


def _valid(kind: Column, value: Column) -> Column:
    """Whether a value is of its kind; never null."""
    time = value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z") & value.try_cast("timestamp_ntz").isNotNull() & ~value.startswith("0000")
    rules = {
        "whole": value.rlike(r"\A[0-9]+\z"),
        "time": time,
        "time or null": value.isNull() | time,
        "year or null": value.isNull() | value.rlike(r"\A[0-9]{4}\z"),
        "flag": value.isin("Y", "N"),
        "text": value.rlike(r"\S"),
    }
    return F.coalesce(reduce(lambda c, r: c.when(kind == r[0], r[1]), rules.items(), F.when(F.lit(False), F.lit(True))), F.lit(False))


def invalid_values(values: DataFrame) -> DataFrame:
    """The dictionary (col, kind, raw, value_reason, value_detail) of values (col, kind, raw) that break their column's rule.

    Each distinct value is judged once. ``value_detail`` names the column and what it must hold.
    """
    judged = values.select("col", "kind", "raw").distinct().where(~_valid(F.col("kind"), _decoded(F.col("raw"))))
    detail = F.concat("col", F.lit(": not a "), F.col("kind"))
    return judged.select("col", "kind", "raw", F.lit("value").alias("value_reason"), detail.alias("value_detail"))


def parse_lines(df: DataFrame, row_id: str, file: str, line: str, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """(row_id, file, fields, reason, detail): each line, its decoded fields, and why it fails.

    Reasons, of which the first that applies is given: ``unknown_file`` of a line whose file name
    is null or has no layout, whose fields are null; ``column_count``, ``quoting`` and ``value``;
    null for rows that load. Structure is checked in the row; ``detail`` says what was found. For
    values, the dictionary of :func:`invalid_values` is joined back; of several in a row the first
    column counts. A null line is a line without fields and fails by its column count. ``row_id``
    must be unique. Hot values are split by adaptive execution, as the join is one of large streams.
    """
    layouts = layouts or LAYOUTS
    by_file = lambda value: F.coalesce(*[F.when(F.col("__file") == name, value(layout)) for name, layout in layouts.items()])
    known = F.coalesce(F.col("__file").isin(list(layouts)), F.lit(False))
    lines = df.select(df[row_id].alias("__id"), df[file].alias("__file"), F.coalesce(df[line], F.lit("")).alias("__line"))
    lines = lines.withColumn("__raw", F.when(known, _split(F.col("__line"))))
    control = F.exists("__raw", lambda f: f.rlike(r"(?<!\\)[\x00-\x08\x0a-\x1f]"))
    width = by_file(lambda x: F.lit(len(x.columns)))
    why = lambda reason, detail: F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))
    bad_field = F.array_position(F.transform("__raw", _badly_quoted), F.lit(True)).cast("string")
    structure = (
        F.when(~known, why("unknown_file", F.coalesce("__file", F.lit("no file name"))))
        .when(F.size("__raw") != width, why("column_count", F.concat(F.size("__raw").cast("string"), F.lit(" of "), width.cast("string"))))
        .when(F.exists("__raw", _badly_quoted), why("quoting", F.concat(F.lit("field "), bad_field)))
        .when(control, why("value", F.lit("a control character")))
    )
    lines = lines.select("__id", "__file", "__raw", structure.alias("__bad"))

    checked = by_file(lambda x: F.array(*[F.struct(F.lit(x.columns.index(c)).alias("at"), F.lit(c).alias("col"), F.lit(k).alias("kind"), F.get("__raw", x.columns.index(c)).alias("raw")) for c, k in x.kinds.items()]))
    values = lines.where("__bad is null").select("__id", F.explode(checked).alias("v")).select("__id", "v.*")
    failed = values.join(invalid_values(values), ["col", "kind", "raw"]).groupBy("__id").agg(F.min_by(F.struct(F.col("value_reason").alias("reason"), F.col("value_detail").alias("detail")), "at").alias("__value"))
    both = lines.join(failed, "__id", "left").withColumn("__why", F.coalesce("__bad", "__value"))
    return both.select(F.col("__id").alias(row_id), F.col("__file").alias(file), F.transform("__raw", _decoded).alias("fields"), F.col("__why.reason").alias("reason"), F.col("__why.detail").alias("detail"))


def loaded(parsed: DataFrame, row_id: str, file: str, name: str) -> DataFrame:
    """The valid rows of one file, with its columns as strings."""
    return parsed.where((F.col(file) == name) & F.col("reason").isNull()).select(row_id, *[F.get("fields", k).alias(c) for k, c in enumerate(LAYOUTS[name].columns)])


def rejected(parsed: DataFrame, row_id: str) -> DataFrame:
    """(row_id, reason, detail) of the rows that fail."""
    return parsed.where("reason is not null").select(row_id, "reason", "detail")
