"""Escaped delimited tables: tab-separated, optionally in backticks, with backslash escapes."""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_AT_ONCE = 10_000

# What an escaped letter stands for; other characters stand for themselves.
ESCAPES = {"0": "\x00", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
_FIELD = re.compile(r"`((?:[^\\`]+|\\.|\\\Z|`(?![\t\n]|\Z))*)(`|\Z)|((?:[^\t\n\\]+|\\.|\\\Z)*)", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def decode(data: bytes) -> str:
    """UTF-8, or Latin-1 for the whole file where it is not."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _value(m: re.Match) -> str | None:
    raw = m.group(3) if m.group(3) is not None and m.group(1) is None else None
    if raw in ("NULL", "\\N"):
        return None
    return _ESCAPED.sub(lambda e: ESCAPES.get(e.group(1), e.group(1)), m.group(1) if raw is None else raw)


def parse_text(text: str) -> Iterator[list[str | None]]:
    """The rows of a file. A backtick closes a field only before a tab, a line's end or the end.

    Bare ``NULL`` and ``\\N`` are null, in backticks they are text. Blank lines are skipped and an
    empty field at the end of the file is kept, with or without escapes in the file.
    """
    at, row = 0, []
    while at < len(text):
        if not row and text[at] == "\n":
            at += 1
            continue
        m = _FIELD.match(text, at)
        row.append(_value(m))
        at = m.end()
        end = text[at] if at < len(text) else None
        at += 1
        if end == "\t" and at >= len(text):
            row.append("")
        if end == "\n" or at >= len(text):
            yield row
            row = []


def plain_fields(line: Column) -> Column:
    """The fields of a line of a file without escapes, all in the JVM."""

    def value(field: Column) -> Column:
        inside = F.substring(field, F.lit(2), F.length(field) - 2)
        return F.when(field == "NULL", F.lit(None)).when((F.length(field) > 1) & field.startswith("`") & field.endswith("`"), inside).otherwise(field)

    return F.transform(F.split(line, "\t", -1), value)


def _parsed(width: int):
    """Rows of files (path, content): their fields, or null ones and all fields where the number differs."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = enumerate(parse_text(decode(content.as_buffer().to_pybytes())))
                while part := list(islice(rows, ROWS_AT_ONCE)):
                    fit = [len(row) == width for _, row in part]
                    columns = [pa.array([row[k] if ok else None for (_, row), ok in zip(part, fit)], pa.string()) for k in range(width)]
                    file = pa.array([os.path.basename(path)] * len(part), pa.string())
                    wrong = pa.array([None if ok else row for (_, row), ok in zip(part, fit)], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*columns, file, pa.array([n for n, _ in part], pa.int64()), wrong], names=[*map(str, range(width)), "_file", "_row", "_fields"])

    return run


def load_table(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the right number of fields, the others with all their fields); absent files are empty.

    Files are read by Spark, wherever it can read. As a field may hold line ends, a file (of at
    most 2 GB) is one task; give exports as many files, or, where a record is one line, take
    ``operators.rejects``. Rows have the columns, ``_file`` and ``_row``, their place, which makes
    ties of later sorts total; the others have _file, _row, _arity and _fields.
    """
    names = [f"`{c}` string" for c in (*map(str, range(len(columns))), "_file")]
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
        raw = files.mapInArrow(_parsed(len(columns)), ", ".join([*names, "_row bigint", "_fields array<string>"]))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"{path} is not there; its table is empty", stacklevel=2)
        raw = spark.createDataFrame([], ", ".join([*names, "_row bigint", "_fields array<string>"]))
    rows = raw.where("_fields is null").select(*[F.col(f"`{k}`").alias(c) for k, c in enumerate(columns)], "_file", "_row")
    return rows, raw.where("_fields is not null").select("_file", "_row", F.size("_fields").alias("_arity"), "_fields")
