"""Bundles of tables and blobs: which source a table comes from, blobs with fallbacks, sessions."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_NAME = re.compile(r"^(?:.*/)?\D*(\d{4})\.zip$")


def table_source(name: str, is_law: bool, incremental: set[str], bill: set[str] | None, law: set[str]) -> str | None:
    """Where a table comes from, given the tables each bundle carries.

    An incremental bundle wins for a table of law it carries; tables of bills come from the bill
    bundle if there is one, else from the law bundle.
    """
    if is_law:
        return "incremental" if name in incremental else "law" if name in law else None
    if bill is not None:
        return "bill" if name in bill else None
    return "law" if name in law else None


def with_blobs(rows: DataFrame, name: str, stores: list[DataFrame]) -> DataFrame:
    """``rows`` with the ``body`` of the blob that ``name`` names, from the first store that has it.

    Stores have the columns lob_file and body, lob_file being unique; a blob nowhere is null.
    """
    found = rows
    for k, store in enumerate(stores):
        found = found.join(store.select(F.col("lob_file").alias(name), F.col("body").alias(f"__b{k}")), name, "left")
    bodies = [F.col(f"__b{k}") for k in range(len(stores))]
    return found.withColumn("body", F.coalesce(*bodies)).drop(*[f"__b{k}" for k in range(len(stores))])


def read_members(spark: SparkSession, keys: DataFrame, path: str) -> DataFrame:
    """(key, lob_file, body, error): members of a zip for rows (key, lob_file), each task reading its own.

    ``path`` is a file, or a URI of a store that all executors reach, of which only the members
    asked for are read. Names travel to the tasks, bytes do not; a broken or absent member is an
    error of its row.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with store.open_input_file(inside) as opened, zipfile.ZipFile(opened) as z:
            for batch in batches:
                out = []
                for key, name in zip(*(c.to_pylist() for c in batch.columns)):
                    try:
                        out.append((key, name, z.read(name), None))
                    except Exception as e:
                        out.append((key, name, None, f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.string()))], names=["key", "lob_file", "body", "error"])

    return keys.select(F.col("key").cast("string"), "lob_file").mapInArrow(run, "key string, lob_file string, body binary, error string")


def session_files(paths: list[str]) -> dict[str, str]:
    """Session (first year) -> file, in order of sessions; files with other names are left out."""
    found = {m.group(1): p for p in paths if (m := SESSION_NAME.match(p))}
    return dict(sorted(found.items()))


def newest_session(page: str, pinned: str | None = None) -> str | None:
    """The session with the highest year among the links of a page, unless one is pinned."""
    years = re.findall(r'href="[^"]*?(\d{4})[^"]*\.zip"', page)
    return pinned or (max(years) if years else None)


def ingest_sessions(spark: SparkSession, sessions: dict[str, Callable[[], DataFrame]], out: str, done: str) -> dict[str, str]:
    """Writes each session's table to ``out/session=...`` and then its marker to ``done``.

    Sessions with a marker are skipped, those without one are written again from the start, and
    one that fails is reported while the others go on. The data comes first, the marker last, so
    a run that stops anywhere is resumed by the next. Markers that are there but cannot be read
    end the run, as everything would be written again otherwise.
    """
    try:
        ready = {r.session for r in spark.read.parquet(done).select(F.col("session").cast("string").alias("session")).collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ready = set()
    report = {}
    for session, load in sorted(sessions.items()):
        if session in ready:
            report[session] = "skipped"
            continue
        try:
            load().write.mode("overwrite").parquet(f"{out}/session={session}")
            spark.createDataFrame([(session,)], "session string").write.mode("append").parquet(done)
            report[session] = "done"
        except Exception as e:
            report[session] = f"failed: {type(e).__name__}"
    return report
