"""Published versions of a set of tables, on any file system that Spark can reach."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession

from lawloom.operators.search import write_index


#: Columns that the query tools look tables up by.
LOOKUPS = {
    "law_section": ("law_code", "section_num_norm"),
    "law_toc": ("law_code", "node_treepath"),
    "law_toc_sections": ("law_code", "section_num"),
    "bill": ("measure_type", "measure_num", "session_year"),
    "bill_version": ("bill_id", "version_num"),
    "bill_version_text": ("bill_version_id",),
    "bill_section_ref": ("law_code", "section"),
    "bill_history": ("bill_id", "action_date"),
    "bill_analysis": ("bill_id", "analysis_id"),
    "analysis_text": ("analysis_id",),
}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def publish(tables: dict[str, DataFrame], root: str, meta: dict[str, str], version: str | None = None, *, indexes: dict[str, tuple[str, str]] | None = None, sorted_by: dict[str, tuple[str, ...]] | None = None) -> str:
    """Writes a version of all tables and makes it the current one; returns its name.

    ``indexes`` has the key and text column of tables that get a full-text index, ``sorted_by`` the
    columns by which tables are partitioned and sorted for lookups (LOOKUPS if not given), so that
    a filter on them skips files and row groups.

    Readers see the whole version or none: it is written beside the others, and only then the
    pointer is put in place by a rename. A failure leaves the pointer as it was and removes what
    was written.
    """
    spark = next(iter(tables.values())).sparkSession
    version = version or f"v{time.time_ns()}"
    fs, path = _fs(spark, root)
    try:
        for name, df in tables.items():
            columns = [c for c in (LOOKUPS if sorted_by is None else sorted_by).get(name, ()) if c in df.columns]
            placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns) if columns else df
            placed.write.mode("overwrite").parquet(f"{root}/{version}/{name}.parquet")
        for name, (key, text) in (indexes or {}).items():
            write_index(tables[name], key, text, f"{root}/{version}/{name}.index")
        spark.createDataFrame([(k, str(v)) for k, v in sorted(meta.items())], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{version}/meta.parquet")
    except Exception:
        fs.delete(path(f"{root}/{version}"), True)
        raise
    staged = path(f"{root}/_current.{version}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    fs.delete(path(f"{root}/_current"), False)
    fs.rename(staged, path(f"{root}/_current"))
    return version


def current(spark: SparkSession, root: str) -> str:
    """The folder of the current version; resolve it for each query, as it may be replaced."""
    fs, path = _fs(spark, root)
    stream = fs.open(path(f"{root}/_current"))
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{root}/{name}"


def meta_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """Key and value pairs of a version; none if it has no such table."""
    try:
        return {r.key: r.value for r in spark.read.parquet(f"{folder}/meta.parquet").collect()}
    except Exception:
        return {}


def report(counts: dict, **more) -> str:
    """A report as JSON."""
    return json.dumps({**counts, **more}, ensure_ascii=False, sort_keys=True, default=str)
