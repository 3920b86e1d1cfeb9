"""Tables by name, from a published version, a folder or given DataFrames; an archive is optional."""

from __future__ import annotations

from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lawloom.functions.keys import CodeBook, format_session
from lawloom.operators.search import Index, read_index
from lawloom.sources.artifacts import current, meta_of

OPTIONAL = {
    "bill_analysis": "analysis_id string, bill_id string, house string, analysis_type string, committee_code string, committee_name string, analysis_date string, amendment_date string",
    "analysis_text": "analysis_id string, format string, text_zlib binary",
    "bill_version_authors": "bill_version_id string, name string, house string, contribution string, primary_author_flg string",
    "veto_message": "bill_id string, veto_date string",
    "veto_text": "bill_id string, veto_date string, format string, text_zlib binary",
    "bill_summary_vote": "bill_id string, location_code string, vote_date_time string, motion_id string, ayes string, noes string, abstain string, vote_result string",
    "bill_motion": "motion_id string, motion_text string",
    "law_toc": "law_code string, heading string, node_treepath string",
    "law_toc_sections": "law_code string, section_num string, node_treepath string",
    "session_coverage": "session_year string, key string, value string",
}


class Store:
    """One set of tables; optional ones that are absent are empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | str):
        self.spark, self._tables = spark, tables

    def __call__(self, name: str) -> DataFrame:
        if isinstance(self._tables, dict):
            if name in self._tables:
                return self._tables[name]
        else:
            try:
                return self.spark.read.parquet(f"{self._tables}/{name}.parquet")
            except Exception:
                if name not in OPTIONAL:
                    raise
        if name not in OPTIONAL:
            raise KeyError(name)
        return self.spark.createDataFrame([], OPTIONAL[name])


    def index(self, name: str) -> Index | None:
        """The stored full-text index of a table; None where none was published."""
        if isinstance(self._tables, dict):
            return None
        try:
            return read_index(self.spark, f"{self._tables}/{name}.index")
        except AnalysisException:
            return None


class Catalog:
    """What the tools read: the current store, maybe an archive, and facts about them."""

    def __init__(self, spark: SparkSession, now: dict[str, DataFrame] | str, archive: dict[str, DataFrame] | str | None = None, meta: dict[str, str] | None = None, *, pending: frozenset[str] = frozenset(), source: str = "Unofficial copy of public records."):
        self.spark, self.now = spark, Store(spark, now)
        self.archive = None if archive is None else Store(spark, archive)
        self.meta = meta if meta is not None else meta_of(spark, now) if isinstance(now, str) else {}
        self.pending, self.source = pending, source

    @classmethod
    def published(cls, spark: SparkSession, root: str, archive: str | None = None, **more) -> Catalog:
        """The current version below ``root``; make one for each query, as it may be replaced."""
        return cls(spark, current(spark, root), archive, **more)

    @cached_property
    def book(self) -> CodeBook:
        """Names of codes, a fixed table of some dozens of rows."""
        return CodeBook.from_titles([(r.code, r.title) for r in self.now("codes").collect()])

    @property
    def stores(self) -> list[tuple[str, Store]]:
        return [("current", self.now), *([("archive", self.archive)] if self.archive else [])]

    def envelope(self, payload: dict, notes: list[str] | None = None) -> dict:
        """A payload with the facts that every answer carries; notes only where there are some."""
        session = self.meta.get("session_year")
        head = {"law_extract_date": self.meta.get("law_extract_date") or None, "bill_extract_date": self.meta.get("bill_extract_date") or None, "current_session": format_session(session) if session else None, "source": self.source}
        return {**head, **({"notes": list(notes)} if notes else {}), **payload}
