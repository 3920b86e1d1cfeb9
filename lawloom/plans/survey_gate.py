"""The whole gate of the survey (Q1 to Q12), over whole tables, with its shares as parameters.

A table that is not there measures nothing, so its checks fail. Rows given twice count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions.citations import CodeBook
from lawloom.operators.quality import Check, gate, metrics, not_worse
from lawloom.operators.search import corpus_size, matching, parse_match, postings
from lawloom.operators.text import parse_titles
from lawloom.sources.tables import table

REQUIRED = ("schema_version", "build_utc", "law_extract_date", "bill_extract_date", "session_year", "title_coverage")
FLOORS = {"law_section": 160_000, "bill": 1_000, "bill_version": 1_000, "bill_version_text": 1_000, "bill_history": 10_000, "bill_analysis": 1_000, "bill_section_ref": 20_000, "bill_version_authors": 1_000}
#: (code, section, needle): sections whose longest text has more than 100 characters, and holds the needle if there is one.
SPOTS = (("EDC", "44955", None), ("PEN", "187", "malice"), ("GOV", "54950", "public"), ("CONS", "Art. I, Sec. 1", "inalienable"))
PROBE = "malice aforethought"
CONSTITUTION = "CONS"
KEYS = {"law_section": ["id"], "bill": ["bill_id"], "bill_version": ["bill_version_id"], "bill_version_text": ["bill_version_id"], "bill_history": ["bill_id", "bill_history_id"], "bill_section_ref": ["ref_id"]}
TABLES = (*FLOORS, "codes", "meta", "analysis_text")
EXTRACTS = {"law_extract": ("law_section",), "bill_extract": ("bill", "bill_version", "bill_history", "bill_analysis")}


def read_all(spark: SparkSession, root: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """Those of the tables that are there."""
    found = {}
    for name in names:
        try:
            found[name] = table(spark, root, name)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def row_count(df: DataFrame, name: str) -> Column:
    """Rows of a table, those given twice counted once."""
    keys = KEYS.get(name)
    return F.count_distinct(*keys) if keys and set(keys) <= set(df.columns) else F.count(F.lit(1))


def extract_dates(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """(tbl, metric, value) of the extract dates in seconds: as meta states them, else the latest trans_update."""
    if "meta" in tables:
        stated = lambda key: F.max(F.when(F.col("key") == key, F.unix_timestamp(F.try_to_timestamp("value", F.lit("yyyy-MM-dd HH:mm:ss")))))
        return [metrics({name: tables["meta"]}, {name: {"date": stated(f"{name}_date")}}) for name in EXTRACTS]
    dates = []
    for name, of in EXTRACTS.items():
        stamps = [tables[t].select(F.col("trans_update").cast("timestamp").alias("at")) for t in of if t in tables]
        if stamps:
            dates.append(metrics({name: reduce(DataFrame.unionByName, stamps)}, {name: {"date": F.unix_timestamp(F.max("at"))}}))
    return dates


def survey_checks(*, floors: dict[str, int] = FLOORS, spots=SPOTS, law_text: float = 0.999, scoped: int = 300, several: int = 400, ref_keys: float = 0.9, titles: float = 0.99, texts: float = 0.99, bad_titles: float = 0.01, good_titles: float = 0.8, analyses: float | None = 0.95, law_days: int = 40, bill_days: int = 21) -> list[Check]:
    """The checks; ``analyses`` is None where no texts of analyses are expected."""
    return [
        Check("Q1 meta keys", "meta", "present", ">=", len(REQUIRED)),
        *[Check(f"Q2 {t} rows", t, "rows", ">=", n) for t, n in floors.items()],
        Check("Q2 codes at least", "codes", "rows", ">=", 25),
        Check("Q2 codes at most", "codes", "rows", "<=", 35),
        Check("Q3 section text coverage", "law_section", "with_text", ">=", law_text, "rows"),
        Check("Q3 section keys complete", "law_section", "no_key", "=", 0),
        Check("Q3 article-scoped keys", "law_section", "scoped", ">=", scoped),
        Check("Q4 multi-version sections", "section_keys", "several", ">=", several, level="warn"),
        *[Check(f"Q5 spot {c} {s}", "law_section", f"spot{k}", ">=", 1) for k, (c, s, _) in enumerate(spots)],
        Check("Q6 reference keys", "bill_section_ref", "keyed", ">=", ref_keys, "scoped", "warn"),
        Check("Q7 versions for bills", "bill_version", "ids", ">=", 1, "bills"),
        Check("Q7 titles", "bill_version", "titled", ">=", titles, "with_lob", "warn"),
        Check("Q8 version texts", "bill_version", "with_text", ">=", texts, "with_lob"),
        Check("Q9 titles not parsed", "titles", "bad", "<=", bad_titles, "parsed"),
        Check("Q9 titles parsed", "titles", "ok", ">=", good_titles, "parsed", "warn"),
        *([] if analyses is None else [Check("Q10 analysis texts there", "analysis_text", "there", ">=", 1), Check("Q10 analysis texts", "analysis_text", "rows", ">=", analyses, "analyses", "warn")]),
        Check("Q11 search finds", "index", "hits", ">=", 1),
        Check("Q11 search rows", "index", "rows", "=", 1, "sections"),
        Check("Q12 law_extract_date", "law_extract", "days", "<=", law_days, level="warn"),
        Check("Q12 bill_extract_date", "bill_extract", "days", "<=", bill_days, level="warn"),
    ]


def _spot(code: str, section: str, needle: str | None) -> Column:
    longest = F.max(F.when((F.col("law_code") == code) & (F.col("section_num_norm") == section), F.struct(F.length("content_text").alias("n"), F.lower("content_text").alias("text"))))
    held = longest["n"] > 100
    return F.coalesce(held if needle is None else held & longest["text"].contains(needle), F.lit(False)).cast("int")


def survey_metrics(tables: dict[str, DataFrame], now: Column, *, spots=SPOTS, probe: str = PROBE, constitution: str = CONSTITUTION) -> DataFrame:
    """(tbl, metric, value) of the tables that are there."""
    parts = []

    def measure(name: str, df: DataFrame, **columns: Column) -> None:
        parts.append(metrics({name: df}, {name: columns}))

    for name in tables:
        if name not in ("law_section", "bill_version", "meta"):
            measure(name, tables[name], rows=row_count(tables[name], name))
    if "meta" in tables:
        measure("meta", tables["meta"], present=F.count_distinct(F.when(F.col("key").isin(*REQUIRED) & (F.col("value") != ""), F.col("key"))))
    if "law_section" in tables:
        law = tables["law_section"]
        scoped = (F.col("law_code") == constitution) & F.col("section_num_norm").like("Art. %, Sec. %")
        n = F.count(F.lit(1))
        found = {f"spot{k}": _spot(*s) for k, s in enumerate(spots)}
        measure("law_section", law, rows=n, with_text=F.count_if(F.length("content_text") > 0), no_key=F.count_if(F.col("section_num_norm").isNull()), scoped=F.count_if(scoped), **found)
        measure("section_keys", law.groupBy("law_code", "section_num_norm").count(), several=F.count_if(F.col("count") > 1))
        docs = law.select("id", "content_text")
        measure("index", matching(parse_match(probe), postings(docs, "id", "content_text"), "id"), hits=n)
        measure("index", corpus_size(docs, "content_text"), rows=F.max("docs"))
        measure("index", law, sections=n)
    if "bill_section_ref" in tables:
        refs = tables["bill_section_ref"].where((F.col("law_code") == constitution) & F.col("struct").isNull()).select("ref_id", "section").distinct()
        measure("bill_section_ref", refs, scoped=F.count(F.lit(1)), keyed=F.count_if(F.col("section").like("Art. %, Sec. %")))
    if "bill" in tables:
        measure("bill_version", tables["bill"], bills=row_count(tables["bill"], "bill"))
    if "bill_version" in tables:
        versions = tables["bill_version"].groupBy("bill_version_id").agg(F.max("lob_file").alias("lob_file"), F.max("title_text").alias("title_text"))
        blobs = F.col("lob_file").isNotNull()
        n = F.count(F.lit(1))
        measure("bill_version", versions, rows=n, ids=n, with_lob=F.count_if(blobs), titled=F.count_if(blobs & (F.length("title_text") > 0)))
        if "bill_version_text" in tables:
            texts = tables["bill_version_text"].where(F.octet_length("text_zlib") > 32).select("bill_version_id").distinct()
            measure("bill_version", versions.where(blobs).join(texts, "bill_version_id"), with_text=n)
        if "codes" in tables:
            book = CodeBook.from_titles([(r.code, r.title) for r in tables["codes"].collect()])
            status = parse_titles(versions.where("title_text is not null"), "bill_version_id", "title_text", book)
            measure("titles", status, parsed=n, ok=F.count_if(F.col("status") == "ok"), bad=F.count_if(F.col("status").isin("partial", "fail", "error")))
    if "analysis_text" in tables:
        measure("analysis_text", tables["analysis_text"], there=F.lit(1) + 0 * F.count(F.lit(1)))
        if "bill_analysis" in tables:
            measure("analysis_text", tables["bill_analysis"], analyses=F.count(F.lit(1)))
    for date in extract_dates(tables):
        parts.append(date.select("tbl", F.lit("days").alias("metric"), F.floor((F.unix_timestamp(now) - F.col("value")) / 86_400).cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def survey_gate(spark: SparkSession, root: str, now: Column) -> DataFrame:
    """(name, level, ok, value, needed) of all checks over the tables below ``root``."""
    return gate(spark, survey_metrics(read_all(spark, root), now), survey_checks())


#: Tables whose rows are held against those of the version before.
KEPT = ("law_section", "bill", "bill_version", "bill_version_text", "bill_history", "bill_analysis", "bill_section_ref")


def state(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, metric, value): rows of each kept table that is there, and the extract dates."""
    empty = spark.createDataFrame([], "tbl string, metric string, value double")
    parts = [metrics({t: tables[t]}, {t: {"rows": row_count(tables[t], t)}}) for t in KEPT if t in tables]
    return reduce(DataFrame.unionByName, [*parts, *extract_dates(tables)], empty)


def regression(spark: SparkSession, tables: dict[str, DataFrame], previous: dict[str, DataFrame], *, share: float = 0.98) -> DataFrame:
    """(name, level, ok, value, needed): Q13, tables against those of the version before.

    A table that was there and is not now has -1 rows and fails; one that was not there before is
    a warning. Extract dates, in seconds, may not be older; one that is missing counts as 0.
    ``previous`` without any table is a version that cannot be read, which fails.
    """
    if not previous:
        return spark.createDataFrame([("previous.readable", "fail", False, None, None)], "name string, level string, ok boolean, value double, needed double")
    wanted = spark.createDataFrame([*((t, "rows", -1.0) for t in KEPT), *((t, "date", 0.0) for t in EXTRACTS)], "tbl string, metric string, absent double")
    now, before = (wanted.join(state(spark, x), ["tbl", "metric"], "left") for x in (tables, previous))
    now = now.select("tbl", "metric", F.coalesce("value", "absent").alias("value"))
    rows = not_worse(now.where("metric = 'rows'"), before.where("metric = 'rows'"), share)
    dates = before.where("metric = 'date'").select("tbl", "metric", F.coalesce("value", "absent").alias("value"))
    return rows.unionByName(not_worse(now.where("metric = 'date'"), dates, 1.0))
