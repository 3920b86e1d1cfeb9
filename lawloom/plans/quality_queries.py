"""The quality gate, coverage and the limiter over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators.limiter import limit_hits
from lawloom.operators.quality import Check, era_notes, gate, metrics, not_worse
from lawloom.operators.relational import unpivot_metrics
from lawloom.operators.surveys import fixed_sample, freshest
from lawloom.plans.survey_gate import read_all, regression, survey_gate
from lawloom.sources.tables import table

CHECKS = [
    Check("sections", "law_section", "rows", ">=", 100),
    Check("section text coverage", "law_section", "with_text", ">=", 0.9, "rows"),
    Check("section keys complete", "law_section", "no_key", "=", 0),
    Check("multi-version sections", "law_section", "inactive", ">=", 1, level="warn"),
    Check("versions for bills", "bill_version", "bills", ">=", 100),
    Check("titles", "bill_version", "with_title", ">=", 0.9, "rows", "warn"),
    Check("version texts", "bill_version_text", "packed", ">=", 0.99, "rows"),
    Check("reference keys", "bill_section_ref", "shaped", ">=", 0.9, "rows", "warn"),
    Check("codes at least", "codes", "rows", ">=", 25),
    Check("codes at most", "codes", "rows", "<=", 35),
    Check("no such metric", "codes", "absent", ">=", 1, level="warn"),
]


def _metrics(spark: SparkSession, root: str) -> DataFrame:
    n = F.count(F.lit(1))
    wanted = {
        "law_section": {"rows": n, "with_text": F.count_if(F.length("content_text") > 0), "no_key": F.count_if(F.col("section_num_norm").isNull()), "inactive": F.count_if(F.col("active_flg") == "N")},
        "bill_version": {"rows": n, "bills": F.count_distinct("bill_id"), "with_title": F.count("title_text")},
        "bill_version_text": {"rows": n, "packed": F.count_if(F.octet_length("text_zlib") > 32)},
        "bill_section_ref": {"rows": n, "shaped": F.count_if(F.col("section").rlike(r"\A[0-9]+(\.[0-9]+)*\z"))},
        "codes": {"rows": n},
    }
    return metrics({t: table(spark, root, t) for t in wanted}, wanted)


def q_gate(spark: SparkSession, root: str) -> DataFrame:
    """The few checks of CHECKS, which have SQL, with floors for small tables; `q_gate_survey` is the whole gate."""
    return gate(spark, _metrics(spark, root), CHECKS)


def q_gate_survey(spark: SparkSession, root: str) -> DataFrame:
    """Q1 to Q12: the outcome of each check of the survey, at its shares, on the first of 2030."""
    return survey_gate(spark, root, F.lit("2030-01-01").cast("timestamp"))


def q13_not_worse(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of bills against those of a version before, here without the rows of the last session; `q13_tables` is the whole of Q13."""
    last = table(spark, root, "bill").agg(F.max("session_year").alias("s")).first().s
    n = F.count(F.lit(1))
    now = metrics({"bill": table(spark, root, "bill")}, {"bill": {"rows": n, "pointed": F.count("latest_bill_version_id")}})
    before = metrics({"bill": table(spark, root, "bill").where(F.col("session_year") < last)}, {"bill": {"rows": n}})
    return not_worse(now, before)


def q13_tables(spark: SparkSession, root: str) -> DataFrame:
    """Q13: all tables and extract dates against those of a version before, here without the rows of the last session."""
    tables = read_all(spark, root)
    last = tables["bill"].agg(F.max("session_year").alias("s")).first().s
    former = {
        "law_section": F.date_format("trans_update", "yyyy") < last[:4], "bill": F.col("session_year") < last, "bill_section_ref": F.col("session_year") < last,
        "bill_version": F.col("bill_id") < last, "bill_history": F.col("bill_id") < last, "bill_version_text": F.col("bill_version_id") < last[:4],
    }
    return regression(spark, tables, {t: df.where(former[t]) if t in former else df for t, df in tables.items()})


def g12_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Notes on kinds of measures of a session without chaptered bills or pointers, or before 2021; `g12_eras` has the rules of G12."""
    kinds = table(spark, root, "bill").where("session_year is not null and measure_type is not null").groupBy(F.concat_ws(" ", "session_year", "measure_type").alias("session_year"))
    wide = kinds.agg(F.count("chapter_num").alias("chaptered"), F.count("latest_bill_version_id").alias("pointed"))
    return era_notes(unpivot_metrics(wide, ["session_year"], ["chaptered", "pointed"]), [("chaptered", "no chaptered bills"), ("pointed", "no pointers")], [(2021, "before 2021")])


ERA_RULES = [("bill_analysis", "no analyses"), ("bill_history", "no history"), ("bill_summary_vote", "no votes")]
ERAS = [(1999, "chiefly chaptered bills")]


def session_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(session_year, key, value): rows by session of the tables of ERA_RULES that are there, 0 included."""
    sessions = tables["bill"].select("session_year").where("session_year is not null").distinct()
    parts = [sessions.select("session_year", F.lit("bills").alias("key"), F.lit("1").alias("value"))]
    for name, _ in ERA_RULES:
        if name in tables:
            counted = tables[name].groupBy(F.substring("bill_id", 1, 8).alias("session_year")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(sessions.join(counted, "session_year", "left").select("session_year", F.lit(name).alias("key"), F.coalesce("n", F.lit(0)).cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def g12_eras(spark: SparkSession, root: str) -> DataFrame:
    """Notes on what sessions lack, and on sessions before 1999; a table that is not there gives no note."""
    tables = read_all(spark, root, ("bill", *(name for name, _ in ERA_RULES)))
    return era_notes(session_rows(tables), ERA_RULES, ERAS)


def g13_span(spark: SparkSession, root: str) -> DataFrame:
    """The first and last session."""
    return table(spark, root, "bill").agg(F.min("session_year").alias("first"), F.max("session_year").alias("last"))


def w1_limiter(spark: SparkSession, root: str) -> DataFrame:
    """Events of each user, at most three within six hours."""
    events = table(spark, root, "events").select("event_id", "user_id", "ts")
    return limit_hits(events, "user_id", "ts", "event_id", window=21_600.0, limit=3).select("event_id", "allowed")


def x3_sample(spark: SparkSession, root: str) -> DataFrame:
    """Ten documents of each kind, the same on each run."""
    return fixed_sample(table(spark, root, "documents"), "doc_id", "kind", 10)


def s14_freshest(spark: SparkSession, root: str) -> DataFrame:
    """The blob delivered last, and whether it was so long before the first of 2030."""
    rows = table(spark, root, "lob_manifest").select("lob_file", "delivered_at")
    return freshest(rows.groupBy("delivered_at").agg(F.max("lob_file").alias("lob_file")), "lob_file", "delivered_at", F.lit("2030-01-01").cast("timestamp")).select("lob_file", "stale")


QUERIES = {q.__name__: q for q in (q_gate, q_gate_survey, q13_not_worse, q13_tables, g12_coverage, g12_eras, g13_span, w1_limiter, x3_sample, s14_freshest)}

_OPS = {">=": ">=", "<=": "<=", "=": "="}
_VALUES = {
    ("law_section", "rows"): "(SELECT count(*) FROM law_section)",
    ("law_section", "with_text"): "(SELECT count(*) FROM law_section WHERE length(content_text) > 0)",
    ("law_section", "no_key"): "(SELECT count(*) FROM law_section WHERE section_num_norm IS NULL)",
    ("law_section", "inactive"): "(SELECT count(*) FROM law_section WHERE active_flg = 'N')",
    ("bill_version", "rows"): "(SELECT count(*) FROM bill_version)",
    ("bill_version", "bills"): "(SELECT count(DISTINCT bill_id) FROM bill_version)",
    ("bill_version", "with_title"): "(SELECT count(title_text) FROM bill_version)",
    ("bill_version_text", "rows"): "(SELECT count(*) FROM bill_version_text)",
    ("bill_version_text", "packed"): "(SELECT count(*) FROM bill_version_text WHERE octet_length(text_zlib) > 32)",
    ("bill_section_ref", "rows"): "(SELECT count(*) FROM bill_section_ref)",
    ("bill_section_ref", "shaped"): "(SELECT count(*) FROM bill_section_ref WHERE section SIMILAR TO '[0-9]+(\\.[0-9]+)*')",
    ("codes", "rows"): "(SELECT count(*) FROM codes)",
    ("codes", "absent"): "NULL",
}


def _check_sql(c: Check) -> str:
    value = f"CAST({_VALUES[c.tbl, c.metric]} AS DOUBLE)"
    needed = f"{c.threshold}::DOUBLE" + (f" * {_VALUES[c.tbl, c.of]}" if c.of else "")
    return f"SELECT '{c.name}' AS name, '{c.level}' AS level, coalesce({value} {c.op} {needed}, false) AS ok, {value} AS value, {needed} AS needed"


ORACLE_SQL = {
    "x3_sample": "SELECT kind, doc_id FROM documents WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY md5('7' || doc_id), doc_id) <= 10",
    "s14_freshest": "SELECT max(lob_file) AS lob_file, true AS stale FROM lob_manifest WHERE delivered_at = (SELECT max(delivered_at) FROM lob_manifest)",
    "q_gate": " UNION ALL ".join(map(_check_sql, CHECKS)),
    "q13_not_worse": "SELECT 'bill.rows' AS name, 'fail' AS level, n >= was * 0.98 AS ok, CAST(n AS DOUBLE) AS value, was * 0.98::DOUBLE AS needed FROM (SELECT count(*) AS n, count(*) FILTER (session_year < (SELECT max(session_year) FROM bill)) AS was FROM bill) UNION ALL SELECT 'bill.pointed', 'warn', false, CAST(count(latest_bill_version_id) AS DOUBLE), NULL FROM bill",
    "q13_tables": " UNION ALL ".join(
        [
            *(
                f"SELECT '{t}.rows' AS name, 'fail' AS level, n >= was * 0.98 AS ok, CAST(n AS DOUBLE) AS value, was * 0.98::DOUBLE AS needed FROM (SELECT count(DISTINCT {key}) AS n, count(DISTINCT {key}) FILTER ({former}) AS was FROM {t}, (SELECT max(session_year) AS last FROM bill))"
                for t, key, former in (
                    ("law_section", "id", "year(trans_update) < CAST(left(last, 4) AS INT)"), ("bill", "bill_id", "session_year < last"), ("bill_version", "bill_version_id", "left(bill_id, 8) < last"),
                    ("bill_version_text", "bill_version_id", "left(bill_version_id, 4) < left(last, 4)"), ("bill_history", "(bill_id, bill_history_id)", "left(bill_id, 8) < last"), ("bill_section_ref", "ref_id", "session_year < last"),
                )
            ),
            "SELECT 'bill_analysis.rows', 'warn', false, -1::DOUBLE, NULL",
            "SELECT 'law_extract.date', 'fail', n >= was, n, was FROM (SELECT floor(epoch(max(trans_update))) AS n, floor(epoch(max(trans_update) FILTER (year(trans_update) < CAST(left(last, 4) AS INT)))) AS was FROM law_section, (SELECT max(session_year) AS last FROM bill))",
            "SELECT 'bill_extract.date', 'fail', n >= was, n, was FROM (SELECT floor(epoch(max(trans_update))) AS n, floor(epoch(max(trans_update) FILTER (session < last))) AS was FROM (SELECT trans_update, session_year AS session FROM bill UNION ALL SELECT trans_update, left(bill_id, 8) FROM bill_version UNION ALL SELECT trans_update, left(bill_id, 8) FROM bill_history), (SELECT max(session_year) AS last FROM bill))",
        ]
    ),
    "g12_coverage": """WITH k AS (SELECT session_year || ' ' || measure_type AS session_year, count(chapter_num) AS c, count(latest_bill_version_id) AS p FROM bill WHERE session_year IS NOT NULL AND measure_type IS NOT NULL GROUP BY 1)
    SELECT session_year, 'no chaptered bills' AS note FROM k WHERE c = 0 UNION ALL SELECT session_year, 'no pointers' FROM k WHERE p = 0 UNION ALL SELECT session_year, 'before 2021' FROM k WHERE TRY_CAST(left(session_year, 4) AS INT) < 2021""",
    "w1_limiter": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    w AS (SELECT user_id, n, event_id, true AS allowed, [t] AS held FROM e WHERE n = 1
      UNION ALL SELECT user_id, n, event_id, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END
      FROM (SELECT e.user_id, e.n, e.event_id, e.t, list_filter(w.held, lambda x: e.t - x <= 21600) AS kept FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
    SELECT event_id, allowed FROM w UNION ALL SELECT event_id, false FROM events WHERE user_id IS NULL OR ts IS NULL""",
    "g13_span": "SELECT min(session_year) AS first, max(session_year) AS last FROM bill",
}
