"""Queries of the data-quality operators over the corpus tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators.packed import citations, unpack_values
from lawloom.operators.references import broken_references, normal_key, validity
from lawloom.operators.rejects import LAYOUTS, loaded, parse_lines, rejected
from lawloom.operators.snapshots import row_digest, snapshot_changes
from lawloom.sources.tables import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Values of the histories that hold two or more."""
    return unpack_values(table(spark, root, "law_section"), "id", "history").where("values > 1").select("id", "pos")


def p4_values(spark: SparkSession, root: str) -> DataFrame:
    """Every value of every history, unquoted."""
    return unpack_values(table(spark, root, "law_section"), "id", "history").select("id", "pos", "value")


def p4_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """What the values of each history hold together, in letters and digits, and their citations: nothing may be lost or moved."""
    values = unpack_values(table(spark, root, "law_section"), "id", "history")
    bare = F.regexp_replace("value", "[^A-Za-z0-9]", "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", bare.alias("v")))), lambda x: x["v"]), "")
    return values.groupBy("id").agg(F.md5(joined).alias("digest"), F.sum(citations(F.col("value"))).cast("bigint").alias("cited"), F.max(citations(F.col("value"))).cast("bigint").alias("most"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Law sections and bills added, removed or changed between neighbouring snapshots."""
    tables = (("law_section_snapshot", "id", ["content_text", "effective_date"]), ("bill_snapshot", "bill_id", ["current_status"]))
    rows = []
    for name, key, compared in tables:
        df = table(spark, root, name)
        rows.append(df.select(F.lit(name).alias("tbl"), F.col(key).alias("rec_key"), "snapshot_date", "loaded_at", F.hex(row_digest([df[c] for c in compared])).alias("values")))
    changes = snapshot_changes(reduce(DataFrame.unionByName, rows), "snapshot_date", "rec_key", "loaded_at", ["values"], part="tbl")
    return changes.select("tbl", "rec_key", "snapshot_date", "change")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the two known files that fail, with the reason; lines of unknown files are in p6_rejected."""
    return rejected(parse_lines(table(spark, root, "raw_row"), "raw_id", "file_name", "line"), "raw_id").where("reason <> 'unknown_file'").select("raw_id", "reason")


def p6_rejected(spark: SparkSession, root: str) -> DataFrame:
    """All lines that do not load, with the reason and what was found."""
    return rejected(parse_lines(table(spark, root, "raw_row"), "raw_id", "file_name", "line"), "raw_id")


def p6_loaded_history(spark: SparkSession, root: str) -> DataFrame:
    """Valid rows of the history file."""
    return loaded(parse_lines(table(spark, root, "raw_row"), "raw_id", "file_name", "line"), "raw_id", "file_name", "BILL_HISTORY_TBL.dat")


def p6_loaded_sections(spark: SparkSession, root: str) -> DataFrame:
    """Valid rows of the section file."""
    return loaded(parse_lines(table(spark, root, "raw_row"), "raw_id", "file_name", "line"), "raw_id", "file_name", "LAW_SECTION_TBL.dat")


def _broken(spark: SparkSession, root: str) -> DataFrame:
    refs, bills, versions = (table(spark, root, n) for n in ("bill_section_ref", "bill", "bill_version"))
    codes, sections, blobs = (table(spark, root, n) for n in ("codes", "law_section", "lob_manifest"))
    of_ref = refs.select(F.lit("bill_section_ref").alias("tbl"), F.col("ref_id").cast("string").alias("rec_key"), F.col("session_year").alias("period"), F.col("trans_update").alias("at"), "law_code", "section")
    known = validity(codes.withColumn("since", F.lit(None).cast("timestamp_ntz")), ["code"], F.lit(True), "since")
    in_codes = of_ref.join(F.broadcast(known.select(F.col("k0").alias("__code"))), normal_key(of_ref["law_code"]) == F.col("__code"), "left_semi")  # a fixed table of 30 codes
    of_bill = bills.select(F.lit("bill").alias("tbl"), F.col("bill_id").alias("rec_key"), F.col("session_year").alias("period"), F.col("trans_update").alias("at"), "latest_bill_version_id")
    of_version = versions.select(F.lit("bill_version").alias("tbl"), F.col("bill_version_id").alias("rec_key"), F.substring("bill_id", 1, 8).alias("period"), F.col("trans_update").alias("at"), "lob_file")
    found = {
        "law_code": broken_references(of_ref, ["law_code"], known, small=True),
        "section": broken_references(in_codes, ["law_code", "section"], validity(sections, ["law_code", "section_num_norm"], F.col("active_flg") == "Y", "trans_update")),
        "latest_bill_version_id": broken_references(of_bill, ["latest_bill_version_id"], validity(versions, ["bill_version_id"], F.col("active_flg") == "Y", "trans_update")),
        "lob_file": broken_references(of_version, ["lob_file"], validity(blobs, ["lob_file"], F.col("deleted_at").isNull(), "delivered_at", "deleted_at")),
    }
    parts = [d.select("tbl", F.lit(field).alias("field"), "rec_key", "period", "reason") for field, d in found.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """References that lead nowhere, to deleted records or to later ones."""
    return _broken(spark, root)


def p7_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many there are of each kind, per table, field and session."""
    return _broken(spark, root).groupBy("tbl", "field", "period", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {q.__name__: q for q in (p4_found, p4_values, p4_round_trip, p5_found, p6_found, p6_rejected, p6_loaded_history, p6_loaded_sections, p7_found, p7_counts)}

_CHANGES = """
SELECT '{t}' AS tbl, coalesce(c.k, p.k) AS rec_key, coalesce(c.snapshot_date, p.nxt) AS snapshot_date,
       CASE WHEN p.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM {t}_rows WHERE prv IS NOT NULL) c
FULL JOIN (SELECT * FROM {t}_rows WHERE nxt IS NOT NULL) p ON c.k = p.k AND c.prv = p.snapshot_date
WHERE p.k IS NULL OR c.k IS NULL OR {differ}
"""
_ROWS = """
{t}_snaps AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS prv, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nxt
              FROM (SELECT DISTINCT snapshot_date FROM {t} WHERE snapshot_date IS NOT NULL AND {k} IS NOT NULL)),
{t}_rows AS (SELECT {k} AS k, {cols}, snapshot_date, prv, nxt FROM {t} JOIN {t}_snaps USING (snapshot_date) WHERE {k} IS NOT NULL
             QUALIFY row_number() OVER (PARTITION BY snapshot_date, {k} ORDER BY loaded_at DESC NULLS LAST) = 1)
"""
_N = "upper(regexp_replace({}, '^\\s+|[\\s.]+$', '', 'g'))"


def _orphans(tbl: str, field: str, key: str, period: str, source: str, keys: list[str], parent: str, parent_keys: list[str], live: str, since: str) -> str:
    on = " AND ".join(f"{_N.format('r.' + a)} = p.k{i}" for i, a in enumerate(keys))
    known = " AND ".join(f"r.{a} IS NOT NULL" for a in keys)
    agg = ", ".join(f"{_N.format(a)} AS k{i}" for i, a in enumerate(parent_keys))
    return f"""
SELECT '{tbl}' AS tbl, '{field}' AS field, CAST(r.{key} AS VARCHAR) AS rec_key, {period} AS period,
       CASE WHEN p.live IS NULL THEN 'missing' WHEN NOT p.live THEN 'deleted' ELSE 'late' END AS reason
FROM {source} r LEFT JOIN (SELECT {agg}, bool_or(coalesce({live}, false)) AS live, min(CASE WHEN {live} THEN {since} END) AS since
                           FROM {parent} GROUP BY ALL) p ON {on}
WHERE {known} AND (p.live IS NULL OR NOT p.live OR p.since > r.trans_update)
"""


_P5 = "WITH " + ", ".join(_ROWS.format(t=t, k=k, cols=c) for t, k, c in (("law_section_snapshot", "id", "content_text, effective_date"), ("bill_snapshot", "bill_id", "current_status"))) + " UNION ALL ".join(
    _CHANGES.format(t=t, differ=" OR ".join(f"c.{x} IS DISTINCT FROM p.{x}" for x in cols))
    for t, cols in (("law_section_snapshot", ("content_text", "effective_date")), ("bill_snapshot", ("current_status",)))
)
_P7 = " UNION ".join(
    [
        _orphans("bill_section_ref", "law_code", "ref_id", "r.session_year", "bill_section_ref", ["law_code"], "codes", ["code"], "true", "CAST(NULL AS TIMESTAMP)"),
        _orphans("bill_section_ref", "section", "ref_id", "r.session_year", f"(SELECT * FROM bill_section_ref WHERE {_N.format('law_code')} IN (SELECT {_N.format('code')} FROM codes))", ["law_code", "section"], "law_section", ["law_code", "section_num_norm"], "active_flg = 'Y'", "trans_update"),
        _orphans("bill", "latest_bill_version_id", "bill_id", "r.session_year", "bill", ["latest_bill_version_id"], "bill_version", ["bill_version_id"], "active_flg = 'Y'", "trans_update"),
        _orphans("bill_version", "lob_file", "bill_version_id", "substr(r.bill_id, 1, 8)", "bill_version", ["lob_file"], "lob_manifest", ["lob_file"], "deleted_at IS NULL", "delivered_at"),
    ]
)
_B, _T, _Q = "chr(92)", "chr(9)", "'`'"
_LINE = "regexp_replace(coalesce(line, ''), chr(13) || '$', '')"
_SAFE = f"replace(replace(replace({_LINE}, {_B} || {_B}, chr(57344)), {_B} || {_T}, chr(57345)), {_B} || {_Q}, chr(57346))"
_TEXT = "CASE WHEN len(x) > 1 AND starts_with(x, '`') AND ends_with(x, '`') THEN x[2:-2] ELSE x END"
for _letter, _code in (("0", 0), ("b", 8), ("n", 10), ("r", 13), ("t", 9), ("Z", 26)):
    _TEXT = f"replace({_TEXT}, {_B} || '{_letter}', chr({_code}))"
_VALUE = f"list_transform(f, lambda x: CASE WHEN x IN ('NULL', {_B} || 'N') THEN NULL ELSE replace(replace(replace(regexp_replace({_TEXT}, '\\\\(.)', '\\1', 'gs'), chr(57345), {_T}), chr(57346), '`'), chr(57344), {_B}) END)"
_TIME = "coalesce(regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') AND NOT starts_with({0}, '0000') AND try_cast({0} AS TIMESTAMP) IS NOT NULL, false)"
_P6 = f"""
WITH split AS (SELECT raw_id, file_name, string_split({_SAFE}, {_T}) AS f FROM raw_row WHERE file_name IN ('BILL_HISTORY_TBL.dat', 'LAW_SECTION_TBL.dat')),
parsed AS (SELECT *, {_VALUE} AS v FROM split)
SELECT * FROM (SELECT raw_id, CASE
  WHEN len(f) <> CASE file_name WHEN 'BILL_HISTORY_TBL.dat' THEN 13 ELSE 18 END THEN 'column_count'
  WHEN len(list_filter(f, lambda x: CASE WHEN starts_with(x, '`') THEN NOT (len(x) > 1 AND ends_with(x, '`')) ELSE contains(x, '`') END)) > 0 THEN 'quoting'
  WHEN len(list_filter(f, lambda x: regexp_matches(regexp_replace(x, '\\\\.', '', 'gs'), '[\x01-\x08\x0a-\x1f]') OR contains(x, chr(0)))) > 0 THEN 'value'
  WHEN file_name = 'BILL_HISTORY_TBL.dat' AND NOT (coalesce(regexp_full_match(v[2], '[0-9]+'), false) AND coalesce(regexp_full_match(v[7], '[0-9]+'), false) AND {_TIME.format("v[3]")} AND {_TIME.format("v[6]")} AND coalesce(regexp_matches(v[4], '[^\\s]'), false)) THEN 'value'
  WHEN file_name = 'LAW_SECTION_TBL.dat' AND NOT ({_TIME.format("v[18]")} AND (v[7] IS NULL OR {_TIME.format("v[7]")}) AND (v[4] IS NULL OR regexp_full_match(v[4], '[0-9]{{4}}')) AND coalesce(v[16] IN ('Y', 'N'), false)) THEN 'value'
  END AS reason FROM parsed) WHERE reason IS NOT NULL
"""


def _loaded_sql(file: str) -> str:
    columns = ", ".join(f"v[{k}] AS {c}" for k, c in enumerate(LAYOUTS[file].columns, 1))
    return f"{_P6.split('SELECT * FROM (SELECT raw_id')[0]} SELECT raw_id, {columns} FROM parsed WHERE file_name = '{file}' AND raw_id NOT IN (SELECT raw_id FROM ({_P6}))"


ORACLE_SQL = {
    "p6_found": _P6,
    "p6_loaded_history": _loaded_sql("BILL_HISTORY_TBL.dat"),
    "p6_loaded_sections": _loaded_sql("LAW_SECTION_TBL.dat"),
    "p4_found": "SELECT id, unnest(range(1, n + 1)) AS pos FROM (SELECT id, len(regexp_extract_all(regexp_replace(history, '\\([^()]*\\)', ' ', 'g'), '\\b(?:Stats|Prop)\\.')) AS n FROM law_section) WHERE n > 1",
    "p4_round_trip": "SELECT id, digest, n AS cited, 1 AS most FROM (SELECT id, md5(regexp_replace(history, '[^A-Za-z0-9]', '', 'g')) AS digest, len(regexp_extract_all(regexp_replace(history, '\\([^()]*\\)', ' ', 'g'), '\\b(?:Stats|Prop)\\.')) AS n FROM law_section) WHERE n > 0",
    "p5_found": _P5,
    "p7_found": _P7,
    "p7_counts": f"SELECT tbl, field, period, reason, count(*) AS n FROM ({_P7}) GROUP BY ALL",
}
