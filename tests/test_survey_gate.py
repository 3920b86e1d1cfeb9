"""The whole gate of the survey on hand-made tables."""

import datetime
import zlib

from pyspark.sql import functions as F

from lawloom.operators.quality import gate
from lawloom.plans.quality_queries import ORACLE_SQL, q13_tables
from lawloom.plans.survey_gate import REQUIRED, regression, survey_checks, survey_metrics

AT = datetime.datetime(2029, 12, 20, 12)


def _tables(spark, **changed):
    long = "Malice aforethought is not presumed. " + "w " * 60
    blob = zlib.compress(("An act " + " ".join(map(str, range(80)))).encode())
    rows = {
        "codes": ("code string, title string", [("BRG", "Bridges Code")] * 30),
        "meta": ("key string, value string", [(k, "2029-12-20 12:00:00") for k in REQUIRED]),
        "law_section": ("id string, law_code string, section_num_norm string, content_text string, trans_update timestamp", [("1", "PEN", "187", long, AT), ("2", "PEN", "187", long, AT), ("3", "CONS", "Art. I, Sec. 1", "x", AT)]),
        "bill": ("bill_id string, trans_update timestamp", [("b1", AT), ("b2", AT)]),
        "bill_version": ("bill_version_id string, lob_file string, title_text string, trans_update timestamp", [(f"v{k}", "f", "An act to amend Section 1 of the Bridges Code, relating to bridges.", AT) for k in (1, 2, 3)] * 2),
        "bill_version_text": ("bill_version_id string, text_zlib binary", [(f"v{k}", blob) for k in (1, 2, 3)]),
        "bill_history": ("bill_id string, bill_history_id long, trans_update timestamp", [("b1", 1, AT)] * 2),
        "bill_section_ref": ("ref_id long, law_code string, section string, struct string", [(1, "CONS", "Art. I, Sec. 1", None)] * 2 + [(2, "BRG", "1", None)]),
        "bill_analysis": ("id string, trans_update timestamp", [("a", AT)]),
        "bill_version_authors": ("id string", [("a",)]),
        "analysis_text": ("id string", [("a",)]),
    }
    rows |= {name: (rows[name][0], body) for name, body in changed.items()}
    return {name: spark.createDataFrame(body, schema) for name, (schema, body) in rows.items() if body is not None}


def _outcome(spark, tables):
    spots = (("PEN", "187", "malice"),)
    floors = dict.fromkeys(("law_section", "bill", "bill_version", "bill_history"), 1)
    checked = gate(spark, survey_metrics(tables, F.lit("2030-01-01").cast("timestamp"), spots=spots), survey_checks(floors=floors, spots=spots, scoped=1, several=1))
    return {r.name: r for r in checked.collect()}


def test_all_checks_hold(spark):
    got = _outcome(spark, _tables(spark))
    assert {f"Q{k}" for k in range(1, 13)} == {name.split()[0] for name in got}
    assert [name for name, r in got.items() if not r.ok] == []
    assert got["Q2 bill_history rows"].value == 1 and got["Q2 bill_version rows"].value == 3 and got["Q12 law_extract_date"].value == 11


def test_each_check_can_fail(spark):
    title = "An act to amend Section 1 of the Bridges Code, relating to bridges."
    changed = {
        "meta": [(k, "") for k in REQUIRED],
        "law_section": [("1", "PEN", "187", "short", AT), ("2", "PEN", None, None, AT)],
        "bill": [(f"b{k}", AT) for k in range(5)],
        "bill_version": [("v1", "f", title, AT), ("v2", "f", "An act to amend Section 1 of the Nowhere Code.", AT), ("v3", "f", None, AT)],
        "bill_version_text": [("v1", zlib.compress(b"x" * 9)), ("v9", b"y" * 99)],
        "bill_section_ref": [(1, "CONS", "1", None)],
        "analysis_text": None,
    }
    got = _outcome(spark, _tables(spark, **changed))
    held = {name for name, r in got.items() if r.ok}
    assert held == {"Q2 law_section rows", "Q2 bill rows", "Q2 bill_version rows", "Q2 bill_history rows", "Q2 codes at least", "Q2 codes at most", "Q11 search rows"}
    assert got["Q8 version texts"].value == 0 and got["Q8 version texts"].needed == 0.99 * 3


def _compared(spark, now, previous):
    return {r.name: (r.level, r.ok) for r in regression(spark, now, previous).collect()}


def test_regression(spark):
    whole = _tables(spark, meta=None)
    same = _compared(spark, whole, whole)
    assert len(same) == 9 and set(same.values()) == {("fail", True)}
    earlier = AT - datetime.timedelta(days=1)
    worse = _tables(spark, meta=None, law_section=[("1", "PEN", "187", "x", earlier)], bill_version_text=None, bill_history=[])
    got = _compared(spark, worse, whole)
    assert {name for name, (level, ok) in got.items() if not ok} == {"law_section.rows", "law_extract.date", "bill_version_text.rows", "bill_history.rows"}
    assert _compared(spark, whole, worse)["bill_version_text.rows"] == ("warn", False)
    assert _compared(spark, whole, {}) == {"previous.readable": ("fail", False)}


def test_regression_agrees_with_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    for t in ("law_section", "bill", "bill_version", "bill_version_text", "bill_history", "bill_section_ref"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(f"SELECT name, level, ok, value, needed FROM ({ORACLE_SQL['q13_tables']}) ORDER BY name").fetchall()
    assert sorted(map(tuple, q13_tables(spark, data).collect())) == want
