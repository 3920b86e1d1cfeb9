"""Sources, published versions, tools and the command line."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lawloom.catalog import Catalog
from lawloom.cli import main
from lawloom.functions.blobs import pack
from lawloom.sources.artifacts import current, meta_of, publish, report
from lawloom.sources.bundles import ingest_sessions, read_members, with_blobs
from lawloom.sources.escaped import load_table, plain_fields
from lawloom.tools import Tools


def test_load_table(spark, tmp_path):
    (tmp_path / "A_TBL.dat").write_bytes("`x\\ty`\tNULL\n1\t2\t3\n`é`\t``\n".encode())
    rows, bad = load_table(spark, str(tmp_path / "A_TBL.dat"), ["a", "b"])
    assert [(r.a, r.b, r._row) for r in rows.orderBy("_row").collect()] == [("x\ty", None, 0), ("é", "", 2)]
    assert [(r._file, r._row, r._arity, r._fields) for r in bad.collect()] == [("A_TBL.dat", 1, 3, ["1", "2", "3"])]
    (tmp_path / "B_TBL.dat").write_bytes("1\t2\n".encode() * 25_000 + "é\t".encode("latin-1"))
    both, _ = load_table(spark, str(tmp_path / "*_TBL.dat"), ["a", "b"])
    assert {r._file: r.n for r in both.groupBy("_file").agg(F.count("*").alias("n")).collect()} == {"A_TBL.dat": 2, "B_TBL.dat": 25_001}
    with pytest.warns(UserWarning):
        rows, bad = load_table(spark, str(tmp_path / "none.dat"), ["a"])
    assert rows.count() == 0 and bad.count() == 0


def test_plain_fields(spark):
    df = spark.createDataFrame([("`a`\tNULL\t`NULL`\tb`c\t",)], "line string")
    assert df.select(plain_fields(df.line).alias("f")).first().f == ["a", None, "NULL", "b`c", ""]


def test_blobs(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", None)], "id string, lob_file string")
    stores = [spark.createDataFrame([("a", b"new")], "lob_file string, body binary"), spark.createDataFrame([("a", b"old"), ("b", b"full")], "lob_file string, body binary")]
    assert {r.id: r.body and bytes(r.body) for r in with_blobs(rows, "lob_file", stores).collect()} == {"1": b"new", "2": b"full", "3": None, "4": None}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a", b"x")
    got = {r.key: (r.body and bytes(r.body), r.error is None) for r in read_members(spark, rows.selectExpr("id key", "lob_file"), str(tmp_path / "z.zip")).collect()}
    assert got["1"] == (b"x", True) and got["2"] == (None, False) and got["4"][1] is False


def test_sessions_resume(spark, tmp_path):
    calls = []
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017
        ingest_sessions(spark, {"1999": lambda: None}, str(tmp_path / "t"), str(tmp_path / "broken"))

    def load(name, fail=False):
        def run():
            calls.append(name)
            if fail:
                raise ValueError(name)
            return spark.createDataFrame([(name,)], "v string")

        return run

    out, done = str(tmp_path / "t"), str(tmp_path / "done")
    assert ingest_sessions(spark, {"1999": load("a"), "2001": load("b", True)}, out, done) == {"1999": "done", "2001": "failed: ValueError"}
    assert ingest_sessions(spark, {"1999": load("a"), "2001": load("b")}, out, done) == {"1999": "skipped", "2001": "done"}
    assert calls == ["a", "b", "b"] and {(r.v, r.session) for r in spark.read.parquet(out).collect()} == {("a", 1999), ("b", 2001)}


def test_publish(spark, tmp_path):
    root = str(tmp_path / "store")
    publish({"t": spark.createDataFrame([(1,)], "a int")}, root, {"session_year": "20232024"}, "v1")
    publish({"t": spark.createDataFrame([(2,)], "a int")}, root, {}, "v2")
    assert current(spark, root).endswith("/v2") and spark.read.parquet(current(spark, root) + "/t.parquet").first().a == 2
    assert meta_of(spark, f"{root}/v1") == {"session_year": "20232024"}
    broken = spark.createDataFrame([("x",)], "a string").selectExpr("cast(a as int) a")
    with pytest.raises(Exception):  # noqa: B017
        publish({"t": broken}, root, {}, "v3")
    assert current(spark, root).endswith("/v2") and not (tmp_path / "store/v3").exists()
    assert json.loads(report({"a": 1}, at=dt.date(2024, 1, 1))) == {"a": 1, "at": "2024-01-01"}


@pytest.fixture(scope="module")
def tools(spark):
    t = lambda m, d: dt.datetime(2023, m, d)
    act = "An act.\nThe people of the Province do enact as follows:\nSECTION 1. Section 12 of the Bridges Code{lineage} is amended to read:\n12. {body}"
    bills = [("202320240AB1", "20232024", "0", "AB", "1", "Chaptered", "2023", "CHP", "0", "5", "v1b", "Signed"), ("202320240AB2", "20232024", "0", "AB", "2", "Introduced", None, None, None, None, "v2", "Open"), ("202120220SB3", "20212022", "0", "SB", "3", "Chaptered", "2021", "CHP", "0", "9", "v3", "Signed")]
    bill_columns = "bill_id string, session_year string, session_num string, measure_type string, measure_num string, measure_state string, chapter_year string, chapter_type string, chapter_session_num string, chapter_num string, latest_bill_version_id string, current_status string, current_location string, current_house string, trans_update timestamp, active_flg string, trans_uid string"
    versions = [("v1a", "202320240AB1", "99", t(1, 1), "Introduced", "s"), ("v1b", "202320240AB1", "95", t(9, 1), "Chaptered", "s"), ("v2", "202320240AB2", "99", t(2, 1), "Introduced", "s"), ("v3", "202120220SB3", "95", dt.datetime(2021, 9, 1), "Chaptered", "s")]
    texts = [("v1a", pack(act.format(lineage="", body="Draft text of the bridge."))), ("v1b", pack(act.format(lineage=", as amended by Section 1 of Chapter 9 of the Statutes of 2021,", body="(a) The dealer must file."))), ("v2", b"broken"), ("v3", pack(act.format(lineage="", body="(a) The dealer shall file.")))]
    refs = [(1, "20232024", "v1b", "202320240AB1", "amend", "BRG", "12", "0", None, None), (2, "20232024", "v1a", "202320240AB1", "add", "BRG", "12", "0", None, None), (3, "20232024", "v2", "202320240AB2", "add", "BRG", "10", "1", "20", None), (4, "20212022", "v3", "202120220SB3", "amend", "BRG", "12", "0", None, None)]
    law = [("i1", "BRG", "12.", "12", "Amended by Stats. 2023, Ch. 5, Sec. 1. (AB 1)", "2023", "5", None, "(a) The dealer must file.", "Y", t(10, 1)), ("i2", "BRG", "13.", "13", "Added by Stats. 1950, Ch. 1.", "1950", "1", None, "Other bridge text.", "Y", t(10, 1))]
    make = spark.createDataFrame
    tables = {
        "codes": make([("BRG", "Bridges Code - BRG")], "code string, title string"),
        "bill": make([(*b, None, None, None, "Y", None) for b in bills], bill_columns),
        "bill_version": make([(*v, None) for v in versions], "bill_version_id string, bill_id string, version_num string, action_date timestamp, action string, subject string, title_text string"),
        "bill_version_text": make(texts, "bill_version_id string, text_zlib binary"),
        "bill_section_ref": make(refs, "ref_id int, session_year string, bill_version_id string, bill_id string, action string, law_code string, section string, is_range string, range_end string, struct string"),
        "bill_history": make([("202320240AB1", 2, t(2, 1), "b", "2"), ("202320240AB1", 1, t(1, 1), "a", "1")], "bill_id string, bill_history_id int, action_date timestamp, action string, action_sequence string"),
        "law_section": make(law, "id string, law_code string, section_num string, section_num_norm string, history string, op_statutes string, op_chapter string, effective_date timestamp, content_text string, active_flg string, trans_update timestamp"),
        "bill_analysis": make([("a1", "202320240AB1", "L", "floor", "C", "Com", "2023-05-01", None)], "analysis_id string, bill_id string, house string, analysis_type string, committee_code string, committee_name string, analysis_date string, amendment_date string"),
        "analysis_text": make([("a1", "text", pack("An analysis."))], "analysis_id string, format string, text_zlib binary"),
    }
    return Tools(Catalog(spark, tables, meta={"session_year": "20232024", "law_extract_date": "2023-10-02"}, pending=frozenset({"Open"})))


def test_section_tools(tools):
    got = tools.get_section("bridges code", "§ 12(a)")
    assert got["current_session"] == "2023-2024" and got["versions"][0]["operative_citation"] == "Stats. 2023, Ch. 5" and got["code_name"] == "Bridges Code"
    assert tools.get_section("bridges", "1")["suggestions"] == ["12", "13"] and "suggestions" in tools.get_section("zzz", "1")
    assert [r["section"] for r in tools.search_sections("bridge")["results"]] == ["13"]
    assert ">>dealer<<" in tools.search_sections("dealer file", "BRG")["results"][0]["snippet"]
    assert tools.search_sections("absent")["results"] == [] and "error" in tools.search_sections(" ")
    hit = tools.bills_affecting_section("BRG", "12")
    assert [(b["measure"], b["pending"], [r["match"] for r in b["references"]]) for b in hit["bills"]] == [("AB 2", True, ["range"]), ("AB 1", False, ["direct"]), ("SB 3", False, ["direct"])]
    assert tools.bills_affecting_section("BRG", "999")["bills"] == []


def test_published_index(spark, tools, tmp_path):
    root = str(tmp_path / "indexed")
    toc = spark.createDataFrame([("BRG", "Bridges", "1"), ("BRG", "Dealers", "1.1"), ("BRG", "", "1.1.1")], "law_code string, heading string, node_treepath string")
    place = spark.createDataFrame([("BRG", "12.", "1.1.1"), ("BRG", "13.", "1")], "law_code string, section_num string, node_treepath string")
    tables = {**tools.c.now._tables, "law_toc": toc, "law_toc_sections": place}
    publish(tables, root, {"session_year": "20232024"}, "v1", indexes={"law_section": ("id", "content_text")})
    stored = Tools(Catalog.published(spark, root, pending=frozenset({"Open"})))
    assert stored.c.now.index("law_section") and not stored.c.now.index("bill")
    for query in ("dealer file", "bridge*", '"other bridge" OR dealer', "text NOT dealer"):
        want, got = tools.search_sections(query)["results"], stored.search_sections(query)["results"]
        assert [{**r, "heading": None} for r in got] == want and want
    assert stored.search_sections("dealer OR bridge")["results"][0]["heading"] in ("Dealers", "Bridges")
    assert {r["section"]: r["heading"] for r in stored.search_sections("dealer OR bridge")["results"]} == {"12": "Dealers", "13": "Bridges"}
    assert stored.get_section("bridges code", "12")["hierarchy"] == ["Bridges", "Dealers"]


def test_bill_tools(tools):
    bill = tools.get_bill("AB 1")["bill"]
    assert [h["action"] for h in bill["history"]] == ["a", "b"] and [v["version_id"] for v in bill["versions"]] == ["v1b", "v1a"] and bill["chapter"] == "Stats. 2023, Ch. 5"
    assert bill["sections_affected"] == [{"action": "amend", "code": "BRG", "section": "12"}] and bill["analyses"][0]["has_text"]
    assert "error" in tools.get_bill("AB 9") and "error" in tools.get_bill("??") and "error" in tools.get_bill("AB 1", "1700")
    assert tools.get_bill_analyses(analysis_id="a1")["text"] == "An analysis." and "error" in tools.get_bill_analyses(analysis_id="zz")
    assert tools.chapter_to_bill(2023, 5)["bill"]["measure"] == "AB 1" and "error" in tools.chapter_to_bill(2023, 77) and "coverage" in tools.chapter_to_bill(1950, 1)
    assert "The dealer must file." in tools.get_bill_text("AB 1")["text"]
    assert tools.get_bill_text("AB 1", section_filter="Section 12 of the Bridges Code")["blocks"][0]["body"] == "(a) The dealer must file."
    assert tools.get_bill_text("AB 1", version="introduced")["version"]["version_id"] == "v1a" and "available_versions" in tools.get_bill_text("AB 1", version="zzz")
    assert "error" in tools.get_bill_text("AB 2")
    made = tools.compare_bill_versions("AB 1")
    assert made["from"]["version_id"] == "v1a" and not made["identical"] and made["title_and_digest"] == {"identical": True} and "redline_markdown" in made["body"]
    assert "error" in tools.compare_bill_versions("AB 2")


def test_lineage_tools(tools):
    history = tools.get_legislative_history("BRG", "12")
    assert [(e["resolution"], e["bill"]["measure"]) for e in history["events"]] == [("resolved", "AB 1")] and [b["measure"] for b in history["enacted_bills_citing_section"]] == ["AB 1", "SB 3"]
    assert tools.get_legislative_history("BRG", "13")["events"][0]["resolution"] == "predates_electronic_records"
    made = tools.compare_section_versions("BRG", "12", "Stats. 2021, Ch. 9")
    assert made["redline_markdown"] == "(a) The dealer ~~shall~~ *must* file."
    prior = tools.compare_section_versions("BRG", "12")
    assert prior["from"]["label"] == "Stats. 2021, Ch. 9" and prior["changes"][0]["added"] == "must"
    assert tools.compare_section_versions("BRG", "12", "AB 1")["identical"] and "no_prior_version" in tools.compare_section_versions("BRG", "13")
    assert "error" in tools.compare_section_versions("BRG", "12", "what?")
    assert tools.health()["law_extract_date"] == "2023-10-02"


def test_command_line(spark, tmp_path, capsys, data):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/CODES_TBL.dat").write_text("`BRG`\t`Bridges Code`\nbad\n")
    (tmp_path / "layout.json").write_text(json.dumps({"codes": ["code", "title"]}))
    assert main(["build", "--source", str(tmp_path / "in"), "--layout", str(tmp_path / "layout.json"), "--out", str(tmp_path / "out"), "--meta", '{"session_year": "20232024"}'], spark) == 0
    assert json.loads(capsys.readouterr().out)["bad_rows"] == {"codes": 1}
    assert main(["ask", "--root", str(tmp_path / "out"), "health"], spark) == 0
    assert main(["ask", "--root", str(tmp_path / "out"), "nothing"], spark) == 2
    assert main(["sanity", "--tables", data], spark) in (0, 1)
    (tmp_path / "s/1999").mkdir(parents=True)
    (tmp_path / "s/1999/T_TBL.dat").write_text("1\n")
    assert main(["build-archive", "--source", str(tmp_path / "s"), "--table", "t", "--columns", "a", "--out", str(tmp_path / "arc")], spark) == 0
