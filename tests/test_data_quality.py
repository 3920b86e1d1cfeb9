"""Packed values, snapshot changes, failing lines and broken references."""

import datetime as dt

import pytest

from lawloom.operators.packed import unpack_values
from lawloom.operators.references import broken_references, normal_key, validity
from lawloom.operators.rejects import LAYOUTS, loaded, parse_lines, rejected
from lawloom.operators.snapshots import snapshot_changes

A, B, C = "Added by Stats. 1941, Ch. 5, Sec. 4.", "Repealed November 8, 1969, by Prop. 62; Res.Ch. 29, 1968.", "Amended (as added by Stats. 1977, Ch. 535, Sec. 17) by Stats. 1980, Ch. 1, Sec. 2; operative June 1, 1999."


@pytest.mark.parametrize(
    ("field", "values"),
    [
        (f"{A}; {B}", [A, B]),
        (f'"{A}", "{B}"', [A, B]),
        (f"“{A}”;; “{C}”", [A, C]),
        (f"`{A}`; ; {C};", [A, C]),
        (f"'{A}' | '{B}' |", [A, B]),
        (f"~ {A} ~ {A}", [A, A]),
        (f'"{A[:-1]} See ""old well"" in Sec. 3."\n"{B}"', [A[:-1] + ' See "old well" in Sec. 3.', B]),
        (f'{A} See "old well" in Sec. 3. • {B}', [A + ' See "old well" in Sec. 3.', B]),
        (f"{A} Inoperative | repealed by its own terms. // {C}", [A + " Inoperative | repealed by its own terms.", C]),
        (f"{C}\t{B}\t", [C, B]),
        (f"## Heading amended, and section renumbered, by Stats. 1962, Ch. 1, Sec. 9. ## {A}", ["Heading amended, and section renumbered, by Stats. 1962, Ch. 1, Sec. 9.", A]),
        (C, [C]),
        ("", []),
        ("  ;; ", []),
        ("no citation here", []),
        (None, []),
    ],
)
def test_values_of_a_field(spark, field, values):
    df = spark.createDataFrame([("a", field, "x")], "id string, history string, value string")
    rows = sorted(unpack_values(df, "id", "history").collect(), key=lambda r: r.pos)
    assert [r.value for r in rows] == values
    assert [r.pos for r in rows] == list(range(1, len(values) + 1))


def test_values_of_rows(spark):
    schema = "id string, history string, pos int"
    many = "; ".join([A] * 2000)
    df = spark.createDataFrame([("a", f"{A}; {B}", 7), ("a", f"{A}; {B}", 7), (None, A, None), ("long", many, 1)], schema)
    rows = unpack_values(df, "id", "history").collect()
    assert sum(r.id == "a" for r in rows) == 4 and sum(r.id is None for r in rows) == 1
    assert sum(r.id == "long" for r in rows) == 2000
    assert unpack_values(spark.createDataFrame([], schema), "id", "history").count() == 0


SNAP = "snap string, id string, at timestamp, text string, other string, change string"


def test_snapshot_changes(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    rows = [
        ("2025-01", "same", t(1), "x", "1", None), ("2025-02", "same", t(2), "x", "2", None),
        ("2025-01", "gone", t(1), "x", "1", None), ("2025-01", "null", t(1), None, "1", None), ("2025-02", "null", t(2), None, "1", None),
        ("2025-01", "new null", t(1), "x", "1", None), ("2025-02", "new null", t(2), None, "1", None),
        ("2025-02", "added", t(2), "", "1", None), ("2025-02", "added", t(2), "", "1", None),
        ("2025-01", "replaced", t(1), "a", "1", None), ("2025-01", "replaced", t(9), "b", "1", None), ("2025-02", "replaced", t(2), "b", "1", None),
        ("2025-02", None, t(2), "x", "1", None), (None, "x", t(2), "x", "1", None), ("2025-04", "same", t(3), "x ", "1", None),
    ]
    got = {(r.id, r.snap, r.change) for r in snapshot_changes(spark.createDataFrame(rows, SNAP), "snap", "id", "at", ["text"], leaf_rows=1).collect()}
    later = {(k, "2025-04", "removed") for k in ("null", "new null", "added", "replaced")}
    assert got == {("gone", "2025-02", "removed"), ("new null", "2025-02", "changed"), ("added", "2025-02", "added"), ("same", "2025-04", "changed")} | later
    assert snapshot_changes(spark.createDataFrame([], SNAP), "snap", "id", "at", ["text"]).count() == 0
    assert snapshot_changes(spark.createDataFrame(rows[:1], SNAP), "snap", "id", "at", ["text"]).count() == 0


def test_snapshot_changes_deep(spark):
    """Many keys, so that the tree has several levels; against a plain comparison."""
    rows = [(s, f"k{i}", None, f"{i}" if i % 97 else f"{i} {s}", None, None) for s in ("1", "2", "3") for i in range(3000) if not (s == "2" and i % 501 == 0)]
    got = {(r.id, r.snap, r.change) for r in snapshot_changes(spark.createDataFrame(rows, SNAP), "snap", "id", "at", ["text"], leaf_rows=2).collect()}
    texts = {s: {r[1]: r[3] for r in rows if r[0] == s} for s in "123"}
    want = set()
    for a, b in ("12", "23"):
        for k in texts[a].keys() | texts[b].keys():
            x, y = texts[a].get(k), texts[b].get(k)
            if x != y:
                want.add((k, b, "added" if x is None else "removed" if y is None else "changed"))
    assert got == want


GOOD = "`b1`\t12\t2020-02-29 00:00:00\t`done`\tNULL\t2020-01-01 23:59:59\t3\t``\t\\N\tNULL\tNULL\tNULL\tNULL"


def _line(at, value):
    fields = GOOD.split("\t")
    fields[at] = value
    return "\t".join(fields)


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (GOOD, None),
        (GOOD + "\r", None),
        (GOOD + "\t", "column_count"),
        ("", "column_count"),
        (None, "column_count"),
        (_line(3, "`a\\\tb`"), None),
        (_line(3, "`a`b`c`"), None),
        (_line(3, "a`b"), "quoting"),
        (_line(3, "`open"), "quoting"),
        (_line(3, "`open\\`"), "quoting"),
        (_line(3, "`open\\\\`"), None),
        (_line(3, "`"), "quoting"),
        (_line(3, "a\\`b"), None),
        (_line(3, "``"), "value"),
        (_line(3, "` `"), "value"),
        (_line(3, "NULL"), "value"),
        (_line(3, "`NULL`"), None),
        (_line(3, "`a\rb`"), "value"),
        (_line(3, "`a\\\rb`"), None),
        (_line(1, "12a"), "value"),
        (_line(1, "-1"), "value"),
        (_line(6, "\\N"), "value"),
        (_line(2, "2021-02-29 00:00:00"), "value"),
        (_line(2, "2020-02-29 24:00:00"), "value"),
        (_line(2, "2020-02-29"), "value"),
        (_line(5, "NULL"), "value"),
        ("x" * 100_000, "column_count"),
    ],
)
def test_history_lines(spark, line, reason):
    df = spark.createDataFrame([(1, "BILL_HISTORY_TBL.dat", line, "x")], "raw_id bigint, file_name string, line string, reason string")
    assert [r.reason for r in parse_lines(df, "raw_id", "file_name", "line").collect()] == [reason]


def test_section_lines(spark):
    good = "\t".join(["`i`", "`AA`", "`1.`", "`1999`", "`1`", "`2`", "NULL", "`v`", *["NULL"] * 5, "`note`", "x.lob", "`Y`", "NULL", "2020-01-01 00:00:00"])
    bad = [good.replace("`1999`", "`199`"), good.replace("`Y`", "`y`"), good.replace("NULL\t`v`", "`soon`\t`v`")]
    lines = [good, good.replace("`1999`", "\\N"), *bad]
    df = spark.createDataFrame([(k, "LAW_SECTION_TBL.dat", x) for k, x in enumerate(lines)] + [(9, "OTHER.dat", good), (10, None, good)], "raw_id int, file_name string, line string")
    parsed = parse_lines(df, "raw_id", "file_name", "line")
    assert {r.raw_id: r.reason for r in rejected(parsed, "raw_id").collect()} == {2: "value", 3: "value", 4: "value", 9: "unknown_file", 10: "unknown_file"}
    assert {r.raw_id: r.detail for r in rejected(parsed, "raw_id").collect()} == {2: "op_statutes: not a year or null", 3: "active_flg: not a flag", 4: "effective_date: not a time or null", 9: "OTHER.dat", 10: "no file name"}
    rows = {r.raw_id: r for r in loaded(parsed, "raw_id", "file_name", "LAW_SECTION_TBL.dat").collect()}
    assert set(rows) == {0, 1} and rows[0].op_statutes == "1999" and rows[1].op_statutes is None and rows[0].history == "note"
    assert loaded(parsed, "raw_id", "file_name", "LAW_SECTION_TBL.dat").columns == ["raw_id", *LAYOUTS["LAW_SECTION_TBL.dat"].columns]
    assert parse_lines(df.limit(0), "raw_id", "file_name", "line").count() == 0


def test_broken_references(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    parents = spark.createDataFrame(
        [("K1", "Y", t(1)), ("k1", "Y", t(9)), ("K2", "N", t(1)), ("K2", None, t(1)), ("K3", "Y", t(5)), ("K3", "N", t(1)), (None, "Y", t(1)), ("K4", "Y", None)], "key string, flag string, since timestamp"
    )
    refs = spark.createDataFrame(
        [(1, " k1. ", t(2)), (2, "K2", t(2)), (3, "k3", t(4)), (4, "K3..", t(5)), (5, "none", t(2)), (6, None, t(2)), (7, "K4", t(1)), (8, "K3", None), (5, "none", t(2))], "id int, key string, at timestamp"
    )
    known = validity(parents, ["key"], parents["flag"] == "Y", "since")
    got = sorted((r.id, r.reason) for r in broken_references(refs, ["key"], known).collect())
    assert got == [(2, "deleted"), (3, "late"), (5, "missing"), (5, "missing")]
    assert sorted((r.id, r.reason) for r in broken_references(refs, ["key"], known, small=True).collect()) == got
    spans = {r.k0: (r.valid_from, r.valid_to, r.open) for r in validity(parents, ["key"], parents["flag"] == "Y", "since", "since").collect()}
    assert spans == {"K1": (t(1), None, True), "K2": (t(1), t(1), False), "K3": (t(5), None, True), "K4": (None, None, True)}
    assert broken_references(refs.limit(0), ["key"], known).count() == 0
    assert {r.reason for r in broken_references(refs, ["key"], known.limit(0)).collect()} == {"missing"}


def test_normal_key(spark):
    df = spark.createDataFrame([(" a.1. .",), ("",), (None,)], "k string")
    assert [r.n for r in df.select(normal_key(df.k).alias("n")).collect()] == ["A.1", "", None]
