"""Text in one form."""

import pytest

from lawloom.llm.lookalikes import Union, unify

SCHEMA = "doc_id bigint, text string, mixed int"


def test_union_is_transitive():
    u = Union()
    u.join("a", "b")
    u.join("c", "b")
    assert u.classes() == [["a", "b", "c"]]


@pytest.mark.parametrize(
    ("text", "form", "case"),
    [
        ("plain", "plain", False),
        ("café “x” — naïve", "café “x” — naïve", False),
        ("слово και λόγος", "слово και λόγος", False),
        ("ｆｅｅ！", "fee!", True),
        ("café", "café", True),
        ("ế", "ế", True),
        ("a​b­c﻿", "abc", True),
        ("a b　c", "a b c", True),
        ("сode", "code", True),
        ("Тhe tеn", "The ten", True),
        ("Wιthιn", "Within", True),
        ("слoво", "слово", True),
        ("日本　x", "日本 x", True),
        ("x̶", "x̶", True),
        ("𝐜𝐨𝐝𝐞 ﬃ ｱ", "code ﬃ ア", False),
        ("Ａ\u030a x", "Å x", True),
        ("zж", "zж", True),
        ("xж", "хж", True),
        ("", "", False),
        (None, None, False),
    ],
)
def test_forms(spark, text, form, case):
    base = "the code of the ten within the fee " * 20 + " слово слово вода кот ア ア"
    rows = [(1, text, 9), (2, base, 9)]
    got = {r.doc_id: r for r in unify(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()}
    assert got[1].text == form and (got[1].rewritten + got[1].kept > 0) == case and got[2].text == base


def test_rows(spark):
    rows = [(None, "ａ", 1), (1, "b", 1), (1, "b", 1), (2, "x​" * 50_000, 1)]
    got = unify(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()
    assert sorted((str(r.doc_id), len(r.text), r.rewritten) for r in got) == [("1", 1, 0), ("1", 1, 0), ("2", 50_000, 50_000), ("None", 1, 1)]
    assert unify(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0
