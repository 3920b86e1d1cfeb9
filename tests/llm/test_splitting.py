"""Oversized texts."""

import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.llm.splitting import cuts, split_oversized


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n()1é\r", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    found = cuts(text, limit, overlap)
    assert "".join(text[a if k == 0 else a + overlap : b] for k, (a, b, _) in enumerate(found)) == text
    assert all(b - a <= limit for a, b, _ in found)
    assert all(found[k + 1][0] == found[k][1] - overlap for k in range(len(found) - 1))
    assert (len(found) > 1) == (len(text) > limit)


def test_strong_boundaries_come_first():
    text = "x" * 60 + ".\nSECTION 2. " + "y" * 20 + ". (a) " + "z" * 50
    assert cuts(text, 100, 5)[0][1:] == (62, "section")
    assert cuts("a" * 50, 20, 5)[0][2] == "hard"
    assert cuts("aaaa bbbb cccc", 10, 2)[0][1:] == (10, "word")
    assert cuts("word. " * 10, 20, 2)[0][2] == "sentence"


def test_split_oversized(spark):
    z = lambda t: zlib.compress(t.encode())
    rows = [("a", z("w " * 9000), 1), ("exact", z("x" * 8000), 1), ("over", z("x" * 8001), 1), ("null", None, 1), ("cut", z("y" * 9000)[:-3], 1), ("raw", b"plain", 1), ("none", b"", 1), ("empty", z(""), 1), (None, z("é" * 8001), 1)]
    df = spark.createDataFrame([*rows, rows[2]], "id string, body binary, pos int")
    got = split_oversized(df, "id", "body", packed=True).collect()
    assert {r.id: r.pieces for r in got} == {"a": 3, "exact": 1, "over": 2, None: 2}
    assert sum(r.id == "over" for r in got) == 4
    a = sorted((r for r in got if r.id == "a"), key=lambda r: r.pos)
    assert [r.pos for r in a] == [1, 2, 3] and a[1].piece[:400] == a[0].piece[-400:] and all(len(r.piece) <= 8000 for r in a)
    assert split_oversized(df.limit(0), "id", "body", packed=True).count() == 0
