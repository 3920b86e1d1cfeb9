"""Redlines that are refused are counted as such."""

from lawloom.operators.text import change_counts, redlines


def test_refused_pairs_keep_a_row(spark):
    pairs = spark.createDataFrame([(1, "a b", "a b"), (2, "a b", "a c"), (3, "x" * 60_000, "y" * 60_000)], "id int, old string, new string")
    got = {r.id: (r.kind, r.n, r.chars, r.reason) for r in change_counts(redlines(pairs, ["id"], "old", "new"), ["id"], refused=True).collect()}
    assert got == {2: ("edit", 1, 2, None), 3: ("refused", 1, None, "the texts differ almost throughout")}
