"""Near-duplicate pairs against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest

from lawloom.llm.near_duplicates import BANDS, key_pairs, near_duplicates, segments, signatures, traverse

SCHEMA = "tbl string, key string, body binary, packed boolean, digest int"
PHRASE = "it is hereby declared that this provision serves the public interest of the province"


def _corpus():
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"z{rng.randint(0, 50)}"
        rows.append(("bill_version_text", f"k{k}", " ".join(words).encode(), False, 1))
    rows += [("bill_version_text", f"c{k}", " ".join(base).encode(), False, 1) for k in range(30)]
    rows += [("bill_version_text", f"r{k}", " ".join(rng.sample(base, 60)).encode(), False, 1) for k in range(60)]
    for k in range(120):  # one phrase in very many short texts, some of them alike
        own = random.Random(k // 3)
        words = [f"v{own.randint(0, 10_000)}" for _ in range(own.randint(4, 20))]
        rows.append(("bill_version_text", f"p{k}", " ".join([*words[: k % 3 + 3], PHRASE, *words[3:]]).encode(), False, 1))
    for k in range(40):  # texts within longer ones
        rows.append(("bill_version_text", f"s{k}", " ".join([*base[: 30 + 2 * k], *(f"y{k}{j}" for j in range(k % 7))]).encode(), False, 1))
    rows += [("law_version_text", *r[1:]) for r in rows[:40]]
    return rows + [("bill_version_text", "n", None, False, 1), ("bill_version_text", None, b"a b c d e f", False, 1), ("bill_version_text", "e", b"", False, 1), ("bill_version_text", "z", b"not packed", True, 1), rows[0]]


def _brute(rows, words, t):
    sets = {}
    for tbl, key, body, packed, _ in rows:
        if key and body and not packed:
            w = body.decode().split()
            sets[tbl, key] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    keys = sorted(k for k in sets if sets[k])
    t = Fraction(t)
    return {(*a, b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) * t.denominator >= t.numerator * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("threshold", "words", "run_limit"), [("0.3", 3, 8), ("0.5", 5, 8), ("0.5", 3, 256), ("0.6", 3, 8), ("0.8", 5, 8), ("0.8", 3, 256), ("0.95", 3, 8), ("1", 5, 8)])
def test_pairs(spark, threshold, words, run_limit):
    rows = _corpus()
    want = _brute(rows, words, threshold)
    links, members = near_duplicates(spark.createDataFrame(rows, SCHEMA), threshold=float(threshold), words=words, run_limit=run_limit)
    got = [tuple(r) for r in key_pairs(links, members).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 400


def test_empty(spark):
    links, members = near_duplicates(spark.createDataFrame([], SCHEMA))
    assert key_pairs(links, members).count() == 0
    for bad in ({"threshold": 0.0}, {"threshold": 1.1}, {"words": 0}):
        with pytest.raises(ValueError):
            near_duplicates(spark.createDataFrame([], SCHEMA), **bad)


@pytest.mark.parametrize("t", ["0.3", "0.5", "0.7", "0.8", "0.95"])
@pytest.mark.parametrize("n", [3, 8, 20, 60, 150, 700, 2500])
def test_sets_at_the_threshold_meet(n, t):
    rng = np.random.default_rng(n)
    t = Fraction(t)
    parts = [segments(band, t) for band in range(BANDS)]
    for _ in range(60):
        m = int(np.ceil(n * rng.uniform(float(t), 1)))
        need = -(-t.numerator * (n + m) // (t.numerator + t.denominator))
        if need > min(n, m):
            continue
        pool = rng.integers(0, 2**64, size=n + m - need, dtype=np.uint64)
        assert len(np.intersect1d(signatures(np.unique(pool[:m]), t, parts), signatures(np.unique(pool[m - need :]), t, parts)))


def test_traversal_keeps_what_can_match():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2**63, size=(50, 16), dtype=np.int64)
    bits[25:] = bits[:25]
    sizes = np.full(50, 600)
    i, j = traverse(np.repeat([0, 1], [25, 25]), bits, sizes, np.zeros(50, int), Fraction(4, 5))
    assert all((a < 25) == (b < 25) for a, b in zip(i, j))
    i, j = traverse(np.zeros(50, int), bits, sizes, np.zeros(50, int), Fraction(4, 5))
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} >= {(k, k + 25) for k in range(25)}


def test_small_sets_always_meet():
    rng = np.random.default_rng(5)
    t = Fraction(4, 5)
    parts = [segments(band, t) for band in range(BANDS)]
    for a, b in ((4, 5), (5, 6), (8, 10), (16, 17), (16, 20)):
        for runs in rng.integers(0, 2**64, size=(20_000, b), dtype=np.uint64):
            assert set(signatures(np.sort(runs[:a]), t, parts).tolist()) & set(signatures(np.sort(runs), t, parts).tolist())


@pytest.mark.parametrize("other", ["x y", " ".join(f"o{k}" for k in range(90))])
def test_key_with_two_texts(spark, other):
    one = " ".join(f"w{k}" for k in range(90))
    for texts in ((one, other), (other, one)):
        rows = [("t", "a", body.encode(), False, 1) for body in texts] + [("t", "b", (one + " end").encode(), False, 1)]
        links, members = near_duplicates(spark.createDataFrame(rows, SCHEMA).coalesce(1))
        assert [tuple(r) for r in key_pairs(links, members).collect()] == [("t", "a", "b")]
