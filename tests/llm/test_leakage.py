"""Leaked passages against brute force."""

import random
import re

from lawloom.functions.textvec import split_words
from lawloom.llm.leakage import BLOCK_CHARS, _dump, compile_patterns, leaked, search

WORD = re.compile(r"[^\W_]+")
TEXTS, ITEMS = "doc_id bigint, text string, item_id int", "item_id bigint, text string, doc_id int"


def _runs(text, n):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_against_brute_force(spark):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["Ab", "c", "d-e", "É"]) for _ in range(n))
    items = [(k, some(12), 0) for k in range(8)] + [(8, None, 0), (9, "", 0), (10, "short", 0), (None, some(12), 0)]
    items.append((11, items[0][1], 0))
    texts = [(k, some(60), 0) for k in range(40)] + [(40, None, 0), (41, "", 0), (42, some(20_000), 0), (0, some(40), 0), (None, items[0][1], 0)]
    want = {(d, i) for d, t, _ in texts for i, x, _ in items if i is not None and _runs(t, 4) & _runs(x, 4)}
    for limit in (BLOCK_CHARS, 40):
        got = leaked(spark.createDataFrame(texts, TEXTS), "doc_id", "text", spark.createDataFrame(items, ITEMS), "item_id", "text", run=4, block_limit=limit).collect()
        assert len(got) == len(set(got)) and {(r.doc_id, r.item_id) for r in got} == want


def test_empty(spark):
    texts, items = spark.createDataFrame([], TEXTS), spark.createDataFrame([], ITEMS)
    assert leaked(texts, "doc_id", "text", items, "item_id", "text").count() == 0
    some = spark.createDataFrame([(1, "a b c " * 9, 1)], ITEMS)
    assert leaked(texts, "doc_id", "text", some, "item_id", "text").count() == 0


def test_tables_of_a_full_block_are_small():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(50_000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=300))) for k in range(BLOCK_CHARS // 1_900)]
    p = compile_patterns(items, 13)
    assert len(_dump(p)) < 64_000_000
    text, item = search(split_words(["x " + items[7][1][500:900], "none of it", items[-1][1]]), p)
    assert [*zip(text.tolist(), item.tolist())] == [(0, 7), (2, len(items) - 1)]
