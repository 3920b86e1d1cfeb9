"""Token ids against the tokenizer itself."""

import os
import random
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.llm.queries import TOKENIZER
from lawloom.llm.tokenizing import class_runs, decode, encode, split_pieces

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files here")
TEXTS = ["It's  we'll\n\n x '' 's's", "", None, "日本 naïve ½ 🙂", "<|endoftext|> a", "  \t ", "a" * 3000, "word " * 5000, "don't"]


@cache
def _tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


def _pieces(texts):
    """The tokenizer's own words, by their places in the texts."""
    split = _tokenizer().pre_tokenizer.pre_tokenize_str
    return [[t[a:b] for _, (a, b) in split(t)] for t in texts]


def _split(texts):
    words, first = split_pieces(texts, class_runs(TOKENIZER))
    return [words.slice(a, b - a).to_pylist() for a, b in zip(first, first[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\xa0'sdmtlvera1½!é日ᲉꟋ ", max_size=30), max_size=5))
def test_pieces_are_those_of_the_tokenizer(texts):
    assert _split(texts) == _pieces(texts)


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    random.Random(1).shuffle(points)
    texts = ["".join(points[k : k + 5000]) for k in range(0, len(points), 5000)]
    texts += [" ".join(("a" + c, "1" + c, "!" + c, c)) for c in points[:20_000]]
    assert _split(texts) == _pieces(texts)


def test_ids(spark):
    t = _tokenizer()
    rows = [(k, x, [1]) for k, x in enumerate(TEXTS)] + [(None, "x y", None), (0, TEXTS[0], None)]
    rows += [(100 + k, "".join(chr(c) for c in range(0x1C80 + 40 * k, 0x1CA8 + 40 * k)), None) for k in range(20)]
    got = encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>"), "doc_id", "text", TOKENIZER).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(k), t.encode(x or "", add_special_tokens=False).ids) for k, x, _ in rows)


def test_more_words_than_16_bits(spark):
    t = _tokenizer()
    text = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}" for k in range(70_000))
    got = encode(spark.createDataFrame([("x", text), ("y", text[:50])], "doc_id string, text string").coalesce(1), "doc_id", "text", TOKENIZER).collect()
    assert {r.doc_id: r.ids for r in got} == {"x": t.encode(text, add_special_tokens=False).ids, "y": t.encode(text[:50], add_special_tokens=False).ids}


def test_round_trip_and_empty(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id bigint, text string")
    ids = encode(df, "doc_id", "text", TOKENIZER)
    assert {r.doc_id: r.text for r in decode(ids, "doc_id", "ids", TOKENIZER).collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    assert encode(df.limit(0), "doc_id", "text", TOKENIZER).count() == 0
