"""Token ids of a whole corpus by a byte-level BPE of a public tokenizer, and back.

Texts are split into the tokenizer's words in Spark, each distinct word is encoded once, and the
ids are joined back by position.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.plans.durable import cut

SPACE, LETTER, NUMBER, OTHER = range(4)
_CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
CHUNK_DOCS, CHUNK_CHARS = 2048, 4_000_000  # a chunk holds no more than one batch


class Classes(NamedTuple):
    """Classes of code points as runs: from ``start[k]`` on they have the class ``kind[k]``."""

    start: np.ndarray
    kind: np.ndarray

    def table(self) -> np.ndarray:
        return np.repeat(self.kind, np.diff(np.append(self.start, 0x110000)))


@lru_cache(maxsize=4)
def classes(path: str) -> Classes:
    """The classes that the tokenizer itself splits by, whichever Unicode version it was built on.

    Its splitter is asked once for all code points in order, of which each piece has one class, and
    for one code point of each piece: what it joins with is its class.
    """
    split = _tokenizer(path).pre_tokenizer.pre_tokenize_str
    joins = lambda before, c: len(split(before + c)) == 1
    start, kind = [], []
    for low, high in ((0, 0x20), (0x20, 0x21), (0x21, 0xD800), (0xE000, 0x110000)):
        for _, (at, _) in split("".join(map(chr, range(low, high)))):
            c = chr(low + at)
            start.append(low + at)
            kind.append(LETTER if joins("a", c) else NUMBER if joins("1", c) else OTHER if joins("!", c) else SPACE)
    return Classes(np.array(start), np.array(kind, np.uint8))


@lru_cache(maxsize=4)
def _table(runs: bytes) -> np.ndarray:
    start, kind = np.frombuffer(runs, np.int64).reshape(2, -1)
    return Classes(start, kind.astype(np.uint8)).table()


def class_runs(path: str) -> bytes:
    """:func:`classes` as bytes, for tasks."""
    return np.stack([classes(path).start, classes(path).kind.astype(np.int64)]).tobytes()


def split_pieces(texts: list[str | None], runs: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The tokenizer's words of all texts in order, and the first word of each text.

    ``runs`` are the tokenizer's classes of code points, by :func:`class_runs`.

    The words are those of the pattern of byte-level BPE: a contraction; letters, digits or other
    characters with at most one blank before them; white space, of which the last character before
    a word stands alone or, if a blank, joins the word.
    """
    joined = "".join(t or "" for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    n = len(cp)
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    borders = np.concatenate(([0], np.cumsum(lengths)))
    if not n:
        return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(len(texts) + 1, np.int64)
    c = _table(runs)[cp]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = c[1:] != c[:-1]
    edge[borders] = True
    first_of_text = np.zeros(n + 1, bool)
    first_of_text[borders] = True
    begins = np.flatnonzero(edge[:n] & (c != SPACE) & ~first_of_text[:n])
    begins = begins[c[begins - 1] == SPACE]
    blank = cp[begins - 1] == 0x20
    edge[begins - 1] = True
    edge[begins[blank]] = False
    quotes = np.flatnonzero((cp == 0x27) & edge[:n])
    if len(quotes):
        after = np.concatenate((cp, np.zeros(3, np.uint32)))
        for tail in _CONTRACTIONS:
            hit = quotes.copy()
            for k, ch in enumerate(tail, 1):
                hit = hit[(hit + k < n) & (after[hit + k] == ord(ch))]
                hit = hit[~first_of_text[hit + k]]
            edge[hit + 1] = False
            edge[hit + len(tail) + 1] = True
    width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    place = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    at = np.flatnonzero(edge)
    words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(place[at]), pa.py_buffer(joined.encode("utf-8", "replace")))
    return words.dictionary_encode(), np.searchsorted(at, borders)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch of bounded size, with the texts of ``column``."""
    texts, start, size = batch.column(column).to_pylist(), 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if k + 1 - start >= CHUNK_DOCS or size >= CHUNK_CHARS:
            yield batch.slice(start, k + 1 - start), texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def _encode(path: str):
    def run(batches):
        for batch in batches:
            found = _tokenizer(path).encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.ids for e in found], pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _place(codes: np.ndarray, first: np.ndarray, flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> pa.ListArray:
    """Ids of each text: of word w they are flat[begin[w] : begin[w] + count[w]]."""
    many = count[codes]
    ends = np.cumsum(many)
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total) + np.repeat(begin[codes] - (ends - many), many)
    offsets = np.concatenate(([0], ends))[first]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[source], pa.int32()))


def _chunks(kind: pa.DataType, runs: bytes):
    """Texts in chunks: their keys, the first word of each, their words as codes, and the distinct words."""

    def run(batches):
        from pyspark import TaskContext

        serial = 0
        for batch in batches:
            for part, texts in _slices(batch, 1):
                words, first = split_pieces(texts, runs)
                codes = words.indices.to_numpy().astype(np.uint16 if len(words.dictionary) <= 1 << 16 else np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(TaskContext.get().partitionId() << 32) + serial], pa.int64()),
                        pa.array([part.column(0).to_pylist()], pa.list_(kind)),
                        pa.array([first.astype(np.int64).tobytes()], pa.binary()),
                        pa.array([codes.tobytes()], pa.binary()),
                        pa.array([words.dictionary.to_pylist()], pa.list_(pa.string())),
                    ],
                    names=["chunk", "keys", "first", "codes", "words"],
                )
                serial += 1

    return run


def _by_chunk(key: str, kind: pa.DataType):
    """The ids of each text of a chunk, those of its distinct words being put in their places."""

    def run(batches):
        for batch in batches:
            batch = pa.Table.from_batches([batch]).combine_chunks()
            for k in range(batch.num_rows):
                codes, first, found = batch.column("codes")[k].as_py(), np.frombuffer(batch.column("first")[k].as_py(), np.int64), batch.column("found")[k].values
                if found is None:
                    found = pa.array([], pa.struct([("pos", pa.int32()), ("ids", pa.list_(pa.int32()))]))
                place, lists = found.flatten()
                order = np.argsort(place.to_numpy())
                offsets = lists.offsets.to_numpy().astype(np.int64)
                own = np.frombuffer(codes, np.uint16 if len(order) <= 1 << 16 else np.int32).astype(np.int64)
                ids = _place(own, first, lists.values.to_numpy(), offsets[:-1][order], np.diff(offsets)[order])
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("keys")[k].as_py(), kind), ids], names=[key, "ids"])

    return run


def _kind(spark_type: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[spark_type]


def encode(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; one row for each row.

    ``tokenizer`` is the file of a byte-level BPE; strings of special tokens in a text are
    ordinary text. An empty and a null text both give an empty list; null and repeated keys are
    kept as they are; other columns are ignored; an empty table gives an empty result.

    Texts are split once, into chunks that hold their words as codes; each distinct word of the
    corpus is encoded once; its ids come back to the chunks by a shuffle join on the word and are
    put in place by position. Nothing is broadcast, whatever the number of words.
    """
    kind = dict(df.dtypes)[key]
    chosen = df.select(df[key].alias("__key"), df[text].alias("__text"))
    chunks = cut(chosen.mapInArrow(_chunks(_kind(kind), class_runs(tokenizer)), f"chunk bigint, keys array<{kind}>, first binary, codes binary, words array<string>"))
    asked = chunks.select("chunk", F.posexplode("words").alias("pos", "word"))
    table = asked.select("word").distinct().mapInArrow(_encode(tokenizer), "word string, ids array<int>")
    found = asked.join(table.hint("merge"), "word").groupBy("chunk").agg(F.collect_list(F.struct("pos", "ids")).alias("found"))
    whole = chunks.select("chunk", "keys", "first", "codes").join(found.hint("merge"), "chunk", "left").select("keys", "first", "codes", "found")
    return whole.mapInArrow(_by_chunk(key, _kind(kind)), f"`{key}` {kind}, ids array<int>")


@lru_cache(maxsize=4)
def _pieces(path: str) -> list[tuple[int, bytes]]:
    """Id and bytes of each piece of a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    loaded = _tokenizer(path)
    special = {t.content for t in loaded.get_added_tokens_decoder().values()}
    return [(i, piece.encode() if piece in special else bytes(byte_of[ch] for ch in piece)) for piece, i in loaded.get_vocab().items()]


def decode(df: DataFrame, key: str, ids: str, tokenizer: str) -> DataFrame:
    """(key, text) from lists of ids, by a join with the table of pieces.

    The vocabulary is a fixed table (50,257 pieces), so it may be broadcast; the texts' ids are
    joined by position. An empty list gives an empty text, a null list a null one, an id outside
    the vocabulary no bytes. Keys must be unique.
    """
    spark = df.sparkSession
    pieces = spark.createDataFrame(_pieces(tokenizer), "id int, piece binary")
    rows = df.select(df[key].alias("__key"), F.posexplode(ids).alias("pos", "id")).join(F.broadcast(pieces), "id")
    joined = rows.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("p"))
    text = joined.select("__key", F.decode(F.unhex(F.array_join(F.col("p.piece"), "")), "utf-8").alias("text"))
    empty = F.when(df[ids].isNotNull(), F.lit(""))
    return df.join(text, df[key].eqNullSafe(text["__key"]), "left").select(df[key], F.coalesce(text["text"], empty).alias("text"))
