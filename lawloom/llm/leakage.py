"""Held-out passages inside a corpus, by a Wu-Manber search over words.

The patterns are all runs of ``run`` words of the held-out items. A text is scanned as a sequence
of words: the pair of words at the end of the search window selects a shift; where the pair ends
no pattern the window moves on by that shift, so most words are never looked at. Where the shift
is 0, the pair's bucket lists the patterns that end so, and they are compared word by word.

Items are a query set that is searched in blocks of bounded size. A pattern is kept as its place in
the words of its block, four bytes, and tables are as narrow as their values, so a block takes
about 12 bytes a word and 5 a slot of its tables. Blocks are compiled by tasks, not by the driver.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawloom.functions.textvec import Words, mix, split_words
from lawloom.plans.durable import cut

BATCH = 512
TABLE_BITS = (16, 22)  # least and most
BLOCK_CHARS = 6_000_000  # of items in a block; its tables take some 45 MB at most
SCAN_BLOCKS = 4  # blocks that one scan of the corpus searches


class Patterns(NamedTuple):
    """Search tables of a block of items.

    ``words`` are the words of the block, id k + 1 for the k-th; other words have id 0. ``ids`` are
    the items' words in order; a pattern is a place in them where ``run`` words begin, equal ones
    being one. ``shift`` has the safe move by pair of words; patterns of a pair are
    ``order[bucket[pair] : bucket[pair + 1]]``, ``place`` their places; items of pattern k are
    ``items[item_at[k] : item_at[k + 1]]``.
    """

    run: int
    words: pa.Array
    ids: np.ndarray
    bits: int
    shift: np.ndarray
    bucket: np.ndarray
    order: np.ndarray
    place: np.ndarray
    items: np.ndarray
    item_at: np.ndarray


def _block(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Block of two neighbouring word ids, in a table of 2 ** bits."""
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64)


def _distinct(ids: np.ndarray, at: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of the equal runs of words that begin at each place, and which of them each one equals.

    Runs are told apart by a hash, and those of one hash are compared word by word.
    """
    with np.errstate(over="ignore"):
        value = np.zeros(len(at), np.uint64)
        for k in range(run):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64))
    _, first, which = np.unique(value, return_index=True, return_inverse=True)
    unlike = np.zeros(len(at), bool)
    for k in range(run):
        unlike |= ids[at + k] != ids[at[first[which]] + k]
    odd = np.flatnonzero(unlike)  # of one hash, but other words: each is a pattern by itself
    which[odd] = len(first) + np.arange(len(odd))
    return at[np.concatenate((first, odd))], which


def compile_patterns(items: list[tuple[int, str]], run: int) -> Patterns | None:
    """Search tables for all runs of ``run`` words (2 at least) of the items; None if there are none."""
    split = split_words([text for _, text in items])
    ids = split.codes.astype(np.int32) + 1
    counts = np.maximum(np.diff(split.first) - run + 1, 0)
    if not counts.sum():
        return None
    owner = np.repeat(np.array([item for item, _ in items], np.int64), counts)
    at = np.arange(counts.sum()) + np.repeat(split.first[:-1] - split.first[0] - (np.cumsum(counts) - counts), counts)
    place, which = _distinct(ids, at, run)
    pairs = np.unique(np.stack([which, owner]), axis=1)
    bits = min(max(TABLE_BITS[0], (8 * len(place)).bit_length()), TABLE_BITS[1])  # grows with the patterns, so that most pairs end none
    shift = np.full(1 << bits, run - 1, np.int8 if run < 128 else np.int32)
    for end in range(1, run):  # the pair of words end - 1 and end; the later one wins
        shift[_block(ids[place + end - 1], ids[place + end], bits)] = run - 1 - end
    last = _block(ids[place + run - 2], ids[place + run - 1], bits)
    order = np.argsort(last, kind="stable").astype(np.int32)
    bucket = np.searchsorted(last[order], np.arange((1 << bits) + 1)).astype(np.int32)
    return Patterns(run, split.vocabulary, ids, bits, shift, bucket, order, place.astype(np.int32), pairs[1], np.searchsorted(pairs[0], np.arange(len(place) + 1)).astype(np.int32))


def search(split: Words, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(position of the text, item) for each text of a batch that holds a pattern; distinct."""
    run = p.run
    known = pc.index_in(split.vocabulary, value_set=p.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
    ids = known[split.codes] if len(split.codes) else np.zeros(0, np.int32)
    doc = np.arange(len(split.first) - 1)
    at, end = split.first[:-1] + run - 1, split.first[1:]
    found_text, found_item = [], []
    alive = at < end
    doc, at, end = doc[alive], at[alive], end[alive]
    while len(at):
        block = _block(ids[at - 1], ids[at], p.bits)
        move = p.shift[block].astype(np.int64)
        stop = np.flatnonzero(move == 0)
        if len(stop):
            low, high = p.bucket[block[stop]].astype(np.int64), p.bucket[block[stop] + 1]
            many = high - low
            candidate = p.order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
            where = np.repeat(stop, many)
            for k in range(run):
                on = p.ids[p.place[candidate] + run - 1 - k] == ids[at[where] - k]
                candidate, where = candidate[on], where[on]
            begin = p.item_at[candidate].astype(np.int64)
            owners = p.item_at[candidate + 1] - begin
            found_item.append(p.items[np.arange(owners.sum()) + np.repeat(begin - (np.cumsum(owners) - owners), owners)])
            found_text.append(np.repeat(doc[where], owners))
        at = at + np.maximum(move, 1)
        alive = at < end
        doc, at, end = doc[alive], at[alive], end[alive]
    if not found_text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hits = np.unique(np.stack([np.concatenate(found_text), np.concatenate(found_item)]), axis=1)
    return hits[0], hits[1]


def _scan(blocks: list, key: str):
    """The hits of texts in several blocks; a batch is split into words once for all of them."""

    def run(batches: Iterator[pa.RecordBatch]):
        tables = [_load(b.value) for b in blocks]
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                split = split_words(batch.column(1).to_pylist())
                for p in tables:
                    text, item = search(split, p)
                    if len(text):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(item, pa.int64())], names=[key, "item"])

    return run


def _dump(p: Patterns) -> bytes:
    return pickle.dumps(p, protocol=5)


def _load(data: bytes) -> Patterns:
    return pickle.loads(data)


def _compile(run: int):
    """One row a block, of sorted rows (block, item, text): its search tables."""

    def compiled(rows: list[tuple[int, str]]) -> list[bytes]:
        p = compile_patterns(rows, run)
        return [] if p is None else [_dump(p)]

    def work(batches: Iterator[pa.RecordBatch]):
        block, rows = None, []
        for batch in batches:
            for b, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block and rows:
                    yield pa.RecordBatch.from_arrays([pa.array(compiled(rows), pa.binary())], names=["tables"])
                    rows = []
                block = b
                rows.append((item, text))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(compiled(rows), pa.binary())], names=["tables"])

    return work


def leaked(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, *, run: int = 13, block_limit: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_key): texts that hold ``run`` consecutive words of an item; distinct rows.

    A word is a maximal run of letters and digits of the lower-cased text. The corpus is scanned
    where it lies, without a shuffle; the items are a query set in blocks of some ``block_limit``
    characters, four of which one scan searches. An item is in one block, by its hash. Null texts
    and items, and those of fewer than ``run`` words, match nothing; runs that several items share
    give each of them; repeated rows give one; other columns are ignored.
    """
    if not 2 <= run < 1 << 15:
        raise ValueError("run must be at least 2")
    spark = texts.sparkSession
    chosen = texts.select(texts[key].alias("__key"), texts[text].alias("__text")).where("__text is not null")
    kind = dict(chosen.dtypes)["__key"]
    schema = f"`{key}` {kind}, item bigint"
    asked = items.select(items[item_key].cast("bigint").alias("item"), items[item_text].alias("text")).where("item is not null and text is not null").distinct()
    chars = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / block_limit))
    placed = asked.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "item", "text").repartition(min(blocks, 1000), "block").sortWithinPartitions("block", "item")
    tables = cut(placed.mapInArrow(_compile(run), "tables binary"))
    sent = [spark.sparkContext.broadcast(bytes(row.tables)) for row in tables.toLocalIterator()]
    parts = [chosen.mapInArrow(_scan(sent[k : k + SCAN_BLOCKS], key), schema) for k in range(0, len(sent), SCAN_BLOCKS)]
    if not parts:
        return spark.createDataFrame([], T._parse_datatype_string(schema)).withColumnRenamed("item", item_key)
    return reduce(DataFrame.unionByName, parts).distinct().withColumnRenamed("item", item_key)
