"""Vectorised word splitting over whole Arrow batches.

A word is a maximal run of letters and digits of the lower-cased text. Batches are handled as
one UTF-8 buffer: a class table marks the bytes of words, run ends give word offsets, and Arrow
encodes the words as codes of a small dictionary, so Python never loops over words.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash


class Words(NamedTuple):
    """Words of a batch in order: ``codes`` into ``vocabulary``; document d has [first[d], first[d+1])."""

    codes: np.ndarray
    vocabulary: pa.Array
    first: np.ndarray


@cache
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, code points and byte lengths of the non-ASCII characters of a UTF-8 buffer."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int32)
    size = np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2))
    cp = np.where(size == 4, lead & 0x07, np.where(size == 3, lead & 0x0F, lead & 0x1F))
    for k in (1, 2, 3):
        more = size > k
        cp[more] = cp[more] << 6 | (data[at[more] + k] & 0x3F)
    return at, cp, size


def mark(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which bytes belong to characters that ``wanted``, a table over code points, holds."""
    small = np.zeros(256, bool)
    small[:128] = wanted[:128]
    on = small[data]
    at, cp, size = code_points(data)
    if len(at):
        yes = wanted[cp]
        for k in range(4):
            own = yes & (size > k)
            on[at[own] + k] = True
    return on


def split_words(texts: list[str | None]) -> Words:
    """Words of each text; a null text has none."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    on = mark(data, _alnum())
    edge = np.flatnonzero(on[1:] != on[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum(end - start)
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[on]))
    coded = words.dictionary_encode()
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    borders = np.concatenate(([0], np.cumsum(sizes)))
    first = np.searchsorted(start, borders)
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, first)


def hash_vocabulary(vocabulary: pa.Array) -> np.ndarray:
    """64-bit hashes of the words of a dictionary."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: Words, n: int, seeds: np.ndarray | None = None) -> list[np.ndarray | None]:
    """The sorted distinct hashes of each document's runs of ``n`` words.

    ``seeds`` has a number for each document; runs of documents with unlike seeds never agree.
    """
    of = hash_vocabulary(words.vocabulary)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    count, first = len(of) - n + 1, words.first
    run = np.zeros(max(count, 0), np.uint64)
    if count > 0:
        if seeds is not None:
            run = np.repeat(seeds.astype(np.uint64), np.diff(first))[:count]
        for k in range(n):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + of[k : k + count])
    return [np.unique(run[a : max(a, b - n + 1)]) for a, b in zip(first[:-1], first[1:])]
