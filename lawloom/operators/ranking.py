"""The best documents of many sets of terms at once.

A block of documents is a bit map for each term; the documents that hold a set are the conjunction of
its maps, so only matches are scored. Each task keeps the k best documents of a set, and what cannot
be among them any more is dropped before it is sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 4_000_000  # of a block's table of terms and documents
SETS = 512  # conjunctions made at once


class Page(NamedTuple):
    """Sets of terms: numbers, terms as rising indices into ``terms`` (filled up with its length), and a place each.

    ``terms`` are ascending ids, ``weights`` theirs; ``places`` are the values that ``place`` points to.
    """

    numbers: np.ndarray
    held: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    place: np.ndarray | None
    places: list | None


def page_of(rows: list[tuple], weight: Callable[[np.ndarray], np.ndarray], within: bool) -> Page:
    """Rows (number, [(id, documents that hold it)], place) as arrays; ``weight`` gives a term's weight by its documents."""
    sizes = np.fromiter((len(r[1]) for r in rows), np.int64, len(rows))
    ids = np.fromiter((t[0] for r in rows for t in r[1]), np.int64, sizes.sum())
    counts = np.fromiter((t[1] for r in rows for t in r[1]), np.int64, sizes.sum())
    terms, first, codes = np.unique(ids, return_index=True, return_inverse=True)
    held = np.full((len(rows), sizes.max()), len(terms), np.int64)
    held[np.arange(sizes.max()) < sizes[:, None]] = codes
    places = list(dict.fromkeys(r[2] for r in rows)) if within else None
    number = {p: k for k, p in enumerate(places or ())}
    place = np.fromiter((number[r[2]] for r in rows), np.int64, len(rows)) if within else None
    return Page(np.fromiter((r[0] for r in rows), np.int64, len(rows)), held, terms, weight(counts[first]), place, places)


def ranks(keys: pa.Array) -> np.ndarray:
    """Integers in the order of the keys."""
    if pa.types.is_integer(keys.type) and not keys.null_count:
        return keys.to_numpy(zero_copy_only=False)
    return pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


class _Best:
    """The k best documents of each set so far: highest score first, then the smallest key."""

    def __init__(self, sets: int, k: int, kind: pa.DataType):
        self.k, self.of, self.units, self.score, self.keys = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)
        self.least = np.full(sets, -1)  # units that a document needs at least

    def add(self, of: np.ndarray, units: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        of, units, score = np.concatenate((self.of, of)), np.concatenate((self.units, units)), np.concatenate((self.score, score))
        keys = pa.concat_arrays([self.keys, keys])
        order = np.lexsort((ranks(keys), -units, of))
        sorted_of = of[order]
        start = np.flatnonzero(np.concatenate(([True], sorted_of[1:] != sorted_of[:-1])))
        nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        last = order[nth == self.k - 1]
        self.least[of[last]] = units[last]
        chosen = order[nth < self.k]
        self.of, self.units, self.score, self.keys = of[chosen], units[chosen], score[chosen], keys.take(pa.array(chosen))


def _matches(page: Page, best: _Best, doc: np.ndarray, code: np.ndarray, part: np.ndarray, docs: int, place: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(set, units, score, document) of the documents of a block that hold a set and may be among its best."""
    present, row = np.unique(code, return_inverse=True)
    table = np.zeros((len(present) + 1, docs))
    table[row, doc] = part
    there = np.zeros(table.shape, bool)
    there[row, doc] = True
    there[-1] = True
    bits = np.packbits(there, axis=1)
    at = np.full(len(page.terms) + 1, -1)
    at[present] = np.arange(len(present))
    at[-1] = len(present)
    rows = at[page.held]
    alive = np.flatnonzero((rows >= 0).all(axis=1))
    for k in range(0, len(alive), SETS):
        own = alive[k : k + SETS]
        of_terms = rows[own]
        both = bits[of_terms[:, 0]]
        for c in range(1, of_terms.shape[1]):
            both &= bits[of_terms[:, c]]
        s, d = np.nonzero(np.unpackbits(both, axis=1, count=docs))
        if place is not None:
            same = place[d] == page.place[own[s]]
            s, d = s[same], d[same]
        score = np.zeros(len(s))
        for c in range(of_terms.shape[1]):
            score += table[of_terms[s, c], d]
        units = np.floor(score * 1e9 + 0.5).astype(np.int64)
        good = units >= best.least[own[s]]
        yield own[s[good]], units[good], score[good], d[good]


def ranked(page: Page, k: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], kind: pa.DataType):
    """A kernel from rows (key, dl, ids, tfs, place) to (set, key, units, score): the k best of each task.

    ``part`` is what a term adds to a score, by its weight, frequency and document's length. Units are
    billionths of a score; documents are compared by them.
    """

    def run(batches):
        best = _Best(len(page.numbers), k, kind)
        for batch in batches:
            ids = batch.column(2)
            borders = ids.offsets.to_numpy()
            values, tf = ids.values.to_numpy(), batch.column(3).values.to_numpy()
            doc_of = np.repeat(np.arange(batch.num_rows), np.diff(borders))
            values, tf = values[borders[0] : borders[-1]], tf[borders[0] : borders[-1]]
            code = np.minimum(np.searchsorted(page.terms, values), len(page.terms) - 1)
            known = page.terms[code] == values
            doc_of, code, tf = doc_of[known], code[known], tf[known]
            parts = part(page.weights[code], tf, batch.column(1).to_numpy()[doc_of])
            place = None
            if page.places is not None:
                found = pc.index_in(batch.column(4), value_set=pa.array(page.places, batch.column(4).type))
                place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
            step = max(64, CELLS // (1 + len(np.unique(code))))
            for low in range(0, batch.num_rows, step):
                high = min(low + step, batch.num_rows)
                a, b = np.searchsorted(doc_of, (low, high))
                if a == b:
                    continue
                found = list(_matches(page, best, doc_of[a:b] - low, code[a:b], parts[a:b], high - low, None if place is None else place[low:high]))
                of, units, score, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
                if len(of):
                    best.add(of, units, score, batch.column(0).take(pa.array(d + low)))
        if len(best.of):
            columns = [pa.array(page.numbers[best.of]), best.keys, pa.array(best.units), pa.array(best.score)]
            yield pa.RecordBatch.from_arrays(columns, names=["set", "key", "units", "score"])

    return run
