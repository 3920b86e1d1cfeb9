"""Oversized texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lawloom.functions.blobs import unpack

#: From the strongest to the weakest kind of boundary; a piece may end where a match ends.
BOUNDARIES = (
    ("section", re.compile(r"(?:\r\n|[\r\n])[ \t\r\n]*(?=(?:SECTION|Section|SEC\.|Sec\.)[ \t]+\d)")),
    ("subdivision", re.compile(r"(?:\r\n|[\r\n])[ \t\r\n]*(?=\([0-9A-Za-z]{1,4}\))")),
    ("sentence", re.compile(r"[.!?;:。！？][\"'”’)\]]*\s+|[。！？]|\n\s*\n")),
    ("word", re.compile(r"\s+")),
)
_TOKEN = re.compile(r"\s+|\w+|[^\w\s]")


def _boundaries(text: str, offsets: np.ndarray | None) -> list[tuple[str, np.ndarray]]:
    """Sorted boundary positions of each kind, in units of size."""
    found = []
    for kind, pattern in BOUNDARIES:
        at = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        found.append((kind, at if offsets is None else offsets[at]))
    return found


def _last(at: np.ndarray, least: int, most: int) -> int | None:
    """The last boundary b with least < b <= most."""
    k = int(np.searchsorted(at, most, "right"))
    return int(at[k - 1]) if k and at[k - 1] > least else None


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of boundary at the end) of each piece, in characters.

    Prefix sums over the tokens give the offset of each token, and binary search the last
    boundary under the limit: the strongest kind that fills at least half a piece, else the
    strongest that moves on at all, else the end of the last whole token, else a hard cut.
    Pieces cover the text in order; each after the first starts ``overlap`` before the end of
    the one before it. A text within the limit is one piece; an empty text has none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    total = len(text)
    if total <= limit:
        return [(0, total, "end")] if total else []
    kinds = _boundaries(text, None)
    tokens = np.fromiter(accumulate(len(t) for t in _TOKEN.findall(text)), np.int64)
    pieces, start = [], 0
    while total - start > limit:
        most = start + limit
        end = kind = None
        for least in (start + max(overlap, limit // 2), start + overlap):
            for name, at in kinds:
                if (end := _last(at, least, most)) is not None:
                    kind = name
                    break
            if end is not None:
                break
        if end is None and (end := _last(tokens, start + overlap, most)) is not None:
            kind = "token"
        if end is None:
            end, kind = most, "hard"
        pieces.append((start, end, kind))
        start = end - overlap
    return [*pieces, (start, total, "end")]


def _run(key: str, read: Callable, limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = read(body)
                if text is None:
                    continue
                found = cuts(text, limit, overlap)
                size += len(text) * with_text
                out += [(k, pos, len(found), a, b, kind, text[a:b] if with_text else None) for pos, (a, b, kind) in enumerate(found, 1)]
                if size > 16_000_000:
                    yield _batch(out, key, batch.schema.field(0).type)
                    out, size = [], 0
            if out:
                yield _batch(out, key, batch.schema.field(0).type)

    return run


def _batch(rows: list[tuple], key: str, kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[key, "pos", "pieces", "start", "end", "boundary", "piece"])


def _as_text(body: str | None) -> str | None:
    return body


def split_oversized(df: DataFrame, key: str, body: str, *, limit: int = 8000, overlap: int = 400, packed: bool = False, with_text: bool = True) -> DataFrame:
    """One row a piece: (key, pos from 1, pieces of the text, start, end, boundary, piece).

    Sizes count characters (code points). ``packed`` reads ``body`` as zlib over UTF-8. Each text
    is cut where it lies, without a shuffle, and read whole. Null texts and blobs that do not
    unpack have no row, nor have empty texts; a null key is kept; rows given twice give their
    pieces twice; other columns are ignored. ``piece`` is null without ``with_text``.
    """
    chosen = df.select(df[key].alias("__key"), df[body].alias("__body"))
    kind = dict(chosen.dtypes)["__key"]
    schema = f"`{key}` {kind}, pos int, pieces int, start bigint, end bigint, boundary string, piece string"
    return chosen.mapInArrow(_run(key, unpack if packed else _as_text, limit, overlap, with_text), schema)
