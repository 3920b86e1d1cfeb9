"""Compressed document bodies."""

from __future__ import annotations

import zlib


def unpack(blob: bytes | None) -> str | None:
    """Text of a zlib blob over UTF-8.

    None for a null blob and for one that does not unpack completely: cut off, not
    compressed, empty, or not UTF-8 inside. Bytes after the end of the stream are ignored.
    """
    if blob is None:
        return None
    stream = zlib.decompressobj()
    try:
        body = stream.decompress(blob) + stream.flush()
        return body.decode("utf-8") if stream.eof else None
    except (zlib.error, UnicodeDecodeError):
        return None


def pack(text: str | None) -> bytes | None:
    """The inverse of :func:`unpack`; None stays None."""
    return None if text is None else zlib.compress(text.encode("utf-8"), 6)
