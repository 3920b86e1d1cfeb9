"""Lexemes of legal prose, on which the grammars of this package work."""

from __future__ import annotations

import re
from typing import NamedTuple

#: A number may have dots and hyphens inside and letters at its end; a dot before a word ends it.
_LEXEME = re.compile(r"(?P<number>[0-9][0-9A-Za-z\-]*(?:\.[0-9][0-9A-Za-z\-]*)*)|(?P<word>[^\W\d_]+)|(?P<mark>\S)")


class Lexeme(NamedTuple):
    """A number, word or mark with its place in the text; ``low`` is its lower case."""

    kind: str
    text: str
    low: str
    start: int
    end: int


END = Lexeme("end", "", "", 1 << 60, 1 << 60)


class Lexemes:
    """The lexemes of a text; beyond the last one all are END."""

    def __init__(self, text: str, begin: int = 0, end: int | None = None):
        self.text = text
        self.all = [Lexeme(m.lastgroup, m.group(), m.group().lower(), *m.span()) for m in _LEXEME.finditer(text, begin, len(text) if end is None else end)]

    def __len__(self) -> int:
        return len(self.all)

    def __getitem__(self, k: int) -> Lexeme:
        return self.all[k] if k < len(self.all) else END

    def follow(self, k: int, *wanted: str) -> bool:
        """Whether these lower-cased lexemes stand at k."""
        return all(self[k + n].low == w for n, w in enumerate(wanted))

    def past(self, k: int, *optional: str) -> int:
        """k, or k + 1 where one of ``optional`` stands there."""
        return k + (self[k].low in optional)

    def slice(self, first: int, last: int) -> str:
        """The text from the first to the last of these lexemes."""
        return self.text[self[first].start : self[last].end]


def squeeze(text: str) -> str:
    """``text`` on one line with single blanks."""
    return " ".join(text.split())
