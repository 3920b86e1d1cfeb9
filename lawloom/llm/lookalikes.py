"""Text that looks the same brought to one form.

Strings and code points that look alike form classes by union-find: full-width forms with their
ASCII characters, base letters and combining accents with the composed letter, unusual blanks with
the blank, invisible characters with the empty string, and letters of different scripts. The most
frequent member of a class in the corpus stands for it. A multi-pattern automaton rewrites texts
greedily, the longest match first. Letters of another script are rewritten only inside runs of
letters that mix scripts, so words wholly in one script stay as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INVISIBLE = "​‌‍⁠﻿­"
BLANKS = " " + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
ACCENTS = "".join(map(chr, range(0x0300, 0x0370)))

# Letters that look alike, as Latin, Cyrillic, Greek ("-" where there is none).
LETTERS = """
a а α
c с ϲ
d ԁ -
e е ε
h һ -
i і ι
j ј ϳ
k к κ
n - η
o о ο
p р ρ
q ԛ -
s ѕ -
t т τ
u - υ
v ѵ ν
w ԝ ω
x х χ
y у γ
A А Α
B В Β
C С Ϲ
E Е Ε
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
Q Ԛ -
S Ѕ -
T Т Τ
V Ѵ -
W Ԝ -
X Х Χ
Y Ү Υ
Z - Ζ
"""
FORM_RANGES = ((0xA0, 0x3000), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x1EE00, 0x1EF00), (0x2F800, 0x2FA20))  # blocks with forms of other characters
SCRIPTS = ("Latin", "Cyrillic", "Greek")
_RUN = regex.compile(r"\p{L}+")
_BEYOND = re.compile(r"[\x00-\x7F]?[^\x00-\x7F]+")
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_LATIN = regex.compile(r"\p{Latin}")
_OF_SCRIPT = {s: regex.compile(rf"\p{{{s}}}") for s in SCRIPTS}


class Union:
    """Union-find over strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: str, y: str) -> None:
        self.parent[self.find(x)] = self.find(y)

    def classes(self) -> list[list[str]]:
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        return [sorted(g) for g in groups.values()]


@cache
def forms() -> list[list[str]]:
    """Classes of strings that are forms of one character in any script."""
    union = Union()
    for c in WIDE:
        union.join(c, chr(ord(c) - 0xFEE0))
    for c in BLANKS:
        union.join(c, " ")
    for c in INVISIBLE:
        union.join(c, "")
    for code in chain(*(range(*r) for r in FORM_RANGES)):
        c = chr(code)
        if unicodedata.decomposition(c).startswith(("<font>", "<narrow>", "<wide>")) and c not in WIDE and c not in BLANKS:
            union.join(c, unicodedata.normalize("NFKC", c))
        apart = unicodedata.normalize("NFD", c)
        if apart != c and all(m in ACCENTS for m in apart[1:]):
            union.join(apart, unicodedata.normalize("NFC", c))
            union.join(c, unicodedata.normalize("NFC", c))
            for k in range(2, len(apart)):
                union.join(unicodedata.normalize("NFC", apart[:k]) + apart[k:], apart)
    return union.classes()


@cache
def letters() -> dict[str, dict[str, str]]:
    """Script -> letter -> the look-alike letter of that script, over transitive classes."""
    union = Union()
    for row in LETTERS.split("\n"):
        known = [c for c in row.split() if c != "-"]
        for c in known[1:]:
            union.join(c, known[0])
    table: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    for group in union.classes():
        for script in SCRIPTS:
            own = [c for c in group if _OF_SCRIPT[script].match(c)]
            if own:
                table[script] |= {c: own[0] for c in group}
    return table


def is_variant(member: str) -> bool:
    """Whether a string holds a character that is a case by itself."""
    return any(c in WIDE or c in BLANKS or c in INVISIBLE or c in ACCENTS for c in member)


class Rules(NamedTuple):
    """What rewriting needs: ``replace`` by pattern (None: a case without another form), letter weights."""

    replace: dict[str, str | None]
    weight: dict[str, float]


def choose(counts: dict[str, int]) -> Rules:
    """The most frequent member stands for its class; variants do only where nothing else can."""
    replace: dict[str, str | None] = {c: None for c in ACCENTS}
    for group in forms():
        best = max(group, key=lambda m: (not is_variant(m), m == "", counts.get(m, 0), [-ord(c) for c in m]))
        replace |= {m: best for m in group if m != best and m}
    total = sum(counts.values()) + 1
    weight = {c: math.log((counts.get(c, 0) + 0.01) / total) for c in letter_set()}
    return Rules(replace, weight)


@cache
def letter_set() -> frozenset[str]:
    return frozenset(c for t in letters().values() for c in t)


class Scanner:
    """The automaton over all patterns that are to be replaced or reported.

    A pattern ends in one of ``ends`` and holds no ASCII beyond its first character, so only
    stretches beyond ASCII with such an end, and the character before them, have to be scanned.
    """

    def __init__(self, replace: dict[str, str | None]):
        import ahocorasick

        self.made = ahocorasick.Automaton()
        for pattern, by in replace.items():
            self.made.add_word(pattern, (len(pattern), by, is_variant(pattern)))
        self.made.make_automaton()
        self.ends = frozenset(pattern[-1] for pattern in replace)

    def rewrite(self, text: str) -> tuple[str, int, int]:
        """(text after one turn, cases replaced, cases without another form)."""
        done = kept = 0

        def one(stretch: re.Match) -> str:
            nonlocal done, kept
            piece = stretch.group()
            if self.ends.isdisjoint(piece):
                return piece
            out, at = [], 0
            for end, (length, by, variant) in self.made.iter_long(piece):
                done += variant and by is not None
                kept += variant and by is None
                if by is not None:
                    out += [piece[at : end + 1 - length], by]
                    at = end + 1
            return "".join([*out, piece[at:]])

        return _BEYOND.sub(one, text), done, kept


def _one_script(run: str, rules: Rules) -> str:
    """A mixed run in one script: the one that all its letters have, with the likeliest letters."""
    best, likely = run, -math.inf
    for script in SCRIPTS:
        table, of = letters()[script], _OF_SCRIPT[script]
        other = [s for s in SCRIPTS if s != script]
        new = "".join(table.get(c, c) if any(_OF_SCRIPT[s].match(c) for s in other) else c for c in run)
        if any(_OF_SCRIPT[s].search(new) for s in other) or not of.search(new):
            continue
        score = sum(rules.weight.get(c, 0.0) for c in new)
        if score > likely:
            best, likely = new, score
    return best


def mixed_runs(text: str) -> list[tuple[int, int]]:
    """Spans of runs of letters that mix Latin with Greek or Cyrillic."""
    if not _FOREIGN.search(text):
        return []
    return [m.span() for m in _RUN.finditer(text) if not m.group().isascii() and _FOREIGN.search(m.group()) and _LATIN.search(m.group())]


def rewrite(text: str, rules: Rules, scanner: Scanner) -> tuple[str, int, int]:
    """(text in one form, cases rewritten, cases that have no other form and stay).

    A case is a member of a class that is a case by itself, or a mixed run; the automaton replaces
    members, longest first, until none is left that has a better one.
    """
    if text.isascii():
        return text, 0, 0
    done = kept = 0
    for turn in range(3):
        if scanner.ends.isdisjoint(text):
            break
        new, replaced, left = scanner.rewrite(text)
        done += replaced
        kept += left * (not turn)
        if new == text:
            break
        text = new
    for a, b in reversed(mixed_runs(text)):
        new = _one_script(text[a:b], rules)
        done += new != text[a:b]
        kept += new == text[a:b]
        text = text[:a] + new + text[b:]
    return text, done, kept


def _counts(batches: Iterator[pa.RecordBatch]):
    """Occurrences of the members of classes in a task's texts."""
    import ahocorasick

    made = ahocorasick.Automaton()
    members = {m for g in forms() for m in g if m}
    for m in members:
        if len(m) > 1:
            made.add_word(m, m)
    made.make_automaton()
    wanted = {m for m in members if len(m) == 1} | letter_set()
    single: Counter[str] = Counter()
    pairs: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text.isascii():
                for c in _ASCII:
                    if n := text.count(c):
                        single[c] += n
                continue
            single.update(text)
            if any("̀" <= c <= "ͯ" for c in set(text)):
                pairs.update(m for _, m in made.iter(text))
    both = [(m, n) for m, n in single.items() if m in wanted] + list(pairs.items())
    yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in both], pa.string()), pa.array([n for _, n in both], pa.int64())], names=["member", "n"])


_ASCII = [chr(c) for c in range(0x20, 0x7F)]


def frequencies(df: DataFrame, text: str) -> dict[str, int]:
    """Counts over all texts; as many as there are members of classes, whatever the corpus."""
    rows = df.select(df[text].alias("text")).where("text is not null").mapInArrow(_counts, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n"))
    return {r.member: r.n for r in rows.collect()}


def _run(rules: Rules, key: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(rules.replace)
        for batch in batches:
            done = [(None, 0, 0) if t is None else rewrite(t, rules, scanner) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] if with_text else None for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())],
                names=[key, "text", "rewritten", "kept"],
            )

    return run


def unify(df: DataFrame, key: str, text: str, *, with_text: bool = True) -> DataFrame:
    """(key, text, rewritten, kept): each text in one form, and its cases; one row for each row.

    Cases are full-width forms, combining accents, invisible characters, unusual blanks, and runs
    of letters that mix Latin with Greek or Cyrillic. ``rewritten`` counts those that the rewriting
    replaced, ``kept`` those that have no better form: an accent that composes with nothing, and a
    mixed run that fits no single script. Forms of a character that are no case, such as
    mathematical letters, are rewritten but not counted. Null texts stay null with counts of 0,
    empty ones empty; null and repeated keys are kept; other columns are ignored. ``text`` is null
    without ``with_text``.
    """
    rules = choose(frequencies(df, text))
    kind = dict(df.dtypes)[key]
    chosen = df.select(df[key].alias("__key"), df[text].alias("__text"))
    return chosen.mapInArrow(_run(rules, key, with_text), f"`{key}` {kind}, text string, rewritten int, kept int")
