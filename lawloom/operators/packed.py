"""Several values packed in one field, as one row a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates values, and the characters that enclose them.
DELIMITER = r"\s*(?:;;?|\|\|?|//?|~|##|•|·|\t|\r?\n)\s*"
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”"}
#: Marks around delimiters while a field is taken apart: code points that no text may hold.
OPEN, CLOSE = "﷐", "﷑"
CITATION = r"\b(?:Stats|Prop)\."


def citations(text: Column) -> Column:
    """How many citations a text holds outside parentheses."""
    return F.regexp_count(F.regexp_replace(text, r"\([^()]*\)", " "), F.lit(CITATION))


def _outer_quote(field: Column) -> Column:
    """The character that opens enclosed values of the field: the first one at the start of a value."""
    some = "".join(QUOTES)
    first = F.regexp_extract(field, rf"^[\s;,|/~#•·]*([{some}])", 1)
    later = F.regexp_extract(field, rf"(?:[;|/~•·,\t\n]|##)\s*([{some}])(?=[A-Za-z .]+(?:Stats|Prop|\())", 1)
    return F.when(first != "", first).when(later != "", later).otherwise(F.lit('"'))


def _marked(field: Column) -> Column:
    """The field with marks around the delimiters that stand outside quotes.

    Splitting on the quote character makes odd pieces literals; only even ones can hold
    delimiters. A comma is one only next to a quote.
    """
    quote = _outer_quote(field)

    def between(piece: Column) -> Column:
        only = piece.rlike(r"^[\s,;]*,[\s,;]*$")
        return F.when(only, F.concat(F.lit(OPEN), piece, F.lit(CLOSE))).otherwise(F.regexp_replace(piece, f"({DELIMITER})", f"{OPEN}$1{CLOSE}"))

    def piece(count: Column, opening: str, closing: str):
        return lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(opening), p, F.when(i + 1 < count, F.lit(closing)).otherwise(F.lit("")))).otherwise(between(p))

    whole = None
    for opening, closing in QUOTES.items():
        text = F.array_join(F.transform(F.split(field, f"[{opening}{closing}]", -1), piece(F.size(F.split(field, f"[{opening}{closing}]", -1)), opening, closing)), "")
        whole = F.when(quote == opening, text) if whole is None else whole.when(quote == opening, text)
    return whole


def _fold(notes: Column, part: Column) -> Column:
    """Add what follows one delimiter to the notes so far.

    A part with a citation begins a note; one without belongs to the note before it, with its
    delimiter; an empty one counts for nothing. Text before the first citation opens that note.
    """
    delimiter = F.when(part.contains(CLOSE), F.substring_index(part, CLOSE, 1)).otherwise(F.lit(""))
    body = F.substring_index(part, CLOSE, -1)
    last = F.element_at(notes, -1)
    grown = F.concat(F.slice(notes, 1, F.size(notes) - 1), F.array(F.concat(last, delimiter, body)))
    fresh = F.concat(notes, F.array(body))
    return (
        F.when(F.trim(body) == "", notes)
        .when(F.size(notes) == 0, fresh)
        .when((citations(body) > 0) & (citations(last) > 0), fresh)
        .otherwise(grown)
    )


def _unquoted(note: Column) -> Column:
    """A note without the quotes around it; doubled quotes inside stand for one."""
    bare = F.regexp_replace(note, r"^[\s,;]+|[\s,;]+$", "")
    result = bare
    for opening, closing in QUOTES.items():
        inside = F.substring(bare, F.lit(2), F.length(bare) - 2)
        if opening == closing:
            inside = F.replace(inside, F.lit(opening * 2), F.lit(opening))
        result = F.when((F.length(bare) > 1) & bare.startswith(opening) & bare.endswith(closing), inside).otherwise(result)
    return F.regexp_replace(result, r"^\s+|\s+$", "")


def unpack_values(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, pos from 1, values in the field, value): each note of a packed field.

    A value is one note with exactly one citation outside parentheses (``Stats.``, or ``Prop.``
    with its ``Res.Ch.``); remarks belong to their note whatever punctuation they use. Null, empty
    and blank fields and those without a citation have no row; repeated notes and rows count
    again; a null key is kept; other columns are ignored. All of it is narrow SQL array work: no
    shuffle, and a field of any length stays in its row.
    """
    parts = F.split(_marked(df[field]), OPEN, -1)
    notes = F.filter(F.aggregate(parts, F.array().cast("array<string>"), _fold), lambda n: citations(n) > 0)
    taken = df.select(df[key].alias(key), notes.alias("__notes")).where(F.size("__notes") > 0)
    return taken.select(key, F.size("__notes").alias("values"), F.posexplode("__notes").alias("__pos", "__note")).select(
        key, (F.col("__pos").cast("bigint") + 1).alias("pos"), "values", _unquoted(F.col("__note")).alias("value")
    )
