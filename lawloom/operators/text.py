"""Text kernels as operators on DataFrames: rows in, typed rows out, Arrow batches between.

All of them are narrow: a text is worked on where it lies. Errors of one row become a column.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions import blocks as B
from lawloom.functions import citations as C
from lawloom.functions import flatten as T
from lawloom.functions import redline as R
from lawloom.functions.blobs import unpack
from lawloom.functions.keys import CodeBook

REF = "struct<action:string,code:string,section:string,is_range:boolean,range_end:string,struct:string>"
EVENT = "struct<kind:string,citation:string,year:int,year_alt:int,chapter:int,ex_session:int,proposition:string,date:string,measure_hint:string,role:string>"
BLOCK = "struct<heading:string,action:string,lineage:string,intro:string,body:string>"
CHANGE = "struct<kind:string,deleted:string,added:string,context_before:string,context_after:string>"
ROWS_AT_ONCE = 200


def map_rows(df: DataFrame, inputs: dict[str, Column], work: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that ``work`` yields for each row of ``df``; it gets the inputs by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = list(inputs)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)

    def run(batches):
        out: list[tuple] = []
        for got in batches:
            for k in range(0, got.num_rows, ROWS_AT_ONCE):
                for values in zip(*(c.to_pylist() for c in got.slice(k, ROWS_AT_ONCE).columns)):
                    out += work(**dict(zip(names, values)))
                if out:
                    yield batch(out)
                    out = []

    return df.select(*[c.alias(n) for n, c in inputs.items()]).mapInArrow(run, schema)


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def parse_titles(df: DataFrame, key: str, title: str, book: CodeBook) -> DataFrame:
    """(key, status, note, refs); a null title has the status no_title, one that breaks the parser error."""
    names = tuple(sorted((code, tuple(aliases)) for code, aliases in book.names.items()))

    def work(key, title):
        if title is None:
            yield key, "no_title", None, []
            return
        try:
            found = C.parser_for(names).parse(title)
        except Exception as e:
            yield key, "error", f"{type(e).__name__}: {e}", []
            return
        yield key, found.status, found.note, [vars(r) for r in found.refs]

    return map_rows(df, {"key": df[key], "title": df[title]}, work, f"`{key}` {_kind(df, key)}, status string, note string, refs array<{REF}>")


def parse_histories(df: DataFrame, key: str, note: str) -> DataFrame:
    """(key, pos, event): the events of each history note, operative ones first."""

    def work(key, note):
        for pos, event in enumerate(C.parse_history(note), 1):
            yield key, pos, vars(event)

    return map_rows(df, {"key": df[key], "note": df[note]}, work, f"`{key}` {_kind(df, key)}, pos int, event {EVENT}")


LADDER = ("added", "note", "lineage", "sibling", "earlier_chapter", "untraceable")


def prior_ladder(anchors: DataFrame, on: list[str], earlier: DataFrame) -> DataFrame:
    """(on, anchor_id, rung, year, chapter, act_section): the version before each of many versions.

    ``anchors`` has the columns on, anchor_id, note, action, lineage, sibling, year and chapter:
    the note or the block of a version, the lineage of a repealed block beside it, and the chapter
    that made it. ``earlier`` (on, anchor_id, year, chapter) has the chapter enacted before it, as
    ``versions.prior_chapter`` finds it. The first rung that names a chapter counts:

    ``added``: there is no version before it; ``note``: an earlier version in the note's
    parentheses; ``lineage`` of the block, unless it names the version itself; ``sibling``: that of
    the repealed block; ``earlier_chapter``; else ``untraceable``. Chapters are null for the first
    and the last. Nulls anywhere skip a rung.
    """

    def work(note, action, lineage, sibling, year, chapter, **key):
        rung, found = None, (None, None, None)
        if (action or "").startswith("added") or (note or "").lower().startswith("added"):
            rung = "added"
        elif named := next((e for e in C.parse_history(note) if e.role == "prior_version" and e.kind == "chapter"), None):
            rung, found = "note", (named.year, named.chapter, C.note_hints(note).get((named.year, named.chapter, named.ex_session)))
        else:
            for name, phrase in (("lineage", lineage), ("sibling", sibling)):
                node = C.lineage_node(phrase)
                if node and node[:2] != (year, chapter):
                    rung, found = name, node
                    break
        yield *key.values(), rung, *found

    keys = [*on, "anchor_id"]
    inputs = {c: anchors[c] for c in (*keys, "note", "action", "lineage", "sibling", "year", "chapter")}
    told = map_rows(anchors, inputs, work, ", ".join([*(f"`{c}` {_kind(anchors, c)}" for c in keys), "rung string", "year int", "chapter int", "act_section string"]))
    last = earlier.select(*keys, F.col("year").alias("__year"), F.col("chapter").alias("__chapter"))
    both = told.join(last, keys, "left")
    rung = F.coalesce("rung", F.when(F.col("__chapter").isNotNull(), "earlier_chapter"), F.lit("untraceable"))
    own = lambda c, other: F.when(F.col("rung").isNotNull(), F.col(c)).otherwise(F.col(other)).alias(c)
    return both.select(*keys, rung.alias("rung"), own("year", "__year"), own("chapter", "__chapter"), "act_section")


def enacting_blocks(df: DataFrame, key: str, body: str, *, packed: bool = False) -> DataFrame:
    """(key, pos, code_name, section, block): blocks of bills whose intro names a section of a code."""

    def work(key, body):
        text = unpack(body) if packed else body
        for pos, (name, section, block) in enumerate(B.all_blocks(text or ""), 1):
            yield key, pos, name, section, block._asdict()

    return map_rows(df, {"key": df[key], "body": df[body]}, work, f"`{key}` {_kind(df, key)}, pos int, code_name string, section string, block {BLOCK}")


def block_index(df: DataFrame, key: str, body: str, *, packed: bool = False, whole_up_to: int = 50_000) -> DataFrame:
    """(key, status, chars, blocks, rising, head_chars, body_chars): how each bill is served.

    status is ``whole`` up to ``whole_up_to`` characters, else ``index`` if it has blocks, else
    ``whole``; ``unavailable`` for a null or broken text. ``rising`` tells whether the numbers of
    the blocks rise; head and body lie around the enacting clause.
    """

    def work(key, body):
        text = unpack(body) if packed else body
        if text is None:
            yield key, "unavailable", None, None, None, None, None
            return
        rows, rising = B.section_index(text)
        head, rest = B.split_head_body(text)
        yield key, "index" if len(text) > whole_up_to and rows else "whole", len(text), len(rows), rising, len(head), len(rest)

    return map_rows(df, {"key": df[key], "body": df[body]}, work, f"`{key}` {_kind(df, key)}, status string, chars int, blocks int, rising boolean, head_chars int, body_chars int")


def redlines(pairs: DataFrame, keys: list[str], old: str, new: str, *, packed: bool = False, refuse: bool = True) -> DataFrame:
    """(keys, identical, refused, markdown, changes): the redline of each pair of texts.

    Without ``refuse`` every pair is redlined, however long. With it, pairs that would take too long
    to wait for are refused with the reason, as the tools do. A missing text of a pair counts as
    empty; if both miss, nothing comes out.
    """

    def work(old, new, **key):
        a, b = (unpack(old), unpack(new)) if packed else (old, new)
        if a is None and b is None:
            return
        a, b = a or "", b or ""
        if refuse and a != b and (why := R.refusal(a, b)):
            yield *key.values(), False, why, None, None
            return
        made = R.redline(a, b)
        yield *key.values(), made.identical, None, made.markdown, [c._asdict() for c in made.changes]

    spark = pairs.sparkSession
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    pairs = pairs.repartition(spread, *keys)  # by cost, not by size: a slow pair occupies one task
    columns = {k: pairs[k] for k in keys} | {"old": pairs[old], "new": pairs[new]}
    kinds = ", ".join(f"`{k}` {_kind(pairs, k)}" for k in keys)
    return map_rows(pairs, columns, work, f"{kinds}, identical boolean, refused string, markdown string, changes array<{CHANGE}>")


def change_counts(lines: DataFrame, keys: list[str], *, refused: bool = False) -> DataFrame:
    """(keys, kind, n, chars, reason): changes of each redline by kind, with the characters they touch.

    With ``refused`` a refused pair has one row of the kind ``refused`` with the reason and without characters.
    """
    each = lines.select(*keys, "refused", F.explode_outer("changes").alias("c")).where("refused is not null or c is not null" if refused else "c is not null")
    touched = F.coalesce(F.length("c.deleted"), F.lit(0)) + F.coalesce(F.length("c.added"), F.lit(0))
    kind = F.when(F.col("refused").isNotNull(), "refused").otherwise(F.col("c.kind"))
    chars = F.sum(F.when(F.col("refused").isNull(), touched))
    return each.groupBy(*keys, kind.alias("kind"), F.col("refused").alias("reason")).agg(F.count(F.lit(1)).alias("n"), chars.alias("chars")).select(*keys, "kind", "n", "chars", "reason")


def extract_documents(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, format, text, error) of files in any of the known formats."""

    def work(key, body):
        yield key, *T.extract_document(None if body is None else bytes(body))

    return map_rows(df, {"key": df[key], "body": df[body]}, work, f"`{key}` {_kind(df, key)}, format string, text string, error string")


def convert_documents(df: DataFrame, key: str, body: str, *, converter: str = "soffice", at_once: int = 50, seconds: int = 600) -> DataFrame:
    """(key, text, error) of office files by an external converter on the executors.

    One process takes ``at_once`` files, with a profile of its own, as starting it costs more than
    a file. Where the program is absent, or a file does not convert, the row says so.
    """

    def start(program: str, folder: Path, bodies: list) -> str | None:
        for k, data in enumerate(bodies):
            (folder / f"{k}.doc").write_bytes(data or b"")
        files = [str(folder / f"{k}.doc") for k, data in enumerate(bodies) if data is not None]
        command = [program, "--headless", f"-env:UserInstallation=file://{folder}/profile", "--convert-to", "txt:Text", "--outdir", str(folder), *files]
        try:
            subprocess.run(command, capture_output=True, timeout=seconds, check=False)
        except subprocess.TimeoutExpired:
            return "the converter took too long"
        return None

    def run(batches):
        program = shutil.which(converter)
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                bodies = part.column(1).to_pylist()
                texts: list[str | None] = [None] * len(bodies)
                error = None if program else "no converter here"
                if program:
                    with tempfile.TemporaryDirectory() as made:
                        error = start(program, Path(made), bodies)
                        for k in range(len(bodies)):
                            if (out := Path(made, f"{k}.txt")).exists():
                                texts[k] = out.read_text(errors="replace").strip()
                errors = [None if t is not None else error or "not converted" for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[key, "text", "error"])

    chosen = df.select(df[key].alias("__key"), df[body].alias("__body"))
    return chosen.mapInArrow(run, f"`{key}` {_kind(df, key)}, text string, error string")


def flatten_bills(df: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, title, text) of bills in markup; null markup gives nulls."""

    def work(key, markup):
        yield (key, None, None) if markup is None else (key, T.extract_title(markup), T.bill_text(markup))

    return map_rows(df, {"key": df[key], "markup": df[markup]}, work, f"`{key}` {_kind(df, key)}, title string, text string")
