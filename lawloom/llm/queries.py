"""Queries of the operators on text, with their production parameters."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.garbling import repair
from lawloom.llm.groups import grouped
from lawloom.llm.leakage import leaked
from lawloom.llm.lookalikes import unify
from lawloom.llm.near_duplicates import key_pairs, near_duplicates
from lawloom.llm.splitting import split_oversized
from lawloom.llm.tokenizing import decode, encode
from lawloom.sources.tables import table

TOKENIZER = os.environ.get("LAWLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def _fields(spark: SparkSession, root: str) -> DataFrame:
    """The fields that may hold garbled text."""
    parts = [
        table(spark, root, name).select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("key"), F.col("trans_uid").alias("source"), F.col(text).alias("text"))
        for name, key, text in (("law_section", "id", "content_text"), ("bill_version", "bill_version_id", "title_text"), ("bill_history", "bill_history_id", "action"))
    ]
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Records whose field was read in another encoding than it was written in."""
    return repair(_fields(spark, root)).select("tbl", F.col("key").alias("rec_key")).distinct()


def p1_repaired(spark: SparkSession, root: str) -> DataFrame:
    """The original text of those records, wherever nothing was lost."""
    return repair(_fields(spark, root)).select("tbl", F.col("key").alias("rec_key"), "repaired", "lost").distinct()


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Prints of more than 8,000 characters: those that the splitter cuts into several pieces."""
    pieces = split_oversized(table(spark, root, "bill_version_text"), "bill_version_id", "text_zlib", packed=True, with_text=False)
    return pieces.where("pos = 1 and pieces > 1").select("bill_version_id")


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """All pieces of all prints, with their text."""
    return split_oversized(table(spark, root, "bill_version_text"), "bill_version_id", "text_zlib", packed=True)


def p2_rejoined(spark: SparkSession, root: str) -> DataFrame:
    """Documents cut into pieces of 1,000 characters, 50 of which overlap, and put together again: (doc_id, digest, fits, overlaps)."""
    pieces = split_oversized(table(spark, root, "documents"), "doc_id", "text", limit=1000, overlap=50)
    own = F.when(F.col("pos") > 1, F.expr("substring(piece, 51)")).otherwise(F.col("piece"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "piece", own.alias("own"))))
    packed = pieces.groupBy("doc_id").agg(listed.alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["own"]), "")
    fits = F.forall("p", lambda x: F.length(x["piece"]) <= 1000)
    seams = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.right(a["piece"], F.lit(50)) == F.left(b["piece"], F.lit(50)))
    return packed.select("doc_id", F.md5(text).alias("digest"), fits.alias("fits"), F.forall(seams, lambda x: x).alias("overlaps"))


def _compared(spark: SparkSession, root: str) -> DataFrame:
    prints = table(spark, root, "bill_version_text").select(F.lit("bill_version_text").alias("tbl"), F.col("bill_version_id").alias("key"), F.col("text_zlib").alias("body"), F.lit(True).alias("packed"))
    sections = table(spark, root, "law_section").select(F.lit("law_section").alias("tbl"), F.col("id").alias("key"), F.col("content_text").cast("binary").alias("body"), F.lit(False).alias("packed"))
    return prints.unionByName(sections)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of prints, and of sections, that share 0.8 or more of their runs of three words."""
    links, members = near_duplicates(_compared(spark, root), threshold=0.8, words=3, least_words=20)
    return key_pairs(links, members)


def p3_sections(spark: SparkSession, root: str) -> DataFrame:
    """The pairs of sections alone, whose texts SQL can read."""
    links, members = near_duplicates(_compared(spark, root).where("tbl = 'law_section'"), threshold=0.8, words=3, least_words=20)
    return key_pairs(links, members).select("key_a", "key_b")


def p3_groups(spark: SparkSession, root: str) -> DataFrame:
    """The group of every compared text, and how many different texts it is like."""
    return grouped(*near_duplicates(_compared(spark, root), threshold=0.8, words=3, least_words=20))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, root, "documents"), "doc_id", "text", TOKENIZER)


def p8_decoded(spark: SparkSession, root: str) -> DataFrame:
    """Every document's text made again from its ids; a null text comes back empty."""
    return decode(p8_ids(spark, root), "doc_id", "ids", TOKENIZER)


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold 13 consecutive words of a held-out item, with the item."""
    return leaked(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_item"), "item_id", "text")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents in which the rewriting to one form replaces a case, or meets one that has no other form."""
    return unify(table(spark, root, "documents"), "doc_id", "text", with_text=False).where("rewritten > 0 or kept > 0").select("doc_id").distinct()


def p10_texts(spark: SparkSession, root: str) -> DataFrame:
    """Every document's text in one form."""
    return unify(table(spark, root, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_rejoined": p2_rejoined,
    "p3_found": p3_found,
    "p3_sections": p3_sections,
    "p3_groups": p3_groups,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_texts": p10_texts,
}
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_RUNS = "SELECT DISTINCT {key}, array_to_string(words[i:i + 12], ' ') AS run FROM (SELECT {key}, words, unnest(range(1, len(words) - 11)) AS i FROM (SELECT {key}, " + _WORDS + " AS words FROM {table}))"
_CASES = "[\\x{FF01}-\\x{FF5E}\\x{0300}-\\x{036F}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{00AD}\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
_MIXED = "\\p{Latin}\\p{L}*[\\p{Greek}\\p{Cyrillic}]|[\\p{Greek}\\p{Cyrillic}]\\p{L}*\\p{Latin}"
_SECTIONS = f"""
WITH runs AS (SELECT DISTINCT id, array_to_string(words[i:i + 2], ' ') AS run FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM (SELECT id, {_WORDS.replace('text', 'content_text')} AS words FROM law_section) WHERE len(words) >= 20)),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id)
SELECT a.id AS key_a, b.id AS key_b FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id
GROUP BY a.id, b.id, x.n, y.n HAVING count(*) * 5 >= (x.n + y.n - count(*)) * 4
"""
ORACLE_SQL: dict[str, str] = {
    "p2_rejoined": "SELECT doc_id, md5(text) AS digest, true AS fits, true AS overlaps FROM documents WHERE length(text) > 0",
    "p3_sections": _SECTIONS,
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": f"SELECT DISTINCT d.doc_id, e.item_id FROM ({_RUNS.replace('{key}', 'doc_id').replace('{table}', 'documents')}) d JOIN ({_RUNS.replace('{key}', 'item_id').replace('{table}', 'eval_item')}) e USING (run)",
    "p10_found": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_CASES}|{_MIXED}')",
}
