"""Full-text search over all documents, with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawloom.operators.relational import meeting
from lawloom.operators.search import Index, bm25, corpus_size, matches_text, matching, parse_match, postings, read_index, snippet, terms, words_of, write_index
from lawloom.plans.durable import checkpoint_folder, cut
from lawloom.sources.tables import table

_LOW = "strip_accents(lower(text))"
_TERMS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+')"


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", "text", "source")


def _asked(docs: DataFrame) -> DataFrame:
    """Stated query set: of each document whose id is divisible by 100, its three longest terms."""
    words = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    rank = Window.partitionBy("query").orderBy(F.length("term").desc(), "term")
    return words.withColumn("n", F.row_number().over(rank)).where("n <= 3").select("query", "term")


_BASE = f"""
docs AS (SELECT doc_id, source, {_TERMS.format(_LOW)} AS terms FROM documents),
size AS (SELECT count(*) AS n, avg(coalesce(len(terms), 0)) AS avgdl FROM docs),
posted AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(terms) AS term, len(terms) AS dl FROM docs) GROUP BY doc_id, term),
asked AS (SELECT query, term FROM (SELECT doc_id AS query, term, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, term) AS k FROM posted WHERE doc_id % 100 = 0) WHERE k <= 3)
"""
_SCORE = """
SELECT query, doc_id, round(score, 6) AS score, rank FROM (
  SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
    SELECT a.query, p.doc_id, sum(greatest(ln((s.n - d.n + 0.5) / (d.n + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))) AS score, count(*) AS held, any_value(a.terms) AS terms
    FROM (SELECT query, term, count(*) OVER (PARTITION BY query) AS terms FROM asked) a JOIN posted p USING (term) JOIN (SELECT term, count(*) AS n FROM posted GROUP BY term) d USING (term), size s {}
    GROUP BY a.query, p.doc_id) WHERE held = terms) WHERE rank <= 10"""


def f1_postings(spark: SparkSession, root: str) -> DataFrame:
    """the postings table, as documents and occurrences of each term."""
    return postings(_docs(spark, root), "doc_id", "text", with_positions=False).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))


def _best(docs: DataFrame, asked: DataFrame, within: str | None = None) -> DataFrame:
    posted = postings(docs, "doc_id", "text", with_positions=False, carried=within)
    return bm25(asked, "query", "term", posted, "doc_id", corpus_size(docs, "text"), 10, within=within)


def f3_postings(spark: SparkSession, root: str) -> DataFrame:
    """A boolean expression over postings instead of texts."""
    tree = parse_match("(agency OR dealer) AND shall NOT vehicle")
    return matching(tree, postings(_docs(spark, root), "doc_id", "text"), "doc_id")


def f4_bm25(spark: SparkSession, root: str) -> DataFrame:
    """the ten best documents of each asked query."""
    docs = _docs(spark, root)
    best = _best(docs, _asked(docs))
    return best.select("query", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def f5_filtered(spark: SparkSession, root: str) -> DataFrame:
    """the same among documents of the asking document's source, with weights of the whole corpus."""
    docs = _docs(spark, root)
    mine = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "source")
    best = _best(docs, _asked(docs).join(mine, "query"), "source")
    return best.select("query", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _stored(spark: SparkSession, root: str) -> Index:
    """An index of all documents, stored in the shared checkpoint folder."""
    path = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    write_index(_docs(spark, root), "doc_id", "text", path)
    return read_index(spark, path)


def f1_index(spark: SparkSession, root: str) -> DataFrame:
    """The best documents of each asked query from a stored index."""
    index, asked = _stored(spark, root), _asked(_docs(spark, root))
    best = bm25(asked, "query", "term", index.joined(asked, "term"), "doc_id", index.size, 10)
    return best.select("query", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def f3_index(spark: SparkSession, root: str) -> DataFrame:
    """A boolean expression from a stored index, of which only the asked terms are read."""
    tree = parse_match("(agency OR dealer) AND shall NOT vehicle")
    return matching(tree, _stored(spark, root).of(*words_of(tree)), "doc_id")


def _match(expression: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        return _docs(spark, root).where(matches_text(parse_match(expression), F.col("text"))).select("doc_id")

    return run


def f6_snippet(spark: SparkSession, root: str) -> DataFrame:
    """snippets of the documents found by F4, whose texts alone are moved."""
    docs = _docs(spark, root)
    asked = _asked(docs)
    best = cut(_best(docs, asked))
    words = asked.groupBy("query").agg(F.array_sort(F.collect_list("term")).alias("words"))
    return best.join(words, "query").join(meeting(docs, best, "doc_id"), "doc_id").select("query", "doc_id", snippet(F.col("text"), F.col("words")).alias("snippet"))


_PHRASE = "list_contains(list_transform(range(1, len(terms)), lambda i: terms[i] || ' ' || terms[i + 1]), '{}')"
QUERIES = {
    "f1_postings": f1_postings,
    "f3_phrase": _match('"shall record"'),
    "f3_near": _match("NEAR(agency dealer, 5)"),
    "f3_boolean": _match("(agency OR dealer) AND shall NOT vehicle"),
    "f3_prefix": _match("regist*"),
    "f3_postings": f3_postings,
    "f1_index": f1_index,
    "f3_index": f3_index,
    "f4_bm25": f4_bm25,
    "f5_filtered": f5_filtered,
    "f6_snippet": f6_snippet,
}
ORACLE_SQL = {
    "f1_postings": f"WITH {_BASE} SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences FROM posted GROUP BY term",
    "f3_phrase": f"WITH {_BASE} SELECT doc_id FROM docs WHERE {_PHRASE.format('shall record')}",
    "f3_near": f"WITH {_BASE}, p AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM docs)) SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.term = 'agency' AND b.term = 'dealer' AND abs(a.pos - b.pos) - 1 <= 5",
    "f3_boolean": f"WITH {_BASE} SELECT doc_id FROM docs WHERE (list_contains(terms, 'agency') OR list_contains(terms, 'dealer')) AND list_contains(terms, 'shall') AND NOT list_contains(terms, 'vehicle')",
    "f3_postings": f"WITH {_BASE} SELECT doc_id FROM docs WHERE (list_contains(terms, 'agency') OR list_contains(terms, 'dealer')) AND list_contains(terms, 'shall') AND NOT list_contains(terms, 'vehicle')",
    "f3_index": f"WITH {_BASE} SELECT doc_id FROM docs WHERE (list_contains(terms, 'agency') OR list_contains(terms, 'dealer')) AND list_contains(terms, 'shall') AND NOT list_contains(terms, 'vehicle')",
    "f1_index": f"WITH {_BASE} " + _SCORE.format(""),
    "f3_prefix": f"WITH {_BASE} SELECT DISTINCT doc_id FROM posted WHERE starts_with(term, 'regist')",
    "f4_bm25": f"WITH {_BASE} " + _SCORE.format(""),
    "f5_filtered": f"WITH {_BASE} " + _SCORE.format("JOIN docs x ON true JOIN docs y ON true WHERE x.doc_id = a.query AND y.doc_id = p.doc_id AND x.source = y.source"),
}
