"""Queries of the text operators, versions and lineage over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions.citations import note_sections
from lawloom.functions.flatten import detect_column, law_section_text_column
from lawloom.functions.keys import CodeBook, chapter_citation, format_session, norm_section, norm_session
from lawloom.operators.intervals import leading_number
from lawloom.operators.matching import matches
from lawloom.operators.text import block_index, change_counts, enacting_blocks, extract_documents, map_rows, parse_histories, parse_titles, prior_ladder, redlines
from lawloom.operators.versions import pick_version, predecessors, prior_chapter, resolve_chapters, walk
from lawloom.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def code_book(spark: SparkSession, root: str) -> CodeBook:
    """Names of the codes, a fixed table of 30 rows."""
    return CodeBook.from_titles([(r.code, r.title) for r in table(spark, root, "codes").collect()])


# --- flatteners and formats


@query(
    """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace('<p>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p>', '</p\\s*>|<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t\\x{A0}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(9) || chr(11) || chr(12))) AS digest FROM documents WHERE text IS NOT NULL"""
)
def t1f_flatten(spark: SparkSession, root: str) -> DataFrame:
    """T1f, T12: texts put into markup and flattened again."""
    docs = table(spark, root, "documents").where("text is not null")
    markup = F.concat(F.lit("<p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>"))
    return docs.select("doc_id", F.md5(law_section_text_column(markup)).alias("digest"))


_HEADS = ("D0CF11E0A1B11AE1", "504B0304", "7B5C72746631", "0A203C21444F435459504520", "20203C68746D6C3E", "")  # doc, docx, rtf, two pages, and as stored


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'doc' WHEN 1 THEN 'docx' WHEN 2 THEN 'rtf' WHEN 3 THEN 'html' WHEN 4 THEN 'html' ELSE
    CASE WHEN regexp_matches(lower(substr(ltrim(substr(text, 1, 600), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1, 60)), '^<!doctype|<html|<body') THEN 'html' ELSE 'text' END END AS format FROM documents WHERE text IS NOT NULL"""
)
def t4f_detect(spark: SparkSession, root: str) -> DataFrame:
    """T4f: formats of files by their first bytes: documents behind the heads of six kinds of files."""
    heads = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % len(_HEADS) + 1).cast("int"))
    docs = table(spark, root, "documents").where("text is not null")
    return docs.select("doc_id", detect_column(F.concat(F.unhex(heads), F.encode("text", "utf-8"))).alias("format"))


@query("SELECT doc_id, 'text' AS format, length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8199) || chr(8195) || chr(8201) || chr(8239) || chr(12288))) AS chars FROM documents WHERE text IS NOT NULL AND NOT lower(text) LIKE '%<html%' AND NOT lower(text) LIKE '%<body%'")
def t9f_extract(spark: SparkSession, root: str) -> DataFrame:
    """T5f to T9f: text of files, here of documents as bytes."""
    docs = table(spark, root, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("body"))
    return extract_documents(docs, "doc_id", "body").select("doc_id", "format", F.length("text").cast("bigint").alias("chars"))


@query("SELECT doc_id, 'html' AS format, md5(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def t6f_html(spark: SparkSession, root: str) -> DataFrame:
    """T6f, T9f: documents put into pages and read again; the digest is of letters and digits."""
    docs = table(spark, root, "documents").where("text is not null")
    marked = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.encode(F.concat(F.lit("<!DOCTYPE html><html><!-- x --><body><p class='a'>"), marked, F.lit("</p><br/>&nbsp;</body></html>")), "utf-8")
    found = extract_documents(docs.select("doc_id", page.alias("body")), "doc_id", "body")
    return found.select("doc_id", "format", F.md5(F.regexp_replace("text", "[^A-Za-z0-9]", "")).alias("digest"))


# --- keys


@query("SELECT DISTINCT section, rtrim(trim(section), '.') AS key FROM bill_section_ref WHERE section IS NOT NULL")
def k2_section_key(spark: SparkSession, root: str) -> DataFrame:
    """K2, K5: normalized section keys."""
    rows = table(spark, root, "bill_section_ref").where("section is not null").select("section").distinct()
    return map_rows(rows, {"section": rows["section"]}, lambda section: [(section, norm_section(section))], "section string, key string")


@query("SELECT DISTINCT session_year, left(session_year, 4) || '-' || substr(session_year, 5, 4) AS session, CAST(substr(session_year, 1, 4) AS INT) % 2 = 1 AND CAST(substr(session_year, 5, 4) AS INT) = CAST(substr(session_year, 1, 4) AS INT) + 1 AS valid FROM bill WHERE length(session_year) = 8")
def k11_session(spark: SparkSession, root: str) -> DataFrame:
    """Sessions as people read them, and whether they are two years from an odd one."""
    rows = table(spark, root, "bill").where("length(session_year) = 8").select("session_year").distinct()
    return map_rows(rows, {"session": rows["session_year"]}, lambda session: [(session, format_session(session), norm_session(session) == session)], "session_year string, session string, valid boolean")


@query("SELECT id, TRY_CAST(regexp_extract(section_num_norm, '^\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS num FROM law_section")
def k13_numval(spark: SparkSession, root: str) -> DataFrame:
    """Leading numbers of keys."""
    return table(spark, root, "law_section").select("id", leading_number(F.col("section_num_norm")).alias("num"))


@query("SELECT bill_id, CASE WHEN chapter_num IS NOT NULL AND chapter_num <> '' THEN 'Stats. ' || chapter_year || ', ' || CASE WHEN coalesce(TRY_CAST(chapter_session_num AS INT), 0) > 0 THEN chapter_session_num || CASE WHEN TRY_CAST(chapter_session_num AS INT) % 100 IN (11, 12, 13) THEN 'th' WHEN TRY_CAST(chapter_session_num AS INT) % 10 = 1 THEN 'st' WHEN TRY_CAST(chapter_session_num AS INT) % 10 = 2 THEN 'nd' WHEN TRY_CAST(chapter_session_num AS INT) % 10 = 3 THEN 'rd' ELSE 'th' END || ' Ex. Sess., ' ELSE '' END || 'Ch. ' || chapter_num END AS citation FROM bill")
def k15_citation(spark: SparkSession, root: str) -> DataFrame:
    """Chapter citations, null without a number."""
    rows = table(spark, root, "bill")
    inputs = {"key": rows["bill_id"], "kind": rows["chapter_type"], "year": rows["chapter_year"], "number": rows["chapter_num"], "session": rows["chapter_session_num"]}
    return map_rows(rows, inputs, lambda key, kind, year, number, session: [(key, chapter_citation(kind, year, number, session))], "bill_id string, citation string")


# --- citations


@query()
def c1_title_parse(spark: SparkSession, root: str) -> DataFrame:
    """References of each version's title."""
    versions = table(spark, root, "bill_version").select("bill_version_id", "title_text").distinct()
    parsed = parse_titles(versions, "bill_version_id", "title_text", code_book(spark, root))
    return parsed.select("bill_version_id", "status", F.explode_outer("refs").alias("ref")).select("bill_version_id", "status", "ref.*")


@query()
def c1_status(spark: SparkSession, root: str) -> DataFrame:
    """Parse statuses over rows and over distinct titles."""
    versions = table(spark, root, "bill_version").select("bill_version_id", "title_text").distinct()
    parsed = parse_titles(versions, "bill_version_id", "title_text", code_book(spark, root)).select("bill_version_id", "status").join(versions, "bill_version_id")
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("title_text").alias("titles"))


_CITE = r"Stats\.?\s*(\d{4})\s*,\s*(?:(\d{1,2})(?:st|nd|rd|th)\s+Ex(?:traordinary|\.)?(?:\s*Sess\.?)?\s*,\s*)?Ch\.?\s*(\d{1,6})"
_CITES = f"(SELECT DISTINCT id, CAST(y AS INT) AS year, CAST(c AS INT) AS chapter, coalesce(TRY_CAST(x AS INT), 0) AS ex_session FROM (SELECT id, unnest(regexp_extract_all(history, '{_CITE}', 1)) AS y, unnest(regexp_extract_all(history, '{_CITE}', 2)) AS x, unnest(regexp_extract_all(history, '{_CITE}', 3)) AS c FROM law_section))"


@query(f"SELECT * FROM {_CITES}")
def c3_history_parse(spark: SparkSession, root: str) -> DataFrame:
    """The chapters that each section's history cites."""
    events = parse_histories(table(spark, root, "law_section"), "id", "history")
    return events.where("event.kind = 'chapter'").select("id", "event.year", "event.chapter", "event.ex_session").distinct()


@query()
def c3_events(spark: SparkSession, root: str) -> DataFrame:
    """Events by kind and role."""
    events = parse_histories(table(spark, root, "law_section"), "id", "history")
    return events.groupBy("event.kind", "event.role").agg(F.count(F.lit(1)).alias("n"))


_EX = r"(?:(\d{1,2})(?:st|nd|rd|th)\s+Ex(?:traordinary|\.)?(?:\s*Sess\.?)?\s*,\s*)?"
_HINT = rf"Stats\.?\s*(\d{{4}})\s*,\s*{_EX}Ch\.?\s*(\d{{1,6}})\s*(?:\([^)]*\)\s*)?,\s*Sec\.?\s*([0-9][0-9.]*)"
_HINTS = ", ".join(f"unnest(regexp_extract_all(history, '{_HINT}', {k})) AS {c}" for k, c in ((1, "y"), (2, "x"), (3, "c"), (4, "s")))


@query(f"SELECT DISTINCT id, CAST(y AS INT) AS year, CAST(c AS INT) AS chapter, coalesce(TRY_CAST(x AS INT), 0) AS ex_session, rtrim(s, '.') AS act_section FROM (SELECT id, {_HINTS} FROM law_section)")
def c4_hints(spark: SparkSession, root: str) -> DataFrame:
    """C4: sections of the acts that histories cite."""
    rows = table(spark, root, "law_section")
    work = lambda key, note: [(key, *chapter, section) for chapter, section in note_sections(note)]
    return map_rows(rows, {"key": rows["id"], "note": rows["history"]}, work, "id string, year int, chapter int, ex_session int, act_section string").distinct()


# --- blocks and redlines


@query()
def b2_blocks(spark: SparkSession, root: str) -> DataFrame:
    """B1, B2: the blocks of all prints, with what they enact."""
    found = enacting_blocks(table(spark, root, "bill_version_text"), "bill_version_id", "text_zlib", packed=True)
    return found.select("bill_version_id", "pos", "code_name", "section", "block.action", "block.lineage", F.length("block.body").alias("body_chars"))


@query()
def b3_index(spark: SparkSession, root: str) -> DataFrame:
    """How each print is served."""
    return block_index(table(spark, root, "bill_version_text"), "bill_version_id", "text_zlib", packed=True)


def _version_pairs(spark: SparkSession, root: str) -> DataFrame:
    chain = predecessors(table(spark, root, "bill_version"), "bill_id", "bill_version_id", "version_num").where("prior is not null")
    texts = table(spark, root, "bill_version_text").select("bill_version_id", "text_zlib")
    old = texts.select(F.col("bill_version_id").alias("prior"), F.col("text_zlib").alias("old"))
    return chain.join(texts.withColumnRenamed("text_zlib", "new"), "bill_version_id").join(old, "prior")


@query()
def r2_redline(spark: SparkSession, root: str) -> DataFrame:
    """Each print against the one before it; none is refused."""
    made = redlines(_version_pairs(spark, root), ["bill_version_id", "prior"], "old", "new", packed=True, refuse=False)
    return made.select("bill_version_id", "prior", "identical", "refused", F.size("changes").alias("changes"), F.length("markdown").alias("chars"))


@query()
def r8_change_counts(spark: SparkSession, root: str) -> DataFrame:
    """Changes between prints by kind; none is refused, so the reason is null."""
    made = redlines(_version_pairs(spark, root), ["bill_version_id"], "old", "new", packed=True, refuse=False)
    return change_counts(made, ["bill_version_id"])


# --- versions and lineage


@query("SELECT bill_id, bill_version_id, lead(bill_version_id) OVER (PARTITION BY bill_id ORDER BY coalesce(TRY_CAST(version_num AS BIGINT), 0), bill_version_id) AS prior FROM (SELECT DISTINCT bill_id, bill_version_id, version_num FROM bill_version WHERE bill_id IS NOT NULL)")
def v2_predecessor(spark: SparkSession, root: str) -> DataFrame:
    """V2: the next older version."""
    return predecessors(table(spark, root, "bill_version"), "bill_id", "bill_version_id", "version_num")


_PICK = "SELECT bill_id, bill_version_id, fits FROM (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY coalesce(TRY_CAST(version_num AS BIGINT), 0), bill_version_id) AS n, CAST(count(*) OVER (PARTITION BY bill_id) AS INT) AS fits FROM (SELECT DISTINCT bill_id, bill_version_id, version_num, action_date, action FROM bill_version) WHERE {}) WHERE n = 1"


@query(_PICK.format("lower(action) LIKE '%amend%'"))
def v1_pick_phrase(spark: SparkSession, root: str) -> DataFrame:
    """V1: the newest version whose action holds a phrase."""
    return pick_version(table(spark, root, "bill_version"), "Amend")


@query(_PICK.format("version_num = '99'"))
def v1_pick_number(spark: SparkSession, root: str) -> DataFrame:
    """V1: the version of a number."""
    return pick_version(table(spark, root, "bill_version"), "99")


@query(
    """WITH RECURSIVE e AS (SELECT o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior FROM orders),
    w AS (SELECT k, k AS last, 0 AS hops FROM e UNION ALL SELECT w.k, e.prior, w.hops + 1 FROM w JOIN e ON e.k = w.last WHERE e.prior IS NOT NULL AND w.hops < 25)
    SELECT k AS o_orderkey, arg_max(last, hops) AS last, max(hops) AS hops FROM w GROUP BY k"""
)
def l3_chain_walk(spark: SparkSession, root: str) -> DataFrame:
    """L3: up to 25 steps from each order to its customer's earlier ones."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = table(spark, root, "orders").select("o_orderkey", F.lag("o_orderkey").over(order).alias("prior"))
    return walk(edges, "o_orderkey", "prior")


@query(
    f"SELECT e.id, e.year, e.chapter, b.bill_id, b.ties FROM {_CITES} e LEFT JOIN (SELECT chapter_year, chapter_num, bill_id, CAST(count(*) OVER (PARTITION BY chapter_year, chapter_num) - 1 AS BIGINT) AS ties, row_number() OVER (PARTITION BY chapter_year, chapter_num ORDER BY bill_id) AS n FROM bill WHERE chapter_num IS NOT NULL AND chapter_year IS NOT NULL) b ON CAST(e.year AS VARCHAR) = b.chapter_year AND CAST(e.chapter AS VARCHAR) = b.chapter_num AND b.n = 1"
)
def l1_chapters(spark: SparkSession, root: str) -> DataFrame:
    """Chapters that histories cite, with the bill that became each."""
    events = c3_history_parse(spark, root).withColumn("chapter_year", F.col("year").cast("string")).withColumn("chapter_num", F.col("chapter").cast("string"))
    bills = table(spark, root, "bill").where("chapter_num is not null and chapter_year is not null").select("chapter_year", "chapter_num", "bill_id")
    return resolve_chapters(events, bills, ["chapter_year", "chapter_num"]).select("id", "year", "chapter", "bill_id", "ties")


_CHAPTERED = "(SELECT DISTINCT r.law_code, rtrim(trim(r.section), '.') AS section, b.bill_id, CAST(v.d AS VARCHAR) AS date, TRY_CAST(b.chapter_year AS INT) AS year, TRY_CAST(b.chapter_num AS INT) AS chapter FROM bill_section_ref r JOIN bill b ON r.bill_id = b.bill_id AND r.bill_version_id = b.latest_bill_version_id LEFT JOIN (SELECT bill_version_id, max(action_date) AS d FROM bill_version GROUP BY 1) v ON v.bill_version_id = b.latest_bill_version_id WHERE b.chapter_num IS NOT NULL AND r.section IS NOT NULL AND r.law_code IS NOT NULL)"


@query(
    f"""SELECT law_code, section, anchor_id, prior FROM (SELECT a.law_code, a.section, a.bill_id AS anchor_id, coalesce(
      max(struct_pack(d := c.date, y := c.year, n := c.chapter, id := c.bill_id)) FILTER (c.date < a.date).id,
      max(struct_pack(y := c.year, n := c.chapter, id := c.bill_id)) FILTER (((c.year < a.year) OR (c.year = a.year AND c.chapter < a.chapter)) AND (a.date IS NULL OR c.date IS NULL)).id) AS prior
    FROM {_CHAPTERED} a JOIN {_CHAPTERED} c USING (law_code, section) GROUP BY ALL) WHERE prior IS NOT NULL"""
)
def l4_prior_chapter(spark: SparkSession, root: str) -> DataFrame:
    """For each chaptered bill that touches a section the bill that did so before it."""
    rows = _enacted(spark, root)
    return prior_chapter(rows.withColumnRenamed("cand_id", "anchor_id"), rows, ["law_code", "section"])


def _enacted(spark: SparkSession, root: str) -> DataFrame:
    """(law_code, section, cand_id, date, year, chapter) of each chaptered bill that touches a section."""
    refs, bills, versions = (table(spark, root, n) for n in ("bill_section_ref", "bill", "bill_version"))
    latest = bills.where("chapter_num is not null").select("bill_id", F.col("latest_bill_version_id").alias("bill_version_id"), F.col("chapter_year").try_cast("int").alias("year"), F.col("chapter_num").try_cast("int").alias("chapter"))
    dated = versions.groupBy("bill_version_id").agg(F.date_format(F.max("action_date"), "yyyy-MM-dd HH:mm:ss").alias("date"))
    touched = refs.where("section is not null and law_code is not null").select("law_code", F.rtrim(F.trim("section"), F.lit(".")).alias("section"), "bill_id", "bill_version_id")
    return touched.join(latest, ["bill_id", "bill_version_id"]).join(dated, "bill_version_id", "left").select("law_code", "section", F.col("bill_id").alias("cand_id"), "date", "year", "chapter").distinct()


_PAREN = r"\([^)]*?Stats\.?\s*(\d{4})\s*,\s*(?:\d{1,2}(?:st|nd|rd|th)\s+Ex(?:traordinary|\.)?(?:\s*Sess\.?)?\s*,\s*)?Ch\.?\s*(\d{1,6})"


@query(
    f"""WITH a AS (SELECT law_code, section_num_norm AS section, id AS anchor_id, history, TRY_CAST(op_statutes AS INT) AS year, TRY_CAST(op_chapter AS INT) AS chapter FROM law_section WHERE law_code IS NOT NULL AND section_num_norm IS NOT NULL),
    e AS (SELECT a.anchor_id, max(struct_pack(y := c.year, n := c.chapter, id := c.bill_id)) AS m FROM a JOIN {_CHAPTERED} c USING (law_code, section) WHERE c.year < a.year OR (c.year = a.year AND c.chapter < a.chapter) GROUP BY 1)
    SELECT law_code, section, anchor_id, CASE WHEN starts_with(lower(coalesce(history, '')), 'added') THEN 'added' WHEN regexp_matches(history, '{_PAREN}') THEN 'note' WHEN e.m IS NOT NULL THEN 'earlier_chapter' ELSE 'untraceable' END AS rung,
      CASE WHEN starts_with(lower(coalesce(history, '')), 'added') THEN NULL WHEN regexp_matches(history, '{_PAREN}') THEN CAST(regexp_extract(history, '{_PAREN}', 1) AS INT) ELSE e.m.y END AS year,
      CASE WHEN starts_with(lower(coalesce(history, '')), 'added') THEN NULL WHEN regexp_matches(history, '{_PAREN}') THEN CAST(regexp_extract(history, '{_PAREN}', 2) AS INT) ELSE e.m.n END AS chapter
    FROM a LEFT JOIN e USING (anchor_id)"""
)
def l4_ladder(spark: SparkSession, root: str) -> DataFrame:
    """L4: the version before each section of current law, by the rungs of the ladder."""
    sections = table(spark, root, "law_section").where("law_code is not null and section_num_norm is not null")
    none = F.lit(None).cast("string")
    anchors = sections.select("law_code", F.col("section_num_norm").alias("section"), F.col("id").alias("anchor_id"), F.col("history").alias("note"), none.alias("action"), none.alias("lineage"), none.alias("sibling"), F.col("op_statutes").try_cast("int").alias("year"), F.col("op_chapter").try_cast("int").alias("chapter"))
    rows = _enacted(spark, root)
    found = prior_chapter(anchors.withColumn("date", none), rows, ["law_code", "section"])
    chapters = rows.groupBy("cand_id").agg(F.max("year").alias("year"), F.max("chapter").alias("chapter")).withColumnRenamed("cand_id", "prior")
    return prior_ladder(anchors, ["law_code", "section"], found.join(chapters, "prior")).drop("act_section")


_NUM = "TRY_CAST(regexp_extract({}, '^\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE)"


@query(
    f"""SELECT code, key, ref_id, kind FROM (SELECT s.code, s.key, r.ref_id, CASE WHEN r.section = s.key THEN 'direct' WHEN r.ranged THEN CASE WHEN r.lo <= s.num AND s.num <= r.hi THEN 'range' END
      WHEN r.struct IS NOT NULL AND s.num - r.lo > 0 AND s.num - r.lo <= 100 THEN 'structural_add_nearby' END AS kind
    FROM (SELECT DISTINCT ref_id, law_code AS code, sec AS section, coalesce(is_range = '1', false) AS ranged, {_NUM.format("sec")} AS lo, {_NUM.format("range_end")} AS hi, range_end, struct FROM (SELECT *, coalesce(section, regexp_extract(struct, 'Section ([0-9.]+)', 1)) AS sec FROM bill_section_ref)) r
    JOIN (SELECT DISTINCT law_code AS code, section_num_norm AS key, {_NUM.format("section_num_norm")} AS num FROM law_section) s USING (code)) WHERE kind IS NOT NULL"""
)
def g3_match_kind(spark: SparkSession, root: str) -> DataFrame:
    """How each reference touches each section."""
    section = F.coalesce("section", F.regexp_extract("struct", r"Section ([0-9.]+)", 1))
    refs = table(spark, root, "bill_section_ref").select("ref_id", F.col("law_code").alias("code"), section.alias("section"), F.coalesce(F.col("is_range") == "1", F.lit(False)).alias("is_range"), "range_end", "struct")
    sections = table(spark, root, "law_section").select(F.col("law_code").alias("code"), F.col("section_num_norm").alias("key"))
    return matches(refs, sections)
