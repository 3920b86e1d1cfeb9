"""Filters, joins, aggregates, sorts and set operations over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawloom.operators.intervals import as_of, band, contained, leading_number, nearest
from lawloom.operators.relational import ancestors, first_store, flagged, last_write, ordered_distinct, unpivot_metrics, with_headings
from lawloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with SQL that gives the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _tables(spark, root, *names):
    return [table(spark, root, n) for n in names]


# Stated query set: every reference whose id is divisible by 100.
_ASKED = "(SELECT ref_id, law_code, rtrim(trim(section), '.') AS section FROM bill_section_ref WHERE ref_id % 100 = 0)"
_NUM = "TRY_CAST(regexp_extract({}, '^\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE)"


def _asked(spark, root):
    refs = table(spark, root, "bill_section_ref").where("ref_id % 100 = 0")
    return refs.select("ref_id", "law_code", F.rtrim(F.trim("section"), F.lit(".")).alias("section"))


@query(f"SELECT DISTINCT q.ref_id, s.id, s.law_code, s.section_num_norm, s.active_flg FROM {_ASKED} q JOIN law_section s ON q.law_code = s.law_code AND q.section = s.section_num_norm")
def proj1_point_lookup(spark, root):
    """All rows of each asked (code, section)."""
    sections = table(spark, root, "law_section").select("id", "law_code", "section_num_norm", "active_flg")
    return _asked(spark, root).join(sections.withColumn("section", F.col("section_num_norm")), ["law_code", "section"]).select("ref_id", "id", "law_code", "section_num_norm", "active_flg").distinct()


@query(
    f"""SELECT ref_id, section_num_norm AS suggestion, rank FROM (
    SELECT ref_id, section_num_norm, row_number() OVER (PARTITION BY ref_id ORDER BY length(section_num_norm), section_num_norm) AS rank
    FROM (SELECT DISTINCT ref_id, law_code, left(section, 2) AS prefix FROM {_ASKED} WHERE section IS NOT NULL) q
    JOIN (SELECT DISTINCT law_code, section_num_norm FROM law_section WHERE section_num_norm IS NOT NULL) s
    ON q.law_code = s.law_code AND s.section_num_norm ILIKE q.prefix || '%') WHERE rank <= 10"""
)
def proj2_prefix_suggest(spark, root):
    """Ten suggestions that begin like the asked section, the shortest first."""
    asked = _asked(spark, root).where("section is not null").select("ref_id", "law_code", F.lower(F.substring("section", 1, 2)).alias("prefix")).distinct()
    known = table(spark, root, "law_section").where("section_num_norm is not null").select("law_code", "section_num_norm").distinct()
    # The ten best of each prefix of up to two characters, found before any question meets them.
    prefixes = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda n: F.lower(F.left(F.col("section_num_norm"), n))))
    best = Window.partitionBy("law_code", "prefix").orderBy(F.length("section_num_norm"), "section_num_norm")
    known = known.withColumn("prefix", F.explode(prefixes)).withColumn("rank", F.row_number().over(best)).where("rank <= 10")
    return asked.join(known, ["law_code", "prefix"]).select("ref_id", F.col("section_num_norm").alias("suggestion"), F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""SELECT ref_id, law_code, section_num_norm, round(gap, 6) AS gap, rank FROM (
    SELECT q.ref_id, q.law_code, s.section_num_norm, abs(q.num - s.val) AS gap, row_number() OVER (PARTITION BY q.ref_id, q.law_code ORDER BY abs(q.num - s.val), s.section_num_norm) AS rank
    FROM (SELECT DISTINCT ref_id, law_code, {_NUM.format("section")} AS num FROM {_ASKED}) q
    JOIN (SELECT DISTINCT law_code, section_num_norm, {_NUM.format("section_num_norm")} AS val FROM law_section) s ON q.law_code = s.law_code
    WHERE q.num IS NOT NULL AND s.val IS NOT NULL) WHERE rank <= 5"""
)
def proj3_nearest_number(spark, root):
    """The five sections of the code nearest by number."""
    asked = _asked(spark, root).select("ref_id", "law_code", leading_number(F.col("section")).alias("num")).distinct()
    held = table(spark, root, "law_section").select("law_code", "section_num_norm").distinct().withColumn("val", leading_number(F.col("section_num_norm")))
    best = nearest(asked, "ref_id", "num", held, "section_num_norm", "val", ["law_code"], 5)
    return best.select("ref_id", "law_code", "section_num_norm", F.round("gap", 6).alias("gap"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag")
def proj4_in_list(spark, root):
    """Membership in a small list."""
    return table(spark, root, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN is_range = '1' THEN 'range' WHEN struct IS NOT NULL THEN 'struct' WHEN section IS NOT NULL THEN 'section' ELSE 'none' END AS kind, count(*) AS n FROM bill_section_ref GROUP BY 1")
def proj5_candidates(spark, root):
    """P5: references by what makes them candidates."""
    kind = F.when(F.col("is_range") == "1", "range").when(F.col("struct").isNotNull(), "struct").when(F.col("section").isNotNull(), "section").otherwise("none")
    return table(spark, root, "bill_section_ref").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT substr(bill_id, 1, 8) AS session, count(*) AS n FROM bill_version WHERE bill_id LIKE '20%' GROUP BY 1")
def proj6_session_scope(spark, root):
    """Versions by the session that their id begins with."""
    return table(spark, root, "bill_version").where(F.col("bill_id").startswith("20")).groupBy(F.substring("bill_id", 1, 8).alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (content_text IS NOT NULL) AS present, count(*) FILTER (length(content_text) > 100) AS long, count(*) AS n FROM law_section")
def proj7_content(spark, root):
    """Sections with text, and with more than a stub of it."""
    return table(spark, root, "law_section").agg(F.count("content_text").alias("present"), F.count_if(F.length("content_text") > 100).alias("long"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT v.bill_version_id, t.bill_version_id IS NOT NULL AS has_text FROM bill_version v LEFT JOIN bill_version_text t USING (bill_version_id)")
def proj9_presence(spark, root):
    """Versions with a flag for their text."""
    versions, texts = _tables(spark, root, "bill_version", "bill_version_text")
    return flagged(versions.select("bill_version_id").distinct(), ["bill_version_id"], texts, "has_text")


@query(
    "SELECT ref_id, '{\"action\":\"' || action || '\"' || coalesce(',\"section\":\"' || section || '\"', '') || coalesce(',\"range_end\":\"' || range_end || '\"', '') || coalesce(',\"struct\":\"' || struct || '\"', '') || '}' AS ref FROM (SELECT DISTINCT ref_id, action, section, range_end, struct FROM bill_section_ref WHERE action IS NOT NULL)"
)
def proj10_optional_keys(spark, root):
    """P10: references as JSON that leaves absent keys out."""
    refs = table(spark, root, "bill_section_ref").where("action is not null").select("ref_id", "action", "section", "range_end", "struct").distinct()
    return refs.select("ref_id", F.to_json(F.struct("action", "section", "range_end", "struct")).alias("ref"))


@query(
    "SELECT DISTINCT r.ref_id, b.bill_id, r.law_code, r.section, r.action FROM bill_section_ref r JOIN bill b ON r.bill_id = b.bill_id AND r.bill_version_id = b.latest_bill_version_id"
)
def j1_pointer_join(spark, root):
    """References of the version that the bill points to."""
    refs, bills = _tables(spark, root, "bill_section_ref", "bill")
    latest = bills.select("bill_id", F.col("latest_bill_version_id").alias("bill_version_id"))
    return refs.join(latest, ["bill_id", "bill_version_id"]).select("ref_id", "bill_id", "law_code", "section", "action").distinct()


@query("SELECT DISTINCT bill_version_id, v.version_num, octet_length(t.text_zlib) AS bytes FROM bill_version v JOIN bill_version_text t USING (bill_version_id)")
def j2_inner(spark, root):
    """Versions with their text's packed size."""
    versions, texts = _tables(spark, root, "bill_version", "bill_version_text")
    sizes = texts.select("bill_version_id", F.octet_length("text_zlib").cast("bigint").alias("bytes"))
    return versions.select("bill_version_id", "version_num").distinct().join(sizes, "bill_version_id").distinct()


@query(
    "SELECT l_orderkey, l_linenumber, s.n FROM lineitem LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) s USING (l_partkey, l_suppkey)"
)
def j4_composite_left(spark, root):
    """Left join on two keys."""
    items = table(spark, root, "lineitem")
    returned = items.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return items.join(returned, ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "n")


@query("SELECT r.ref_id, c.title FROM (SELECT DISTINCT ref_id, law_code FROM bill_section_ref) r LEFT JOIN codes c ON r.law_code = c.code")
def j5_dimension(spark, root):
    """Left join to a dimension."""
    refs, codes = _tables(spark, root, "bill_section_ref", "codes")
    return refs.select("ref_id", F.col("law_code").alias("code")).distinct().join(codes, "code", "left").select("ref_id", "title")


@query(
    "SELECT DISTINCT r.ref_id, b.chapter_num, CAST(v.action_date AS VARCHAR) AS chaptered FROM bill_section_ref r JOIN bill b ON r.bill_id = b.bill_id AND r.bill_version_id = b.latest_bill_version_id LEFT JOIN bill_version v ON v.bill_version_id = b.latest_bill_version_id"
)
def j6_three_way(spark, root):
    """References, their bill by its pointer, and the pointed version's date."""
    refs, bills, versions = _tables(spark, root, "bill_section_ref", "bill", "bill_version")
    latest = bills.select("bill_id", F.col("latest_bill_version_id").alias("bill_version_id"), "chapter_num")
    dated = versions.select("bill_version_id", F.date_format("action_date", "yyyy-MM-dd HH:mm:ss").alias("chaptered")).distinct()
    return refs.join(latest, ["bill_id", "bill_version_id"]).join(dated, "bill_version_id", "left").select("ref_id", "chapter_num", "chaptered").distinct()


_LIVE = "(SELECT DISTINCT law_code, section_num_norm AS section FROM law_section WHERE active_flg = 'Y')"


@query(f"SELECT DISTINCT r.ref_id, s.section IS NOT NULL AS exists_now FROM bill_section_ref r LEFT JOIN {_LIVE} s ON r.law_code = s.law_code AND r.section = s.section")
def j7_existence_flag(spark, root):
    """Whether each referenced section is current law."""
    refs, sections = _tables(spark, root, "bill_section_ref", "law_section")
    live = sections.where("active_flg = 'Y'").select("law_code", F.col("section_num_norm").alias("section"))
    return flagged(refs.select("ref_id", "law_code", "section").distinct(), ["law_code", "section"], live, "exists_now").select("ref_id", "exists_now").distinct()


@query(f"SELECT session_year, count(*) AS missing FROM (SELECT DISTINCT session_year, ref_id, law_code, section FROM bill_section_ref) r WHERE NOT EXISTS (SELECT 1 FROM {_LIVE} s WHERE r.law_code = s.law_code AND r.section = s.section) GROUP BY session_year")
def j8_missing(spark, root):
    """References without a current section, per session."""
    refs, sections = _tables(spark, root, "bill_section_ref", "law_section")
    live = sections.where("active_flg = 'Y'").select("law_code", F.col("section_num_norm").alias("section"))
    return refs.select("session_year", "ref_id", "law_code", "section").distinct().join(live, ["law_code", "section"], "left_anti").groupBy("session_year").agg(F.count(F.lit(1)).alias("missing"))


@query(
    f"""SELECT r.ref_id, s.section_num_norm FROM
    (SELECT DISTINCT ref_id, law_code, {_NUM.format("section")} AS lo, {_NUM.format("range_end")} AS hi FROM bill_section_ref WHERE is_range = '1') r
    JOIN (SELECT DISTINCT law_code, section_num_norm, {_NUM.format("section_num_norm")} AS num FROM law_section) s
    ON r.law_code = s.law_code AND r.lo <= s.num AND s.num <= r.hi"""
)
def j9_range_containment(spark, root):
    """Sections inside referenced ranges, both ends included."""
    refs, sections = _tables(spark, root, "bill_section_ref", "law_section")
    ranges = refs.where("is_range = '1'").select("ref_id", "law_code", leading_number(F.col("section")).alias("lo"), leading_number(F.col("range_end")).alias("hi")).distinct()
    points = sections.select("law_code", "section_num_norm").distinct().withColumn("num", leading_number(F.col("section_num_norm")))
    return contained(points, "num", ranges, "lo", "hi", ["law_code"]).select("ref_id", "section_num_norm")


@query(
    f"""SELECT r.ref_id, s.section_num_norm FROM
    (SELECT DISTINCT ref_id, law_code, {_NUM.format("regexp_extract(struct, 'Section ([0-9.]+)', 1)")} AS lo FROM bill_section_ref WHERE struct IS NOT NULL) r
    JOIN (SELECT DISTINCT law_code, section_num_norm, {_NUM.format("section_num_norm")} AS num FROM law_section) s
    ON r.law_code = s.law_code AND s.num - r.lo > 0 AND s.num - r.lo <= 100"""
)
def j10_band_nearby(spark, root):
    """Sections up to 100 above the start of a referenced structural unit."""
    refs, sections = _tables(spark, root, "bill_section_ref", "law_section")
    units = refs.where("struct is not null").select("ref_id", "law_code", leading_number(F.regexp_extract("struct", r"Section ([0-9.]+)", 1)).alias("lo")).distinct()
    points = sections.select("law_code", "section_num_norm").distinct().withColumn("num", leading_number(F.col("section_num_norm")))
    return band(points, "num", units, "lo", 100.0, ["law_code"]).select("ref_id", "section_num_norm")


@query(
    """SELECT a.event_id, max(struct_pack(ts := b.ts, id := b.event_id)).id AS prior FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts GROUP BY a.event_id"""
)
def j11_asof_prior(spark, root):
    """Each event's latest strictly earlier event of its user, the larger id on ties."""
    events = table(spark, root, "events").select("event_id", "user_id", "ts")
    return as_of(events, events, "user_id", "ts", "event_id").select("event_id", "prior")


@query(
    "SELECT o_custkey, o_orderkey, store FROM (SELECT *, min(store) OVER (PARTITION BY o_custkey) AS best FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS store FROM orders)) WHERE store = best"
)
def j12_priority_lookup(spark, root):
    """A customer's open orders, or the others where there are none."""
    orders = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    stores = [orders.where("o_orderstatus = 'O'").drop("o_orderstatus"), orders.where("o_orderstatus <> 'O'").drop("o_orderstatus")]
    return first_store(stores, ["o_custkey"])


@query("SELECT bill_id, list_sort(list(DISTINCT action)) AS actions FROM (SELECT bill_id, action FROM bill_section_ref WHERE session_year >= '2023' UNION ALL SELECT bill_id, action FROM bill_section_ref WHERE session_year < '2023') WHERE action IS NOT NULL GROUP BY bill_id")
def j13_concat_dedup(spark, root):
    """References of two stores together, deduplicated by bill."""
    refs = table(spark, root, "bill_section_ref").where("action is not null").select("bill_id", "action", "session_year")
    both = refs.where("session_year >= '2023'").unionByName(refs.where("session_year < '2023'"))
    return both.groupBy("bill_id").agg(F.array_sort(F.collect_set("action")).alias("actions"))


_PATHS = "(SELECT id, law_code || '.' || coalesce(rtrim(division, '.'), '-') || '.' || coalesce(rtrim(chapter, '.'), '-') AS path FROM law_section WHERE law_code IS NOT NULL)"


def _toc(spark, root):
    part = lambda c: F.coalesce(F.rtrim(F.col(c), F.lit(".")), F.lit("-"))
    return table(spark, root, "law_section").where("law_code is not null").select("id", F.concat_ws(".", "law_code", part("division"), part("chapter")).alias("path"))


@query(
    f"""SELECT n.id, list(h.heading ORDER BY h.depth) AS hierarchy FROM {_PATHS} n
    JOIN (SELECT DISTINCT path, 1 AS depth, 'Code ' || path AS heading FROM (SELECT split_part(path, '.', 1) AS path FROM {_PATHS})
          UNION SELECT DISTINCT p, 2, 'Division ' || p FROM (SELECT array_to_string(string_split(path, '.')[1:2], '.') AS p FROM {_PATHS})
          UNION SELECT DISTINCT path, 3, 'Chapter ' || path FROM {_PATHS} WHERE len(string_split(path, '.')) = 3) h
    ON h.path = array_to_string(string_split(n.path, '.')[1:h.depth], '.') GROUP BY n.id"""
)
def j15_tree_path(spark, root):
    """Headings above each section, from materialized paths."""
    nodes = _toc(spark, root)
    depth = F.size(F.split("path", "\\."))
    above = nodes.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("depth", depth).where("depth <= 3")
    name = F.when(F.col("depth") == 1, "Code ").when(F.col("depth") == 2, "Division ").otherwise("Chapter ")
    return with_headings(nodes, "id", "path", above.select("path", F.concat(name, F.col("path")).alias("heading")), "path", "heading")


@query(
    "SELECT b.bill_id, h.last_action, v.subject FROM bill b LEFT JOIN (SELECT bill_id, CAST(max(action_date) AS VARCHAR) AS last_action FROM bill_history GROUP BY bill_id) h USING (bill_id) LEFT JOIN (SELECT bill_version_id, max(subject) AS subject FROM bill_version GROUP BY ALL) v ON v.bill_version_id = b.latest_bill_version_id"
)
def j16_decorrelated(spark, root):
    """What would be a lookup a row, as one aggregate and joins."""
    bills, history, versions = _tables(spark, root, "bill", "bill_history", "bill_version")
    last = history.groupBy("bill_id").agg(F.date_format(F.max("action_date"), "yyyy-MM-dd HH:mm:ss").alias("last_action"))
    subject = versions.groupBy(F.col("bill_version_id").alias("latest_bill_version_id")).agg(F.max("subject").alias("subject"))
    return bills.join(last, "bill_id", "left").join(subject, "latest_bill_version_id", "left").select("bill_id", "last_action", "subject")


_COUNTS = ("bill", "bill_version", "bill_version_text", "bill_section_ref", "bill_history", "law_section", "codes", "lob_manifest")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in _COUNTS))
def a1_counts(spark, root):
    """A1: rows of each table."""
    return reduce(DataFrame.unionByName, [table(spark, root, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n") for t in _COUNTS])


@query("SELECT count(*) AS groups FROM (SELECT 1 FROM law_section GROUP BY law_code, section_num_norm HAVING count(*) > 1)")
def a2_dup_groups(spark, root):
    """A2: keys that several rows share."""
    return table(spark, root, "law_section").groupBy("law_code", "section_num_norm").count().where("count > 1").agg(F.count(F.lit(1)).alias("groups"))


@query("SELECT count(*) FILTER (section SIMILAR TO '[0-9]+(\\.[0-9]+)*') AS shaped, count(*) AS n FROM bill_section_ref")
def a3_cond_sum(spark, root):
    """A3: references whose key has the shape of a key."""
    return table(spark, root, "bill_section_ref").agg(F.count_if(F.col("section").rlike(r"\A[0-9]+(\.[0-9]+)*\z")).alias("shaped"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(max(m) AS VARCHAR) AS extracted FROM (SELECT max(trans_update) AS m FROM bill UNION ALL SELECT max(trans_update) FROM bill_version UNION ALL SELECT max(trans_update) FROM bill_history UNION ALL SELECT max(trans_update) FROM law_section)")
def a4_max_union(spark, root):
    """The latest time of several tables."""
    parts = [table(spark, root, t).agg(F.max("trans_update").alias("m")) for t in ("bill", "bill_version", "bill_history", "law_section")]
    return reduce(DataFrame.unionByName, parts).agg(F.date_format(F.max("m"), "yyyy-MM-dd HH:mm:ss").alias("extracted"))


@query("SELECT coalesce(sum(octet_length(text_zlib)), 0) AS bytes FROM bill_version_text")
def a6_bytes(spark, root):
    """Packed bytes of all texts."""
    return table(spark, root, "bill_version_text").agg(F.coalesce(F.sum(F.octet_length("text_zlib")), F.lit(0)).alias("bytes"))


@query("SELECT lang, kind, count(*) AS n FROM documents GROUP BY ALL")
def a7_histogram(spark, root):
    """Counts by class."""
    return table(spark, root, "documents").groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT session_year, count(*) AS n, round(count(*) FILTER (action IS NOT NULL AND law_code IS NOT NULL) * 1.0 / nullif(count(*), 0), 6) AS ratio, count(*) FILTER (action IS NOT NULL AND law_code IS NOT NULL) * 100 >= count(*) * 99 AS ok FROM bill_section_ref GROUP BY session_year")
def a8_ratio_gate(spark, root):
    """Share of classified references per session, against 99 percent."""
    good = F.count_if(F.col("action").isNotNull() & F.col("law_code").isNotNull())
    n = F.count(F.lit(1))
    return table(spark, root, "bill_section_ref").groupBy("session_year").agg(n.alias("n"), F.round(good / F.nullif(n, F.lit(0)), 6).alias("ratio"), (good * 100 >= n * 99).alias("ok"))


@query("SELECT bill_id, list(x ORDER BY ref_id) AS refs FROM (SELECT DISTINCT bill_id, ref_id, ref_id || ':' || coalesce(action, '') || ':' || coalesce(section, '') AS x FROM bill_section_ref WHERE bill_id IS NOT NULL) GROUP BY bill_id")
def a9_ordered_collect(spark, root):
    """The references of each bill in order; the list is the feature, and as long as one bill has references."""
    refs = table(spark, root, "bill_section_ref").where("bill_id is not null").select("bill_id", "ref_id", F.concat_ws(":", F.col("ref_id").cast("string"), F.coalesce("action", F.lit("")), F.coalesce("section", F.lit(""))).alias("x")).distinct()
    return refs.groupBy("bill_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "x"))), lambda r: r["x"]).alias("refs"))


@query("SELECT bill_id, list(action ORDER BY first) AS actions FROM (SELECT bill_id, action, min(ref_id) AS first FROM bill_section_ref WHERE action IS NOT NULL AND bill_id IS NOT NULL GROUP BY ALL) GROUP BY bill_id")
def a10_ordered_distinct(spark, root):
    """Distinct actions in the order of their first occurrence."""
    refs = table(spark, root, "bill_section_ref").where("action is not null and bill_id is not null")
    return ordered_distinct(refs, ["bill_id"], "action", "ref_id", "actions")


@query("SELECT bill_id, arg_min(primary_location, bill_history_id) FILTER (primary_location IS NOT NULL) AS first_location FROM bill_history GROUP BY bill_id")
def a12_first_non_null(spark, root):
    """The first known location of each bill."""
    return table(spark, root, "bill_history").groupBy("bill_id").agg(F.min_by("primary_location", F.when(F.col("primary_location").isNotNull(), F.col("bill_history_id"))).alias("first_location"))


@query("SELECT source, list(doc_id ORDER BY doc_id)[1:5] AS sample FROM documents WHERE source IS NOT NULL AND text IS NULL GROUP BY source")
def a14_sample(spark, root):
    """The first five documents without text of each source, as a report."""
    rank = Window.partitionBy("source").orderBy("doc_id")
    rows = table(spark, root, "documents").where("source is not null and text is null").select("source", "doc_id").withColumn("n", F.row_number().over(rank)).where("n <= 5")
    return rows.groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("sample"))


@query(
    """SELECT session_year, key, value FROM (SELECT session_year, count(*) AS bills, count(chapter_num) AS chaptered, count(latest_bill_version_id) AS pointed FROM bill GROUP BY session_year)
    UNPIVOT (value FOR key IN (bills, chaptered, pointed))"""
)
def a15_coverage(spark, root):
    """One row a metric and session."""
    wide = table(spark, root, "bill").groupBy("session_year").agg(F.count(F.lit(1)).alias("bills"), F.count("chapter_num").alias("chaptered"), F.count("latest_bill_version_id").alias("pointed"))
    return unpivot_metrics(wide, ["session_year"], ["bills", "chaptered", "pointed"])


@query("SELECT law_code, count(DISTINCT bill_id) AS bills FROM bill_section_ref GROUP BY law_code")
def a16_count_distinct(spark, root):
    """Bills that touch each code."""
    return table(spark, root, "bill_section_ref").groupBy("law_code").agg(F.count_distinct("bill_id").alias("bills"))


@query("SELECT bill_id, bill_history_id, row_number() OVER (PARTITION BY bill_id ORDER BY action_date NULLS FIRST, coalesce(TRY_CAST(regexp_extract(action_sequence, '^\\s*([-+]?[0-9]+)', 1) AS BIGINT), 0), bill_history_id) AS pos FROM (SELECT DISTINCT bill_id, bill_history_id, action_date, action_sequence FROM bill_history)")
def o1_action_order(spark, root):
    """O1: each bill's actions by date, then by number, then by id."""
    number = F.coalesce(F.regexp_extract("action_sequence", r"^\s*([-+]?[0-9]+)", 1).try_cast("bigint"), F.lit(0))
    order = Window.partitionBy("bill_id").orderBy(F.col("action_date").asc_nulls_first(), number, "bill_history_id")
    rows = table(spark, root, "bill_history").select("bill_id", "bill_history_id", "action_date", "action_sequence").distinct()
    return rows.select("bill_id", "bill_history_id", F.row_number().over(order).cast("bigint").alias("pos"))


@query("SELECT bill_id, list(bill_version_id ORDER BY num, bill_version_id) AS newest_first FROM (SELECT DISTINCT bill_id, bill_version_id, coalesce(TRY_CAST(version_num AS BIGINT), 0) AS num FROM bill_version WHERE bill_id IS NOT NULL) GROUP BY bill_id")
def o2_newest_first(spark, root):
    """O2: versions count down, so ascending numbers put the newest first."""
    rows = table(spark, root, "bill_version").where("bill_id is not null").select("bill_id", "bill_version_id", F.coalesce(F.col("version_num").try_cast("bigint"), F.lit(0)).alias("num")).distinct()
    return rows.groupBy("bill_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("num", "bill_version_id"))), lambda r: r["bill_version_id"]).alias("newest_first"))


@query("SELECT law_code, section_num_norm, id FROM law_section QUALIFY row_number() OVER (PARTITION BY law_code, section_num_norm ORDER BY coalesce(active_flg = 'Y', false) DESC, id) = 1")
def o4_flag_sort_pick(spark, root):
    """Of the rows of a section the live one, then the first."""
    live = F.coalesce(F.col("active_flg") == "Y", F.lit(False))
    order = Window.partitionBy("law_code", "section_num_norm").orderBy(live.desc(), "id")
    return table(spark, root, "law_section").select("law_code", "section_num_norm", "id", F.row_number().over(order).alias("n")).where("n = 1").drop("n")


@query("SELECT law_code, section_num_norm, max(length(content_text)) AS longest FROM law_section GROUP BY ALL")
def o5_longest(spark, root):
    """The longest text of each section."""
    rows = table(spark, root, "law_section").groupBy("law_code", "section_num_norm").agg(F.max_by("content_text", F.length("content_text")).alias("text"))
    return rows.select("law_code", "section_num_norm", F.length("text").cast("bigint").alias("longest"))


@query("SELECT bill_id, chapter_year FROM bill ORDER BY coalesce(TRY_CAST(chapter_year AS INT), 0) DESC, bill_id LIMIT 100")
def o6_cap(spark, root):
    """The hundred latest, a stated cap with a total order."""
    year = F.coalesce(F.col("chapter_year").try_cast("int"), F.lit(0))
    return table(spark, root, "bill").select("bill_id", "chapter_year").orderBy(year.desc(), "bill_id").limit(100)


@query("SELECT session_year, bool_or(chapter_num IS NOT NULL) AS any_chaptered FROM bill GROUP BY session_year")
def o9_exists_probe(spark, root):
    """Whether there is any."""
    return table(spark, root, "bill").groupBy("session_year").agg(F.bool_or(F.col("chapter_num").isNotNull()).alias("any_chaptered"))


@query("SELECT n_nationkey AS k, 'nation' AS tbl FROM nation UNION ALL SELECT c_nationkey, 'customer' FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def u2_bag_union(spark, root):
    """Union that keeps repeats."""
    nation, customer, supplier = _tables(spark, root, "nation", "customer", "supplier")
    return reduce(DataFrame.unionByName, [nation.select(F.col("n_nationkey").alias("k"), F.lit("nation").alias("tbl")), customer.select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("tbl")), supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("tbl"))])


@query("SELECT DISTINCT law_code, section_num_norm FROM law_section")
def u3_distinct(spark, root):
    """Distinct keys."""
    return table(spark, root, "law_section").select("law_code", "section_num_norm").distinct()


@query("SELECT bill_version_id FROM bill_version EXCEPT SELECT bill_version_id FROM bill_version_text")
def u4_except(spark, root):
    """U4: versions without a row of text."""
    versions, texts = _tables(spark, root, "bill_version", "bill_version_text")
    return versions.select("bill_version_id").subtract(texts.select("bill_version_id"))


@query("SELECT bill_id, bill_history_id, action FROM bill_history QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY trans_update DESC NULLS LAST, bill_history_id DESC) = 1")
def t8_last_write(spark, root):
    """The row written last of each bill."""
    return last_write(table(spark, root, "bill_history"), ["bill_id"], [F.col("trans_update"), F.col("bill_history_id")]).select("bill_id", "bill_history_id", "action")
