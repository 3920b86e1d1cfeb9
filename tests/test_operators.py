"""Operators on DataFrames against plain Python."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lawloom.functions.blobs import pack
from lawloom.functions.keys import CodeBook
from lawloom.operators import search as S
from lawloom.operators import text as X
from lawloom.operators.intervals import as_of, band, contained, nearest
from lawloom.operators.limiter import allow, limit_hits
from lawloom.operators.matching import matches
from lawloom.operators.quality import Check, age_in_days, era_notes, gate, metrics, not_worse, passed
from lawloom.operators.relational import ancestors, first_store, flagged, last_write, meeting, ordered_distinct, unpivot_metrics, with_headings
from lawloom.operators.text import prior_ladder
from lawloom.operators.versions import pick_version, predecessors, prior_chapter, resolve_chapters, walk
from lawloom.plans.search_queries import f6_snippet

RNG = random.Random(7)


# --- joins without equal keys


def test_contained(spark):
    points = [(RNG.choice("ab"), round(RNG.uniform(0, 5000), 1), k) for k in range(200)] + [("a", None, 900), (None, 1.0, 901)]
    ranges = [(RNG.choice("ab"), x := round(RNG.uniform(0, 5000), 1), round(x + RNG.choice([0, 0.5, 3, 100, 4000]), 1), k) for k in range(60)] + [("a", 5.0, 1.0, 900), ("a", None, 1.0, 901), ("b", 1.0, None, 902)]
    got = contained(spark.createDataFrame(points, "g string, x double, p int"), "x", spark.createDataFrame(ranges, "g string, lo double, hi double, r int"), "lo", "hi", ["g"]).select("p", "r").collect()
    want = {(p, r) for g, x, p in points for h, lo, hi, r in ranges if g == h and None not in (x, lo, hi) and lo <= x <= hi}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = spark.createDataFrame([], "g string, lo double, hi double, r int")
    assert contained(spark.createDataFrame(points, "g string, x double, p int"), "x", none, "lo", "hi", ["g"]).count() == 0


def test_band(spark):
    left = [("a", float(k)) for k in range(0, 400, 7)] + [("a", None)]
    right = [("a", float(k)) for k in range(0, 400, 13)] + [("b", 5.0)]
    got = band(spark.createDataFrame(left, "g string, x double"), "x", spark.createDataFrame(right, "g string, y double"), "y", 100.0, ["g"]).collect()
    want = {(x, y) for g, x in left for h, y in right if g == h and x is not None and 0 < x - y <= 100}
    assert len(got) == len(want) and {(r.x, r.y) for r in got} == want


def test_nearest(spark):
    queries = [(RNG.choice("ab"), k, RNG.uniform(0, 20_000)) for k in range(20)] + [("a", 99, None), ("z", 98, 1.0)]
    rows = [(g, f"r{k}", float(RNG.randint(0, 20_000))) for k in range(80) for g in "ab"]
    got = {(r.q, r["rank"]): r.r for r in nearest(spark.createDataFrame(queries, "g string, q int, x double"), "q", "x", spark.createDataFrame(rows, "g string, r string, y double"), "r", "y", ["g"], 5).collect()}
    want = {}
    for g, q, x in queries:
        if x is not None:
            near = sorted((abs(x - y), r) for h, r, y in rows if h == g)[:5]
            want |= {(q, n): r for n, (_, r) in enumerate(near, 1)}
    assert got == want
    empty = spark.createDataFrame([], "g string, r string, y double")
    assert nearest(spark.createDataFrame(queries, "g string, q int, x double"), "q", "x", empty, "r", "y", ["g"], 5).count() == 0


def test_as_of(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, RNG.choice(["a", "b", None]), start + dt.timedelta(hours=RNG.randint(0, 200)) if RNG.random() > 0.05 else None) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, u string, at timestamp_ntz")
    got = {r.id: r.prior for r in as_of(df, df, "u", "at", "id", slice_seconds=36_000).collect()}
    want = {i: max(((t2, j) for j, u2, t2 in rows if u and u2 == u and t and t2 and t2 < t), default=(None, None))[1] for i, u, t in rows}
    assert got == want


def test_matches(spark):
    refs = [(1, "A", "12", False, None, None), (2, "A", "10", True, "20", None), (3, "A", "10", True, "11", "Chapter 1"), (4, "A", "1", False, None, "Chapter 2"), (5, "A", "12", True, "13", "Part"), (6, "B", "12", False, None, None), (7, None, None, False, None, None), (8, "A", "x", True, None, None)]
    sections = spark.createDataFrame([("A", "12"), ("A", "12"), ("A", None)], "code string, key string")
    got = {(r.ref_id, r.kind) for r in matches(spark.createDataFrame(refs, "ref_id int, code string, section string, is_range boolean, range_end string, struct string"), sections).collect()}
    assert got == {(1, "direct"), (2, "range"), (4, "structural_add_nearby"), (5, "direct")}


# --- relational idioms


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 1, "z")], "k string, n int, v string")
    assert {(r.k, r.n) for r in last_write(df, ["k"], [F.col("n")]).collect()} == {("a", 2), ("b", 1), (None, 1)}
    assert {(r.k, r.here) for r in flagged(df.select("k").distinct(), ["k"], df.where("n = 2"), "here").collect()} == {("a", True), ("b", False), (None, False)}
    stores = [df.where("k = 'b'").select("k", "n"), df.select("k", "n")]
    assert sorted((str(r.k), r.n, r.store) for r in first_store(stores, ["k"]).collect()) == [("None", 1, 1), ("a", 1, 1), ("a", 2, 1), ("b", 1, 0)]
    many = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 2, "x"), ("a", 0, None)], "k string, n int, v string")
    assert ordered_distinct(many, ["k"], "v", "n", "v").first().v == ["y", "x"]
    assert df.select(ancestors(F.lit("a.b.c")).alias("p")).first().p == ["a", "a.b", "a.b.c"]
    nodes = spark.createDataFrame([(1, "a.b"), (2, "z"), (3, None)], "id int, path string")
    heads = spark.createDataFrame([("a", "A"), ("a.b", "AB")], "path string, heading string")
    assert {r.id: r.hierarchy for r in with_headings(nodes, "id", "path", heads, "path", "heading").collect()} == {1: ["A", "AB"], 2: [], 3: []}
    assert {(r.key, r.value) for r in unpivot_metrics(spark.createDataFrame([("s", 1, 2)], "k string, a int, b int"), ["k"], ["a", "b"]).collect()} == {("a", 1), ("b", 2)}


# --- versions


def test_prior_ladder(spark):
    rows = [
        ("added", "Added by Stats. 1950, Ch. 1.", None, None, None, 1950, 1),
        ("block added", None, "added to the Code, to read", None, None, 2000, 1),
        ("note", "Amended (as amended by Stats. 1977, Ch. 5, Sec. 17) by Stats. 1980, Ch. 1.", None, "as added by Section 3 of Chapter 9 of the Statutes of 1970", None, 1980, 1),
        ("lineage", None, "amended to read", "as added by Section 3 of Chapter 9 of the Statutes of 1970", None, 1980, 1),
        ("sibling", None, "amended to read", "as amended by Section 1 of Chapter 1 of the Statutes of 1980", "as added by Chapter 8 of the Statutes of 1969", 1980, 1),
        ("earlier", "Amended by Stats. 1980, Ch. 1.", None, None, None, 1980, 1),
        ("lost", None, None, None, None, None, None),
    ]
    anchors = spark.createDataFrame([("C", *r) for r in rows], "code string, anchor_id string, note string, action string, lineage string, sibling string, year int, chapter int")
    earlier = spark.createDataFrame([("C", "earlier", 1960, 7), ("C", "note", 1961, 7), ("C", "added", 1962, 7)], "code string, anchor_id string, year int, chapter int")
    got = {r.anchor_id: (r.rung, r.year, r.chapter, r.act_section) for r in prior_ladder(anchors, ["code"], earlier).collect()}
    assert got == {
        "added": ("added", None, None, None), "block added": ("added", None, None, None), "note": ("note", 1977, 5, "17"), "lineage": ("lineage", 1970, 9, "3"),
        "sibling": ("sibling", 1969, 8, None), "earlier": ("earlier_chapter", 1960, 7, None), "lost": ("untraceable", None, None, None),
    }
    assert prior_ladder(anchors.limit(0), ["code"], earlier).count() == 0


def test_versions(spark):
    rows = [("b", "v1", "99", dt.datetime(2020, 1, 1), "Introduced"), ("b", "v2", "98", dt.datetime(2020, 3, 1), "Amended once"), ("b", "v3", "97", dt.datetime(2020, 3, 9), "AMENDED twice"), ("b", "v3", "97", dt.datetime(2020, 3, 9), "AMENDED twice"), ("c", "w", None, None, None), (None, "x", "1", None, None)]
    df = spark.createDataFrame(rows, "bill_id string, bill_version_id string, version_num string, action_date timestamp_ntz, action string")
    assert {(r.bill_version_id, r.prior) for r in predecessors(df, "bill_id", "bill_version_id", "version_num").collect()} == {("v3", "v2"), ("v2", "v1"), ("v1", None), ("w", None)}
    pick = lambda spec: {(r.bill_id, r.bill_version_id, r.fits) for r in pick_version(df.where("bill_id = 'b'"), spec).collect()}
    assert pick(None) == {("b", "v3", 3)} and pick("98") == {("b", "v2", 1)} and pick("amended") == {("b", "v3", 2)}
    assert pick("2020-03") == {("b", "v3", 2)} and pick("v1") == {("b", "v1", 1)} and pick("nothing") == set()


def test_walk(spark):
    edges = [(k, k - 1 if k else None) for k in range(60)] + [(100, 100), (200, 999)]
    got = {r.n: (r.last, r.hops) for r in walk(spark.createDataFrame(edges, "n int, p int"), "n", "p").collect()}
    assert got[0] == (0, 0) and got[10] == (0, 10) and got[25] == (0, 25) and got[59] == (34, 25)
    assert got[100] == (100, 0) and got[200] == (999, 1)


def test_chapters(spark):
    bills = spark.createDataFrame([(2001, 5, "b2"), (2001, 5, "b1"), (2002, 1, "c")], "year int, chapter int, bill_id string")
    events = spark.createDataFrame([(2001, 5), (1999, 1)], "year int, chapter int")
    assert {(r.year, r.bill_id, r.ties) for r in resolve_chapters(events, bills, ["year", "chapter"]).collect()} == {(2001, "b1", 1), (1999, None, None)}
    rows = [("s", "a", "2001-01-02", 2001, 9), ("s", "b", "2001-01-02", 2001, 3), ("s", "c", "2003-01-01", 2003, 1), ("s", "d", None, 1999, 7), ("t", "e", "2003-01-01", 2003, 2)]
    df = spark.createDataFrame(rows, "k string, id string, date string, year int, chapter int")
    got = {r.anchor_id: r.prior for r in prior_chapter(df.withColumnRenamed("id", "anchor_id"), df.withColumnRenamed("id", "cand_id"), ["k"]).collect()}
    assert got == {"c": "a", "a": "d", "b": "d"}


# --- search


DOCS = [(1, "The agency shall record. The café dealer."), (2, "dealer dealer agency"), (3, "shall shall shall"), (4, None), (5, ""), (6, "Record shall, cafés! agency one two three dealer"), (7, "w " * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "x") for d in DOCS], "id int, text string, term string")


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("agency", {1, 2, 6}), ("AGENCY dealer", {1, 2, 6}), ("cafe", {1}), ("caf*", {1, 6}), ('"shall record"', {1}), ("shall NOT agency", {3}),
        ("(record OR dealer) AND shall", {1, 6}), ("NEAR(agency dealer, 2)", {2}), ("NEAR(dealer agency, 3)", {2, 6}), ("NEAR(dealer agency, 4)", {1, 2, 6}), ("nothing", set()), ('"w w w"', {7}),
    ],
)
def test_matching(docs, expression, want):
    tree = S.parse_match(expression)
    assert {r.id for r in S.matching(tree, S.postings(docs, "id", "text"), "id").collect()} == want
    assert {r.id for r in docs.where(S.matches_text(tree, F.col("text"))).collect()} == want


def test_index(spark, docs, tmp_path):
    docs = docs.withColumn("source", F.lit("s"))
    S.write_index(docs, "id", "text", str(tmp_path / "index"), carried="source")
    index = S.read_index(spark, str(tmp_path / "index"))
    assert index.size.first().docs == 7 and index.posted.count() == S.postings(docs, "id", "text").count() and index.posted.where("source <> 's'").isEmpty()
    for expression in ("agency", "caf*", "(record OR dealer) AND shall", "NEAR(dealer agency, 4)", "agen* deal*"):
        tree = S.parse_match(expression)
        words, prefixes = S.words_of(tree)
        some = index.of(words, prefixes)
        assert {r.id for r in S.matching(tree, some, "id").collect()} == {r.id for r in S.matching(tree, S.postings(docs, "id", "text"), "id").collect()}
        assert all(r.term in words or r.term.startswith(tuple(prefixes)) for r in some.select("term").collect())
    plan = index.of(["agency"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,agency)" in plan
    S.write_index(docs.limit(0), "id", "text", str(tmp_path / "none"))
    assert S.read_index(spark, str(tmp_path / "none")).size.first().docs == 0


def test_bm25(spark, docs):
    import math

    posted, size = S.postings(docs, "id", "text"), S.corpus_size(docs, "text")
    assert size.first().docs == 7
    asked = spark.createDataFrame([(1, "agency"), (1, "dealer"), (2, "agency"), (2, "absent"), (3, None)], "q int, term string")
    got = [(r.q, r.id) for r in S.bm25(asked, "q", "term", posted, "id", size, 2).orderBy("q", "rank").collect()]
    assert [g[0] for g in got] == [1, 1] and got[0] == (1, 2)
    total = size.first()
    row = S.scores(["shall"], posted, "id", size).where("id = 3").first()
    idf = max(math.log((7 - 3 + 0.5) / 3.5), 1e-6)
    assert math.isclose(row.score, idf * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 3 / total.avgdl)))
    assert S.postings(docs.limit(0), "id", "text").count() == 0 and S.corpus_size(docs.limit(0), "text").first().docs == 0


def _moved(spark, work):
    """What ``work`` returns, and the MB that it shuffled."""
    written = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite() / 1e6
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    got = work()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return got, written() - before


def _best_by_hand(asked, texts, k):
    """BM25 in plain Python: (query, key, rank) of documents (key, text, place); asked is (query, terms, place)."""
    words = {key: text.split() for key, text, _ in texts}
    place = {key: p for key, _, p in texts}
    avgdl, total = sum(map(len, words.values())) / len(words), len(words)
    n = Counter(w for own in words.values() for w in set(own))
    idf = {w: max(math.log((total - n[w] + 0.5) / (n[w] + 0.5)), 1e-6) for w in n}
    found = set()
    for query, terms, at in asked:
        of = [(-round(sum(idf[t] * own.count(t) * 2.2 / (own.count(t) + 1.2 * (0.25 + 0.75 * len(own) / avgdl)) for t in terms), 9), key) for key, own in words.items() if set(terms) <= set(own) and at in (None, place[key])]
        found |= {(query, key, rank) for rank, (_, key) in enumerate(sorted(of)[:k], 1)}
    return found


@pytest.mark.parametrize("number", [int, "k{}".format])
@pytest.mark.parametrize("place", [False, True])
def test_bm25_by_hand(spark, monkeypatch, number, place):
    monkeypatch.setattr(S, "PAGE", 7)
    texts = [(number(k), " ".join(RNG.choices("abcdefgh", k=RNG.randint(1, 9))), RNG.choice("xy")) for k in range(300)]
    asked = [(q, sorted(set(RNG.choices("abcdefghz", k=RNG.randint(1, 4)))), RNG.choice("xyv") if place else None) for q in range(60)]
    docs = spark.createDataFrame(texts, f"key {'int' if number is int else 'string'}, text string, place string").repartition(3)
    queries = spark.createDataFrame([(q, t, p) for q, terms, p in asked for t in terms], "q int, term string, place string")
    within = "place" if place else None
    best = S.bm25(queries if place else queries.drop("place"), "q", "term", S.postings(docs, "key", "text", carried=within), "key", S.corpus_size(docs, "text"), 5, within=within)
    got = [(r.q, r.key, r.rank) for r in best.collect()]
    assert len(got) == len(set(got)) and set(got) == _best_by_hand(asked, texts, 5)


def test_bm25_moves_no_pairs(spark):
    asked = spark.range(400).select(F.col("id").alias("q"), F.explode(F.array(F.lit("alpha"), F.lit("beta"), F.concat(F.lit("w"), F.col("id") % 9))).alias("term"))
    docs = spark.range(3000).select("id", F.concat_ws(" ", F.lit("alpha beta"), F.concat(F.lit("w"), F.col("id") % 9), F.repeat(F.lit("more "), (F.col("id") % 5).cast("int"))).alias("text"))
    best, moved = _moved(spark, lambda: S.bm25(asked, "q", "term", S.postings(docs, "id", "text"), "id", S.corpus_size(docs, "text"), 10).collect())
    assert len(best) == 4000 and moved < 1


def test_snippets_move_no_pairs(spark, tmp_path):
    text = F.concat_ws(" ", F.lit("alphabetical betatesting"), F.concat(F.lit("wwwwwwwww"), F.col("doc_id") % 3), F.repeat(F.lit("more "), (F.col("doc_id") % 5).cast("int")))
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source")).withColumn("text", text).write.parquet(str(tmp_path / "documents.parquet"))
    rows, moved = _moved(spark, lambda: f6_snippet(spark, str(tmp_path)).collect())
    assert len(rows) == 2000 and all(r.snippet.count(">>") == 3 for r in rows) and moved < 1


def test_snippets_move_found_texts_only(spark, tmp_path):
    rng = random.Random(8)
    texts = [(k, f"Alphabetical betatesting w{k % 97:08} " + " ".join(f"{rng.getrandbits(24):06x}" for _ in range(700))) for k in range(2000)]
    spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("source", F.lit("s")).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # as where the documents found are many
    try:
        rows, moved = _moved(spark, lambda: f6_snippet(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    asked = [(q, ["alphabetical", "betatesting", f"w{q % 97:08}"], None) for q in range(0, 2000, 100)]
    best = _best_by_hand(asked, [(k, text.lower(), None) for k, text in texts], 10)
    assert sorted((r.query, r.doc_id) for r in rows) == sorted((q, k) for q, k, _ in best)
    assert all(r.snippet == f">>Alphabetical<< >>betatesting<< >>w{r.query % 97:08}<< " + " ".join(texts[r.doc_id][1].split()[3:12]) + " …" for r in rows)
    assert moved < 2  # the texts take 9


def test_meeting(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{k}", k) for k in range(5000)] + [(None, -1)], "key string, n int")
    some = spark.createDataFrame([(f"k{k}",) for k in (*range(100), *range(50), 9999)], "key string")
    kept = [r.n for r in meeting(rows, some, "key").collect()]
    assert len(kept) == len(set(kept)) and set(range(100)) <= set(kept) and len(kept) < 700
    assert meeting(rows, some.limit(0), "key").count() == 0 and meeting(rows, some, "key").columns == ["key", "n"]
    monkeypatch.setattr("lawloom.operators.relational.MAP", 2)
    assert set(range(100)) <= {r.n for r in meeting(rows, some, "key").collect()}


def test_index_moves_packed(spark, tmp_path):
    texts = [(k, " ".join(RNG.choices([f"word{w}" for w in range(500)], k=150))) for k in range(2000)]
    docs = spark.createDataFrame(texts, "id int, text string").repartition(4)
    _, moved = _moved(spark, lambda: S.write_index(docs, "id", "text", str(tmp_path / "index")))
    index = S.read_index(spark, str(tmp_path / "index"))
    same = ["id", "term", "tf", "dl", "positions"]
    assert index.posted.select(same).exceptAll(S.postings(docs, "id", "text").select(same)).isEmpty() and index.posted.count() == S.postings(docs, "id", "text").count()
    asked = spark.createDataFrame([("word7",)], "t string")
    rows, read = _moved(spark, lambda: index.joined(asked, "t").count())
    assert rows == sum("word7" in t.split() for _, t in texts)
    assert moved < 4 and read < 0.1  # the texts take 2


def test_snippet(spark):
    long = " ".join(f"w{k}" for k in range(30)) + " Café target x y"
    df = spark.createDataFrame([(1, long), (2, "target only"), (3, "nothing here"), (4, None)], "id int, text string")
    got = {r.id: r.s for r in df.select("id", S.snippet(F.col("text"), F.array(F.lit("cafe"), F.lit("target"))).alias("s")).collect()}
    assert got == {1: "… >>Café<< >>target<< x y", 2: ">>target<< only", 3: "nothing here", 4: None}


# --- text operators


def test_text_operators(spark):
    book = CodeBook({"BRG": ("Bridges Code",)})
    titles = spark.createDataFrame([("a", "An act to amend Section 1 of the Bridges Code, relating to x.", 1), ("b", None, 1), ("c", "", 1)], "id string, title string, status int")
    got = {r.id: (r.status, len(r.refs)) for r in X.parse_titles(titles, "id", "title", book).collect()}
    assert got == {"a": ("ok", 1), "b": ("no_title", 0), "c": ("no_sections", 0)}
    notes = spark.createDataFrame([("a", "Stats. 2001, Ch. 5. Stats. 1999, Ch. 1."), ("b", None)], "id string, note string")
    assert [(r.id, r.pos, r.event.year) for r in X.parse_histories(notes, "id", "note").orderBy("pos").collect()] == [("a", 1, 2001), ("a", 2, 1999)]
    bill = "X\nSECTION 1. Section 1 of the Bridges Code is amended to read:\n1. Text."
    bills = spark.createDataFrame([("a", pack(bill)), ("b", None), ("c", b"broken"), ("d", pack(""))], "id string, body binary")
    assert [(r.id, r.code_name, r.section, r.block.body) for r in X.enacting_blocks(bills, "id", "body", packed=True).collect()] == [("a", "Bridges Code", "1", "Text.")]
    assert {r.id: r.status for r in X.block_index(bills, "id", "body", packed=True, whole_up_to=10).collect()} == {"a": "index", "b": "unavailable", "c": "unavailable", "d": "whole"}
    pairs = spark.createDataFrame([(1, "a b", "a b", 0), (2, "a b", "a c", 0), (3, None, "x", 0), (4, None, None, 0), (5, "a" * 60_000, "b" * 60_000, 0)], "id int, old string, new string, changes int")
    made = X.redlines(pairs, ["id"], "old", "new")
    assert {r.id: (r.identical, r.markdown, bool(r.refused)) for r in made.collect()} == {1: (True, "a b", False), 2: (False, "a ~~b~~ *c*", False), 3: (False, "*x*", False), 5: (False, None, True)}
    assert {(r.id, r.kind, r.n, r.chars) for r in X.change_counts(made, ["id"]).collect()} == {(2, "edit", 1, 2), (3, "new_provision", 1, 1)}
    files = spark.createDataFrame([(1, b"plain"), (2, b"PK bad"), (3, None)], "id int, body binary")
    assert {r.id: (r.format, r.error is None) for r in X.extract_documents(files, "id", "body").collect()} == {1: ("text", True), 2: ("docx", False), 3: (None, False)}
    markup = spark.createDataFrame([(1, "<x:Title>A</x:Title><p>b</p>"), (2, None)], "id int, markup string")
    assert {(r.id, r.title, r.text) for r in X.flatten_bills(markup, "id", "markup").collect()} == {(1, "A", "Ab"), (2, None, None)}
    assert X.parse_titles(titles.limit(0), "id", "title", book).count() == 0


def test_converter(spark, tmp_path):
    tool = tmp_path / "convert"
    tool.write_text('#!/bin/sh\nshift 5\nout=$1\nshift\nfor f in "$@"; do case $(cat $f) in bad) ;; *) tr a-z A-Z < $f > $out/$(basename $f .doc).txt;; esac; done\n')
    tool.chmod(0o755)
    files = spark.createDataFrame([(1, b"word"), (2, b"bad"), (3, None)], "id int, body binary")
    made = X.convert_documents(files, "id", "body", converter=str(tool))
    assert {(r.id, r.text, r.error) for r in made.collect()} == {(1, "WORD", None), (2, None, "not converted"), (3, None, "not converted")}
    absent = X.convert_documents(files, "id", "body", converter="no-such-program")
    assert {r.error for r in absent.collect()} == {"no converter here"}


# --- gate and limiter


def test_gate(spark):
    t = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    m = metrics({"t": t}, {"t": {"rows": F.count(F.lit(1)), "b": F.count("b")}})
    checks = [Check("rows", "t", "rows", ">=", 2), Check("share", "t", "b", ">=", 0.9, "rows", "warn"), Check("at most", "t", "rows", "<=", 1), Check("absent", "t", "c", ">=", 0, None, "warn")]
    got = gate(spark, m, checks)
    assert {r.name: r.ok for r in got.collect()} == {"rows": True, "share": False, "at most": False, "absent": False}
    assert not passed(got) and passed(gate(spark, m, checks[:2]))
    before = spark.createDataFrame([("t", "rows", 3.0)], "tbl string, metric string, value double")
    assert {r.name: (r.level, r.ok) for r in not_worse(m, before).collect()} == {"t.rows": ("fail", False), "t.b": ("warn", False)}
    days = spark.createDataFrame([("2024-01-01 00:00:00",), ("soon",)], "d string").select(age_in_days(F.col("d"), F.lit("2024-01-11").cast("date")).alias("n")).collect()
    assert [r.n for r in days] == [10, None]
    cover = spark.createDataFrame([("2001", "votes", "0"), ("2003", "votes", "5")], "session_year string, key string, value string")
    assert [tuple(r) for r in era_notes(cover, [("votes", "no votes")]).collect()] == [("2001", "no votes")]


def _hits(n):
    start = dt.datetime(2024, 1, 1)
    return [(k, RNG.choice(["a", "a", "b"]), start + dt.timedelta(seconds=RNG.randint(0, 1200))) for k in range(n)]


def test_limiter(spark):
    rows = _hits(300) + [(900, None, dt.datetime(2024, 1, 1)), (901, "a", None)]
    want = {}
    for user in "ab":
        own = sorted((t, k) for k, u, t in rows if u == user and t)
        want |= dict(zip((k for _, k in own), allow([t.timestamp() for t, _ in own], 60.0, 3)))
    got = {r.id: r.allowed for r in limit_hits(spark.createDataFrame(rows, "id int, u string, at timestamp_ntz"), "u", "at", "id", window=60.0, limit=3).collect()}
    assert got == want | {900: False, 901: False}
    assert limit_hits(spark.createDataFrame([], "id int, u string, at timestamp_ntz"), "u", "at", "id").count() == 0


def test_limiter_on_a_stream(spark, tmp_path):
    from lawloom.streaming.limiter import limit_stream

    rows = sorted(_hits(60), key=lambda r: (r[2], r[0]))
    schema = "id int, u string, at timestamp"
    for n, part in enumerate((rows[:25], rows[25:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = limit_stream(stream, "u", "at", "id", window=60.0, limit=3).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(45)
    got = {r.id: r.allowed for r in spark.table("limited").collect()}
    want = {}
    for user in "ab":
        own = [(t, k) for k, u, t in rows if u == user]
        want |= dict(zip((k for _, k in own), allow([t.timestamp() for t, _ in own], 60.0, 3)))
    assert got == want
