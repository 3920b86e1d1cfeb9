"""The query tools: each takes plain arguments and gives a dictionary, errors included.

A tool filters by key, so filters reach the scan, and collects the few rows of one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lawloom.catalog import Catalog, Store
from lawloom.functions import blocks as B
from lawloom.functions import redline as R
from lawloom.functions.blobs import unpack
from lawloom.functions.citations import lineage_node, note_hints, parse_history, parse_ref, parse_section_filter
from lawloom.functions.keys import chapter_citation, format_session, norm_session, parse_measure, parse_section
from lawloom.operators.intervals import leading_number
from lawloom.operators.matching import matches
from lawloom.operators.relational import ancestors
from lawloom.operators.search import MatchError, corpus_size, matching, parse_or_quote, postings, scores, snippet, words_of
from lawloom.operators.versions import version_order

WHOLE_TEXT = 50_000
CHANGE_LIST = 30_000
CITING_CAP = 100
FIRST_YEAR = 1989
HOPS = 25


class _Refused(Exception):
    """An answer that is an error; its payload is the answer."""

    def __init__(self, **payload):
        self.payload = payload


def _rows(df: DataFrame) -> list[Row]:
    return df.collect()


def _plain(value):
    """JSON-like values: times as text, without binary."""
    return value.strftime("%Y-%m-%d %H:%M:%S") if hasattr(value, "strftime") else value


class Tools:
    """All tools over one catalog."""

    def __init__(self, catalog: Catalog):
        self.c = catalog

    def _answer(self, work, *args) -> dict:
        notes: list[str] = []
        try:
            return self.c.envelope(work(notes, *args), notes)
        except _Refused as e:
            return self.c.envelope(e.payload, notes)

    # --- arguments

    def _code(self, text: str) -> str:
        code = self.c.book.resolve(str(text))
        if code is None:
            known = [f"{c} — {self.c.book.display(c)}" for c in sorted(self.c.book.names)]
            raise _Refused(error=f"Unrecognized code name: {text!r}.", suggestions=self.c.book.suggest(str(text)) or known)
        return code

    def _section(self, code: str, text: str) -> tuple[str, str]:
        kind, key = parse_section(code, str(text))
        if kind == "cons_need_article":
            raise _Refused(error="Name the article of the constitution.", expected_format="Art. I, Sec. 1")
        return kind, key

    def _measure(self, text: str):
        found = parse_measure(str(text))
        if found is None:
            raise _Refused(error=f"Unrecognized measure: {text!r}.", expected_format="AB 123")
        return found

    def _session(self, session) -> str | None:
        if session is None:
            return None
        found = norm_session(session)
        if found is None:
            raise _Refused(error=f"Unrecognized session: {session!r}.", expected_format="2023-2024")
        return found

    def _of_section(self, code: str, key: str) -> Column:
        return (F.col("law_code") == code) & (F.col("section_num_norm") == key)

    def _suggestions(self, code: str, key: str) -> list[str]:
        """Keys that begin like this one, the shortest first, else the nearest by number."""
        keys = self.c.now("law_section").where(F.col("law_code") == code).select(F.col("section_num_norm").alias("k")).where("k is not null").distinct()
        like = _rows(keys.where(F.startswith("k", F.lit(key))).orderBy(F.length("k"), "k").limit(10))
        if not like:
            number = leading_number(F.lit(key))
            like = _rows(keys.withColumn("d", F.abs(leading_number(F.col("k")) - number)).where("d is not null").orderBy("d", "k").limit(5))
        return [r.k for r in like]

    def _hierarchy(self, code: str, key: str) -> list[str]:
        place = self.c.now("law_toc_sections").where((F.col("law_code") == code) & (F.rtrim(F.trim("section_num"), F.lit(".")) == key)).select("node_treepath").orderBy("node_treepath").limit(1)
        paths = place.select(F.posexplode(ancestors(F.col("node_treepath"))).alias("depth", "node_treepath"))
        toc = self.c.now("law_toc").where(F.col("law_code") == code).select("node_treepath", "heading")
        return [r.heading for r in _rows(paths.join(toc, "node_treepath").orderBy("depth").select("heading")) if r.heading]

    def _headings(self, sections: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
        """The nearest heading above each of a few sections, by one join."""
        if not sections:
            return {}
        asked = F.broadcast(self.c.spark.createDataFrame(sorted(set(sections)), "law_code string, key string"))  # the rows of one answer
        place = self.c.now("law_toc_sections").withColumn("key", F.rtrim(F.trim("section_num"), F.lit("."))).join(asked, ["law_code", "key"]).groupBy("law_code", "key").agg(F.min("node_treepath").alias("path"))
        paths = place.select("law_code", "key", F.posexplode(ancestors(F.col("path"))).alias("depth", "node_treepath"))
        toc = self.c.now("law_toc").where("heading is not null and heading <> ''").select("law_code", "node_treepath", "heading")
        found = paths.join(toc, ["law_code", "node_treepath"]).groupBy("law_code", "key").agg(F.max_by("heading", "depth").alias("heading"))
        return {(r.law_code, r.key): r.heading for r in _rows(found)}

    # --- sections

    def get_section(self, code: str, section: str) -> dict:
        """All simultaneous versions of a section, with headings; suggestions where it is not found."""
        return self._answer(self._get_section, code, section)

    def _get_section(self, notes, code, section):
        code = self._code(code)
        kind, key = self._section(code, section)
        law = self.c.now("law_section")
        if kind == "cons_article":
            rows = _rows(law.where((F.col("law_code") == code) & F.startswith("section_num_norm", F.lit(f"Art. {key},"))).select("section_num_norm").distinct().orderBy(F.length("section_num_norm"), "section_num_norm"))
            raise _Refused(error="Name a section of the article.", article=key, sections_in_article=[r[0] for r in rows])
        rows = _rows(law.where(self._of_section(code, key)).orderBy(F.coalesce(F.col("active_flg") == "Y", F.lit(False)).desc(), "id"))
        if not rows:
            raise _Refused(error=f"Section {key} not found in the {self.c.book.display(code)}.", suggestions=self._suggestions(code, key))
        if len(rows) > 1:
            notes.append(f"This section has {len(rows)} simultaneous versions; all are given.")
        versions = [
            {"text": r.content_text, "history_note": r.history, "effective_date": _plain(r.effective_date), "operative_citation": chapter_citation("CHP", r.op_statutes, r.op_chapter, None), "active": r.active_flg == "Y", "last_updated": _plain(r.trans_update)}
            for r in rows
        ]
        return {"code": code, "code_name": self.c.book.display(code), "section": key, "hierarchy": self._hierarchy(code, key), "versions": versions}

    def search_sections(self, query: str, code: str | None = None, limit: int = 10) -> dict:
        """Sections that match an expression, the best first, with a snippet; weights are of all sections."""
        return self._answer(self._search, query, code, limit)

    def _search(self, notes, query, code, limit):
        limit = max(1, min(int(limit), 50))
        code = self._code(code) if code else None
        try:
            tree = parse_or_quote(query)
        except MatchError as e:
            raise _Refused(error=f"Cannot search for {query!r}: {e}.", hint='Use words, "phrases", AND, OR, NOT, NEAR(a b, 5) or prefix*.') from None
        law = self.c.now("law_section").select("id", "law_code", "section_num_norm", "content_text").where("content_text is not null")
        index = self.c.now.index("law_section")
        posted, size = (index.of(*words_of(tree)), index.size) if index else (postings(law, "id", "content_text"), corpus_size(law, "content_text"))
        found = matching(tree, posted, "id")
        words = sorted(set(_words(tree)))
        allowed = found if code is None else found.join(law.where(F.col("law_code") == code), "id", "left_semi")
        scored = scores(words, posted, "id", size)
        best = allowed.join(scored, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(F.round("score", 9).desc(), "id").limit(limit)
        shown = F.array(*[F.lit(w) for w in words]).cast("array<string>")
        rows = _rows(best.join(law, "id").select("law_code", "section_num_norm", "score", "id", snippet(F.col("content_text"), shown).alias("snippet")))
        rows.sort(key=lambda r: (-round(r.score, 9), r.id))
        if not rows:
            notes.append("Nothing matches. All terms must occur unless joined by OR; words are not stemmed.")
        heads = self._headings([(r.law_code, r.section_num_norm) for r in rows])
        return {"query": query, "results": [{"code": r.law_code, "section": r.section_num_norm, "heading": heads.get((r.law_code, r.section_num_norm)), "snippet": r.snippet} for r in rows]}

    def bills_affecting_section(self, code: str, section: str) -> dict:
        """Bills whose latest version touches a section, and how."""
        return self._answer(self._affecting, code, section)

    def _affecting(self, notes, code, section):
        code = self._code(code)
        kind, key = self._section(code, section)
        if kind == "cons_article":
            key = f"Art. {key}"
        latest = self.c.now("bill").withColumn("bill_version_id", F.col("latest_bill_version_id"))
        refs = self.c.now("bill_section_ref").where(F.col("law_code") == code).join(latest.select("bill_id", "bill_version_id"), ["bill_id", "bill_version_id"], "left_semi")
        number = F.rtrim(F.trim("section"), F.lit("."))
        named = refs.select("ref_id", F.col("law_code").alias("code"), number.alias("section"), F.coalesce(F.col("is_range").cast("string") == "1", F.lit(False)).alias("is_range"), "range_end", "struct")
        asked = self.c.spark.createDataFrame([(code, key)], "code string, key string")
        hits = matches(named, asked)
        if kind == "cons":
            article = key.split(",")[0]
            hits = hits.unionByName(named.where(F.col("section") == article).select("code", F.lit(key).alias("key"), "ref_id", F.lit("whole_article").alias("kind")))
        rows = _rows(hits.select("ref_id", "kind").join(refs.dropDuplicates(["ref_id"]), "ref_id").join(latest.drop("trans_update", "session_year", "bill_version_id", "active_flg", "trans_uid"), "bill_id").orderBy("ref_id"))
        analyses = {r.bill_id: r.d for r in _rows(self.c.now("bill_analysis").where(F.col("bill_id").isin([r.bill_id for r in rows])).groupBy("bill_id").agg(F.max("analysis_date").alias("d")))} if rows else {}
        subjects = {r.bill_version_id: r.subject for r in _rows(self.c.now("bill_version").where(F.col("bill_version_id").isin([r.latest_bill_version_id for r in rows])).select("bill_version_id", "subject"))} if rows else {}
        bills: dict[str, dict] = {}
        for r in rows:
            entry = bills.setdefault(r.bill_id, {**self._summary(r, True), "subject": subjects.get(r.latest_bill_version_id), "latest_analysis_date": analyses.get(r.bill_id), "references": []})
            entry["references"].append({"action": r.action, "section": r.section, "match": r.kind, **({"adds_structure": r.struct} if r.struct else {}), **({"range_end": r.range_end} if r.range_end else {})})
        notes.append("Matches come from the titles of latest versions; a unit added nearby may not reach the section.")
        exists = not self.c.now("law_section").where(self._of_section(code, key)).isEmpty()
        found = sorted(bills.values(), key=lambda b: (not b["pending"], b["measure"]))
        if not exists and kind != "cons_article":
            notes.append(f"{key} is not in current law.")
            if not found:
                return {"code": code, "section": key, "bills": [], "suggestions": self._suggestions(code, key)}
        return {"code": code, "section": key, "bills": found}

    # --- bills

    def _summary(self, r: Row, live: bool) -> dict:
        """A bill in short; pending only in the current store, by the statuses the catalog names."""
        return {
            "bill_id": r.bill_id, "measure": f"{r.measure_type} {r.measure_num}", "session": format_session(r.session_year) if r.session_year else None, "state": r.measure_state, "status": r.current_status,
            "location": r.current_location, "house": r.current_house, "chapter": chapter_citation(r.chapter_type, r.chapter_year, r.chapter_num, r.chapter_session_num),
            "pending": live and r.current_status in self.c.pending, "latest_version_id": r.latest_bill_version_id,
        }

    def _find_bills(self, measure: str, session) -> tuple[str, Store, list[Row]]:
        """The first store that knows the measure, and its bills, the regular session's first."""
        found = self._measure(measure)
        session = self._session(session) or found.session
        for name, store in self.c.stores:
            bills = store("bill")
            wanted = (F.col("bill_id") == found.bill_id) if found.bill_id else (F.upper("measure_type") == found.type) & (F.col("measure_num") == found.num)
            if session and not found.bill_id:
                wanted &= F.col("session_year") == session
            rows = _rows(bills.where(wanted).orderBy(F.col("session_year").desc(), "session_num", "bill_id"))
            if rows:
                return name, store, rows
        spans = [_rows(s("bill").select("session_year").distinct()) for _, s in self.c.stores]
        raise _Refused(error=f"{measure} was not found" + (f" in {format_session(session)}." if session else "."), archive_sessions=sorted({format_session(r[0]) for rows in spans for r in rows if r[0]}))

    def get_bill(self, measure: str, session: str | None = None) -> dict:
        """A bill with authors, history, versions, sections, analyses and vetoes, and votes of the archive."""
        return self._answer(self._get_bill, measure, session)

    def _get_bill(self, notes, measure, session):
        name, store, rows = self._find_bills(measure, session)
        r = rows[0]
        detail = {**self._summary(r, name == "current"), **self._lists(store, r, name == "archive")}
        more = [{"bill_id": x.bill_id, "session": format_session(x.session_year)} for x in rows[1:]]
        return {"bill": detail, "from": name, **({"additional_matches": more} if more else {})}

    def _lists(self, store: Store, r: Row, votes: bool) -> dict:
        of_bill, of_version = F.col("bill_id") == r.bill_id, F.col("bill_version_id") == r.latest_bill_version_id
        authors = _rows(store("bill_version_authors").where(of_version).orderBy(F.desc("primary_author_flg"), "name"))
        number = F.coalesce(F.regexp_extract("action_sequence", r"^\s*([-+]?[0-9]+)", 1).try_cast("bigint"), F.lit(0))
        history = _rows(store("bill_history").where(of_bill).dropDuplicates(["bill_history_id"]).orderBy("action_date", number, "bill_history_id"))
        versions = _rows(store("bill_version").where(of_bill).dropDuplicates(["bill_version_id"]).orderBy(version_order(F.col("version_num")), "bill_version_id"))
        refs = _rows(store("bill_section_ref").where(of_version).dropDuplicates(["ref_id"]).orderBy("ref_id"))
        vetoes = _rows(store("veto_message").where(of_bill).join(store("veto_text").select("bill_id", "veto_date", "text_zlib"), ["bill_id", "veto_date"], "left").orderBy("veto_date"))
        lists = {
            "authors": [{"name": a.name, "house": a.house, "contribution": a.contribution, "primary": a.primary_author_flg == "Y"} for a in authors],
            "history": [{"date": _plain(h.action_date), "action": h.action} for h in history],
            "versions": [{"version_id": v.bill_version_id, "version_num": v.version_num, "action": v.action, "date": _plain(v.action_date)} for v in versions],
            "sections_affected": [{"action": x.action, "code": x.law_code, "section": x.section, **({"range_end": x.range_end} if x.range_end else {}), **({"adds_structure": x.struct} if x.struct else {})} for x in refs],
            "analyses": self._analyses(store, r.bill_id),
            "veto_messages": [{"veto_date": v.veto_date, **({"text": unpack(bytes(v.text_zlib))} if v.text_zlib else {})} for v in vetoes],
        }
        if votes:
            cast = store("bill_summary_vote").where(of_bill).join(store("bill_motion").select("motion_id", "motion_text"), "motion_id", "left").orderBy("vote_date_time", "location_code")
            lists["votes"] = [{"date": v.vote_date_time, "location": v.location_code, "motion": v.motion_text, "ayes": v.ayes, "noes": v.noes, "abstain": v.abstain, "result": v.vote_result} for v in _rows(cast)]
        return lists

    def _analyses(self, store: Store, bill_id: str) -> list[dict]:
        texts = store("analysis_text").select("analysis_id", F.lit(True).alias("has"))
        rows = _rows(store("bill_analysis").where(F.col("bill_id") == bill_id).join(texts, "analysis_id", "left").orderBy("analysis_date", "analysis_id"))
        return [{"analysis_id": a.analysis_id, "committee_code": a.committee_code, "committee_name": a.committee_name, "house": a.house, "type": a.analysis_type, "date": a.analysis_date, "amendment_date": a.amendment_date, "has_text": bool(a.has)} for a in rows]

    def get_bill_analyses(self, measure: str | None = None, session: str | None = None, analysis_id: str | None = None) -> dict:
        """The analyses of a bill, or the text of one."""
        return self._answer(self._get_analyses, measure, session, analysis_id)

    def _get_analyses(self, notes, measure, session, analysis_id):
        if analysis_id is not None:
            for name, store in self.c.stores:
                one = store("bill_analysis").where(F.col("analysis_id") == analysis_id)
                rows = _rows(one.join(store("analysis_text").select("analysis_id", "text_zlib"), "analysis_id", "left").limit(1))
                if rows:
                    a = rows[0]
                    text = unpack(bytes(a.text_zlib)) if a.text_zlib else None
                    if text is None:
                        raise _Refused(error="The text of this analysis is not available.", analysis_id=analysis_id, bill=a.bill_id)
                    return {"analysis_id": a.analysis_id, "bill": a.bill_id, "committee_code": a.committee_code, "committee_name": a.committee_name, "house": a.house, "type": a.analysis_type, "date": a.analysis_date, "amendment_date": a.amendment_date, "text": text, "from": name}
            raise _Refused(error=f"No analysis {analysis_id!r}.")
        if measure is None:
            raise _Refused(error="Name a measure or an analysis.", expected_format="AB 123")
        name, store, rows = self._find_bills(measure, session)
        more = [{"bill_id": x.bill_id} for x in rows[1:]]
        return {"bill": self._summary(rows[0], name == "current"), "analyses": self._analyses(store, rows[0].bill_id), "from": name, **({"additional_matches": more} if more else {})}

    # --- chapters and history

    def _chapter_rows(self, year: int, chapter: int, ex: int, kind: str | None) -> tuple[str, Store, list[Row]] | None:
        for name, store in self.c.stores:
            wanted = (F.col("chapter_year") == str(year)) & (F.col("chapter_num").try_cast("int") == chapter) & (F.coalesce(F.col("chapter_session_num").try_cast("int"), F.lit(0)) == ex)
            if kind:
                wanted &= F.col("chapter_type") == kind
            rows = _rows(store("bill").where(wanted).orderBy("bill_id"))
            if rows:
                return name, store, rows
        return None

    def chapter_to_bill(self, year: int, chapter: int, kind: str = "statutes", ex_session: int = 0) -> dict:
        """The bill that became a chapter."""
        return self._answer(self._chapter_to_bill, year, chapter, kind, ex_session)

    def _chapter_to_bill(self, notes, year, chapter, kind, ex):
        resolution = kind.lower().startswith("res")
        cited = chapter_citation("CHR" if resolution else "CHP", str(year), str(chapter), str(ex))
        if year < FIRST_YEAR:
            raise _Refused(error=f"{cited} predates electronic records.", coverage=self._coverage())
        found = self._chapter_rows(year, chapter, ex, "CHR" if resolution else "CHP")
        if not found:
            others = [r.chapter_session_num for _, s in self.c.stores for r in _rows(s("bill").where((F.col("chapter_year") == str(year)) & (F.col("chapter_num").try_cast("int") == chapter)).select("chapter_session_num").distinct())]
            hint = [f"A chapter of this number exists in session {o or 0}." for o in sorted(others, key=str)]
            raise _Refused(error=f"{cited} was not found.", coverage=self._coverage(), **({"hint": hint} if hint else {}))
        name, store, rows = found
        lists = self._lists(store, rows[0], False)
        tied = {"warning": f"{len(rows)} bills have this chapter; the first is given."} if len(rows) > 1 else {}
        return {"chapter": cited, "bill": self._summary(rows[0], name == "current"), "authors": lists["authors"], "analyses": lists["analyses"], "veto_messages": lists["veto_messages"], "from": name, **tied}

    def _coverage(self) -> str:
        spans = [s("bill").agg(F.min("session_year").alias("a"), F.max("session_year").alias("b")).first() for _, s in self.c.stores]
        known = sorted(y for r in spans for y in (r.a, r.b) if y)
        return f"Sessions {format_session(known[0])} to {format_session(known[-1])}." if known else "No sessions."

    def get_legislative_history(self, code: str, section: str) -> dict:
        """Events of a section's history notes with the bills behind them, and enacted bills that cite it."""
        return self._answer(self._history, code, section)

    def _history(self, notes, code, section):
        code = self._code(code)
        _, key = self._section(code, section)
        law = _rows(self.c.now("law_section").where(self._of_section(code, key)).orderBy("id"))
        if not law:
            raise _Refused(error=f"Section {key} not found in the {self.c.book.display(code)}.", suggestions=self._suggestions(code, key))
        told = list(dict.fromkeys(r.history for r in law if r.history))
        events, seen = [], set()
        for note in told:
            for e in parse_history(note):
                mark = (e.kind, e.year, e.chapter, e.ex_session, e.proposition)
                if mark not in seen:
                    seen.add(mark)
                    events.append(self._event(e))
        return {"code": code, "section": key, "history_notes": told, "events": events, "enacted_bills_citing_section": self._citing(code, key)}

    def _event(self, e) -> dict:
        out = {"citation": e.citation, "kind": e.kind, "role": e.role, **{k: v for k, v in (("year", e.year), ("chapter", e.chapter), ("proposition", e.proposition), ("date", e.date)) if v}}
        if e.kind == "initiative":
            return {**out, "resolution": "adopted_by_initiative"}
        if e.year < FIRST_YEAR:
            return {**out, "resolution": "predates_electronic_records"}
        found = None
        for year in filter(None, (e.year, e.year_alt)):
            found = found or self._chapter_rows(year, e.chapter, e.ex_session, "CHR" if e.kind == "resolution_chapter" else None)
        if not found:
            return {**out, "resolution": "unresolved"}
        name, _, rows = found
        bill = self._summary(rows[0], name == "current")
        off = {"warning": f"The note names {e.measure_hint}."} if e.measure_hint and e.measure_hint != bill["measure"] else {}
        return {**out, "resolution": "resolved", "bill": bill, "from": name, **off}

    def _citing(self, code: str, key: str) -> list[dict]:
        parts = []
        for n, (_, store) in enumerate(self.c.stores):
            refs = store("bill_section_ref").where((F.col("law_code") == code) & (F.rtrim(F.trim("section"), F.lit(".")) == key)).select("bill_id", "bill_version_id", "action", "ref_id")
            bills = store("bill").where("chapter_num is not null").withColumn("bill_version_id", F.col("latest_bill_version_id")).drop("action", "trans_update")
            parts.append(refs.join(bills, ["bill_id", "bill_version_id"]).withColumn("store", F.lit(n)))
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        found: dict[str, dict] = {}
        for r in sorted(_rows(rows), key=lambda r: (r.store, r.ref_id)):
            entry = found.setdefault(r.bill_id, {"bill_id": r.bill_id, "measure": f"{r.measure_type} {r.measure_num}", "session": format_session(r.session_year or ""), "chapter": chapter_citation(r.chapter_type, r.chapter_year, r.chapter_num, r.chapter_session_num), "actions": [], "_year": int(r.chapter_year or 0)})
            if r.action not in entry["actions"]:
                entry["actions"].append(r.action)
        ordered = sorted(found.values(), key=lambda b: (-b["_year"], b["bill_id"]))[:CITING_CAP]
        return [{k: v for k, v in b.items() if k != "_year"} for b in ordered]

    # --- texts and redlines

    def _prints(self, store: Store, bill_id: str) -> list[Row]:
        versions = store("bill_version").where(F.col("bill_id") == bill_id).dropDuplicates(["bill_version_id"])
        texts = store("bill_version_text").select("bill_version_id", F.lit(True).alias("has_text"))
        return _rows(versions.join(texts, "bill_version_id", "left").orderBy(version_order(F.col("version_num")), "bill_version_id"))

    @staticmethod
    def _label(v: Row) -> dict:
        return {"version_id": v.bill_version_id, "version_num": v.version_num, "action": v.action, "date": _plain(v.action_date), "has_text": bool(v.has_text)}

    def _pick(self, prints: list[Row], spec: str | None, notes: list[str]) -> Row:
        if spec is None:
            return prints[0]
        told = str(spec).strip()
        fits = [v for v in prints if v.bill_version_id == told]
        if not fits and told.isdigit() and len(told) < 4:
            fits = [v for v in prints if v.version_num == told]
        if not fits and told[:4].isdigit():
            fits = [v for v in prints if (_plain(v.action_date) or "").startswith(told)]
        if not fits and told:
            fits = [v for v in prints if told.casefold() in (v.action or "").casefold()]
        if not fits:
            raise _Refused(error=f"No version fits {spec!r}.", available_versions=[self._label(v) for v in prints])
        if len(fits) > 1:
            notes.append(f"{len(fits)} versions fit {spec!r}; the newest is used.")
        return fits[0]

    def _text(self, store: Store, version_id: str) -> str:
        row = store("bill_version_text").where(F.col("bill_version_id") == version_id).select("text_zlib").limit(1).first()
        text = None if row is None or row.text_zlib is None else unpack(bytes(row.text_zlib))
        if text is None:
            raise _Refused(error="The text of this version is missing or does not unpack.", version_id=version_id)
        return text

    def get_bill_text(self, measure: str, session: str | None = None, version: str | None = None, section_filter: str | None = None) -> dict:
        """The text of a version: whole, as an index of its blocks if long, or the blocks of one section."""
        return self._answer(self._bill_text, measure, session, version, section_filter)

    def _bill_text(self, notes, measure, session, version, section_filter):
        _, store, rows = self._find_bills(measure, session)
        prints = self._prints(store, rows[0].bill_id)
        if not prints:
            raise _Refused(error=f"{measure} has no versions.")
        chosen = self._pick(prints, version, notes)
        text = self._text(store, chosen.bill_version_id)
        out = {"measure": f"{rows[0].measure_type} {rows[0].measure_num}", "session": format_session(rows[0].session_year or ""), "version": self._label(chosen), "other_versions": [self._label(v) for v in prints if v is not chosen], "title": chosen.title_text}
        if section_filter is not None:
            target = parse_section_filter(section_filter, self.c.book)
            if target is None:
                raise _Refused(error=f"Unrecognized section: {section_filter!r}.", expected_format="Section 12 of the ... Code")
            found = B.section_blocks(text, self.c.book.display(target[0]), target[1])
            if not found:
                notes.append("No block of this version works on that section.")
            return {**out, "section_filter": section_filter, "blocks": [b._asdict() for b in found]}
        index, rising = B.section_index(text)
        if len(text) <= WHOLE_TEXT or not index:
            return {**out, "text": text}
        if not rising:
            notes.append("The numbers of the blocks do not rise throughout.")
        return {**out, "text_chars": len(text), "sections_index": [{"heading": h, "intro": i} for h, i in index]}

    def compare_bill_versions(self, measure: str, session: str | None = None, from_version: str | None = None, to_version: str | None = None) -> dict:
        """The redline of two versions of a bill, title and digest apart from the body."""
        return self._answer(self._compare_bills, measure, session, from_version, to_version)

    def _compare_bills(self, notes, measure, session, older, newer):
        _, store, rows = self._find_bills(measure, session)
        prints = self._prints(store, rows[0].bill_id)
        if not prints:
            raise _Refused(error=f"{measure} has no versions.")
        to = self._pick(prints, newer, notes)
        at = prints.index(to)
        if older is None and at + 1 >= len(prints):
            raise _Refused(error="There is no older version.", available_versions=[self._label(v) for v in prints])
        start = self._pick(prints, older, notes) if older is not None else prints[at + 1]
        if prints.index(start) < at:
            notes.append("The first version is newer than the second.")
        (h1, b1), (h2, b2) = (B.split_head_body(self._text(store, v.bill_version_id)) for v in (start, to))
        head, body = self._part(h1, h2), self._part(b1, b2)
        same = bool(head.get("identical") and body.get("identical"))
        return {"measure": f"{rows[0].measure_type} {rows[0].measure_num}", "session": format_session(rows[0].session_year or ""), "from": self._label(start), "to": self._label(to), "identical": same, "title_and_digest": head, "body": body, **({"statement": "The versions do not differ."} if same else {})}

    @staticmethod
    def _part(old: str, new: str) -> dict:
        why = None if old == new else R.refusal(old, new)
        if why:
            return {"unavailable": True, "statement": f"No redline: {why}."}
        made = R.redline(old, new)
        if made.identical:
            return {"identical": True}
        changes = [c._asdict() for c in made.changes]
        if len(made.markdown) <= WHOLE_TEXT:
            return {"identical": False, "redline_markdown": made.markdown, "changes": changes}
        counts: dict[str, int] = {}
        for c in made.changes:
            counts[c.kind] = counts.get(c.kind, 0) + 1
        touched = sum(len(c.deleted or "") + len(c.added or "") for c in made.changes)
        return {"identical": False, "unavailable": True, "statement": "The redline is too long.", "change_counts": counts, **({"changes": changes} if touched <= CHANGE_LIST else {})}

    def compare_section_versions(self, code: str, section: str, from_ref: str | None = None, to_ref: str | None = None) -> dict:
        """The redline of two versions of a section: current law, chapters, measures or the one before."""
        return self._answer(self._compare_sections, code, section, from_ref, to_ref)

    def _compare_sections(self, notes, code, section, from_ref, to_ref):
        code = self._code(code)
        _, key = self._section(code, section)
        specs = []
        for ref in (from_ref, to_ref):
            spec = None if ref is None else parse_ref(ref)
            if ref is not None and spec is None:
                raise _Refused(error=f"Unrecognized reference: {ref!r}.", expected_format="current, prior, Stats. 2019, Ch. 12 or AB 12")
            specs.append(spec)
        to = self._end(code, key, specs[1] or {"kind": "current"}, notes)
        first = specs[0] or {"kind": "current" if to["kind"] == "measure" else "prior"}
        start = self._prior(code, key, to, notes) if first["kind"] == "prior" else self._end(code, key, first, notes)
        if start.get("date") and to.get("date") and start["date"] > to["date"]:
            notes.append("The first version is later than the second.")
        shown = lambda e: {k: v for k, v in e.items() if k not in ("text", "lineage", "node", "note")}
        out = {"code": code, "code_name": self.c.book.display(code), "section": key, "from": shown(start), "to": shown(to)}
        why = None if start["text"] == to["text"] else R.refusal(start["text"], to["text"])
        if why:
            return {**out, "identical": False, "statement": f"No redline: {why}."}
        made = R.redline(start["text"], to["text"])
        if made.identical:
            return {**out, "identical": True, "statement": "The versions do not differ."}
        return {**out, "identical": False, "redline_markdown": made.markdown, "changes": [c._asdict() for c in made.changes]}

    def _end(self, code: str, key: str, spec: dict, notes: list[str]) -> dict:
        """One end of a comparison: its kind, label and text."""
        if spec["kind"] == "current":
            rows = _rows(self.c.now("law_section").where(self._of_section(code, key)).orderBy(F.coalesce(F.col("active_flg") == "Y", F.lit(False)).desc(), "id"))
            if not rows:
                raise _Refused(error=f"Section {key} not found in the {self.c.book.display(code)}.", suggestions=self._suggestions(code, key))
            if len(rows) > 1:
                notes.append("The section has several versions; the live one is compared.")
            r = rows[0]
            node = (int(r.op_statutes), int(r.op_chapter)) if (r.op_statutes or "").isdigit() and (r.op_chapter or "").isdigit() else None
            return {"kind": "current", "label": "current law", "text": r.content_text or "", "note": r.history, "node": node, "lineage": None}
        if spec["kind"] == "chapter":
            wanted = (spec["year"], spec["chapter"], spec["ex"])
            return self._chapter_end(code, key, *wanted, self._hint(code, key, wanted), notes)
        name, store, rows = self._find_bills(f"{spec['type']} {spec['num']}", spec.get("session"))
        return self._block_end(code, key, store, rows[0], None, "measure", notes)

    def _hint(self, code: str, key: str, wanted: tuple[int, int, int]) -> str | None:
        """The section of the act of a chapter, as notes of the current section or later acts name it.

        Lineage is followed from the current version back, for at most 25 acts, until the chapter
        is named, an act names itself or none, or the trail is lost.
        """
        row = self.c.now("law_section").where(self._of_section(code, key)).select("history").where("history is not null").orderBy("id").first()
        known = note_hints(row and row.history)
        node = next(iter(known), None)
        for _ in range(HOPS):
            if wanted in known or node is None:
                break
            try:
                end = self._chapter_end(code, key, *node, known.get(node), [])
            except _Refused:
                break
            cited = lineage_node(end["lineage"])
            following = cited and (cited[0], cited[1], 0)
            if cited is None or following == node:
                break
            if cited[2]:
                known.setdefault(following, cited[2])
            node = following
        return known.get(wanted)

    def _chapter_end(self, code, key, year, chapter, ex, hint, notes):
        found = self._chapter_rows(year, chapter, ex, None)
        if not found:
            raise _Refused(error=f"{chapter_citation('CHP', str(year), str(chapter), str(ex))} was not found.", resolution="predates_electronic_records" if year < FIRST_YEAR else "unresolved")
        _, store, rows = found
        if len(rows) > 1:
            notes.append(f"{len(rows)} bills have this chapter; the first is used.")
        return {**self._block_end(code, key, store, rows[0], hint, "chapter", notes), "node": (year, chapter)}

    def _block_end(self, code, key, store, bill, hint, kind, notes):
        text = self._text(store, bill.latest_bill_version_id)
        found = B.section_blocks(text, self.c.book.display(code), key)
        if not found:
            raise _Refused(error=f"{bill.measure_type} {bill.measure_num} does not work on this section.")
        hinted = [b for b in found if hint and b.heading.split(" ")[-1].rstrip(".") == hint]
        block = (hinted or [b for b in found if b.action != "repealed"] or found)[0]
        if len(found) > 1:
            notes.append(f"{len(found)} blocks work on the section; {block.heading} is used.")
        row = store("bill_version").where(F.col("bill_version_id") == bill.latest_bill_version_id).select("action_date").limit(1).first()
        label = chapter_citation(bill.chapter_type, bill.chapter_year, bill.chapter_num, bill.chapter_session_num) or f"{bill.measure_type} {bill.measure_num}"
        return {"kind": kind, "label": label, "bill_id": bill.bill_id, "heading": block.heading, "action": block.action, "date": row and _plain(row.action_date), "text": block.body, "lineage": block.lineage, "note": None, "node": None}

    def _prior(self, code: str, key: str, end: dict, notes: list[str]) -> dict:
        """The version before one: by its note, its block's lineage, or the chapter enacted before it."""
        if (end.get("action") or "").startswith("added") or (end.get("note") or "").lower().startswith("added"):
            raise _Refused(no_prior_version=True, statement="The section was added by this act; there is no version before it.")
        node = None
        if end.get("note"):
            earlier = [e for e in parse_history(end["note"]) if e.role == "prior_version" and e.kind == "chapter"]
            if earlier:
                e = earlier[0]
                node = (e.year, e.chapter, e.ex_session, note_hints(end["note"]).get((e.year, e.chapter, e.ex_session)))
        cited = lineage_node(end.get("lineage"))
        if node is None and cited and cited[:2] != end.get("node"):
            node = (cited[0], cited[1], 0, cited[2])
        if node is None:
            node = self._before(code, key, end)
        if node is None:
            raise _Refused(error="The version before this one cannot be traced.", resolution="untraceable")
        return self._chapter_end(code, key, *node[:3], node[3], notes)

    def _before(self, code: str, key: str, end: dict) -> tuple | None:
        """The latest chapter strictly before an end that cites the section."""
        found = []
        for _, store in self.c.stores:
            refs = store("bill_section_ref").where((F.col("law_code") == code) & (F.rtrim(F.trim("section"), F.lit(".")) == key)).select("bill_id", "bill_version_id").distinct()
            bills = store("bill").where("chapter_num is not null").select("bill_id", F.col("latest_bill_version_id").alias("bill_version_id"), "chapter_year", "chapter_num", "chapter_session_num")
            dates = store("bill_version").select("bill_version_id", "action_date").dropDuplicates(["bill_version_id"])
            found += _rows(refs.join(bills, ["bill_id", "bill_version_id"]).join(dates, "bill_version_id", "left"))
        rows = [(_plain(r.action_date), int(r.chapter_year), int(r.chapter_num), int(r.chapter_session_num or 0)) for r in found if (r.chapter_year or "").isdigit() and (r.chapter_num or "").isdigit()]
        rows = [r for r in rows if end.get("node") is None or r[1:3] != tuple(end["node"])]
        date, node = end.get("date"), end.get("node")
        dated = [r for r in rows if r[0] and date and r[0] < date]
        if not dated and node:
            dated = [r for r in rows if r[1:3] < tuple(node) and (not date or not r[0])]
        if not dated and not date and not node:
            dated = rows
        best = max(dated, key=lambda r: (r[0] or "", *r[1:]), default=None)
        return best and (best[1], best[2], best[3], None)

    def health(self) -> dict | None:
        """Facts about freshness; None where the catalog has none, which a server answers with 503."""
        known = {k: self.c.meta.get(k) for k in ("law_extract_date", "bill_extract_date", "session_year", "build_utc")}
        return known if any(known.values()) else None


def _words(node) -> list[str]:
    return [w for a in node.args for w in ([a] if isinstance(a, str) else _words(a) if hasattr(a, "args") else [])]
