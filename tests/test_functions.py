"""Kernels that need no session."""

import io
import random
import time
import zipfile
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.functions import blocks as B
from lawloom.functions import citations as C
from lawloom.functions import flatten as T
from lawloom.functions import keys as K
from lawloom.functions import redline as R
from lawloom.functions.blobs import pack, unpack
from lawloom.functions.textvec import split_words
from lawloom.operators.limiter import allow
from lawloom.operators.search import MatchError, Node, parse_match, parse_or_quote
from lawloom.sources.bundles import newest_session, session_files, table_source
from lawloom.sources.escaped import decode, parse_text

BOOK = K.CodeBook({"BRG": ("Bridges Code",), "MIL": ("Mills and Dams Code", "mill law"), "CCP": ("Code of Civil Procedure",)}, region=("ca", "cal"))


# --- keys


@pytest.mark.parametrize(("n", "roman"), [(1, "I"), (4, "IV"), (9, "IX"), (13, "XIII"), (40, "XL"), (49, "XLIX"), (88, "LXXXVIII")])
def test_roman(n, roman):
    assert K.to_roman(n) == roman


@pytest.mark.parametrize(("given_", "want"), [("xiii b", "XIII B"), ("1", "I"), ("XIIIA", "XIII A"), ("13 b", "XIII B"), ("iv", "IV"), ("XIII  C", "XIII C"), ("A", "A")])
def test_article(given_, want):
    assert K.norm_article(given_) == want


def test_section_keys():
    assert K.norm_section(" 44955. ") == "44955"
    assert K.cons_key("xiii b", "SEC. 1.") == "Art. XIII B, Sec. 1"
    assert K.law_section_key("CONS", "SEC. 2.", "I") == "Art. I, Sec. 2"
    assert K.law_section_key("BRG", "1.5.", None) == "1.5" and K.law_section_key("BRG", None, None) is None


@pytest.mark.parametrize(("name", "code"), [("brg", "BRG"), ("Cal. Bridges Code", "BRG"), ("mills & dams", "MIL"), ("Mill Law", "MIL"), ("C.C.P.", "CCP"), ("code of civil procedure", "CCP"), ("none", None)])
def test_code_names(name, code):
    assert BOOK.resolve(name) == code


def test_code_suggestions():
    assert BOOK.suggest("Bridge Codes")[0] == "BRG — Bridges Code" and BOOK.suggest("zzzz") == []
    assert K.CodeBook.from_titles([("BRG", "Bridges Code - BRG"), (None, "x")]).display("BRG") == "Bridges Code"


@pytest.mark.parametrize(
    ("code", "text", "want"),
    [
        ("BRG", "§ 12.5", ("plain", "12.5")), ("BRG", "Section 12(b)(1)", ("plain", "12")), ("BRG", "12, subd. (b)", ("plain", "12")),
        ("CONS", "Art. XIII B, Sec. 1", ("cons", "Art. XIII B, Sec. 1")), ("CONS", "Section 1 of Article XIII B", ("cons", "Art. XIII B, Sec. 1")),
        ("CONS", "Article 4", ("cons_article", "IV")), ("CONS", "12", ("cons_need_article", None)),
    ],
)
def test_section_input(code, text, want):
    assert K.parse_section(code, text) == want


@pytest.mark.parametrize(("text", "want"), [("AB 831", ("AB", "831", None)), ("A.B. 0831", ("AB", "831", None)), ("ab-831", ("AB", "831", None)), ("202520260AB13", ("AB", "13", "20252026")), ("AB", None), ("AB " + "1" * 5000, None), ("ABCDE 1", None)])
def test_measure(text, want):
    found = K.parse_measure(text)
    assert (found and found[:3]) == want


@pytest.mark.parametrize(("text", "want"), [("2023", "20232024"), (2024, "20232024"), ("2023-24", "20232024"), ("1999-00", "19992000"), ("20232024", "20232024"), ("2022-23", None), ("2023-25", None), ("23-24", None), ("1700", None), ("", None)])
def test_session(text, want):
    assert K.norm_session(text) == want


def test_chapter_citation():
    assert K.chapter_citation("CHP", "2019", "12", "0") == "Stats. 2019, Ch. 12"
    assert K.chapter_citation("CHP", "2019", "12", "1") == "Stats. 2019, 1st Ex. Sess., Ch. 12"
    assert K.chapter_citation("CHR", "2019", "12", None) == "Res. Ch. 12, 2019" and K.chapter_citation("CHP", "2019", None, None) is None
    assert [K.ordinal(n) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]


# --- titles and notes

PARSER = C.TitleParser(BOOK)


def _refs(title):
    found = PARSER.parse(title)
    return found.status, [(r.action, r.code, r.section, r.range_end, r.struct) for r in found.refs]


@pytest.mark.parametrize(
    ("title", "status", "refs"),
    [
        ("An act to amend Section 12 of the Bridges Code, relating to bridges.", "ok", [("amend", "BRG", "12", None, None)]),
        ("An act to amend Sections 910, 930, and 942 of the Bridges Code, relating to x.", "ok", [("amend", "BRG", s, None, None) for s in ("910", "930", "942")]),
        ("An act to repeal Sections 200 to 262, inclusive, of the Mills & Dams Code, relating to x.", "ok", [("repeal", "MIL", "200", "262", None)]),
        ("An act to add Chapter 4.5 (commencing with Section 1234) to Part 2 of the bridges code, relating to x.", "ok", [("add", "BRG", "1234", None, "Chapter 4.5")]),
        ("An act to amend Section 1 of, and to add Section 2 to, the BridgesCode, relating to x.", "ok", [("amend", "BRG", "1", None, None), ("add", "BRG", "2", None, None)]),
        ("An act to amend Section 1 of the Bridges Code, repeal Section 5 of the Mills and Dams Code, relating to x.", "ok", [("amend", "BRG", "1", None, None), ("repeal", "MIL", "5", None, None)]),
        ("An act to amend 7928.205 of the Bridges Code, relating to x.", "ok", [("amend", "BRG", "7928.205", None, None)]),
        ("An act amend Section 3 of the Bridges Code, relating to x.", "ok", [("amend", "BRG", "3", None, None)]),
        ("A resolution to amend the Constitution, by amending Section 8 of Article XIIIB thereof.", "ok", [("amending", "CONS", "Art. XIII B, Sec. 8", None, None)]),
        ("A resolution to propose by adding Article XIXB thereto.", "ok", [("adding", "CONS", "Art. XIX B", None, "Article XIX B")]),
        ("An act to amend Section 2 of Chapter 5 of the Statutes of 2011, relating to x.", "uncodified", []),
        ("An act to amend Section 2 of the Lake Park District Act, relating to x.", "uncodified", []),
        ("An act to amend Section 39.10 of the Budget Act of 2019, relating to x.", "budget_act", []),
        ("Relative to Section 230 of the Bridges Code.", "no_sections", []),
        ("An act relating to bridges, and making an appropriation therefor.", "no_sections", []),
        ("An act to amend Section 12 of something, relating to x.", "fail", []),
    ],
)
def test_titles(title, status, refs):
    assert _refs(title) == (status, refs)


def test_partial_title():
    found = PARSER.parse("An act to amend Section 1 of the Bridges Code, and to add Section 9 to the same, relating to x.")
    assert found.status == "partial" and len(found.refs) == 1


def test_history():
    events = C.parse_history("Amended (as added by Stats. 1977, Ch. 535, Sec. 17) by Stats. 1980, 1st Ex. Sess., Ch. 1, Sec. 2. (AB 12) Effective June 1, 1999.")
    assert [(e.year, e.chapter, e.ex_session, e.role, e.measure_hint) for e in events] == [(1980, 1, 1, "operative", "AB 12"), (1977, 535, 0, "prior_version", None)]
    resolution = C.parse_history("Amended June 8, 1976, by Prop. 7; Res.Ch. 90, 1999-00. Other: added Nov. 6, 1974, by Prop. 5. Res.Ch. 5, 1974.")
    assert [(e.year, e.year_alt, e.chapter, e.proposition, e.date) for e in resolution] == [(1999, 2000, 90, "7", "June 8, 1976"), (1974, None, 5, "5", "Nov. 6, 1974")]
    assert [(e.kind, e.proposition) for e in C.parse_history("Added November 4, 2014, by initiative Proposition 47, Sec. 1.")] == [("initiative", "47")]
    assert [e.kind for e in C.parse_history("Added by Prop. 8. Initiative measure.")] == ["initiative"]
    assert C.parse_history(None) == [] and C.parse_history("") == [] and C.parse_history("by Prop. 8.") == []
    assert len(C.parse_history("Stats. 1980, Ch. 1. Stats. 1980, Ch. 1.")) == 1


def test_lineage_and_references():
    assert C.lineage_node("as amended by Section 2.5 of Chapter 12 of the Statutes of 2011") == (2011, 12, "2.5")
    assert C.lineage_node("as added by Chapter 12") is None and C.lineage_node(None) is None
    assert C.note_hints("Amended by Stats. 2011, Ch. 12, Sec. 2.5. (AB 1) and Stats. 1980, 2nd Ex. Sess., Ch. 3, Sec. 4.") == {(2011, 12, 0): "2.5", (1980, 3, 2): "4"}
    assert C.parse_ref("Stats. 2019, Ch. 12") == C.parse_ref("Chapter 12, Statutes of 2019") == C.parse_ref("2019/12") == {"kind": "chapter", "year": 2019, "chapter": 12, "ex": 0}
    assert C.parse_ref("Current")["kind"] == "current" and C.parse_ref("AB 12")["kind"] == "measure" and C.parse_ref("what") is None
    assert C.parse_section_filter("Section 12(b) of the Bridges Code", BOOK) == C.parse_section_filter("Bridges Code Section 12", BOOK) == ("BRG", "12")
    assert C.parse_section_filter("Section 12", BOOK) is None


# --- blocks

BILL = (
    "An act to amend.\nThe people of the Province do enact as follows:\nSECTION 1. Section 12 of the Bridges Code, as amended by Section 2 of Chapter 5 of the Statutes of 2011, is amended to read:\n"
    "12. (a) New text. Notwithstanding Section 13 of the Bridges Code.SEC. 2. Section 12.5 of the Bridges Code is repealed.\nSEC. 3. Section 12 is added to the Bridges Code, to read:\n12. Other.\n\nREVISIONS:\nHeading—Line 1.\n"
)


def test_blocks():
    parts = B.split_blocks(BILL)
    assert len(parts) == 4 and all(p in BILL for p in parts)
    found = B.section_blocks(BILL, "Bridges Code", "12")
    assert [(b.heading, b.action, b.body) for b in found] == [("SECTION 1.", "amended to read", "(a) New text. Notwithstanding Section 13 of the Bridges Code."), ("SEC. 3.", "added to the Bridges Code, to read", "Other.")]
    assert found[0].lineage == "as amended by Section 2 of Chapter 5 of the Statutes of 2011"
    assert [b.body for b in B.section_blocks(BILL, "Bridges Code", "12.5")] == [""]
    assert B.section_blocks(BILL, "Bridges Code", "13") == []
    assert [(n, s) for n, s, _ in B.all_blocks(BILL)] == [("Bridges Code", "12"), ("Bridges Code", "12.5"), ("Bridges Code", "12")]
    head, body = B.split_head_body(BILL)
    assert head == "An act to amend." and body.startswith("SECTION 1.") and B.split_head_body("x") == ("", "x")
    index, rising = B.section_index(BILL)
    assert len(index) == 3 and rising and index[1][1].startswith("Section 12.5")
    assert B.split_blocks("") == [""] and B.section_index("") == ([], True)


@pytest.mark.parametrize(
    ("text", "code", "section", "want"),
    [
        ("SEC. 4. Section 9 of the Mill Code, as amended by Section 2\nof Chapter 100 of the Statutes of 2020, is further amended to read:9. (a) G.", "Mill Code", "9", [("SEC. 4.", "amended to read", "as amended by Section 2 of Chapter 100 of the Statutes of 2020", "(a) G.")]),
        ("x follows:SEC. 32.The heading of Part 6 of the Mill Code is amended to read:6.MILL FUNDSEC. 33.Section 12.5 of the Mill Code is amended to read:12.5.This.", "Mill Code", "12.5", [("SEC. 33.", "amended to read", None, "This.")]),
        ("SEC. 1. Section 8 of the Mill Code is amended to read:8. This section, as amended by this act, is strict.", "Mill Code", "8", [("SEC. 1.", "amended to read", None, "This section, as amended by this act, is strict.")]),
        ("SEC. 2. Section 5 of the Mill Code is amended to read:5. A.CORRECTIONS:Digest—Pages 2 and 3.\nText—Page 5.\nREVISIONS:\nTitle—Line 1.", "Mill Code", "5", [("SEC. 2.", "amended to read", None, "A.")]),
        ("SEC. 2. Section 5 of the Mill Code is amended to read:5. A. CORRECTIONS:Digest—Page 2. More.", "Mill Code", "5", [("SEC. 2.", "amended to read", None, "A. CORRECTIONS:Digest—Page 2. More.")]),
        ("SECTION 1.Section 7 of the Code of Civil Procedure now reads:\n7. Notwithstanding Section 8 of the Mill Code.", "Code of Civil Procedure", "7", [("SECTION 1.", "now reads", None, "Notwithstanding Section 8 of the Mill Code.")]),
        ("SEC. 3. Section 5 is added to the Mill Code, to read:5. The SECTION 2 of it quotes.", "Mill Code", "5", [("SEC. 3.", "added to the Mill Code, to read", None, "The SECTION 2 of it quotes.")]),
    ],
)
def test_block_forms(text, code, section, want):
    assert [(b.heading, b.action, b.lineage, b.body) for b in B.section_blocks(text, code, section)] == want
    assert (code, section) in [(n, s) for n, s, _ in B.all_blocks(text)]


# --- redlines


def _strip(markdown, keep):
    import re

    gone, come = (r"~~(.+?)~~", r"\*(.+?)\*")
    return " ".join(re.sub(come, r"\1" if keep == "new" else "", re.sub(gone, r"\1" if keep == "old" else "", markdown, flags=re.S), flags=re.S).split())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the dealer shall", "file a report.", "(a)", "(b)", "nothing here;", "applies"]), max_size=12), st.lists(st.sampled_from(["the dealer must", "file a report.", "(a)", "(b)", "nothing here;", "now"]), max_size=12))
def test_redline_round_trip(old, new):
    old, new = " ".join(old), " ".join(new)
    made = R.redline(old, new)
    flat = lambda t: " ".join(" ".join(R.segments(t)).split())
    assert _strip(made.markdown, "new") == flat(new) and _strip(made.markdown, "old") == flat(old)
    assert made.identical == (R.segments(old) == R.segments(new))


def test_redline():
    assert R.redline("(a)The “fee” is due. (b) X y.", '(a) The "fee" is  due.\n(b) X y.').identical
    made = R.redline("(a) The dealer shall file a report within ten days. (b) Gone for good.", "(a) The dealer must file a report within ten days. (c) Brand new provision here.")
    assert made.markdown.split("\n")[0] == "(a) The dealer ~~shall~~ *must* file a report within ten days."
    assert [c.kind for c in made.changes] == ["edit", "deleted_provision", "new_provision"]
    assert made.changes[0].context_before == "(a) The dealer" and made.changes[0].context_after == "file a report within ten days."
    assert R.redline("a b c d e f g h", "a x c y e f g h").changes[0].deleted == "b c d"
    assert R.redline("", "").identical and R.redline("x", "").markdown == "~~x~~"
    assert R.refusal("a" * 60_000, "b" * 60_000) and R.refusal("a b", "a c") is None


# --- flatteners


def test_flatten():
    assert T.law_section_text('<p>a&nbsp;&amp;  b</p><br/>c<span class="EnSpace"/>d') == "a & b\n\nc d"
    bill = '<x:Id>1</x:Id><x:Title>An <i>act</i> to<?m del="<b>gone</b>"?> amend &amp; x</x:Title><p>Body</p>'
    assert T.extract_title(bill) == "An act to amend & x" and T.bill_text(bill) == "An act to amend & xBody"
    assert T.extract_title("<p>none</p>") is None


def _docx(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


@pytest.mark.parametrize(
    ("data", "kind", "text"),
    [
        (b"\xd0\xcf\x11\xe0...", "doc", None),
        (b"{\\rtf1 x}", "rtf", None),
        (b"  <!DOCTYPE html><b>x</b>&amp;<p>y</p>", "html", "x\n&\ny"),
        ("é ".encode(), "text", "é"),
        (b"caf\xe9 \x93x\x94", "text", "café “x”"),
        (_docx("<w:p><w:t>a</w:t><w:tab/>b<w:instrText>CODE</w:instrText></w:p><w:p x='1'>c<w:br w:type='page'/>d</w:p>"), "docx", "a\tb\nc\nd"),
        (b"", "text", ""),
    ],
)
def test_documents(data, kind, text):
    assert T.extract_document(data)[:2] == (kind, text)


def test_broken_documents():
    assert T.extract_document(b"PK broken")[2] and T.extract_document(None) == (None, None, "missing")


# --- blobs, words, parsers, limiter


def test_blobs():
    assert unpack(pack("é x")) == "é x" and unpack(pack("")) == "" and unpack(None) is None and pack(None) is None
    assert unpack(pack("abc" * 100)[:-2]) is None and unpack(b"plain") is None and unpack(b"") is None


def test_words():
    import re

    for texts in (["½ Ž²×a_b’s", "", None, "日本の é́x🙂y"], [], [None], ["a b" * 1000]):
        w = split_words(texts)
        got = [[w.vocabulary[int(c)].as_py() for c in w.codes[a:b]] for a, b in zip(w.first, w.first[1:])]
        assert got == [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("a\tb\n", [["a", "b"]]),
        ("`a`\t`NULL`\tNULL\t\\N\n", [["a", "NULL", None, None]]),
        ("`x`y`\tz", [["x`y", "z"]]),
        ("`a\tb`", [["a\tb"]]),
        ("`two\nlines`\tx\n", [["two\nlines", "x"]]),
        ("`a\\tb\\`c\\\\`\td\\0\n", [["a\tb`c\\", "d\0"]]),
        ("a\n\nb\n", [["a"], ["b"]]),
        ("a\t", [["a", ""]]),
        ("``\t\n", [["", ""]]),
        ("", []),
        ("`open", [["open"]]),
        ("\\NULL\n", [["NULL"]]),
    ],
)
def test_escaped_rows(text, rows):
    assert list(parse_text(text)) == rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.text(alphabet="ab`\\\t\nN", max_size=6)), min_size=1, max_size=4), max_size=4))
def test_escaped_round_trip(rows):
    shown = lambda v: "NULL" if v is None else "`" + v.replace("\\", "\\\\").replace("`", "\\`").replace("\t", "\\t").replace("\n", "\\n") + "`"
    assert list(parse_text("".join("\t".join(map(shown, r)) + "\n" for r in rows))) == rows


def test_decoding_and_bundles():
    assert decode("é".encode()) == "é" and decode(b"\xe9") == "é"
    assert table_source("codes", True, {"codes"}, None, {"codes"}) == "incremental" and table_source("codes", True, set(), None, {"codes"}) == "law"
    assert table_source("bill", False, {"bill"}, {"bill"}, set()) == "bill" and table_source("bill", False, set(), None, {"bill"}) == "law" and table_source("bill", False, set(), set(), {"bill"}) is None
    assert session_files(["x/pub_2001.zip", "pub_1999.zip", "odd.zip", "pub_99.zip"]) == {"1999": "pub_1999.zip", "2001": "x/pub_2001.zip"}
    assert newest_session('<a href="pub_1999.zip"><a href="pub_2023.zip">') == "2023" and newest_session("", "2001") == "2001" and newest_session("") is None


def test_limiter_does_not_count_denied_hits():
    assert allow([0, 1, 2, 59, 60.5, 61.5], 60, 2) == [True, True, False, False, True, True]
    assert allow([0, 60], 60, 1) == [True, False] and allow([], 60, 1) == []


def test_match_grammar():
    phrase = lambda *w: Node("phrase", w)
    assert parse_match('a "b c" d*') == Node("and", (phrase("a"), phrase("b", "c"), Node("prefix", ("d",))))
    assert parse_match("a OR b AND c NOT d") == Node("or", (phrase("a"), Node("and", (phrase("b"), Node("not", (phrase("c"), phrase("d")))))))
    assert parse_match("NEAR(a b, 5)") == Node("near", (5, phrase("a"), phrase("b"))) and parse_match("Café") == phrase("cafe")
    for bad in ("(a", "a AND", '"open', "NEAR(a", "a) b", "a-b"):
        with pytest.raises(MatchError):
            parse_match(bad)
    assert parse_or_quote("a-b (c") == Node("and", (phrase("a", "b"), phrase("c")))
    with pytest.raises(MatchError):
        parse_or_quote("  ")


def _pairs_of_texts():
    rng = random.Random(11)
    for letters in ("ab", "abc ", "etaoin shrdlu ", "é日a\U0001f600b"):
        for _ in range(150):
            a, b = ("".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(2))
            yield a, rng.choice([b, a[: len(a) // 2] + b + a[len(a) // 2 :], a])


@pytest.mark.parametrize("bits", [0, 8_000_000])
def test_longest_is_that_of_difflib(monkeypatch, bits):
    monkeypatch.setattr(R, "BITS", bits)
    monkeypatch.setattr(R, "GRAMS", (5, 2))
    for a, b in _pairs_of_texts():
        m = SequenceMatcher(None, a, b, autojunk=False)
        want = tuple(m.find_longest_match())
        got = R._longest(a, b, 0, len(b))
        assert got == want or got[2] == want[2] == 0
        assert (R._matched(a, b, -1, len(a) + 1) or 0) == sum(x.size for x in m.get_matching_blocks())


def test_partners_are_those_of_all_ratios():
    rng = random.Random(5)
    for _ in range(200):
        texts = [" ".join(rng.choices("the of a dealer shall file".split(), k=rng.randint(1, 12))) for _ in range(10)]
        olds, news = rng.choices(texts, k=5), rng.choices(texts[3:], k=6)
        want, free = {}, 0
        for i, old in enumerate(olds):
            likeness = {j: SequenceMatcher(None, old, news[j], autojunk=False).ratio() for j in range(free, len(news))}
            if likeness and max(likeness.values()) > R.PAIR_ABOVE:
                want[i] = max(likeness, key=lambda j: (likeness[j], -j))
                free = want[i] + 1
        assert R._partners(olds, news) == want


def test_long_texts_are_compared_soon():
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(400)]
    old = rng.choices(words, k=3000)
    new = [w if rng.random() > 0.02 else "changed" for w in old]
    began = time.process_time()
    assert R._partners([" ".join(old)], [" ".join(new)]) == {0: 0}
    assert time.process_time() - began < 5  # difflib took over 20


def test_partners_need_no_exact_counts(monkeypatch):
    """A partner that no other segment can reach is settled by its longest stretch alone."""
    taken = []
    longest = R._longest
    monkeypatch.setattr(R, "_longest", lambda *x: taken.append(1) or longest(*x))
    old = "the dealer shall file a report within ten days, and the agency shall record it"
    news = [old[:40][::-1], "our" + old[3:], "zzz"]
    assert R._partners([old], news) == {0: 1} and len(taken) == 1
