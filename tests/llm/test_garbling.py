"""Wrongly decoded text."""

import random
import unicodedata

from lawloom.llm.garbling import CHAINS, readings, repair, undo

SCHEMA = "tbl string, key string, source string, text string, pool int"
WORDS = ["“fee”", "§ 12", "naïve", "5½", "Île", "mover’s", "Ã-frame", "grade Â", "Łódź", "now — then"]


def _garble(text, *chain):
    for written, read in chain:
        out = []
        for b in text.encode(written):
            try:
                out.append(bytes([b]).decode(read))
            except UnicodeDecodeError:
                out.append(chr(b))
        text = "".join(out)
    return text


def test_undo_reverses_each_single_byte_chain():
    for chain in CHAINS[1:]:
        if all(read not in ("gbk", "big5", "shift_jis", "euc_kr") for _, read in chain) and chain[0][0] == "utf-8":
            assert undo(_garble("“é”—½", *chain), chain) == "“é”—½", chain
    assert undo("鈥檚", (("utf-8", "gbk"),)) == "’s"
    assert undo("plain", CHAINS[1]) is None and undo("Ã-frame", CHAINS[1]) is None


def test_repair(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(600):
        text = " ".join(rng.choice(WORDS) for _ in range(3)) + " end"
        chain = rng.choice(CHAINS[1:3]) if k % 20 == 0 else ()
        bad = _garble(text, *chain)
        rows.append((rng.choice("ab"), str(k), rng.choice(["x", None]), bad, 1))
        if bad != text:
            want[str(k)] = text
    rows += [("a", "lost", "x", "caf� x", 1), ("a", "null", "x", None, 1), ("a", "empty", "x", "", 1), ("a", "ascii", "x", "plain", 1), ("a", None, None, "Â§ 1", 1), ("a", "long", "x", "w " * 50_000 + "â€œ", 1)]
    rows += [r for r in rows if r[1] == "0"]
    got = repair(spark.createDataFrame(rows, SCHEMA)).collect()
    fixed = {r.key: r.repaired for r in got if r.key and r.key.isdigit()}
    assert fixed == want
    others = {r.key: (r.repaired[-6:], r.lost) for r in got if not (r.key and r.key.isdigit())}
    assert others == {"lost": ("caf� x", True), None: ("§ 1", False), "long": ("w w w “"[-6:], False)}
    assert len(got) == len(want) + 3 + ("0" in want)


def test_empty(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quick_test_never_denies_a_reading():
    rng = random.Random(6)
    chars = "éÃ©â€œ½Â ÐÑ€їПрслово日本語鈥檚ä漢カナαβγ\x9d\x81\xa0"
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(1, 8)))
        meant = {n: t for n, chain in enumerate(CHAINS) if chain and (t := undo(text, chain)) is not None}
        assert dict(readings(text)) == {0: text, **{n: t for n, t in meant.items() if all(unicodedata.category(c) not in ("Cc", "Cn", "Co") for c in t if c not in text)}}


def test_prose_of_other_scripts_and_many_sources(spark):
    rng = random.Random(8)
    words = ["слово", "закон", "λόγος", "νόμος", "法律です", "県の条例", "naïve", "“fee”"]
    rows = [("a", str(k), f"s{k % 700}", " ".join(rng.choice(words) for _ in range(8)), 1) for k in range(1400)]
    rows += [("a", f"bad{k}", f"s{k}", _garble("the “fee” is naïve", ("utf-8", "cp1252")), 1) for k in range(20)]
    got = {r.key: r.repaired for r in repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {f"bad{k}": "the “fee” is naïve" for k in range(20)}
