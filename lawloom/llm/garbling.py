"""Text decoded with the wrong character encoding: found by expectation-maximization, and restored.

Each stretch of characters beyond ASCII has a latent chain of encodings: none, or one or two steps
of writing in one encoding and reading in another. A stretch is as likely under a chain as the
text that undoing the chain gives, under frequencies of characters in clean text. The mixture of
chains of each pool (a field of a source) and the frequencies are estimated together from all
records, so evidence too weak in one record adds up; then each stretch is repaired by posterior.

Stretches that no chain can have made are clean for certain: they are counted by character, once,
and never kept as such, so prose in other scripts costs one scan. The readings of the rest are
written once; a round of the estimate only weighs them. Mixtures are a table with one row a pool,
joined to the readings; what comes to the driver is one number for each character of Unicode in use.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.plans.durable import cut

STRETCH = r"[^\x00-\x7F]+"
LOST = "\ufffd"
_STRETCH = re.compile(STRETCH)
HELD = 200_000  # counts that a task holds before it passes them on

# Encodings that UTF-8 is read in by mistake; the first group also twice.
OFTEN = ("cp1252", "latin-1")
SELDOM = ("cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "koi8_r", "mac_roman", "gbk", "big5", "shift_jis", "euc_kr")
#: A chain lists steps (written, read) in the order in which they happened.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    (),
    *(((("utf-8", c)),) for c in (*OFTEN, *SELDOM)),
    *((("utf-8", a), ("utf-8", b)) for a in OFTEN for b in OFTEN),
    (("cp1252", "latin-1"),),
)
CLEAN = 0
LOSS = len(CHAINS)  # characters that could not be read were replaced for good: no clean text holds them
WAYS = len(CHAINS) + 1
LAST_STEPS = sorted({chain[-1] for chain in CHAINS if chain})


@lru_cache(maxsize=200_000)
def _to_bytes(char: str, encoding: str) -> bytes | None:
    """The bytes that were read as ``char``; unassigned bytes are read as control characters."""
    try:
        return char.encode(encoding)
    except UnicodeEncodeError:
        code = ord(char)
        if 0x80 <= code <= 0x9F and encoding.startswith("cp1"):
            try:
                bytes([code]).decode(encoding)
            except UnicodeDecodeError:
                return bytes([code])
        return None


def _reread(text: str, raw: list[bytes | None], k: int, written: str) -> tuple[str, int] | None:
    """What the fewest characters from k on stand for, and where they end."""
    whole = b""
    for end in range(k, min(k + 4, len(text))):
        if raw[end] is None:
            return None
        whole += raw[end]
        try:
            return whole.decode(written), end + 1
        except UnicodeDecodeError:
            continue
    return None


def _undo_step(text: str, written: str, read: str) -> str | None:
    """``text`` with every stretch read again as it was written; None if nothing changes."""
    raw = [_to_bytes(c, read) for c in text]
    out, k = [], 0
    while k < len(text):
        meant = _reread(text, raw, k, written) if raw[k] is not None and raw[k][0] >= 0x80 else None
        if meant is None:
            out.append(text[k])
            k += 1
        else:
            out.append(meant[0])
            k = meant[1]
    new = "".join(out)
    return new if new != text else None


def undo(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the steps of ``chain``; None where the chain cannot have made it."""
    for written, read in reversed(chain):
        if (text := _undo_step(text, written, read)) is None:
            return None
    return text


_SEQUENCE = re.compile(rb"[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}")


def _control(error: UnicodeEncodeError) -> tuple[bytes, int]:
    """Bytes for what an encoding lacks: control characters stand for themselves, others break a sequence."""
    return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) <= 0x9F else b"?" for c in error.object[error.start : error.end]), error.end


codecs.register_error("lawloom-control", _control)


def _may_undo(stretch: str, written: str, read: str) -> bool:
    """Whether a step can have made a stretch, judged by its bytes alone; a quick and wide test."""
    if written != "utf-8":
        return True
    return _SEQUENCE.search(stretch.encode(read, "lawloom-control")) is not None


@lru_cache(maxsize=100_000)
def readings(stretch: str) -> tuple[tuple[int, str], ...]:
    """(chain, text) for each chain that can have made the stretch; the clean one comes first, or LOSS where it cannot be clean."""
    found = [(LOSS if LOST in stretch else CLEAN, stretch)]
    may = {step: _may_undo(stretch, *step) for step in LAST_STEPS}
    for number, chain in enumerate(CHAINS[1:], 1):
        if may[chain[-1]] and (text := undo(stretch, chain)) is not None and not any(_unused(c) for c in text if c not in stretch):
            found.append((number, text))
    return tuple(found)


@lru_cache(maxsize=20_000)
def _unused(char: str) -> bool:
    """Whether nobody writes a character: a control, a private one or one without a meaning."""
    return unicodedata.category(char) in ("Cc", "Cn", "Co", "Cs")


class Model(NamedTuple):
    """Log weights of each chain in a pool without evidence, counts of each character and of all,
    and log weights of a class of characters being followed by another character beyond ASCII.
    Pools have their own table."""

    unknown: list[float]
    chars: dict[str, float]
    total: float
    follows: dict[str, float]


@lru_cache(maxsize=20_000)
def _class(char: str) -> str:
    """Script of a letter, else the general category."""
    kind = unicodedata.category(char)[0]
    return unicodedata.name(char, "L").split(" ")[0] if kind == "L" else kind


@lru_cache(maxsize=100_000)
def _parts(text: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Characters beyond ASCII, and the classes of those that another one follows."""
    return tuple(c for c in text if c > "\x7f"), tuple(_class(a) for a, b in zip(text, text[1:]) if a > "\x7f" and b > "\x7f")


PRIOR = [0.9 if k == CLEAN else 0.1 / (WAYS - 1) for k in range(WAYS)]
FLOOR = 1e-4  # count of a character that none has
FOLLOWS = 0.02  # how often a character of a class without evidence is followed by another


def posterior(known: list[tuple[int, str]], n: float, weight: list[float], model: Model) -> tuple[list[float], float]:
    """The probability of each reading of a stretch that occurs n times, and its log likelihood.

    What a stretch itself adds, in its pool, to the counts of characters is left out, so none justifies itself.
    """
    scores = []
    for chain, text in known:
        chars, followed = _parts(text)
        held = (max(0.0, model.chars.get(c, 0.0) - n * chars.count(c)) for c in chars)
        scores.append(weight[chain] + sum(math.log((h + FLOOR) / model.total) for h in held) + sum(model.follows.get(c, math.log(FOLLOWS)) for c in followed))
    top = max(scores)
    total = sum(math.exp(s - top) for s in scores)
    return [math.exp(s - top) / total for s in scores], top + math.log(total)


POOL, CHAR, CLASS, FOLLOWED, CHAIN, LIKELIHOOD, AMBIGUOUS = range(7)
COUNT = "kind int, pool string, what string, weight double"


def _counts(rows: dict[tuple[int, str | None, str | None], float]) -> pa.RecordBatch:
    keys = list(rows)
    kinds = (pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([*(pa.array([k[n] for k in keys], kind) for n, kind in enumerate(kinds)), pa.array([*rows.values()], pa.float64())], names=["kind", "pool", "what", "weight"])


def _clean_text(sums: defaultdict, text: str, weight: float) -> None:
    """Counts the characters of a clean text."""
    chars, followed = _parts(text)
    for c in chars:
        if c != LOST:
            sums[CHAR, None, c] += weight
            sums[CLASS, None, _class(c)] += weight
    for c in followed:
        sums[FOLLOWED, None, c] += weight


def _survey(batches: Iterator[pa.RecordBatch]):
    """Counts of a task's texts: characters of clean stretches, clean stretches of each pool, and
    each stretch that is not clean for certain."""
    sums: defaultdict[tuple, float] = defaultdict(float)
    for batch in batches:
        for pool, text in zip(*(c.to_pylist() for c in batch.columns)):
            for stretch in _STRETCH.findall(text):
                if readings(stretch)[-1][0] != CLEAN:
                    sums[AMBIGUOUS, pool, stretch] += 1
                else:
                    sums[POOL, pool, None] += 1
                    _clean_text(sums, stretch, 1)
        if len(sums) > HELD:
            yield _counts(sums)
            sums.clear()
    yield _counts(sums)


def _read(batches: Iterator[pa.RecordBatch]):
    """The readings of counted stretches."""
    for batch in batches:
        known = [readings(s) for s in batch.column("stretch").to_pylist()]
        chains = pa.array([[c for c, _ in k] for k in known], pa.list_(pa.int32()))
        texts = pa.array([[t for _, t in k] for k in known], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, chains, texts], names=[*batch.schema.names, "chains", "texts"])


def _expect(model):
    """Sums of a task's posteriors: by pool and chain, by chain, and by character of the clean text;
    and the log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]):
        m = model.value
        sums: defaultdict[tuple, float] = defaultdict(float)
        pools: dict[str, list[float]] = {}
        for batch in batches:
            for pool, n, chains, texts, mixture in zip(*(c.to_pylist() for c in batch.columns)):
                if pool not in pools:
                    pools[pool] = _weights(mixture, m)
                chances, likelihood = posterior([*zip(chains, texts)], n, pools[pool], m)
                sums[LIKELIHOOD, None, None] += n * likelihood
                for chain, text, p in zip(chains, texts, chances):
                    if p > 1e-9:
                        sums[POOL, pool, str(chain)] += n * p
                        sums[CHAIN, None, str(chain)] += n * p
                        _clean_text(sums, text, n * p)
            if len(sums) > HELD:
                yield _counts(sums)
                sums.clear()
                pools.clear()
        yield _counts(sums)

    return run


def _maximize(rows: dict[tuple[int, str | None], float]) -> Model:
    """The model of summed counts (kind, what) of clean stretches and of a round."""
    of = lambda kind: {what: w for (k, what), w in rows.items() if k == kind}
    chars, seen, followed, chains = of(CHAR), of(CLASS), of(FOLLOWED), of(CHAIN)
    whole = sum(chains.values()) + 1.0
    follows = {c: math.log((followed.get(c, 0.0) + FOLLOWS) / (n + 1.0)) for c, n in seen.items()}
    unknown = [math.log((chains.get(str(k), 0.0) + p) / whole) for k, p in enumerate(PRIOR)]
    return Model(unknown, chars, sum(chars.values()) + 1.0, follows)


def _mixtures(sums: DataFrame) -> DataFrame:
    """(pool, mixture): what each chain weighs in each pool, from rows (pool, what, weight)."""
    return sums.groupBy("pool").agg(F.collect_list(F.struct("what", "weight")).alias("mixture"))


def _mixed(rows: DataFrame, mixtures: DataFrame | None) -> DataFrame:
    """Rows with the mixture of their pool, null without one."""
    return rows.withColumn("mixture", F.lit(None).cast("array<struct<what:string,weight:double>>")) if mixtures is None else rows.join(mixtures, "pool", "left")


def _weights(mixture: list[dict] | None, model: Model) -> list[float]:
    """Log weights of the chains of a pool; one without evidence has those of all pools."""
    if mixture is None:
        return model.unknown
    sums = [0.0] * WAYS
    for row in mixture:
        sums[int(row["what"])] += row["weight"]
    total = sum(sums) + 1.0
    return [math.log((w + p) / total) for w, p in zip(sums, PRIOR)]


def estimate(counted: DataFrame, *, rounds: int = 12, tolerance: float = 1e-3) -> tuple[Model, DataFrame | None, DataFrame]:
    """The model of counts by :func:`_survey`, the mixtures of pools, and the readings.

    The first characters come from stretches that no chain can have made. A round is one pass over
    the readings of distinct stretches; it ends when the log likelihood of a stretch moves by less
    than ``tolerance``.
    """
    context = counted.sparkSession.sparkContext
    gathered = lambda df: {(r.kind, r.what): r.weight for r in df.where(F.col("pool").isNull()).select("kind", "what", "weight").collect()}
    clean = {(r.kind, r.what): r.weight for r in counted.groupBy("kind", F.when(F.col("pool").isNull(), F.col("what")).alias("what")).agg(F.sum("weight").alias("weight")).collect()}
    clean_chains, stretches = clean.pop((POOL, None), 0.0), clean.pop((AMBIGUOUS, None), 0.0)
    certain = counted.where(F.col("kind") == POOL).select("pool", F.lit(str(CLEAN)).alias("what"), "weight")
    known = counted.where(F.col("kind") == AMBIGUOUS).select("pool", F.col("what").alias("stretch"), F.col("weight").alias("n"))
    known = cut(known.mapInArrow(_read, "pool string, stretch string, n double, chains array<int>, texts array<string>"))
    model, mixtures, before = _maximize(clean), None, None
    for _ in range(rounds if stretches else 0):
        rows = known.select("pool", "n", "chains", "texts")
        rows = _mixed(rows, mixtures)
        sums = cut(rows.mapInArrow(_expect(context.broadcast(model)), COUNT).groupBy("kind", "pool", "what").agg(F.sum("weight").alias("weight")))
        mixtures = _mixtures(sums.where(F.col("kind") == POOL).select("pool", "what", "weight").unionByName(certain))
        new = gathered(sums)
        likelihood = new.pop((LIKELIHOOD, None)) / stretches
        for k, w in clean.items():
            new[k] = new.get(k, 0.0) + w
        new[CHAIN, str(CLEAN)] = new.get((CHAIN, str(CLEAN)), 0.0) + clean_chains
        model = _maximize(new)
        if before is not None and abs(likelihood - before) < tolerance:
            break
        before = likelihood
    return model, mixtures, known


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]):
        m = model.value
        for batch in batches:
            out = []
            for pool, stretch, n, chains, texts, mixture in zip(*(c.to_pylist() for c in batch.columns)):
                by_text: defaultdict[str, float] = defaultdict(float)
                clean = 0.0
                for chain, text, p in zip(chains, texts, posterior([*zip(chains, texts)], n, _weights(mixture, m), m)[0]):
                    by_text[text] += p
                    clean += p * (chain == CLEAN)
                if clean < 0.5:
                    out.append((pool, stretch, max(by_text, key=lambda t: (by_text[t], t)), LOST in stretch))
            types = (pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["pool", "stretch", "meant", "lost"])

    return run


def _doubtful(batches: Iterator[pa.RecordBatch]):
    """(pool, text_id, stretch) for each distinct stretch of a text that is not clean for certain."""
    for batch in batches:
        rows = [
            (pool, name, stretch)
            for pool, name, text in zip(*(c.to_pylist() for c in batch.columns))
            for stretch in set(_STRETCH.findall(text))
            if readings(stretch)[-1][0] != CLEAN
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["pool", "text_id", "stretch"])


def repair(records: DataFrame) -> DataFrame:
    """(tbl, key, text, repaired, lost): the records that hold garbled text.

    ``records`` has the columns ``tbl``, ``key``, ``source`` and ``text``; a pool is a ``tbl`` (one
    field) of a ``source``, null being a source of its own, however many there are. ``repaired`` is
    the original text wherever nothing was lost; ``lost`` tells whether characters were replaced
    for good, which then stay. Null, empty and ASCII texts are no case; rows given twice, and null
    keys, come out as they came in; an empty table gives an empty result.

    Only counts of distinct stretches are shuffled for the estimate. Verdicts are joined back by
    stretch, only garbled ones; partitions of hot stretches are split by adaptive execution.
    """
    context = records.sparkSession.sparkContext
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    pool = F.concat(named("tbl"), F.lit("\x1f"), named("source"))
    dirty = records.select("tbl", "key", "text", pool.alias("pool")).where(F.col("text").rlike(STRETCH))
    counted = cut(dirty.select("pool", "text").mapInArrow(_survey, COUNT).groupBy("kind", "pool", "what").agg(F.sum("weight").alias("weight")))
    model, mixtures, known = estimate(counted)
    weighed = _mixed(known.select("pool", "stretch", "n", "chains", "texts"), mixtures)
    verdicts = cut(weighed.mapInArrow(_judge(context.broadcast(model)), "pool string, stretch string, meant string, lost boolean"))
    dirty = dirty.withColumn("text_id", F.md5("text"))
    found = dirty.select("pool", "text_id", "text").mapInArrow(_doubtful, "pool string, text_id string, stretch string")
    fixes = found.distinct().join(verdicts, ["pool", "stretch"]).groupBy("pool", "text_id").agg(F.map_from_entries(F.collect_list(F.struct("stretch", "meant"))).alias("fix"), F.max("lost").alias("lost"))
    joined = dirty.join(fixes, ["pool", "text_id"])
    parts = F.regexp_extract_all("text", F.lit(rf"{STRETCH}|[\x00-\x7F]+"), F.lit(0))
    return joined.select("tbl", "key", "text", F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at("fix", p), p)), "").alias("repaired"), "lost")
