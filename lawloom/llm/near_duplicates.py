"""Near-duplicate texts: every pair at or above a similarity, by signature trees.

Similarity of two texts is the Jaccard index of their sets of word runs (``words`` consecutive
words); the runs of unlike tables are unlike numbers. Candidates are compared exactly, and nothing
is capped.

1. *Measure.* Each text gives a member row: the digest (128 bits) and size of its set and its token
   bitmap. Texts with equal sets share a digest and are one node from here on; lists and candidates
   name a node by half of the digest, and where two nodes share that half both are compared.
2. *Route.* The hash range of the runs is cut into m segments, and a text is sent to the signature
   of each of its segments, in every band of sizes that its partners can have. m is the least for
   which two sets of the band that reach the threshold agree in a segment but for a chance of
   MISSED (see :func:`segments`). Bands whose sets are too small for that, or whose threshold is
   too low, are routed exactly instead: of n runs the first n - ceil(t n) + 1 by hash are tokens,
   of which two sets that reach t share one. Texts that meet form a list.
3. *Traverse.* Each list is a signature tree: leaves are texts in order of size, inner nodes hold
   the OR of their bitmaps, the range of sizes and the least bit count. A traversal of pairs of
   nodes drops a pair as soon as the largest overlap its bitmaps allow is too small for its sizes.
4. *Hot lists.* Texts in lists above ``run_limit``, where a pair may meet nowhere else, are routed
   once more and exactly: the same prefix, but of their runs from the rarest to the commonest, so a
   phrase that very many texts share routes nobody. Texts whose rarest runs are still in lists
   above ``run_limit`` are much alike; they form one signature tree over the whole cluster, whose
   leaves of LEAF texts are made by likeness (order of the least hash, then of the bitmap). It is
   traversed from the root, one join a level, and what is left are pairs of leaves: tasks of
   bounded size.
5. *Verify.* What is left is compared exactly. Pairs are packed into small units of texts that
   belong together, so a text travels about once, not once a pair. Bodies come by one shuffle join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import cache, lru_cache
from itertools import chain, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions.blobs import unpack
from lawloom.functions.textvec import mix, shingles, split_words
from lawloom.plans.durable import cut

WIDTH = 1024  # bits of a token bitmap
LANES = WIDTH // 64
BAND = 1.6  # ratio of the largest to the smallest set of a size band
MISSED = 1e-9  # chance that a pair at the threshold meets in no segment
SURE = 21.0  # expected segments in common with a lesser chance to have none
EXACT = 800  # sets up to this size are judged by exact occupancy
BATCH = 256  # texts that are split into words at once
UNIT = 64  # texts of one side of a unit of verification
FANOUT = 8
LEAF = 64  # texts of a leaf of a cluster's tree
BANDS = 60  # bands for which segments are worked out, up to 10^12 runs

MEMBER = "tbl string, key string, whole binary, digest bigint, n int, least bigint, bits array<bigint>"


def _texts(body: pa.Array, packed: pa.Array) -> list[str | None]:
    return [
        None if b is None else unpack(b) if z else b.decode("utf-8", "replace")
        for b, z in zip(body.to_pylist(), packed.to_pylist())
    ]


def _sets(batches: Iterable[pa.RecordBatch], words: int, least_words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray | None]]]:
    """Slices of the batches with the set of each text; None where a text is not compared."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            split = split_words(_texts(batch.column("body"), batch.column("packed")))
            seeds = np.fromiter((_seed(t) for t in batch.column("tbl").to_pylist()), np.uint64, batch.num_rows)
            counts = np.diff(split.first)
            yield batch, [s if c >= max(least_words, words) else None for s, c in zip(shingles(split, words, seeds), counts)]


@lru_cache(maxsize=10_000)
def _seed(tbl: str) -> int:
    """Keeps the tables apart: their runs never meet."""
    return xxhash.xxh3_64_intdigest(tbl)


def _digest(runs: np.ndarray) -> bytes:
    """128 bits of a set in rising order."""
    return xxhash.xxh3_128_digest(runs.tobytes())


def _half(digest: bytes) -> int:
    """The half of a digest that names a node in lists."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _bitmap(runs: np.ndarray) -> np.ndarray:
    on = np.zeros(WIDTH, np.uint8)
    on[(runs >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").view(np.int64)


def _measure(words: int, least_words: int):
    def run(batches):
        for batch, sets in _sets(batches, words, least_words):
            rows = [
                (t, k, d := _digest(s), _half(d), len(s), int(s[:1].view(np.int64)[0]), _bitmap(s))
                for t, k, s in zip(batch.column("tbl").to_pylist(), batch.column("key").to_pylist(), sets)
                if s is not None
            ]
            if rows:
                kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                bits = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * LANES, np.concatenate([r[6] for r in rows]))
                yield pa.RecordBatch.from_arrays([*columns, bits], names=["tbl", "key", "whole", "digest", "n", "least", "bits"])

    return run


def band_of(n: int) -> int:
    """The size band of a set: band k holds sizes above BAND ** k up to BAND ** (k + 1)."""
    k = max(0, int(math.log(n) / math.log(BAND)))
    while BAND ** (k + 1) < n:
        k += 1
    while k and BAND**k >= n:
        k -= 1
    return k


def _miss(common: int, apart: int, m: int) -> float:
    """Chance that ``common`` runs all fall into those of m segments that ``apart`` runs touch."""
    touched = np.zeros(apart + 1)
    touched[0] = 1.0
    steps = np.arange(apart + 1) / m
    for _ in range(apart):
        touched[1:] = touched[1:] * steps[1:] + touched[:-1] * (1 - steps[:-1])
        touched[0] = 0.0
    return float((touched * np.minimum(steps, 1.0) ** common).sum())


def _closest(n: int, t: Fraction) -> list[tuple[int, int]]:
    """(runs in common, runs apart) of pairs just at t of which the larger has n runs."""
    found = []
    for other in {n, (n - (-t.numerator * n // t.denominator)) // 2, -(-t.numerator * n // t.denominator)}:
        common = -(-t.numerator * (n + other) // (t.numerator + t.denominator))
        if common <= min(n, other):
            found.append((common, n + other - 2 * common))
    return found


@cache
def segments(band: int, t: Fraction) -> int:
    """Segments for sets of a band; 0 where the exact prefix is the better route.

    Two sets that reach t hold so many runs in common and so many apart. A segment agrees if it
    has common runs only. Up to EXACT runs the chance that none agrees is worked out by exact
    occupancy and has to be below MISSED; beyond, SURE agreeing segments have to be expected. A
    band for which more segments than runs would be needed is routed by prefix.
    """
    low, high = math.floor(BAND**band) + 1, math.floor(BAND ** (band + 1))
    if band == 0 or high < low or t == 1:
        return 0
    if high <= EXACT:
        pairs = [p for n in {*np.linspace(low, high, min(8, high - low + 1)).astype(int).tolist()} for p in _closest(n, t)]
        fits = lambda m: all(_miss(c, d, m) <= MISSED for c, d in pairs)
    else:
        d, c = 2 * high * float((1 - t) / (1 + t)), 2 * low * float(t / (1 + t))
        fits = lambda m: m * math.exp(-d / m) * -math.expm1(-c / m) >= SURE
    few, many = 1, high
    if not fits(many):
        return 0
    while few < many:
        middle = (few + many) // 2
        few, many = (few, middle) if fits(middle) else (middle + 1, many)
    return few


def prefix(n: int, t: Fraction) -> int:
    """Of n runs in any one order, how many first ones two sets that reach t share one of."""
    return n + 1 + (-t.numerator * n) // t.denominator


def signatures(s: np.ndarray, t: Fraction, parts: list[int]) -> np.ndarray:
    """One signature for each segment of the set that is not empty, in each size band from its own
    to that of its largest partners; single runs of the prefix if such a band is routed so.

    ``parts`` has the segments of each band.
    """
    n, found, exact = len(s), [], False
    for band in range(band_of(n), band_of(n * t.denominator // t.numerator) + 1):
        m = parts[band]
        if not m:
            exact = True
            continue
        edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
        begin = np.concatenate(([0], np.searchsorted(s, edges)))
        used = np.flatnonzero(np.diff(np.append(begin, n)))
        sums = np.add.reduceat(mix(s), begin[used])
        found.append(mix(sums + used.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)))
    if exact:
        found.append(mix(s[: prefix(n, t)] ^ np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(found)


def _route(words: int, least_words: int, t: Fraction, parts: list[int]):
    """(token, digest) for each signature of each set; a repeated set only once a task."""

    def run(batches):
        seen: set[bytes] = set()
        for batch, sets in _sets(batches, words, least_words):
            tokens, digests = [], []
            for s in sets:
                if s is None or (d := _digest(s)) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(d)
                own = signatures(s, t, parts)
                tokens.append(own.view(np.int64))
                digests.append(np.full(len(own), _half(d), np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, digests)], names=["token", "digest"])

    return run


def _runs(words: int):
    """(digest, n, run) for each run of each set that its row asks for by its digest."""

    def run(batches):
        for batch, sets in _sets(batches, words, 0):
            digests, sizes, runs = [], [], []
            for s, asked in zip(sets, batch.column("whole").to_pylist()):
                if s is not None and _digest(s) == asked:
                    runs.append(s.view(np.int64))
                    digests.append(np.full(len(s), _half(asked), np.int64))
                    sizes.append(np.full(len(s), len(s), np.int32))
            if runs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (digests, sizes, runs)], names=["digest", "n", "run"])

    return run


def _lists(run_limit: int):
    """Runs of equal tokens in rows sorted by token and digest: short ones as lists of distinct
    members, rows of long ones as they are.

    Memory holds at most one batch and ``run_limit`` rows of the run that crosses its end.
    """

    def out(lists, digests, tokens):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) if x is not None else pa.nulls(len(digests), pa.int64()) for x in (lists, digests, tokens)], names=["list", "digest", "token"])

    def run(batches):
        seen = np.zeros(0, np.uint64)
        tail = np.zeros((2, 0), np.int64)
        hot = None
        for batch in chain(batches, [None]):
            rows = tail if batch is None else np.hstack([tail, np.vstack([batch.column(c).to_numpy() for c in ("token", "digest")])])
            if not rows.shape[1]:
                continue
            again = np.concatenate(([False], (rows[:, 1:] == rows[:, :-1]).all(axis=0)))
            rows = rows[:, ~again]
            last = rows.shape[1] if batch is None else int(np.searchsorted(rows[0], rows[0, -1]))
            whole, tail = rows[:, :last], rows[:, last:]
            if last:
                start = np.flatnonzero(np.concatenate(([True], whole[0, 1:] != whole[0, :-1])))
                size = np.diff(np.append(start, last))
                long = (size > run_limit) | (whole[0, start] == hot if hot is not None else False)
                for a, k in zip(start[long], size[long]):
                    yield out(None, whole[1, a : a + k], whole[0, a : a + k])
                short = (size > 1) & ~long
                names = np.add.reduceat(mix(whole[1].view(np.uint64)), start)
                names, pick = np.unique(names[short], return_index=True)
                fresh = ~np.isin(names, seen)
                seen = np.union1d(seen, names) if len(seen) < 1_000_000 else names
                a, k = start[short][pick][fresh], size[short][pick][fresh]
                if len(a):
                    at = np.arange(k.sum()) + np.repeat(a - (np.cumsum(k) - k), k)
                    yield out(np.repeat(names[fresh].view(np.int64), k), whole[1, at], None)
                hot = None
            if tail.shape[1] > run_limit:
                hot = tail[0, 0]
                yield out(None, tail[1], tail[0])
                tail = tail[:, :0]

    return run


def _needed(na: np.ndarray, nb: np.ndarray, t: Fraction) -> np.ndarray:
    """The least overlap with which sets of these sizes reach the threshold."""
    return -(-(t.numerator * (na + nb)) // (t.numerator + t.denominator))


def _children(tree: np.ndarray) -> np.ndarray:
    """Where the blocks of FANOUT neighbours of one tree begin, ``tree`` being sorted."""
    first = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    rank = np.arange(len(tree)) - np.repeat(first, np.diff(np.append(first, len(tree))))
    return np.flatnonzero(rank % FANOUT == 0)


def traverse(tree: np.ndarray, bits: np.ndarray, sizes: np.ndarray, side: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs that a dual traversal of signature trees leaves.

    ``tree`` names the tree of each set; all trees are built and traversed at once. ``bits`` has
    one row of words a set. Pairs are of a set of side 1 with one of side 2, or of any two sets
    where either has side 0.
    """
    order = np.lexsort((bits[:, 0], sizes, tree))
    bits, sizes, where, tree = bits[order].view(np.uint64), sizes[order].astype(np.int64), side[order], tree[order]
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    levels, cuts = [(bits, sizes, sizes, count(bits))], []
    while len(begin := _children(tree)) < len(tree):
        b, low, high, least = levels[-1]
        cuts.append(np.append(begin, len(tree)))
        levels.append((np.bitwise_or.reduceat(b, begin), np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin), np.minimum.reduceat(least, begin)))
        tree = tree[begin]
    i = j = np.arange(len(tree))
    for depth in range(len(levels) - 1, -1, -1):
        b, low, high, least = levels[depth]
        if depth < len(cuts):
            step = np.arange(FANOUT)
            k, m = (cuts[depth][i][:, None] + step).ravel(), np.repeat(j, FANOUT)
            keep = k < np.repeat(cuts[depth][i + 1], FANOUT)
            k, m = k[keep], m[keep]
            i, j = np.repeat(k, FANOUT), (cuts[depth][m][:, None] + step).ravel()
            keep = (j < np.repeat(cuts[depth][m + 1], FANOUT)) & (i <= j)
            i, j = i[keep], j[keep]
        near = low[j] * t.numerator <= high[i] * t.denominator
        i, j = i[near], j[near]
        common = count(b[i] & b[j])
        most = np.minimum(high[i] - np.maximum(0, least[i] - common), high[j] - np.maximum(0, least[j] - common))
        keep = most >= _needed(low[i], low[j], t)
        i, j = i[keep], j[keep]
    keep = (i != j) & ((where[i] == 0) | (where[j] == 0) | (where[i] != where[j]))
    return order[i[keep]], order[j[keep]]


def _groups(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal ``name`` of sorted batches; a run is small."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column(name).to_numpy()
        last = int(np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))[-1])
        if last or (rest and rest[-1].column(name)[0].as_py() != of[0]):
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest)


def _traverse_lists(t: Fraction):
    def run(batches):
        for table in _groups(batches, "list"):
            table = table.combine_chunks()
            if not table.num_rows:
                continue
            digest = table.column("digest").to_numpy()
            bits = table.column("bits").chunk(0).flatten().to_numpy().reshape(-1, LANES)
            i, j = traverse(table.column("list").to_numpy(), bits, table.column("n").to_numpy(), table.column("side").to_numpy(), t)
            pairs = np.unique(np.stack([np.minimum(digest[i], digest[j]), np.maximum(digest[i], digest[j])]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _rarest(bodies: DataFrame, words: int, t: Fraction) -> DataFrame:
    """(token, digest): the prefix of each set in the order from its rarest run to its commonest."""
    runs = cut(bodies.mapInArrow(_runs(words), "digest bigint, n int, run bigint").distinct())
    held = runs.groupBy("run").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("digest", "n").orderBy("df", "run"))
    size = F.col("n") + 1 - F.ceil(F.col("n") * t.numerator / t.denominator - 1e-9)
    return runs.join(held, "run").withColumn("place", place).where((F.col("place") <= size) & (F.col("df") > 1)).select(F.col("run").alias("token"), "digest")


def _number(starts: dict[int, int] | None):
    """Rows of a task in order as (leaf, digest); without ``starts`` only how many leaves a task has."""

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            if starts is not None and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(at // LEAF + starts[task]), batch.column(0)], names=["leaf", "digest"])
        if starts is None:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([-(-seen // LEAF)], pa.int64())], names=["leaf", "digest"])

    return run


def _cluster(hot: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of leaves that a traversal of one signature tree leaves: rows (list, digest, side).

    The number of leaves of each task comes to the driver, so that leaves are numbered without
    gaps; a node of the level above has FANOUT neighbours.
    """
    ordered = cut(hot.repartitionByRange("least", "bits", "digest").sortWithinPartitions("least", "bits", "digest"))
    starts, leaves = {}, 0
    for task, many in sorted(tuple(r) for r in ordered.select("digest").mapInArrow(_number(None), "leaf bigint, digest bigint").collect()):
        starts[task], leaves = leaves, leaves + many
    placed = cut(ordered.select("digest").mapInArrow(_number(starts), "leaf bigint, digest bigint"))
    lanes = [f"w{k}" for k in range(LANES)]
    nodes = placed.join(hot, "digest").select("leaf", "n", *[F.element_at("bits", k + 1).alias(x) for k, x in enumerate(lanes)])
    ones = sum((F.bit_count(F.col(x)) for x in lanes), F.lit(0))
    tree = [cut(nodes.groupBy(F.col("leaf").alias("node")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min(ones).alias("least"), *[F.bit_or(x).alias(x) for x in lanes]))]
    while leaves > 1:
        leaves = -(-leaves // FANOUT)
        tree.append(cut(tree[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), *[F.bit_or(x).alias(x) for x in lanes])))
    pairs = hot.sparkSession.range(1).select(F.col("id").alias("i"), F.col("id").alias("j"))
    p, q = t.numerator, t.denominator
    for depth, level in reversed(list(enumerate(tree))):
        left, right = (level.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("low", "high", "least", *lanes)]) for x in ("i", "j"))
        common = sum((F.bit_count(F.col(f"i_{x}").bitwiseAND(F.col(f"j_{x}"))) for x in lanes), F.lit(0))
        most = F.least(*[F.col(f"{x}_high") - F.greatest(F.lit(0), F.col(f"{x}_least") - common) for x in "ij"])
        fits = (F.greatest("i_low", "j_low") * p <= F.least("i_high", "j_high") * q) & (most * (p + q) >= p * (F.col("i_low") + F.col("j_low")))
        pairs = cut(pairs.join(left, "i").join(right, "j").where(fits).select("i", "j"))
        if depth:
            children = lambda node: F.explode(F.sequence(F.col(node) * FANOUT, F.col(node) * FANOUT + FANOUT - 1))
            pairs = pairs.select(children("i").alias("a"), "j").select("a", children("j").alias("b")).where("a <= b").toDF("i", "j")
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("leaf"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("leaf"), F.lit(1).alias("side")), F.struct(F.col("j").alias("leaf"), F.lit(2).alias("side"))))
    return pairs.select(F.xxhash64("i", "j", F.lit(1)).alias("list"), F.explode(sides).alias("at")).select("list", "at.*").join(placed, "leaf").select("list", "digest", "side")


def _verify(words: int, t: Fraction):
    def run(batches):
        for table in _groups(batches, "unit"):
            docs = table.filter(pc.is_valid(table.column("body")))
            sets: dict[int, dict[bytes, np.ndarray]] = {}
            for batch, found in _sets(docs.to_batches(), words, 0):
                for asked, s in zip(batch.column("whole").to_pylist(), found):
                    if s is not None and _digest(s) == asked:  # a key may have other texts
                        sets.setdefault(_half(asked), {})[asked] = s
            i, j = [], []
            pairs = table.filter(pc.is_null(table.column("body")))
            for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
                for (da, x), (db, y) in product(sets[a].items(), sets[b].items()):
                    at = np.searchsorted(x, y)
                    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                    if both * t.denominator >= (len(x) + len(y) - both) * t.numerator:
                        i.append(min(da, db))
                        j.append(max(da, db))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.binary()), pa.array(j, pa.binary())], names=["a", "b"])

    return run


def near_duplicates(texts: DataFrame, *, threshold: float = 0.8, words: int = 5, least_words: int = 0, run_limit: int = 256) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and the members of each text.

    ``texts`` has the columns ``tbl``, ``key``, ``body`` (bytes) and ``packed`` (whether the bytes
    are zlib); others are ignored. Texts of one ``tbl`` are compared with each other only.

    Returns ``(links, members)``: links (a, b), a < b, between digests of distinct sets, and
    members (tbl, key, digest). Texts of one digest are copies for this similarity. Nulls, blobs
    that do not unpack and texts of fewer than ``least_words`` or ``words`` words have no row;
    rows given twice count once; each text of a key with several is compared; empty input gives
    empty results. ``threshold`` lies above 0 and is at most 1; digests have 128 bits.
    """
    if not (0 < threshold <= 1 and words >= 1 and run_limit >= 1):
        raise ValueError("threshold must be above 0 and at most 1, words and run_limit at least 1")
    t = Fraction(threshold).limit_denominator(10_000)
    source = texts.select("tbl", "key", "body", "packed").where("tbl is not null and key is not null and body is not null")
    measured = cut(source.mapInArrow(_measure(words, least_words), MEMBER))
    members = measured.select("tbl", "key", F.col("whole").alias("digest"))
    nodes = measured.select("whole", "digest", "n", "least", "bits").dropDuplicates(["whole"]).drop("whole")
    one = measured.groupBy("whole", "digest").agg(F.min(F.struct("tbl", "key")).alias("m")).select("whole", "digest", "m.tbl", "m.key")

    def bodies(asked: DataFrame) -> DataFrame:
        """The bodies of asked rows (tbl, key, ...), at any size by a shuffle of both."""
        return source.join(asked.hint("merge"), ["tbl", "key"])

    def met(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Short lists, and the nodes in lists above the limit."""
        found = cut(routed.repartition("token").sortWithinPartitions("token", "digest").mapInArrow(_lists(run_limit), "list bigint, digest bigint, token bigint"))
        return found.where("token is null").select("list", "digest", F.lit(0).alias("side")), found.where("token is not null").select("digest").distinct()

    parts = [segments(band, t) for band in range(BANDS)]
    lists, hot = met(source.mapInArrow(_route(words, least_words, t, parts), "token bigint, digest bigint"))
    hot = cut(hot)
    if not hot.isEmpty():
        more, alike = met(_rarest(bodies(one.join(hot, "digest")), words, t))
        lists = lists.unionByName(more)
        alike = cut(nodes.join(alike, "digest"))
        if not alike.isEmpty():
            lists = lists.unionByName(_cluster(alike, t))
    lists = lists.distinct().join(nodes, "digest").select("list", "digest", "side", "n", "bits")
    candidates = cut(lists.repartition("list").sortWithinPartitions("list").mapInArrow(_traverse_lists(t), "a bigint, b bigint").distinct())

    ends = candidates.select(F.explode(F.array(F.struct(F.col("a").alias("digest"), F.col("a").alias("near")), F.struct(F.col("b").alias("digest"), F.col("a").alias("near")))).alias("e")).select("e.*")
    label = ends.groupBy("digest").agg(F.min("near").alias("label"))
    size = label.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / UNIT).alias("blocks"))
    spot = label.join(size, "label").select("digest", F.xxhash64("label", F.pmod(F.xxhash64("digest"), "blocks")).alias("spot"))
    placed = candidates.join(spot.select(F.col("digest").alias("a"), F.col("spot").alias("sa")), "a").join(spot.select(F.col("digest").alias("b"), F.col("spot").alias("sb")), "b")
    pairs = cut(placed.select(F.xxhash64(F.least("sa", "sb"), F.greatest("sa", "sb")).alias("unit"), "a", "b"))
    wanted = pairs.select("unit", F.explode(F.array("a", "b")).alias("digest")).distinct()
    rows = bodies(wanted.join(one, "digest")).select("unit", "whole", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), "body", "packed", "tbl").unionByName(
        pairs.select("unit", F.lit(None).cast("binary").alias("whole"), "a", "b", F.lit(None).cast("binary").alias("body"), F.lit(False).alias("packed"), F.lit(None).cast("string").alias("tbl"))
    )
    links = rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_verify(words, t), "a binary, b binary")
    return links, members


def key_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(tbl, key_a, key_b) of all pairs of different keys: of links, and of copies of one text.

    Copies are expanded into all their pairs, as a result of pairs demands; ``groups.grouped``
    says the same without that, one row a key.
    """
    m = members.distinct()
    x = m.select("tbl", F.col("digest").alias("a"), F.col("key").alias("ka"))
    y = m.select("tbl", F.col("digest").alias("b"), F.col("key").alias("kb"))
    linked = links.distinct().join(x, "a").join(y, ["tbl", "b"]).select("tbl", "ka", "kb")
    copies = x.join(y.withColumnRenamed("b", "a"), ["tbl", "a"]).where("ka < kb").select("tbl", "ka", "kb")
    return linked.unionByName(copies).select("tbl", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
