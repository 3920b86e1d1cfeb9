"""A sliding-window limiter for each key, in which denied hits do not count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def allow(times: Iterable[float], window: float, limit: int, held: deque | None = None) -> list[bool]:
    """Whether each hit, in order, is allowed: fewer than ``limit`` allowed ones in the window before it."""
    held = deque() if held is None else held
    out = []
    for now in times:
        while held and now - held[0] > window:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(now)
    return out


def _spells(hits: DataFrame, key: str, order: str, window: float, slice_seconds: float) -> DataFrame:
    """``hits`` (with ``__t``) and ``__spell``, the time at which a run of hits without a long pause began.

    Time is cut into slices; only the last time and the last beginning of each slice are carried
    to later ones, so no task sorts all hits of a busy key.
    """
    rows = hits.withColumn("__s", F.floor(F.col("__t") / slice_seconds))
    inside = Window.partitionBy(key, "__s").orderBy("__t", order)
    slices = Window.partitionBy(key).orderBy("__s")
    ends = rows.groupBy(key, "__s").agg(F.max("__t").alias("__end")).select(key, "__s", F.lag("__end").over(slices).alias("__before"))
    pause = F.col("__t") - F.coalesce(F.lag("__t").over(inside), F.col("__before"))
    fresh = rows.join(ends, [key, "__s"]).withColumn("__new", F.when(F.coalesce(pause > window, F.lit(True)), F.col("__t"))).drop("__before")
    begun = fresh.groupBy(key, "__s").agg(F.max("__new").alias("__last"))
    begun = begun.select(key, "__s", F.max("__last").over(slices.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    running = F.max("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return fresh.join(begun, [key, "__s"]).withColumn("__spell", F.coalesce(running, F.col("__carried"))).drop("__new", "__carried", "__s")


def limit_hits(hits: DataFrame, key: str, time: str, order: str, *, window: float = 60.0, limit: int = 120, slice_seconds: float = 86_400.0) -> DataFrame:
    """``hits`` with ``allowed``; ties in ``time`` are taken by ``order``.

    A denial changes what later hits meet, so hits are folded in order. After a pause of more than
    the window nothing is remembered; hits are therefore cut at such pauses, and a busy key becomes
    many independent groups. Rows with a null key or time are denied.

    A key that never pauses for a window is one run of hits and one task, as each decision depends
    on the one before; memory holds ``limit`` times of it, and rows stream through in batches.
    """
    known = hits.withColumn("__t", F.unix_micros(F.col(time).cast("timestamp")) / 1e6)
    grouped = _spells(known.where(F.col(key).isNotNull() & F.col("__t").isNotNull()), key, order, window, slice_seconds)
    names = hits.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema) + ", allowed boolean"

    def fold(batches):
        group, held = None, deque()
        for batch in batches:
            out = []
            for own, spell, now in zip(*(batch.column(c).to_pylist() for c in ("__k", "__spell", "__t"))):
                if (own, spell) != group:
                    group, held = (own, spell), deque()
                out += allow((now,), window, limit, held)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.bool_())], names=[*names, "allowed"])

    spells = grouped.withColumn("__k", F.col(key)).repartition(key, "__spell").sortWithinPartitions(key, "__spell", "__t", order)
    done = spells.mapInArrow(fold, schema)
    rest = known.where(F.col(key).isNull() | F.col("__t").isNull()).select(*names, F.lit(False).alias("allowed"))
    return done.unionByName(rest)
