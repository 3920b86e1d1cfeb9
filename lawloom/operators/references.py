"""References to records that do not exist, were deleted, or came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_key(key: Column) -> Column:
    """A key without blanks around it or dots at its end, in one letter case."""
    return F.upper(F.regexp_replace(key.cast("string"), r"^\s+|[\s.]+$", ""))


def validity(parents: DataFrame, keys: list[str], live: Column, since: str, until: str | None = None) -> DataFrame:
    """(keys, valid_from, valid_to, open): the interval in which each parent key exists.

    A key with a live row is open: valid from the first of its live rows on, without an end.
    Otherwise it is closed: valid from its first row to the last ``until`` of its rows, null if
    that is not known. Rows with a null key are left out.
    """
    end = parents[until].cast("timestamp_ntz") if until else F.lit(None).cast("timestamp_ntz")
    rows = parents.select(*[normal_key(parents[k]).alias(f"k{i}") for i, k in enumerate(keys)], F.coalesce(live, F.lit(False)).alias("live"), parents[since].cast("timestamp_ntz").alias("since"), end.alias("until"))
    rows = rows.where(" and ".join(f"k{i} is not null" for i in range(len(keys))))
    found = rows.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(
        F.max("live").alias("open"), F.min(F.when(F.col("live"), F.col("since"))).alias("first_live"), F.min("since").alias("first"), F.max("until").alias("last")
    )
    begin, stop = F.when(F.col("open"), F.col("first_live")).otherwise(F.col("first")), F.when(~F.col("open"), F.col("last"))
    return found.select(*[f"k{i}" for i in range(len(keys))], begin.alias("valid_from"), stop.alias("valid_to"), "open")


def broken_references(refs: DataFrame, keys: list[str], parents: DataFrame, at: str = "at", *, small: bool = False) -> DataFrame:
    """The rows of ``refs`` that do not lie in the interval of their parent, with the reason.

    ``parents`` comes from :func:`validity`. A reference is ``missing`` if its key has no interval,
    ``deleted`` if that is closed, and ``late`` if it begins after the reference, whose time is
    ``at``. References and parents are partitioned and sorted by the key alike and merged in one
    pass; parents are one row a key before they move, and partitions of hot keys are split by
    adaptive execution, which repeats only the parent's row. ``small`` says that the parents are a
    fixed table of some dozens of rows, which is broadcast. A reference with a null key is none. A
    null time of either side is never late. Repeated rows stay repeated. The result has the columns
    of ``refs``, the reason, and the interval (valid_from, valid_to).
    """
    named = refs.select("*", *[normal_key(refs[k]).alias(f"__k{i}") for i, k in enumerate(keys)])
    named = named.where(" and ".join(f"__k{i} is not null" for i in range(len(keys))))
    own = parents.select(*[F.col(f"k{i}").alias(f"__k{i}") for i in range(len(keys))], F.col("open").alias("__open"), F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"))
    merged = named.join(F.broadcast(own) if small else own.hint("merge"), [f"__k{i}" for i in range(len(keys))], "left")
    reason = (
        F.when(F.col("__open").isNull(), "missing")
        .when(~F.col("__open"), "deleted")
        .when(F.col("__from") > F.col(at).cast("timestamp_ntz"), "late")
    )
    return merged.withColumn("reason", reason).where("reason is not null").select(*refs.columns, "reason", F.col("__from").alias("valid_from"), F.col("__to").alias("valid_to"))
