"""Ordered scans over keys in levels of time buckets, so that no task holds the rows of a key.

Rows of a key are scanned inside small buckets. What a bucket passes on, a sum or the runs open at its ends, is scanned
inside larger buckets, and only what those pass on meets over the whole key: as many rows as the key's time span has large
buckets, however many rows the key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000
#: Seconds of a small and of a large bucket.
SMALL, LARGE = 10, 7200


def bucket_of(at: Column, seconds: float) -> Column:
    """Number of the bucket of an instant in microseconds."""
    return F.floor(at / F.lit(int(seconds * MICROS))).cast("bigint")


def _added(rows: DataFrame, group: list[str], order: list[str], deltas: list[str]) -> DataFrame:
    """Exclusive running sums inside a group, in place of the deltas."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    return rows.withColumns({d: F.coalesce(F.sum(d).over(before), zero) for d in deltas})


def totals_before(
    edges: DataFrame, keys: list[str], deltas: list[str], small: float = SMALL, large: float = LARGE
) -> DataFrame:
    """Edges with, in place of their deltas, the sums of all deltas of their key before them.

    ``edges`` has the keys, ``at`` in microseconds, ``o``, which orders edges of one instant, and the deltas. Sums of small buckets
    are combined before the shuffle. They are summed up inside large buckets, those over the key; each level gets what
    came before it as a first row of its group. A task scans the edges of one (key, small bucket).
    """
    many = max(1, int(large // small))
    some = edges.withColumn("_b", bucket_of(F.col("at"), small))
    sums = some.groupBy(*keys, "_b").agg(*[F.sum(d).alias(d) for d in deltas]).withColumn("_l", F.floor(F.col("_b") / many))
    totals = sums.groupBy(*keys, "_l").agg(*[F.sum(d).alias(d) for d in deltas])
    none = F.lit(None).cast("bigint")
    larger = _added(totals, keys, ["_l"], deltas).withColumn("_b", none)
    smaller = _added(sums.unionByName(larger), [*keys, "_l"], ["_b"], deltas).where("_b IS NOT NULL").drop("_l")
    first = smaller.withColumns({"at": none, "o": F.lit(None).cast("int")})
    return _added(some.unionByName(first, allowMissingColumns=True), [*keys, "_b"], ["at", "o"], deltas).where("at IS NOT NULL").drop("_b")


def _merged(pieces: DataFrame, keys: list[str], seconds: float | None, max_gap: int | None) -> DataFrame:
    """Pieces joined inside (key, bucket), or over the key.

    A piece says whether it may go on a piece of its group before it (``_open``); where the next begins, if that is
    known, is ``_closed``. What is first in its group stays open at its start, what is last at its end.
    """
    group = list(keys)
    if seconds is not None:
        pieces = pieces.withColumn("_g", bucket_of(F.col("_start"), seconds))
        group.append("_g")
    order = Window.partitionBy(*group).orderBy("_start", "_op")
    before = {"_po": F.lag("_op").over(order), "_pe": F.lag("_end").over(order)}
    same = F.col("_po").eqNullSafe(F.col("_op")) & F.col("_pe").isNotNull()
    if max_gap is not None:
        same = same & (F.col("_start") - F.col("_pe") <= max_gap * MICROS)
    marked = pieces.withColumns(before).withColumns(
        {"_joins": F.col("_open") & same, "_open": F.col("_open") & F.col("_pe").isNull()}
    )
    run = F.last(F.when(~F.col("_joins"), F.col("_start")), ignorenulls=True).over(order)
    ends = F.when(~F.lead("_joins").over(order), F.lead("_start").over(order))
    scanned = marked.withColumns({"_run": run, "_closed": F.coalesce("_closed", ends)})
    return (
        scanned.groupBy(*group, "_op", "_run")
        .agg(
            F.sum("_n").alias("_n"), F.max("_end").alias("_end"), F.max("_closed").alias("_closed"),
            F.max("_open").alias("_open"),
        )
        .select(*keys, "_op", F.col("_run").alias("_start"), "_n", "_end", "_closed", "_open")
    )


def runs_of(
    steps: DataFrame, keys: list[str], max_gap: int | None, small: float = SMALL, large: float = LARGE
) -> DataFrame:
    """Maximal runs of steps: same operation as the step before, at most ``max_gap`` seconds after it.

    ``steps`` has the keys, ``_op``, ``_start`` in microseconds and ``_n``, one row per (key, instant, operation). A run inside
    a bucket is done; only the first and the last of each go on to the next level, at most two a bucket.
    """
    fresh = steps.withColumns({"_end": F.col("_start"), "_closed": F.lit(None).cast("bigint"), "_open": F.lit(True)})
    columns = [*keys, "_op", "_start", "_n", "_end", "_closed"]
    done = []
    for seconds in (small, large):
        pieces = _merged(fresh, keys, seconds, max_gap)
        done.append(pieces.where("NOT _open AND _closed IS NOT NULL").select(*columns))
        fresh = pieces.where("_open OR _closed IS NULL")
    whole = _merged(fresh, keys, None, max_gap).select(*columns)
    return done[0].unionByName(done[1]).unionByName(whole)
