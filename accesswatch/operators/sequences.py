"""Runs and patterns of neighbouring rows per key, scanned in (key, time bucket) tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accesswatch.operators.levels import LARGE, MICROS, SMALL, runs_of


def sequence_runs(
    df: DataFrame,
    keys: list[str],
    ts: str,
    operation: str | None = None,
    max_gap_seconds: int | None = None,
    bucket_seconds: float = SMALL,
) -> DataFrame:
    """Maximal runs of a key's rows: same operation, gaps within the limit.

    Rows collapse to one step per (key, instant, operation) before the shuffle; steps of one instant are ordered by the
    operation's name. Steps are joined in levels of time buckets (``levels.runs_of``), so a key with all its rows in
    one hour is spread too. Columns: keys, the operation, ``n_events``, ``started``, ``ended``, and ``closed`` where
    the next run starts.
    """
    op = F.col(operation) if operation else F.lit("")
    steps = df.groupBy(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_start"), op.alias("_op")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    runs = runs_of(steps, keys, max_gap_seconds, bucket_seconds, max(LARGE, 60 * bucket_seconds))
    return runs.select(
        *keys,
        *([F.col("_op").alias(operation)] if operation else []),
        F.col("_n").alias("n_events"),
        F.timestamp_micros("_start").alias("started"),
        F.timestamp_micros("_end").alias("ended"),
        F.timestamp_micros("_closed").alias("closed"),
    )


def islands(
    df: DataFrame, keys: list[str], ts: str, max_gap_seconds: int, min_size: int,
    bucket_seconds: float = SMALL,
) -> DataFrame:
    """Groups of at least ``min_size`` rows, neighbours at most the gap apart."""
    runs = sequence_runs(df, keys, ts, None, max_gap_seconds, bucket_seconds)
    return runs.where(F.col("n_events") >= min_size).select(*keys, "n_events", "started", "ended")


def operation_patterns(
    df: DataFrame, keys: list[str], ts: str, operation: str, pattern: tuple[str, ...],
    within_seconds: int, event_id: str = "LogID", bucket_seconds: int | None = None,
) -> DataFrame:
    """Consecutive rows of a key whose operations spell ``pattern`` in time.

    Rows collapse to one step per (key, instant, operation) with their count and
    their first and last id, which is exact: inner rows of a match must be alone
    in their step. A match spans at most ``within_seconds``, so each bucket
    also sees the opening seconds of the next one and nothing else.
    """
    span = within_seconds * MICROS
    bucket = max(within_seconds, bucket_seconds or 30 * within_seconds) * MICROS
    last = len(pattern) - 1
    steps = (
        df.groupBy(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(operation).alias("_op"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(event_id).alias("_lo"), F.max(event_id).alias("_hi"))
        .withColumn("_own", F.floor(F.col("_t") / F.lit(bucket)).cast("bigint"))
    )
    opening = F.col("_t") - F.col("_own") * F.lit(bucket) <= span
    seen_by = F.array(F.col("_own"), F.when(opening, F.col("_own") - 1))
    seen = steps.withColumn("_b", F.explode(seen_by)).where("_b is not null")
    order = Window.partitionBy(*keys, "_b").orderBy("_t", "_op")
    ahead = {}
    for i in range(1, last + 1):
        ahead[f"_s{i}"] = F.lead(F.struct("_t", "_op", "_n", "_lo"), i).over(order)
    matched = (F.col("_own") == F.col("_b")) & (F.col("_op") == pattern[0])
    for i in range(1, last + 1):
        matched = matched & (F.col(f"_s{i}._op") == pattern[i])
    for i in range(1, last):
        matched = matched & (F.col(f"_s{i}._n") == 1)
    matched = matched & (F.col(f"_s{last}._t") - F.col("_t") <= span)
    ids = [F.col("_hi"), *[F.col(f"_s{i}._lo") for i in range(1, last + 1)]]
    return seen.withColumns(ahead).where(matched).select(
        *keys,
        F.timestamp_micros("_t").alias("started"),
        F.timestamp_micros(f"_s{last}._t").alias("ended"),
        *[c.alias(f"event_{i + 1}") for i, c in enumerate(ids)],
    )
