"""Injection chains as a join of two streams, with state and without an archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesswatch.operators.detect import chain_steps
from accesswatch.streaming.monitor import LATENESS, with_event_time


def chain_links(
    logs: DataFrame, rules: dict, within_seconds: int = 300, same_ip: bool = True, statuses: tuple[int, ...] | None = (500,),
    lateness: str = LATENESS,
) -> DataFrame:
    """(LogID of a read, LogID of an injection on the same record in the time before it), as soon as both are there.

    Both sides carry a watermark and the join bounds their distance in time, so an injection leaves the state once no read it
    may precede can still come, and a read once no injection it may follow can. A link is written in the batch of its later log,
    in whatever order both arrive within ``lateness``; logs later than that are dropped by the watermark.
    ``chain_counts`` adds links up per read.
    """
    keys = ["UserID", "_id"] + (["IP_Address"] if same_ip else [])
    steps = chain_steps(logs, rules, statuses)
    side = lambda flag, name: with_event_time(steps.where(flag), lateness).select(
        F.col("LogID").alias(f"{name}_log"), F.col("Timestamp").alias(f"{name}_time"), *[F.col(k).alias(f"{name}_{k}") for k in keys]
    )
    reads, injections = side("_read", "read"), side("_injection", "injection")
    near = F.expr(
        f"injection_time >= read_time - INTERVAL {int(within_seconds)} SECONDS AND injection_time < read_time"
    )
    same = reduce(lambda a, b: a & b, [F.col(f"read_{k}") == F.col(f"injection_{k}") for k in keys])
    joined = reads.join(injections, same & near)
    return joined.select(F.col("read_log").alias("LogID"), F.col("injection_log").alias("injection"), F.col("read_time").alias("Timestamp"))


def chain_counts(links: DataFrame) -> DataFrame:
    """Injections before each read, from the links that a stream has written."""
    return links.groupBy("LogID").agg(F.count(F.lit(1)).alias("n_injections"))
