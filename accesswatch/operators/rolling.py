"""Per-key rates over a trailing time window.

The count for a row at time ``t`` covers the key's rows in ``[t - w, t)``: the
row itself and rows of the same instant are not counted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesswatch.operators.levels import LARGE, MICROS, SMALL, totals_before


@dataclass(frozen=True)
class TrailingCount:
    """``name`` counts rows where ``events`` holds over ``seconds``.

    Rows where ``probes`` does not hold get 0.
    """

    name: str
    seconds: int
    events: Column | None = None
    probes: Column | None = None


def _flag(condition: Column | None) -> Column:
    if condition is None:
        return F.lit(1).cast("bigint")
    return F.when(condition, 1).otherwise(0).cast("bigint")


def trailing_counts_window(df: DataFrame, keys: list[str], ts: str, specs: list[TrailingCount]) -> DataFrame:
    """Range-frame form: one shuffle, but all rows of a key meet in one task.

    For keys of limited size; ``trailing_counts`` gives the same result without
    that limit.
    """
    df = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    base = Window.partitionBy(*keys).orderBy("_t")
    known = F.col("_t").isNotNull() & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    out = {}
    for spec in specs:
        counted = F.sum(_flag(spec.events)).over(base.rangeBetween(-spec.seconds * MICROS, -1))
        probe = known if spec.probes is None else known & spec.probes
        out[spec.name] = F.coalesce(F.when(probe, counted), F.lit(0)).cast("bigint")
    return df.withColumns(out).drop("_t")


def instant_counts(
    df: DataFrame, keys: list[str], ts: str, specs: list[TrailingCount], bucket_seconds: float = SMALL
) -> DataFrame:
    """Trailing counts per distinct (key, instant), where any is above zero.

    Rows first collapse to one per instant (combined before the shuffle). Each instant then enters a running sum and
    leaves it again ``w`` later; the sum runs in levels of buckets (``levels.totals_before``), the smallest of which
    may be far shorter than a window. A task holds the instants of one small bucket, however many rows a key has.
    """
    n = range(len(specs))
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col(ts).isNotNull())
    instants = (
        df.where(known)
        .groupBy(*keys, t.alias("_t"))
        .agg(*[F.sum(_flag(s.events)).alias(f"_n{i}") for i, s in enumerate(specs)])
    )

    def edge(at: Column, order: int, deltas: list[Column]) -> Column:
        return F.struct(at.alias("at"), F.lit(order).alias("o"), *[d.alias(f"_d{i}") for i, d in enumerate(deltas)])

    zero = F.lit(0).cast("bigint")
    # An instant is counted before it counts itself; a row exactly a window old still counts, so departures come last.
    edges = [edge(F.col("_t"), 0, [F.col(f"_n{i}") for i in n])]
    for i, spec in enumerate(specs):
        size = F.col(f"_n{i}")
        leaves = edge(F.col("_t") + F.lit(spec.seconds * MICROS), 1, [-size if j == i else zero for j in n])
        edges.append(F.when(size > 0, leaves))
    swept = instants.select(*keys, F.explode(F.array(*edges)).alias("e")).where("e is not null").select(*keys, "e.*")
    counted = totals_before(swept, keys, [f"_d{i}" for i in n], bucket_seconds, max(LARGE, 60 * bucket_seconds))
    some = reduce(lambda a, c: a | c, [F.col(f"_d{i}") > 0 for i in n])
    return counted.where((F.col("o") == 0) & some).select(
        *keys, F.col("at").alias("_t"), *[F.col(f"_d{i}").alias(s.name) for i, s in enumerate(specs)]
    )


def trailing_counts(
    df: DataFrame, keys: list[str], ts: str, specs: list[TrailingCount], bucket_seconds: float = SMALL
) -> DataFrame:
    """Add one column per spec to every row; no row is dropped or repeated.

    The rows meet their instant in an equi join, whose skewed side adaptive
    execution splits, so a key holding a large share of the rows is spread.
    """
    counts = instant_counts(df, keys, ts, specs, bucket_seconds)
    renamed = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_t").alias("_k_t"),
        *[F.col(s.name).alias(f"_v_{s.name}") for s in specs],
    )
    left = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in keys], F.col("_t") == F.col("_k_t"))
    joined = left.join(renamed, on, "left")
    out = {}
    for s in specs:
        value = F.coalesce(F.col(f"_v_{s.name}"), F.lit(0)).cast("bigint")
        out[s.name] = value if s.probes is None else F.when(s.probes, value).otherwise(F.lit(0).cast("bigint"))
    return joined.withColumns(out).select(*df.columns, *[s.name for s in specs])


def is_inventory(endpoint: str = "Endpoint") -> Column:
    return F.col(endpoint).startswith("/inventory/items")


def request_rate_specs(minutes: int = 5, inventory_minutes: int = 10) -> list[TrailingCount]:
    """Requests per user, and inventory requests per user on inventory rows."""
    return [
        TrailingCount("req_freq_5min", minutes * 60),
        TrailingCount("inventory_change_rate", inventory_minutes * 60, is_inventory(), is_inventory()),
    ]


def add_request_rates(df: DataFrame, strategy: str = "instants") -> DataFrame:
    run = {"instants": trailing_counts, "window": trailing_counts_window}[strategy]
    return run(df, ["UserID"], "Timestamp", request_rate_specs())


def by_user_and_time(df: DataFrame) -> DataFrame:
    """Logs by user, then time, then id."""
    return df.orderBy("UserID", "Timestamp", "LogID")
