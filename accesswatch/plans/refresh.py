"""All figures of the report from one scan, kept as daily sums that a refresh renews for the days that changed."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesswatch.operators.report import with_thresholds
from accesswatch.plans.reporting import ARCHIVED_LOG, SCORED_LOG, report_base
from accesswatch.sources.store import RunStore

#: The tables a day's logs are counted for, by the column that splits them.
SPLITS = {"all": None, "role": "Role", "network": "IP_Type", "endpoint": "Endpoint"}
COUNTS = ("n_logs", "n_anomalies", "n_external_anomalies", "n_unusual", "n_unusual_anomalies")
PARTIALS = T.StructType(
    [T.StructField("Timestamp", T.TimestampType()), T.StructField("split", T.StringType()), T.StructField("value", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField("run_id", T.StringType())]
)


def daily_partials(base: DataFrame) -> DataFrame:
    """Counts per day, and per day and role, network class or endpoint, of a report base, by grouping sets in one scan.

    ``split`` names the set and ``value`` is its key, null for a null key. Tasks add up before the shuffle.
    """
    anomalous, unusual = F.col("predicted_anomaly") == 1, F.col("is_unusual_hour")
    rows = base.select(
        F.to_timestamp(F.date_trunc("day", "Timestamp")).alias("_day"), "Role", "Endpoint",
        F.when(F.col("is_internal_ip"), "Internal").otherwise("External").alias("IP_Type"),
        anomalous.alias("_a"), unusual.alias("_u"), F.col("is_internal_ip").alias("_i"),
    )
    columns = [c for c in SPLITS.values() if c]
    sets = [[F.col("_day"), *([F.col(c)] if c else [])] for c in SPLITS.values()]
    figures = [F.count(F.lit(1)), F.count_if("_a"), F.count_if(F.col("_a") & ~F.col("_i")), F.count_if("_u"), F.count_if(F.col("_a") & F.col("_u"))]
    grouped = rows.groupingSets(sets, F.col("_day"), *columns).agg(
        *[f.alias(c) for f, c in zip(figures, COUNTS)], *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    split, value = F.lit("all"), F.lit(None).cast("string")
    for name, c in SPLITS.items():
        if c:
            split, value = F.when(F.col(f"_g_{c}") == 0, name).otherwise(split), F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    return grouped.select(F.col("_day").alias("Timestamp"), split.alias("split"), value.alias("value"), *COUNTS)


def _summed(partials: DataFrame, split: str, name: str) -> DataFrame:
    return (
        partials.where(F.col("split") == split).groupBy(F.col("value").alias(name))
        .agg(F.sum("n_logs").alias("count_usage"), F.sum("n_anomalies").alias("count_anomalies"))
    )


def tables_of(partials: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """The report's tables from daily counts, which are few rows beside the logs."""

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    days = partials.where("split = 'all'")
    headline = with_thresholds(
        days.agg(
            total("n_logs").alias("total_logs"), total("n_anomalies").alias("anomaly_count"),
            total("n_external_anomalies").alias("external_ip_anomalies"),
            total("n_unusual_anomalies").alias("unusual_hour_anomalies"),
        )
    )
    endpoints = _summed(partials, "endpoint", "Endpoint")

    def top(c: str) -> DataFrame:
        return endpoints.where(F.col(c) > 0).select("Endpoint", F.col(c).alias("n_logs")).orderBy(F.desc("n_logs"), "Endpoint").limit(n)

    daily = days.where("n_unusual > 0").groupBy(F.to_date("Timestamp").alias("date")).agg(
        F.sum("n_unusual").alias("count_usage"), F.sum("n_unusual_anomalies").alias("count_anomalies")
    )
    return {
        "headline": headline, "by_role": _summed(partials, "role", "Role"), "by_network": _summed(partials, "network", "IP_Type"),
        "by_endpoint": endpoints, "top_endpoints": top("count_usage"), "top_endpoints_of_anomalies": top("count_anomalies"),
        "daily_unusual_hours": daily,
    }


def refresh_report(spark: SparkSession, archive_path: str, results_path: str, partials_path: str) -> list[str]:
    """Renew the daily counts below ``partials_path`` for the days whose attempts changed in either store; these days.

    A refresh writes all its days in one go, and of a day the counts that arrived last are read, so a refresh that is repeated or
    ends half way counts nothing twice. What was seen of the stores is noted last. A compaction of a store changes all its days.
    """
    stores = {"archive": (RunStore(spark, archive_path), ARCHIVED_LOG), "results": (RunStore(spark, results_path), SCORED_LOG)}
    partials = RunStore(spark, partials_path)
    now = {name: {str(n): days for n, days in store.days().items()} for name, (store, _) in stores.items()}
    before = json.loads(partials.note() or "{}")
    changed = set()
    for name, held in now.items():
        former = before.get(name, {})
        for n in held.keys() ^ former.keys():
            changed.update(held.get(n, former.get(n)))
    days = sorted(d for d in changed if d[:1].isdigit())
    if days:
        both = [store.read(schema, days=days) for store, schema in stores.values()]
        # A day whose logs are all gone has a row too, which replaces its former ones.
        marks = spark.createDataFrame([(d,) for d in days], "d string").select(
            F.to_timestamp("d").alias("Timestamp"), F.lit("day").alias("split"), F.lit(None).cast("string").alias("value"),
            *[F.lit(0).cast("bigint").alias(c) for c in COUNTS],
        )
        partials.write(daily_partials(report_base(*both)).unionByName(marks), f"refresh-{uuid.uuid4().hex}")
    partials.note(json.dumps(now))
    return days


def refreshed_tables(spark: SparkSession, partials_path: str, first: date | None = None, last: date | None = None) -> dict[str, DataFrame]:
    """The report's tables of all days, or of some, from the daily counts."""
    rows = RunStore(spark, partials_path).read(PARTIALS, first=first, last=last)
    latest = rows.groupBy("log_date").agg(F.max("arrival").alias("arrival"))
    return tables_of(rows.join(latest, ["log_date", "arrival"]))
