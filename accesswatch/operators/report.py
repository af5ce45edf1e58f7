"""Scored logs joined with the archive, and the tables an analyst reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesswatch.functions.ip import is_internal_ip
from accesswatch.functions.temporal import REPORT_HOURS, hour_or_default, in_unusual_hours
from accesswatch.operators.quality import ratio

CARRIED = ("Role", "Endpoint", "Timestamp", "predicted_anomaly", "anomaly_score")


_WHOLE = ("bigint", "int", "smallint", "tinyint")


def _rank(df: DataFrame, key: str, order: str) -> tuple[DataFrame, Column]:
    """Rows, and a number of fixed width that orders them: by ``order``, then by the one other value if that is a whole
    number, else by a hash of the other values.

    An order that is neither a whole number nor a time gets the number of its place among the distinct values, of which
    there are as many as runs; nulls come first.
    """
    kinds, rest = dict(df.dtypes), [c for c in df.columns if c not in (key, order)]
    last = F.xxhash64(*(rest or [key]))
    if len(rest) == 1 and kinds[rest[0]] in _WHOLE:
        last = F.coalesce(F.col(rest[0]).cast("bigint"), F.lit(-(2**63)))
    if kinds[order] in _WHOLE:
        place = F.col(order).cast("bigint")
    elif kinds[order] == "timestamp":
        place = F.unix_micros(order)
    else:
        places = df.select(F.col(order).alias("_order")).where("_order IS NOT NULL").distinct()
        places = places.withColumn("_place", F.row_number().over(Window.orderBy("_order")).cast("bigint"))
        df = df.join(places, F.col(order) == F.col("_order"), "left").drop("_order")
        place = F.col("_place")
    # Two whole numbers side by side; places stay below 10 ** 18, so that 38 digits hold both.
    high = F.coalesce(place, F.lit(-(10**18 - 1))).cast("decimal(18,0)")
    return df, high * F.lit(str(2**64)).cast("decimal(20,0)") + last.cast("decimal(20,0)")


def keep_last(df: DataFrame, key: str = "LogID", order: str = "run_id") -> DataFrame:
    """The row of the latest run per key; of rows equal in ``order`` one by their values, never by where they lie.

    The latest is a maximum of a number, which tasks combine in hash tables before the shuffle: any number of copies of one key
    shrink to one row per input task, and nothing is sorted. The rows meet it in a join by key; where the
    rows are bucketed by the key, neither needs a shuffle. A null key is a key.
    """
    ranked, rank = _rank(df, key, order)
    ranked = ranked.withColumn("_rank", rank)
    best = ranked.groupBy(F.col(key).alias("_key")).agg(F.max("_rank").alias("_best"))
    # Not below the maximum is the maximum; said so, only the key is hashed. Null keys meet nothing: theirs is looked up.
    met = ranked.join(best, (F.col(key) == F.col("_key")) & (F.col("_rank") >= F.col("_best")), "left")
    last_null = ranked.where(F.col(key).isNull()).agg(F.max("_rank")).scalar()
    last = F.col("_key").isNotNull() | (F.col(key).isNull() & (F.col("_rank") == last_null))
    return met.where(last).select(*df.columns).distinct()


def join_scores(archive: DataFrame, scored: DataFrame, keep_unscored_flag: bool = False) -> DataFrame:
    """Archive left join scores by log id; archive values win, scores fill nulls.

    ``scored`` must hold one row per log. Unscored logs count as normal, score 0.
    """
    shared = [c for c in CARRIED if c in scored.columns]
    right = scored.select(F.col("LogID").alias("_id"), *[F.col(c).alias(f"_s_{c}") for c in shared])
    joined = archive.join(right, F.col("LogID") == F.col("_id"), "left")
    values = {}
    for c in shared:
        values[c] = F.coalesce(F.col(c), F.col(f"_s_{c}")) if c in archive.columns else F.col(f"_s_{c}")
    joined = joined.withColumns(values)
    for c in ("predicted_anomaly", "anomaly_score"):
        if c not in joined.columns:
            joined = joined.withColumn(c, F.lit(None))
    filled = {
        "predicted_anomaly": F.coalesce(F.col("predicted_anomaly").cast("int"), F.lit(0)),
        "anomaly_score": F.coalesce(F.col("anomaly_score").cast("double"), F.lit(0.0)),
    }
    if keep_unscored_flag:
        filled["is_scored"] = F.col("_id").isNotNull()
    return joined.withColumns(filled).drop("_id", *[f"_s_{c}" for c in shared])


def unscored(archive: DataFrame, scored: DataFrame) -> DataFrame:
    return archive.join(scored.select("LogID"), "LogID", "left_anti")


def with_report_columns(df: DataFrame, hours: tuple[int, int] = REPORT_HOURS) -> DataFrame:
    """Network class, hour and unusual-hour flag of the report."""
    if "IP_Address" not in df.columns:
        df = df.withColumn("IP_Address", F.lit("unknown"))
    return df.withColumns(
        {
            "is_internal_ip": is_internal_ip(F.col("IP_Address")),
            "Hour": hour_or_default(F.col("Timestamp")),
            "is_unusual_hour": in_unusual_hours(F.col("Timestamp"), hours),
        }
    )


def _anomalous() -> Column:
    return F.col("predicted_anomaly") == 1


def headline(df: DataFrame, count_threshold: int = 10, ratio_threshold: float = 0.05) -> DataFrame:
    """All figures at the top of the report in one pass.

    ``any_anomaly`` fires from the first anomaly on; ``over_threshold`` needs
    more than either threshold.
    """
    totals = df.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(_anomalous()).alias("anomaly_count"),
        F.count_if(_anomalous() & ~F.col("is_internal_ip")).alias("external_ip_anomalies"),
        F.count_if(_anomalous() & F.col("is_unusual_hour")).alias("unusual_hour_anomalies"),
    )
    return with_thresholds(totals, count_threshold, ratio_threshold)


def with_thresholds(totals: DataFrame, count_threshold: int = 10, ratio_threshold: float = 0.05) -> DataFrame:
    """Totals with the figures that follow from them."""
    return totals.withColumns(
        {
            "normal_count": F.col("total_logs") - F.col("anomaly_count"),
            "anomaly_ratio": ratio(F.col("anomaly_count"), F.col("total_logs")),
            "any_anomaly": F.col("anomaly_count") > 0,
        }
    ).withColumn(
        "over_threshold",
        (F.col("anomaly_count") > count_threshold) | (F.col("anomaly_ratio") > F.lit(float(ratio_threshold))),
    )


def _usage(df: DataFrame, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count_usage"), F.count_if(_anomalous()).alias("count_anomalies")
    )


def usage_by_role(df: DataFrame) -> DataFrame:
    return _usage(df, F.col("Role"))


def usage_by_network(df: DataFrame) -> DataFrame:
    return _usage(df, F.when(F.col("is_internal_ip"), "Internal").otherwise("External").alias("IP_Type"))


def usage_by_endpoint(df: DataFrame) -> DataFrame:
    return _usage(df, F.col("Endpoint"))


def top_endpoints(df: DataFrame, n: int = 10, anomalies: bool = False) -> DataFrame:
    """The n most requested endpoints; equal counts are ordered by endpoint."""
    if anomalies:
        df = df.where(_anomalous())
    counts = df.groupBy("Endpoint").agg(F.count(F.lit(1)).alias("n_logs"))
    return counts.orderBy(F.desc("n_logs"), "Endpoint").limit(n)


def daily_unusual(df: DataFrame) -> DataFrame:
    """Logs and anomalies per day, unusual hours only."""
    return _usage(df.where("is_unusual_hour"), F.to_date("Timestamp").alias("date"))


def anomalous_logs(df: DataFrame) -> DataFrame:
    return df.where(_anomalous())


def normal_logs(df: DataFrame) -> DataFrame:
    return df.where(F.col("predicted_anomaly") == 0)


def borderline_logs(df: DataFrame, low: float = 0.5, high: float | None = None) -> DataFrame:
    """Rated normal with a score above ``low`` (and at most ``high``)."""
    chosen = (F.col("anomaly_score") > F.lit(float(low))) & (F.col("predicted_anomaly") == 0)
    if high is not None:
        chosen = chosen & (F.col("anomaly_score") <= F.lit(float(high)))
    return df.where(chosen)


def timeline(df: DataFrame) -> DataFrame:
    """Logs by time; logs of one instant by id."""
    return df.orderBy("Timestamp", "LogID")
