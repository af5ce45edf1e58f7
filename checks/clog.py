"""The access-log view of the events table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import table

BASES = (
    "/patient/records", "/billing/invoices", "/inventory/items", "/patient/invoices",
    "/admin/settings", "/admin/users", "/admin/credentials", "/admin/logs", "/login/attempts",
    "/patient/appointments/confirm", "/lab/results", "/pharmacy/orders",
)
LIMITS = (1000, 500, 300, 400)
PAYLOAD = "&query=' OR 1=1 --"
LOG_COLUMNS = (
    "LogID", "UserID", "Role", "Timestamp", "HTTP_Method", "Endpoint", "IP_Address", "HTTP_Response", "Anomalous",
)


def _pick(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def access_log(events: DataFrame) -> DataFrame:
    """Log columns plus ``event_id``, ``k`` and ``score``."""
    # props is {"k": <number>}; plain text functions are cheap enough to be repeated in pushed-down filters.
    k = F.substring_index(F.substring_index("props", ": ", -1), "}", 1).try_cast("bigint")
    e = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    base, payload = F.col("k") % 12, (F.col("k") % 12 == 0) & (F.col("event_id") % 7 == 0)
    endpoint = F.concat(
        _pick(base, BASES),
        F.when(base == 9, "").otherwise(F.concat(F.lit("/"), (4000 + F.col("event_id") % 5).cast("string"))),
        F.when(base < 4, F.concat(F.lit("?export=true&limit="), _pick(base, [str(n) for n in LIMITS]))).otherwise(""),
        F.when(payload, PAYLOAD).otherwise(""),
    )
    kind = F.col("event_type")
    method = (
        F.when(kind == "error", "DELETE")
        .when(kind == "purchase", "PUT")
        .when(kind == "signup", F.when(F.col("k") < 20, "PATCH").otherwise("POST"))
        .when((kind == "click") & (F.col("k") < 10), "HEAD")
        .when((kind == "click") & (F.col("k") < 20), "OPTIONS")
        .otherwise("GET")
    )
    slot = F.col("event_id") % 50
    prefix = (
        F.when(slot == 0, "8.8.4.").when(slot == 1, "100.64.0.").when(slot == 3, "192.168.1.").otherwise("10.0.0.")
    )
    return e.select(
        F.col("event_id").cast("string").alias("LogID"),
        F.col("user_id").alias("UserID"),
        _pick(F.col("user_id") % 4, ("Admin", "Doctor", "Nurse", "Staff")).alias("Role"),
        F.col("ts").cast("timestamp").alias("Timestamp"),
        method.alias("HTTP_Method"),
        endpoint.alias("Endpoint"),
        F.when(slot == 2, "not-an-ip").otherwise(F.concat(prefix, F.col("k").cast("string"))).alias("IP_Address"),
        F.when(payload, 500).when(F.col("value") > 200, 403).otherwise(200).alias("HTTP_Response"),
        (F.col("value") + F.col("k") > 90).cast("int").alias("Anomalous"),
        "event_id",
        "k",
        # Rounded to whole per cent before dividing, which is exact in every engine.
        (F.floor(F.least("value", F.lit(100.0)) + 0.5).cast("double") / 100).alias("score"),
    )


def clog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_log(table(spark, sf_dir, "events"))


def _squeezed(df: DataFrame, start: str, divisor: int) -> DataFrame:
    origin = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    first = F.unix_micros(F.lit(start).cast("timestamp"))
    micros = first + F.floor((F.unix_micros("Timestamp") - origin) / F.lit(divisor)).cast("bigint")
    return df.withColumn("Timestamp", F.timestamp_micros(micros))


def clog_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same logs with the clock running 60 times faster."""
    return _squeezed(clog(spark, sf_dir), "2024-01-01 18:00:00", 60)


def clog_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock 3600 times faster and 15 users."""
    return _squeezed(clog(spark, sf_dir), "2024-01-01 21:00:00", 3600).withColumn("UserID", F.col("UserID") % 15)


def run_a(log: DataFrame) -> DataFrame:
    return log.where(F.col("event_id") % 3 != 0).select(
        "LogID", "Timestamp", "Role", "Endpoint",
        (F.col("score") > 0.6).cast("int").alias("predicted_anomaly"),
        F.col("score").alias("anomaly_score"),
        F.lit("202401010000").alias("run_id"),
    )


def run_b(log: DataFrame) -> DataFrame:
    return log.where(F.col("event_id") % 5 == 0).select(
        "LogID", "Timestamp", "Role", "Endpoint",
        (F.col("k") >= 70).cast("int").alias("predicted_anomaly"),
        (F.col("k").cast("double") / 100).alias("anomaly_score"),
        F.lit("202401010100").alias("run_id"),
    )


def _case(expr: str, values) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


CLOG_SQL = f"""
WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events
), clog AS (
  SELECT CAST(event_id AS VARCHAR) AS "LogID", user_id AS "UserID",
    {_case("user_id % 4", ("Admin", "Doctor", "Nurse", "Staff"))} AS "Role",
    ts AS "Timestamp",
    CASE WHEN event_type = 'error' THEN 'DELETE' WHEN event_type = 'purchase' THEN 'PUT'
      WHEN event_type = 'signup' THEN CASE WHEN k < 20 THEN 'PATCH' ELSE 'POST' END
      WHEN event_type = 'click' AND k < 10 THEN 'HEAD' WHEN event_type = 'click' AND k < 20 THEN 'OPTIONS'
      ELSE 'GET' END AS "HTTP_Method",
    {_case("k % 12", BASES)}
      || CASE WHEN k % 12 = 9 THEN '' ELSE '/' || CAST(4000 + event_id % 5 AS VARCHAR) END
      || CASE WHEN k % 12 < 4 THEN '?export=true&limit=' || {_case("k % 12", LIMITS)} ELSE '' END
      || CASE WHEN k % 12 = 0 AND event_id % 7 = 0 THEN '{PAYLOAD.replace("'", "''")}' ELSE '' END AS "Endpoint",
    CASE event_id % 50 WHEN 0 THEN '8.8.4.' || CAST(k AS VARCHAR) WHEN 1 THEN '100.64.0.' || CAST(k AS VARCHAR)
      WHEN 2 THEN 'not-an-ip' WHEN 3 THEN '192.168.1.' || CAST(k AS VARCHAR)
      ELSE '10.0.0.' || CAST(k AS VARCHAR) END AS "IP_Address",
    CASE WHEN k % 12 = 0 AND event_id % 7 = 0 THEN 500 WHEN value > 200 THEN 403 ELSE 200 END AS "HTTP_Response",
    CASE WHEN value + k > 90 THEN 1 ELSE 0 END AS "Anomalous",
    event_id, k, floor(least(value, 100.0) + 0.5) / 100 AS score
  FROM ev
)"""


def _squeezed_sql(name: str, start: str, divisor: int, user: str) -> str:
    return f""", {name} AS (
  SELECT * REPLACE (
    make_timestamp(epoch_us(TIMESTAMP '{start}') + (epoch_us("Timestamp") - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // {divisor}) AS "Timestamp",
    {user} AS "UserID")
  FROM clog
)"""


DENSE_SQL = CLOG_SQL + _squeezed_sql("clog_dense", "2024-01-01 18:00:00", 60, '"UserID"')
BURST_SQL = CLOG_SQL + _squeezed_sql("clog_burst", "2024-01-01 21:00:00", 3600, '"UserID" % 15')
RUNS_SQL = CLOG_SQL + """, run_a AS (
  SELECT "LogID", "Timestamp", "Role", "Endpoint", CASE WHEN score > 0.6 THEN 1 ELSE 0 END AS predicted_anomaly,
    score AS anomaly_score, '202401010000' AS run_id FROM clog WHERE event_id % 3 <> 0
), run_b AS (
  SELECT "LogID", "Timestamp", "Role", "Endpoint", CASE WHEN k >= 70 THEN 1 ELSE 0 END AS predicted_anomaly,
    CAST(k AS DOUBLE) / 100 AS anomaly_score, '202401010100' AS run_id FROM clog WHERE event_id % 5 = 0
), scored AS (
  SELECT * FROM (SELECT * FROM run_a UNION ALL SELECT * FROM run_b)
  QUALIFY row_number() OVER (PARTITION BY "LogID" ORDER BY run_id DESC) = 1
)"""
# Private and shared blocks as number ranges, written out independently of the text patterns.
PRIVATE_RANGES = (
    (0, 16777215), (167772160, 184549375), (2130706432, 2147483647), (2851995648, 2852061183),
    (2886729728, 2887778303), (3221225472, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055),
    (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (4026531840, 4294967295),
)
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def ip_sql(column: str = '"IP_Address"') -> dict[str, str]:
    """SQL expressions: number, internal, global."""
    valid = f"regexp_full_match({column}, '{_OCTET}([.]{_OCTET}){{3}}')"
    part = lambda i: f"CAST(split_part({column}, '.', {i}) AS BIGINT)"
    number = f"CASE WHEN {valid} THEN {part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)} END"
    ranges = " OR ".join(f"({number}) BETWEEN {a} AND {b}" for a, b in PRIVATE_RANGES)
    private = f"(coalesce(({ranges}) AND ({number}) NOT IN (3221225481, 3221225482), false))"
    shared = f"coalesce(({number}) BETWEEN 1681915904 AND 1686110207, false)"
    return {
        "number": f"({number})",
        "internal": private,
        "global": f"(({number}) IS NOT NULL AND NOT {private} AND NOT {shared})",
    }


STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def stamp(ts) -> Column:
    """Timestamps as text in result rows, the same in both engines."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
