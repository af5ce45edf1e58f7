"""Scenario detectors over the log views."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesswatch.operators import detect
from accesswatch.sources.rules import default_rules
from checks.clog import BURST_SQL, CLOG_SQL, STAMP, clog, clog_burst, ip_sql, stamp
from checks.feature_queries import RESOURCE, ROLE_RULES_SQL, SIGNATURES_SQL
from checks.registry import register

IP = ip_sql()
ITEM = """TRY_CAST(nullif(regexp_extract(split_part("Endpoint", '?', 1), '/([0-9]+)/?$', 1), '') AS BIGINT)"""
ANY_ROLE = "'sql_injection', 'xss', 'external_ip_only'"
ROLE_BOUND = ", ".join(f"'{s}'" for s in detect.ROLE_BOUND)

TAGS = CLOG_SQL + SIGNATURES_SQL + ROLE_RULES_SQL + f""", req AS (SELECT *, {RESOURCE} AS resource FROM clog), tags AS (
  SELECT DISTINCT "LogID", scenario, 'alert' AS severity, 1 AS labelled FROM req JOIN signatures s
    ON resource = rule_endpoint AND req."HTTP_Method" = s."HTTP_Method"
    WHERE scenario IN ({ANY_ROLE}) AND (scenario <> 'external_ip_only' OR NOT {IP['internal']})
  UNION ALL SELECT DISTINCT "LogID", 'unusual_time_access', 'alert', 1 FROM req JOIN signatures s
    ON resource = rule_endpoint AND req."HTTP_Method" = s."HTTP_Method"
    WHERE scenario = 'unusual_ip_access' AND (extract(hour FROM "Timestamp") >= 21 OR extract(hour FROM "Timestamp") < 6)
  UNION ALL SELECT DISTINCT "LogID", scenario, CASE WHEN scenario = 'access_patient_invoices' THEN 'monitor' ELSE 'alert' END,
    CASE WHEN scenario = 'patient_records_put_del' AND req."HTTP_Method" = 'PUT' THEN 0 ELSE 1 END
    FROM req JOIN role_rules r ON resource = rule_endpoint AND req."HTTP_Method" = r."HTTP_Method" AND req."Role" = r."Role"
    WHERE scenario IN ({ROLE_BOUND}))"""


@register("d4_d18_tagged_logs", TAGS + 'SELECT "LogID", scenario, severity, labelled FROM tags')
def d_tags(spark, sf):
    return detect.tag_scenarios(clog(spark, sf), default_rules()).select("LogID", "scenario", "severity", "labelled")


@register(
    "d4_d18_logs_per_scenario",
    TAGS + """SELECT scenario, "Role", count(*) AS n_logs, sum(labelled)::BIGINT AS n_labelled
FROM tags JOIN clog USING ("LogID") GROUP BY ALL""",
)
def d_counts(spark, sf):
    tagged = detect.tag_scenarios(clog(spark, sf), default_rules())
    return tagged.groupBy("scenario", "Role").agg(F.count(F.lit(1)).alias("n_logs"), F.sum("labelled").alias("n_labelled"))


@register("d4_injection_payloads", CLOG_SQL + """SELECT "LogID", 'OR' AS kind FROM clog WHERE "Endpoint" LIKE '%query='' OR 1=1 --' """)
def d4(spark, sf):
    return detect.with_payload(clog(spark, sf)).select("LogID", F.lit("OR").alias("kind"))


def _paid(spark, sf, payload: str):
    """Logs whose payload is another one."""
    return clog(spark, sf).withColumn("Endpoint", F.replace("Endpoint", F.lit("' OR 1=1 --"), F.lit(payload)))


PAID = CLOG_SQL + """SELECT "LogID" FROM clog WHERE "Endpoint" LIKE '%query=%' """


@register("d4_encoded_payloads", PAID)
def d4_encoded(spark, sf):
    return detect.with_payload(_paid(spark, sf, "%27+OR%201%3D1%20--")).select("LogID")


@register("d5_script_payloads", PAID)
def d5(spark, sf):
    return detect.with_payload(_paid(spark, sf, "%3Cscript%3Ealert(1)%3C/script%3E"), detect.SCRIPT).select("LogID")


def _bursts(gap: int) -> str:
    return BURST_SQL + f""", a AS (SELECT "UserID", "Timestamp" AS t, lag("Timestamp") OVER (PARTITION BY "UserID" ORDER BY "Timestamp") AS p
  FROM clog_burst WHERE "HTTP_Method" = 'DELETE' AND {RESOURCE} = '/login/attempts'),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > INTERVAL {gap} SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY "UserID" ORDER BY t) AS g FROM a)
SELECT "UserID", count(*) AS n_events, strftime(min(t), {STAMP}) AS started, strftime(max(t), {STAMP}) AS ended
FROM b GROUP BY "UserID", g HAVING count(*) >= 3"""


def _stamped(df):
    return df.withColumns({c: stamp(c) for c, t in df.dtypes if t == "timestamp"})


@register("d1_failed_attempt_bursts", _bursts(10))
def d1(spark, sf):
    return _stamped(detect.failed_attempt_bursts(clog_burst(spark, sf)))


@register("d1_failed_attempt_bursts_wide_gap", _bursts(600))
def d1_wide(spark, sf):
    return _stamped(detect.failed_attempt_bursts(clog_burst(spark, sf), gap_seconds=600))


def _rapid(seconds: int) -> str:
    return BURST_SQL + f""", c AS (SELECT "UserID", {ITEM} AS item_id, "Timestamp" AS t, "HTTP_Method" AS m, "LogID" FROM clog_burst
  WHERE "HTTP_Method" IN ('PUT', 'DELETE') AND {RESOURCE} = '/inventory/items'),
s AS (SELECT *, lead(m, 1) OVER w AS m2, lead(m, 2) OVER w AS m3, lead(t, 2) OVER w AS t3,
  lead("LogID", 1) OVER w AS event_2, lead("LogID", 2) OVER w AS event_3 FROM c WINDOW w AS (PARTITION BY "UserID", item_id ORDER BY t, m, "LogID"))
SELECT "UserID", item_id, strftime(t, {STAMP}) AS started, strftime(t3, {STAMP}) AS ended, "LogID" AS event_1, event_2, event_3
FROM s WHERE m = 'PUT' AND m2 = 'DELETE' AND m3 = 'PUT' AND t3 - t <= INTERVAL {seconds} SECOND"""


@register("d2_rapid_inventory_changes", _rapid(120))
def d2(spark, sf):
    return _stamped(detect.rapid_inventory_changes(clog_burst(spark, sf), 120, same_ip=False))


@register("d2_rapid_inventory_changes_hour", _rapid(3600))
def d2_hour(spark, sf):
    return _stamped(detect.rapid_inventory_changes(clog_burst(spark, sf), 3600, same_ip=False))


@register(
    "d3_injection_chains",
    BURST_SQL + f""", x AS (SELECT *, {RESOURCE} AS resource, {ITEM} AS id, regexp_extract("Endpoint", '[?&]query=(.*)$', 1) <> '' AS paid FROM clog_burst),
i AS (SELECT * FROM x WHERE paid AND (resource, "HTTP_Method") IN (('/admin/settings', 'POST'), ('/patient/records', 'GET'))),
r AS (SELECT * FROM x WHERE NOT paid AND "HTTP_Method" = 'GET' AND resource IN ('/patient/records', '/billing/invoices', '/inventory/items'))
SELECT r."LogID", r.id AS resource_id, count(*) AS n_injections FROM r JOIN i ON r."UserID" = i."UserID" AND r.id = i.id
  AND i."Timestamp" >= r."Timestamp" - INTERVAL 5 MINUTE AND i."Timestamp" < r."Timestamp" GROUP BY ALL""",
)
def d3(spark, sf):
    chains = detect.injection_chains(clog_burst(spark, sf), default_rules(), same_ip=False, statuses=None)
    return chains.select("LogID", "resource_id", "n_injections")


@register(
    "d19_frequent_record_updates",
    BURST_SQL + f""", p AS (SELECT "LogID", count(*) OVER (PARTITION BY "UserID" ORDER BY "Timestamp"
    RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS n_earlier
  FROM clog_burst WHERE "HTTP_Method" = 'PUT' AND {RESOURCE} = '/patient/records')
SELECT * FROM p WHERE n_earlier >= 2""",
)
def d19(spark, sf):
    return detect.frequent_record_updates(clog_burst(spark, sf), threshold=2).select("LogID", "n_earlier")


@register(
    "d20_export_volume",
    CLOG_SQL + f"""SELECT "UserID", strftime(date_trunc('hour', "Timestamp"), {STAMP}) AS hour_start, count(*) AS n_exports,
  sum(CAST(regexp_extract("Endpoint", 'limit=([0-9]+)', 1) AS BIGINT))::BIGINT AS n_records
FROM clog WHERE "HTTP_Method" = 'GET' AND {RESOURCE} IN ('/patient/records', '/billing/invoices', '/inventory/items')
  AND "Endpoint" LIKE '%export=true%' GROUP BY 1, 2""",
)
def d20(spark, sf):
    return _stamped(detect.export_volume(clog(spark, sf), default_rules()))


RUNS = CLOG_SQL + f""", c AS (SELECT {RESOURCE} AS resource, {ITEM} AS resource_id, "Timestamp" AS t, "HTTP_Method" AS m, "LogID" FROM clog
  WHERE "HTTP_Method" IN ('PUT', 'DELETE')),
d AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY resource, resource_id, m ORDER BY t, "LogID") AS g
  FROM c WHERE resource IN ('/inventory/items', '/billing/invoices', '/patient/records') AND resource_id IS NOT NULL
  WINDOW w AS (PARTITION BY resource, resource_id ORDER BY t, m, "LogID")),
r AS (SELECT resource, resource_id, m, count(*) AS n, min(t) AS a, max(t) AS b FROM d GROUP BY resource, resource_id, m, g),
runs AS (SELECT *, lead(a) OVER (PARTITION BY resource, resource_id ORDER BY a, m) AS closed FROM r)"""


@register(
    "d21_repeated_item_operations",
    RUNS + f"""SELECT resource, resource_id, m AS "HTTP_Method", n AS n_events, strftime(a, {STAMP}) AS started, strftime(b, {STAMP}) AS ended,
  strftime(closed, {STAMP}) AS closed, CASE WHEN m = 'DELETE' THEN 'multiple_delete_same_item' ELSE 'multiple_put_del_same_item' END AS scenario
FROM runs WHERE n > 2 AND (m = 'DELETE' OR closed IS NOT NULL)""",
)
def d21(spark, sf):
    return _stamped(detect.repeated_item_operations(clog(spark, sf), default_rules()))


@register(
    "d21_update_then_delete",
    RUNS + f"""SELECT CASE WHEN resource = '/inventory/items' THEN 'inventory_put_del' ELSE 'billing_invoices_put_del' END AS scenario,
  resource, resource_id, n AS n_puts, strftime(a, {STAMP}) AS started, strftime(closed, {STAMP}) AS deleted
FROM runs WHERE m = 'PUT' AND closed IS NOT NULL AND resource <> '/patient/records'""",
)
def d21_pairs(spark, sf):
    return _stamped(detect.update_then_delete(clog(spark, sf), default_rules()))


@register(
    "d22_first_seen_addresses",
    CLOG_SQL + f""", f AS (SELECT *, {RESOURCE} AS resource, row_number() OVER (PARTITION BY "UserID", "IP_Address" ORDER BY "Timestamp", "LogID") AS n FROM clog)
SELECT "UserID", "IP_Address", "LogID", "HTTP_Method" FROM f
WHERE n = 1 AND "HTTP_Method" = 'GET' AND resource IN ('/patient/records', '/lab/results', '/billing/invoices')""",
)
def d22(spark, sf):
    return detect.first_seen_addresses(clog(spark, sf), default_rules()).select("UserID", "IP_Address", "LogID", "HTTP_Method")
