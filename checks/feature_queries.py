"""Sources, endpoint, time and address features, rules, rates, encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesswatch.functions import endpoint as E
from accesswatch.functions import ip as I
from accesswatch.functions import temporal as T
from accesswatch.operators import authz, encoders, quality, rolling
from accesswatch.operators.networks import longest_network
from accesswatch.sources import files, rules, schemas
from checks.clog import (
    CLOG_SQL, DENSE_SQL, LOG_COLUMNS, RUNS_SQL, STAMP, clog, clog_dense, ip_sql, run_a, run_b, stamp,
)
from checks.registry import register, table

CLEAN = "rtrim(split_part(split_part({c}, '?', 1), '/v', 1), '/')"
IP = ip_sql()


def _clean(column: str) -> str:
    return CLEAN.format(c=column)


def _rule_values(pairs) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in pairs)


ROLE_RULES = [
    (role, scenario, endpoint, method)
    for role, scenarios in rules.ROLE_SCENARIOS.items()
    for scenario in scenarios
    for endpoint, method in rules.SCENARIO_ENDPOINTS.get(scenario, [])
]
ROLE_RULES_SQL = f""", role_rules("Role", scenario, rule_endpoint, "HTTP_Method") AS (VALUES {_rule_values(ROLE_RULES)})"""
SIGNATURES = [(s, e, m) for s, pairs in rules.SCENARIO_ENDPOINTS.items() for e, m in pairs]
SIGNATURES_SQL = f""", signatures(scenario, rule_endpoint, "HTTP_Method") AS (VALUES {_rule_values(SIGNATURES)})"""
RESOURCE = f"regexp_replace({_clean(chr(34) + 'Endpoint' + chr(34))}, '/[0-9]+$', '')"


# --- sources and sinks ---------------------------------------------------------------


@register("s3_table_shape", "SELECT count(*) AS n_rows, 5 AS n_columns FROM customer")
def s3(spark, sf):
    return files.describe_table(table(spark, sf, "customer"))


@register(
    "s4_u1_union_of_runs",
    RUNS_SQL + """
SELECT "LogID", run_id, predicted_anomaly, anomaly_score, NULL::VARCHAR AS "Endpoint", "Role" FROM run_a
UNION ALL SELECT "LogID", run_id, predicted_anomaly, anomaly_score, "Endpoint", NULL::VARCHAR FROM run_b""",
)
def s4(spark, sf):
    log = clog(spark, sf)
    a = run_a(log).drop("Timestamp", "Endpoint")
    b = run_b(log).drop("Timestamp", "Role")
    return files.union_by_name([a, b])


@register(
    "s7_logs_per_role_rule",
    CLOG_SQL + ROLE_RULES_SQL + f""", r AS (SELECT DISTINCT * FROM role_rules),
c AS (SELECT "Role", "HTTP_Method", {RESOURCE} AS resource, count(*) AS n FROM clog GROUP BY ALL)
SELECT r."Role", scenario, rule_endpoint, r."HTTP_Method", coalesce(n, 0)::BIGINT AS n_logs
FROM r LEFT JOIN c ON r."Role" = c."Role" AND r."HTTP_Method" = c."HTTP_Method" AND rule_endpoint = resource""",
)
def s7(spark, sf):
    log = clog(spark, sf)
    counts = log.groupBy("Role", "HTTP_Method", E.resource_path(F.col("Endpoint")).alias("rule_endpoint")).agg(
        F.count(F.lit(1)).alias("n")
    )
    role_rules = rules.role_rules(spark, rules.default_rules()).distinct()
    return role_rules.join(counts, ["Role", "HTTP_Method", "rule_endpoint"], "left").select(
        "Role", "scenario", "rule_endpoint", "HTTP_Method", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_logs")
    )


@register(
    "s8_unlabelled_log",
    CLOG_SQL + f"""
SELECT "LogID", "UserID", "Role", strftime("Timestamp", {STAMP}) AS "Timestamp", "HTTP_Method", "Endpoint",
  "IP_Address", "HTTP_Response" FROM clog""",
)
def s8(spark, sf):
    return files.split_unlabelled(clog(spark, sf)).withColumn("Timestamp", stamp("Timestamp"))


@register(
    "s9_u4_history_after_append",
    CLOG_SQL + """
SELECT "Role", count(*) AS n_logs, count(DISTINCT "LogID") AS n_ids FROM (
  SELECT * FROM clog WHERE event_id % 2 = 0 UNION ALL SELECT * FROM clog WHERE event_id % 2 = 1
  UNION ALL SELECT * FROM clog WHERE event_id % 4 = 0) GROUP BY "Role" """,
)
def s9(spark, sf):
    log = clog(spark, sf)
    part = F.col("event_id")
    history = files.union_by_name([log.where(part % 2 == 0), log.where(part % 2 == 1), log.where(part % 4 == 0)])
    return history.groupBy("Role").agg(F.count(F.lit(1)).alias("n_logs"), F.countDistinct("LogID").alias("n_ids"))


# --- projections and filters ---------------------------------------------------------

BAD_TIMES = CLOG_SQL + """, texts AS (
  SELECT "LogID", CASE event_id % 10 WHEN 0 THEN '2024-13-40 00:00:00' WHEN 1 THEN '' WHEN 2 THEN 'yesterday'
    WHEN 3 THEN strftime("Timestamp", '%Y-%m-%d %H:%M:%S.%f') ELSE strftime("Timestamp", '%Y-%m-%d %H:%M:%S') END AS t
  FROM clog)"""


@register(
    "f1_x10_valid_timestamps",
    BAD_TIMES + f""", parsed AS (SELECT "LogID", coalesce(try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, {STAMP})) AS p FROM texts)
SELECT "LogID", strftime(p, {STAMP}) AS "Timestamp" FROM parsed WHERE p IS NOT NULL""",
)
def f1(spark, sf):
    digit = F.col("event_id") % 10
    text = (
        F.when(digit == 0, "2024-13-40 00:00:00").when(digit == 1, "").when(digit == 2, "yesterday")
        .when(digit == 3, stamp("Timestamp")).otherwise(F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss"))
    )
    texts = clog(spark, sf).select("LogID", text.alias("t"))
    parsed = texts.select("LogID", T.parse_timestamp(F.col("t")).alias("p")).where("p is not null")
    return parsed.select("LogID", stamp("p").alias("Timestamp"))


@register(
    "f2_id_and_time_first",
    CLOG_SQL + f"""SELECT "LogID", strftime("Timestamp", {STAMP}) AS "Timestamp", "UserID", "Role", "Endpoint", "HTTP_Response" FROM clog""",
)
def f2(spark, sf):
    log = clog(spark, sf).select("UserID", "Role", "Endpoint", "HTTP_Response", "LogID", "Timestamp")
    return schemas.id_and_time_first(log).withColumn("Timestamp", stamp("Timestamp"))


@register(
    "f8_inventory_requests",
    CLOG_SQL + """SELECT "HTTP_Method", count(*) FILTER ("Endpoint" LIKE '/inventory/items%') AS inventory, count(*) AS n_logs
FROM clog GROUP BY ALL""",
)
def f8(spark, sf):
    return clog(spark, sf).groupBy("HTTP_Method").agg(
        F.count_if(rolling.is_inventory()).alias("inventory"), F.count(F.lit(1)).alias("n_logs")
    )


# --- scalar functions ----------------------------------------------------------------


@register("x1_clean_endpoint", CLOG_SQL + f"""SELECT "LogID", {_clean('"Endpoint"')} AS clean FROM clog""")
def x1(spark, sf):
    return clog(spark, sf).select("LogID", E.clean_endpoint(F.col("Endpoint")).alias("clean"))


@register("x1_clean_page_url", f"SELECT page_id, {_clean('url')} AS clean FROM pages")
def x1_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", E.clean_endpoint(F.col("url")).alias("clean"))


def _levels(column: str, depth: int = 3) -> str:
    parts = f"string_split({_clean(column)}, '/')"
    return ", ".join(f"coalesce({parts}[{i + 1}], 'none') AS endpoint_level_{i}" for i in range(1, depth + 1))


@register("x2_endpoint_levels", CLOG_SQL + f"""SELECT "LogID", {_levels('"Endpoint"')} FROM clog""")
def x2(spark, sf):
    return clog(spark, sf).select("LogID", *E.endpoint_levels(F.col("Endpoint")))


@register("x2_page_url_levels", f"SELECT page_id, {_levels('url', 5)} FROM pages")
def x2_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", *E.endpoint_levels(F.col("url"), 5))


@register(
    "x3_x6_time_features",
    CLOG_SQL + """
SELECT "LogID", extract(hour FROM "Timestamp")::INTEGER AS hour, (extract(isodow FROM "Timestamp") - 1)::INTEGER AS day_of_week,
  CASE WHEN extract(hour FROM "Timestamp") >= 21 OR extract(hour FROM "Timestamp") < 6 THEN 1 ELSE 0 END AS is_unusual_time,
  (extract(hour FROM "Timestamp") >= 22 OR extract(hour FROM "Timestamp") < 6) AS is_unusual_hour,
  strftime("Timestamp", '%Y-%m-%d') AS event_date, strftime("Timestamp", '%Y%m%d%H%M') AS run_stamp
FROM clog""",
)
def x3(spark, sf):
    ts = F.col("Timestamp")
    return clog(spark, sf).select(
        "LogID", T.hour_of(ts).alias("hour"), T.day_of_week(ts).alias("day_of_week"),
        T.is_unusual_time(ts).alias("is_unusual_time"),
        T.in_unusual_hours(ts, T.REPORT_HOURS).alias("is_unusual_hour"),
        T.event_date(ts).cast("string").alias("event_date"), T.run_stamp(ts).alias("run_stamp"),
    )


@register(
    "x7_x8_network_class",
    CLOG_SQL + f"""
SELECT "LogID", {IP['number']} AS ip_number, {IP['internal']} AS is_internal, {IP['global']} AS is_global,
  CASE WHEN {IP['internal']} THEN 'Internal' ELSE 'External' END AS "IP_Type" FROM clog""",
)
def x7(spark, sf):
    ip = F.col("IP_Address")
    return clog(spark, sf).select(
        "LogID", I.ipv4_to_long(ip).alias("ip_number"), I.is_internal_ip(ip).alias("is_internal"),
        I.is_global_ip(ip).alias("is_global"), I.ip_class(ip).alias("IP_Type"),
    )


SPREAD = "CAST({k} * 7919 % 256 AS VARCHAR)"
SPREAD_IP = ip_sql("ip")


@register(
    "j9_network_class_whole_range",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber,
  CAST((l_orderkey * 2654435761 + l_partkey * 40503) % 4294967296 AS BIGINT) AS n FROM lineitem),
t AS (SELECT *, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS ip FROM a)
SELECT n // 16777216 AS first_octet, {SPREAD_IP['internal']} AS is_internal, {SPREAD_IP['global']} AS is_global, count(*) AS n_addresses
FROM t GROUP BY ALL""",
)
def j9(spark, sf):
    n = (F.col("l_orderkey") * F.lit(2654435761) + F.col("l_partkey") * 40503) % F.lit(4294967296)
    octets = [F.expr(f"cast(n div {d} % 256 as string)") for d in (16777216, 65536, 256, 1)]
    addresses = table(spark, sf, "lineitem").select(n.alias("n")).select("n", F.concat_ws(".", *octets).alias("ip"))
    ip = F.col("ip")
    return addresses.groupBy(
        F.expr("n div 16777216").alias("first_octet"),
        I.is_internal_ip(ip).alias("is_internal"), I.is_global_ip(ip).alias("is_global"),
    ).agg(F.count(F.lit(1)).alias("n_addresses"))


@register(
    "j9_longest_of_many_networks",
    """WITH a AS (SELECT l_orderkey, l_linenumber, CAST((l_orderkey * 2654435761 + l_partkey * 40503) % 4294967296 AS BIGINT) AS n FROM lineitem),
w AS (SELECT o_orderkey AS owner, 4 + o_custkey % 25 AS bits, CAST((o_orderkey * 2246822519) % 4294967296 AS BIGINT) AS n FROM orders),
k AS (SELECT bits, n // (1::BIGINT << (32 - bits)) AS prefix, min(owner) AS owner FROM w GROUP BY ALL),
f AS (SELECT n, bits, owner FROM (SELECT DISTINCT n, bits, n // (1::BIGINT << (32 - bits)) AS prefix FROM a, (SELECT DISTINCT bits FROM k))
  JOIN k USING (bits, prefix) QUALIFY row_number() OVER (PARTITION BY n ORDER BY bits DESC) = 1)
SELECT l_orderkey, l_linenumber, bits::INTEGER AS bits, owner FROM a LEFT JOIN f USING (n)""",
)
def j9_networks(spark, sf):
    """Addresses of all order lines against a network of each order."""
    octets = [F.expr(f"cast(n div {d} % 256 as string)") for d in (16777216, 65536, 256, 1)]
    n = (F.col("l_orderkey") * F.lit(2654435761) + F.col("l_partkey") * 40503) % F.lit(4294967296)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n")).withColumn("ip", F.concat_ws(".", *octets))
    own = ((F.col("o_orderkey") * F.lit(2246822519)) % F.lit(4294967296)).alias("n")
    held = table(spark, sf, "orders").select(F.col("o_orderkey").alias("owner"), (4 + F.col("o_custkey") % 25).cast("int").alias("bits"), own)
    held = held.withColumn("cidr", F.concat(F.concat_ws(".", *octets), F.lit("/"), F.col("bits").cast("string"))).drop("n")
    return longest_network(lines, held, ["bits", "owner"], "ip").drop("n", "ip")


@register(
    "x9_resource_id",
    CLOG_SQL + """
SELECT "LogID", TRY_CAST(nullif(regexp_extract("Endpoint", '/inventory/items/([0-9]+)', 1), '') AS BIGINT) AS item_id,
  TRY_CAST(nullif(regexp_extract(split_part("Endpoint", '?', 1), '/([0-9]+)/?$', 1), '') AS BIGINT) AS any_id
FROM clog""",
)
def x9(spark, sf):
    e = F.col("Endpoint")
    return clog(spark, sf).select("LogID", E.resource_id(e).alias("item_id"), E.resource_id(e, None).alias("any_id"))


@register(
    "x15_request_parameters",
    CLOG_SQL + f"""
SELECT "LogID", {RESOURCE} AS resource,
  TRY_CAST(nullif(regexp_extract(split_part("Endpoint", '?', 1), '/([0-9]+)/?$', 1), '') AS BIGINT) AS resource_id,
  CASE WHEN "Endpoint" LIKE '%export=true%' THEN 1 ELSE 0 END AS export,
  TRY_CAST(nullif(regexp_extract("Endpoint", 'limit=([0-9]+)', 1), '') AS BIGINT) AS "limit",
  nullif(regexp_extract("Endpoint", '[?&]query=(.*)$', 1), '') AS payload
FROM clog""",
)
def x15(spark, sf):
    return clog(spark, sf).select("LogID", *E.request_parameters(F.col("Endpoint")))


# --- rules ---------------------------------------------------------------------------


def _covered(condition: str) -> str:
    return CLOG_SQL + ROLE_RULES_SQL + f"""
SELECT "LogID", CASE WHEN EXISTS (SELECT 1 FROM role_rules r WHERE r."Role" = c."Role" AND r."HTTP_Method" = c."HTTP_Method"
  AND {condition}) THEN 0 ELSE 1 END AS is_authorized
FROM (SELECT *, {_clean('"Endpoint"')} AS path FROM clog) c"""


@register("j3_authorization", _covered("(starts_with(c.path, r.rule_endpoint) OR starts_with(r.rule_endpoint, c.path))"))
def j3(spark, sf):
    table_ = rules.authorization_rules(spark, rules.default_rules())
    return authz.with_authorization(clog(spark, sf), table_).select("LogID", "is_authorized")


@register(
    "j3_authorization_by_segment",
    _covered("(starts_with(c.path || '/', r.rule_endpoint || '/') OR starts_with(r.rule_endpoint || '/', c.path || '/'))"),
)
def j3_segment(spark, sf):
    table_ = rules.authorization_rules(spark, rules.default_rules())
    return authz.with_authorization(clog(spark, sf), table_, "segment").select("LogID", "is_authorized")


@register(
    "j3_unauthorised_by_role",
    CLOG_SQL + ROLE_RULES_SQL + f"""
SELECT c."Role", c."HTTP_Method", count(*) AS n_logs FROM (SELECT *, {_clean('"Endpoint"')} AS path FROM clog) c
WHERE EXISTS (SELECT 1 FROM role_rules r WHERE r."Role" = c."Role" AND r."HTTP_Method" = c."HTTP_Method"
  AND (starts_with(c.path, r.rule_endpoint) OR starts_with(r.rule_endpoint, c.path))) GROUP BY ALL""",
)
def j3_count(spark, sf):
    table_ = rules.authorization_rules(spark, rules.default_rules())
    hits = authz.unauthorised(clog(spark, sf), table_)
    return hits.groupBy("Role", "HTTP_Method").agg(F.count(F.lit(1)).alias("n_logs"))


@register(
    "j4_scenario_combinations",
    CLOG_SQL + SIGNATURES_SQL + f"""
SELECT "LogID" FROM clog WHERE ({RESOURCE}, "HTTP_Method") IN (SELECT (rule_endpoint, "HTTP_Method") FROM signatures)""",
)
def j4(spark, sf):
    signatures = rules.scenario_endpoints(spark, rules.default_rules())
    return authz.scenario_combinations(clog(spark, sf), signatures).select("LogID")


# --- rates ---------------------------------------------------------------------------

RATES = DENSE_SQL + """
SELECT "LogID", count(*) OVER w5 AS req_freq_5min,
  CASE WHEN "Endpoint" LIKE '/inventory/items%' THEN count(*) FILTER ("Endpoint" LIKE '/inventory/items%') OVER w10 ELSE 0 END
    AS inventory_change_rate
FROM clog_dense
WINDOW w5 AS (PARTITION BY "UserID" ORDER BY "Timestamp" RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
  w10 AS (PARTITION BY "UserID" ORDER BY "Timestamp" RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"""


@register("w1_w2_request_rates", RATES)
def w1(spark, sf):
    rated = rolling.add_request_rates(clog_dense(spark, sf))
    return rated.select("LogID", "req_freq_5min", "inventory_change_rate")


@register("w1_w2_request_rates_range_frame", RATES)
def w1_window(spark, sf):
    rated = rolling.add_request_rates(clog_dense(spark, sf), "window")
    return rated.select("LogID", "req_freq_5min", "inventory_change_rate")


@register("w1_w2_request_rates_original_clock", RATES.replace("clog_dense\nWINDOW", "clog\nWINDOW"))
def w1_clog(spark, sf):
    rated = rolling.add_request_rates(clog(spark, sf))
    return rated.select("LogID", "req_freq_5min", "inventory_change_rate")


@register(
    "t1_user_timeline",
    CLOG_SQL + f"""SELECT "UserID", "LogID", strftime("Timestamp", {STAMP}) AS "Timestamp" FROM clog ORDER BY "UserID", clog."Timestamp", "LogID" """,
)
def t1(spark, sf):
    ordered = rolling.by_user_and_time(clog(spark, sf))
    return ordered.select("UserID", "LogID", stamp("Timestamp").alias("Timestamp"))


# --- encoders ------------------------------------------------------------------------

TRAIN = 'event_id % 2 = 0 AND k % 12 <> 11'


@register(
    "e1_label_codes_unseen_kept",
    CLOG_SQL + f""", parts AS (SELECT *, {_levels('"Endpoint"', 1)} FROM clog),
codes AS (SELECT endpoint_level_1 AS label, dense_rank() OVER (ORDER BY endpoint_level_1) - 1 AS code
  FROM (SELECT DISTINCT endpoint_level_1 FROM parts WHERE {TRAIN}))
SELECT "LogID", coalesce(code, (SELECT count(*) FROM codes))::INTEGER AS level_1_code
FROM parts LEFT JOIN codes ON endpoint_level_1 = label""",
)
def e1(spark, sf):
    log = clog(spark, sf).select("LogID", "event_id", "k", *E.endpoint_levels(F.col("Endpoint"), 1))
    codes = encoders.fit_label_codes(log.where(TRAIN), "endpoint_level_1")
    return codes.apply(log, "endpoint_level_1", "level_1_code").select("LogID", "level_1_code")


@register(
    "e1_label_codes_many_classes",
    """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) AS label FROM lineitem),
codes AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM t))
SELECT l_orderkey, l_linenumber, code::INTEGER AS code FROM t JOIN codes USING (label)""",
)
def e1_many(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("label")
    )
    codes = encoders.fit_label_codes(items, "label")
    return codes.apply(items, "label", "code").drop("label")


@register(
    "e2_role_codes",
    CLOG_SQL + """, codes AS (SELECT "Role" AS label, dense_rank() OVER (ORDER BY "Role") - 1 AS code FROM (SELECT DISTINCT "Role" FROM clog))
SELECT "LogID", code::INTEGER AS role_encoded FROM clog JOIN codes ON "Role" = label""",
)
def e2(spark, sf):
    log = clog(spark, sf)
    codes = encoders.fit_label_codes(log, "Role")
    return codes.apply(log, "Role", "role_encoded", unseen="error").select("LogID", "role_encoded")


@register(
    "e3_method_one_hot",
    CLOG_SQL + 'SELECT "LogID", '
    + ", ".join(f"""CASE WHEN "HTTP_Method" = '{m}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "HTTP_Method_{m}" """ for m in schemas.HTTP_METHODS if m != "HEAD")
    + " FROM clog",
)
def e3(spark, sf):
    log = clog(spark, sf).select("LogID", "HTTP_Method")
    seen = encoders.one_hot_categories(log.where("HTTP_Method <> 'HEAD'"), "HTTP_Method")
    return encoders.one_hot(log, "HTTP_Method", seen)


@register(
    "a7_role_risk",
    CLOG_SQL + """SELECT "Role", round(avg("Anomalous"), 9) AS role_risk FROM clog GROUP BY "Role" """,
)
def a7(spark, sf):
    means = encoders.target_means(clog(spark, sf), "Role", "Anomalous")
    return means.withColumn("role_risk", F.round("role_risk", 9))


@register(
    "e4_j5_role_risk_applied",
    CLOG_SQL + """, m AS (SELECT "Role", avg("Anomalous") AS risk FROM clog WHERE "Role" <> 'Staff' GROUP BY "Role"),
g AS (SELECT avg("Anomalous") AS risk FROM clog WHERE "Role" <> 'Staff')
SELECT "LogID", round(coalesce(m.risk, g.risk), 9) AS role_risk FROM clog LEFT JOIN m USING ("Role") CROSS JOIN g""",
)
def e4(spark, sf):
    log = clog(spark, sf)
    train = log.where("Role <> 'Staff'")
    means = encoders.target_means(train, "Role", "Anomalous")
    overall = F.lit(train.agg(F.avg("Anomalous")).first()[0])
    rated = encoders.apply_target_means(log, means, "Role", "role_risk", overall)
    return rated.select("LogID", F.round("role_risk", 9).alias("role_risk"))


@register(
    "e5_standard_scaling",
    """WITH s AS (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_extendedprice) mp, stddev_pop(l_extendedprice) sp,
  avg(l_discount) md, stddev_pop(l_discount) sd FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) + 0.0 AS l_quantity,
  round((l_extendedprice - mp) / sp, 6) + 0.0 AS l_extendedprice, round((l_discount - md) / sd, 6) + 0.0 AS l_discount FROM lineitem, s""",
)
def e5(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *names)
    scaled = encoders.fit_scaler(items, names).apply(items)
    # Adding 0.0 turns a negative zero into a plain one.
    return scaled.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


# --- quality -------------------------------------------------------------------------


@register(
    "a8_class_totals",
    CLOG_SQL + """SELECT count(*) AS total, sum("Anomalous")::BIGINT AS anomalies, sum("Anomalous")::DOUBLE / count(*) AS anomaly_ratio FROM clog""",
)
def a8(spark, sf):
    return quality.class_totals(clog(spark, sf))


@register(
    "a9_label_ratio",
    CLOG_SQL + """SELECT count(*) AS total, sum("Anomalous")::BIGINT AS anomalies, sum("Anomalous")::DOUBLE / count(*) AS anomaly_ratio,
0.5::DOUBLE AS expected_ratio, abs(sum("Anomalous")::DOUBLE / count(*) - 0.5) <= 0.05 AS within_tolerance FROM clog""",
)
def a9(spark, sf):
    return quality.label_ratio_check(clog(spark, sf), 0.5)


@register(
    "a10_external_addresses",
    CLOG_SQL + f""", c AS (SELECT count(*) AS total, count(*) FILTER ({IP['global']}) AS external_ips,
  count(*) FILTER ({IP['global']} AND "Anomalous" = 1) AS anomalous_external_ips,
  count(*) FILTER ({IP['number']} IS NULL) AS invalid_ips FROM clog)
SELECT *, external_ips::DOUBLE / total AS external_ratio, anomalous_external_ips::DOUBLE / total AS anomalous_external_ratio,
  anomalous_external_ips::DOUBLE / external_ips AS anomalous_share_of_external,
  anomalous_external_ips::DOUBLE / external_ips > 0.3 AS high_correlation FROM c""",
)
def a10(spark, sf):
    return quality.external_address_check(clog(spark, sf))


@register(
    "a11_chain_consistency",
    CLOG_SQL + """, x AS (SELECT event_id // 3 AS chain, "IP_Address" AS ip,
  CASE WHEN "Endpoint" LIKE '%/items/%' OR "Endpoint" LIKE '%/records/%' THEN split_part(string_split("Endpoint", '/')[4], '?', 1) END AS id FROM clog)
SELECT chain, count(*) AS n_logs, count(DISTINCT ip) <= 1 AS same_ip, count(DISTINCT id) <= 1 AS same_id FROM x GROUP BY chain""",
)
def a11(spark, sf):
    log = clog(spark, sf).withColumn("chain", F.expr("event_id div 3"))
    return quality.chain_consistency(log, "chain")


DIRTY = """WITH d AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 11 = 1 THEN 'nan'::DOUBLE ELSE l_quantity END AS l_quantity,
  CASE WHEN l_partkey % 13 = 0 THEN 'infinity'::DOUBLE WHEN l_partkey % 13 = 1 THEN '-infinity'::DOUBLE ELSE l_extendedprice END AS l_extendedprice,
  l_discount FROM lineitem)"""


def dirty_items(spark, sf):
    p = F.col("l_partkey")
    quantity = F.when(p % 11 == 0, F.lit(None)).when(p % 11 == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    price = (
        F.when(p % 13 == 0, F.lit(float("inf"))).when(p % 13 == 1, F.lit(float("-inf"))).otherwise(F.col("l_extendedprice"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", quantity.alias("l_quantity"), price.alias("l_extendedprice"), "l_discount"
    )


MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


@register(
    "a12_missing_and_infinite",
    DIRTY + """SELECT count(*) FILTER (l_quantity IS NULL OR isnan(l_quantity)) + count(*) FILTER (l_extendedprice IS NULL)
  + count(*) FILTER (l_discount IS NULL) AS missing_cells,
  count(*) FILTER (isinf(l_quantity)) + count(*) FILTER (isinf(l_extendedprice)) + count(*) FILTER (isinf(l_discount)) AS infinite_cells FROM d""",
)
def a12(spark, sf):
    return quality.missing_and_infinite(dirty_items(spark, sf))


@register(
    "a13_mean_imputation",
    DIRTY + """, m AS (SELECT avg(l_quantity) FILTER (isfinite(l_quantity)) AS q, avg(l_extendedprice) FILTER (isfinite(l_extendedprice)) AS p FROM d)
SELECT l_orderkey, l_linenumber, round(CASE WHEN isfinite(l_quantity) THEN l_quantity ELSE q END, 6) AS l_quantity,
  round(CASE WHEN isfinite(l_extendedprice) THEN l_extendedprice ELSE p END, 6) AS l_extendedprice, l_discount FROM d, m""",
)
def a13(spark, sf):
    items = dirty_items(spark, sf)
    clean = quality.impute_means(items, quality.finite_means(items, MEASURES))
    return clean.withColumns({n: F.round(n, 6) for n in MEASURES[:2]})
