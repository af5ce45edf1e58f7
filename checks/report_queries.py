"""Archive joins, reports, metrics and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesswatch.operators import metrics, report, scoring, stats
from accesswatch.sources import files
from checks.clog import CLOG_SQL, RUNS_SQL, STAMP, clog, ip_sql, run_a, run_b, stamp
from checks.registry import register, table

IP = ip_sql()


def scored_runs(log):
    return report.keep_last(files.union_by_name([run_a(log), run_b(log)]))


def report_base(spark, sf):
    log = clog(spark, sf)
    archive = log.drop("score", "k", "event_id", "Anomalous")
    return report.with_report_columns(report.join_scores(archive, scored_runs(log), keep_unscored_flag=True))


BASE_SQL = RUNS_SQL + f""", base AS (
  SELECT c."LogID", c."UserID", c."Role", c."Timestamp", c."Endpoint", c."IP_Address", coalesce(s.predicted_anomaly, 0) AS predicted_anomaly,
    coalesce(s.anomaly_score, 0.0) AS anomaly_score, s."LogID" IS NOT NULL AS is_scored, {ip_sql('c."IP_Address"')['internal']} AS is_internal_ip,
    extract(hour FROM c."Timestamp")::INTEGER AS "Hour",
    extract(hour FROM c."Timestamp") >= 22 OR extract(hour FROM c."Timestamp") < 6 AS is_unusual_hour
  FROM clog c LEFT JOIN scored s ON c."LogID" = s."LogID")"""


@register("w3_keep_last_run", RUNS_SQL + 'SELECT "LogID", run_id, predicted_anomaly, anomaly_score FROM scored')
def w3(spark, sf):
    return scored_runs(clog(spark, sf)).select("LogID", "run_id", "predicted_anomaly", "anomaly_score")


@register(
    "w3_latest_event_per_user",
    f"""SELECT user_id, strftime(ts, {STAMP}) AS ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def w3_events(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id")
    return report.keep_last(events, "user_id", "ts").withColumn("ts", stamp("ts"))


@register(
    "j1_f10_report_base",
    BASE_SQL + """SELECT "LogID", "UserID", "Role", "Endpoint", predicted_anomaly, anomaly_score, is_scored, is_internal_ip, "Hour", is_unusual_hour FROM base""",
)
def j1(spark, sf):
    return report_base(spark, sf).select(
        "LogID", "UserID", "Role", "Endpoint", "predicted_anomaly", "anomaly_score", "is_scored", "is_internal_ip",
        "Hour", "is_unusual_hour",
    )


@register(
    "j1_archive_gaps_filled_from_scores",
    RUNS_SQL + f"""SELECT c."LogID", coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE c."Role" END, s."Role") AS "Role",
  strftime(coalesce(CASE WHEN event_id % 6 = 0 THEN NULL ELSE c."Timestamp" END, s."Timestamp"), {STAMP}) AS "Timestamp",
  coalesce(s.predicted_anomaly, 0) AS predicted_anomaly FROM clog c LEFT JOIN scored s ON c."LogID" = s."LogID" """,
)
def j1_gaps(spark, sf):
    log = clog(spark, sf)
    archive = log.select(
        "LogID",
        F.when(F.col("event_id") % 4 != 0, F.col("Role")).alias("Role"),
        F.when(F.col("event_id") % 6 != 0, F.col("Timestamp")).alias("Timestamp"),
    )
    merged = report.join_scores(archive, scored_runs(log))
    return merged.select("LogID", "Role", stamp("Timestamp").alias("Timestamp"), "predicted_anomaly")


@register("j1_logs_without_score", RUNS_SQL + 'SELECT "LogID" FROM clog WHERE "LogID" NOT IN (SELECT "LogID" FROM scored)')
def j1_unscored(spark, sf):
    log = clog(spark, sf)
    return report.unscored(log, scored_runs(log)).select("LogID")


@register(
    "a1_a2_f7_headline",
    BASE_SQL + """, t AS (SELECT count(*) AS total_logs, count(*) FILTER (predicted_anomaly = 1) AS anomaly_count,
  count(*) FILTER (predicted_anomaly = 1 AND NOT is_internal_ip) AS external_ip_anomalies,
  count(*) FILTER (predicted_anomaly = 1 AND is_unusual_hour) AS unusual_hour_anomalies FROM base)
SELECT *, total_logs - anomaly_count AS normal_count, anomaly_count::DOUBLE / total_logs AS anomaly_ratio, anomaly_count > 0 AS any_anomaly,
  anomaly_count > 10 OR anomaly_count::DOUBLE / total_logs > 0.05 AS over_threshold FROM t""",
)
def a1(spark, sf):
    return report.headline(report_base(spark, sf))


def _usage_sql(key: str, where: str = "true") -> str:
    return BASE_SQL + f"""SELECT {key}, count(*) AS count_usage, count(*) FILTER (predicted_anomaly = 1) AS count_anomalies
FROM base WHERE {where} GROUP BY 1"""


@register("a3_usage_by_role", _usage_sql('"Role"'))
def a3(spark, sf):
    return report.usage_by_role(report_base(spark, sf))


@register("a4_usage_by_endpoint", _usage_sql('"Endpoint"'))
def a4(spark, sf):
    return report.usage_by_endpoint(report_base(spark, sf))


@register(
    "a4_t3_top_endpoints",
    BASE_SQL + 'SELECT "Endpoint", count(*) AS n_logs FROM base GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10',
)
def a4_top(spark, sf):
    return report.top_endpoints(report_base(spark, sf))


@register(
    "a4_t3_top_endpoints_of_anomalies",
    BASE_SQL + 'SELECT "Endpoint", count(*) AS n_logs FROM base WHERE predicted_anomaly = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10',
)
def a4_top_anomalies(spark, sf):
    return report.top_endpoints(report_base(spark, sf), anomalies=True)


@register("a5_x13_usage_by_network", _usage_sql("""CASE WHEN is_internal_ip THEN 'Internal' ELSE 'External' END AS "IP_Type" """))
def a5(spark, sf):
    return report.usage_by_network(report_base(spark, sf))


@register("a6_j8_daily_unusual_hours", _usage_sql("""strftime("Timestamp", '%Y-%m-%d') AS date""", "is_unusual_hour"))
def a6(spark, sf):
    return report.daily_unusual(report_base(spark, sf)).withColumn("date", F.col("date").cast("string"))


_ROWS = 'SELECT "LogID", predicted_anomaly, anomaly_score FROM base WHERE '


@register("f5_anomalous_logs", BASE_SQL + _ROWS + "predicted_anomaly = 1")
def f5(spark, sf):
    return report.anomalous_logs(report_base(spark, sf)).select("LogID", "predicted_anomaly", "anomaly_score")


@register("f5_normal_logs", BASE_SQL + _ROWS + "predicted_anomaly = 0")
def f5_normal(spark, sf):
    return report.normal_logs(report_base(spark, sf)).select("LogID", "predicted_anomaly", "anomaly_score")


@register("f6_borderline_logs", BASE_SQL + _ROWS + "predicted_anomaly = 0 AND anomaly_score > 0.5")
def f6(spark, sf):
    return report.borderline_logs(report_base(spark, sf)).select("LogID", "predicted_anomaly", "anomaly_score")


@register(
    "t2_timeline",
    CLOG_SQL + f"""SELECT "LogID", strftime("Timestamp", {STAMP}) AS "Timestamp" FROM clog ORDER BY clog."Timestamp", "LogID" """,
)
def t2(spark, sf):
    return report.timeline(clog(spark, sf)).select("LogID", stamp("Timestamp").alias("Timestamp"))


OVERRIDE = RUNS_SQL + """, o AS (SELECT "LogID", coalesce("Role" IN ('Doctor', 'Nurse') AND "Endpoint" IN
  ('/patient/appointments/confirm', '/patient/appointments/cancel'), false) AS cleared, predicted_anomaly AS p, anomaly_score AS s FROM scored),
final AS (SELECT "LogID", CASE WHEN cleared THEN 0 ELSE p END AS predicted_anomaly, CASE WHEN cleared THEN 0.0 ELSE s END AS anomaly_score FROM o)"""


@register("f9_analyst_override", OVERRIDE + "SELECT * FROM final")
def f9(spark, sf):
    cleared = scoring.apply_override(scored_runs(clog(spark, sf)))
    return cleared.select("LogID", "predicted_anomaly", "anomaly_score")


@register("f12_scoring_summary", OVERRIDE + "SELECT sum(predicted_anomaly)::BIGINT AS n_anomalies, count(*) AS n_logs FROM final")
def f12(spark, sf):
    return scoring.scoring_summary(scoring.apply_override(scored_runs(clog(spark, sf))))


# --- metrics -------------------------------------------------------------------------


def judged(spark, sf):
    """Labels with a score, and the class predicted from it."""
    return clog(spark, sf).select("LogID", "Anomalous", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


JUDGED = CLOG_SQL + """, judged AS (SELECT "LogID", "Anomalous" AS y, score, CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS p FROM clog)"""
LABELS = """WITH judged AS (SELECT doc_id, quality AS y, 1 - toxic AS p FROM labels)"""


def quality_labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", "quality", (1 - F.col("toxic")).alias("kept"))


def _cells_sql(source: str) -> str:
    return source + "SELECT y AS label, p AS prediction, count(*) AS n FROM judged GROUP BY ALL"


@register("a16_confusion_cells", _cells_sql(JUDGED))
def a16(spark, sf):
    return metrics.confusion_cells(judged(spark, sf), "Anomalous", "predicted")


@register(
    "a16_confusion_matrix",
    LABELS + "SELECT y AS label, count(*) FILTER (p = 0) AS predicted_0, count(*) FILTER (p = 1) AS predicted_1 FROM judged GROUP BY y",
)
def a16_matrix(spark, sf):
    return metrics.confusion_matrix(quality_labels(spark, sf), "quality", "kept")


def _binary_sql(source: str) -> str:
    return source + """, c AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
  count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM judged),
r AS (SELECT *, (tp + tn)::DOUBLE / n AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT n, tp, fp, fn, tn, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM r"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


RATES = ("accuracy", "precision", "recall", "f1")


@register("a17_m6_binary_metrics", _binary_sql(JUDGED))
def a17(spark, sf):
    return _rounded(metrics.binary_metrics(judged(spark, sf), "Anomalous", "predicted"), *RATES)


@register("a17_binary_metrics_of_labels", _binary_sql(LABELS))
def a17_labels(spark, sf):
    return _rounded(metrics.binary_metrics(quality_labels(spark, sf), "quality", "kept"), *RATES)


def _report_sql(source: str) -> str:
    return source + """, classes AS (SELECT DISTINCT y AS c FROM judged UNION SELECT DISTINCT p FROM judged),
k AS (SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (p = c) AS predicted, count(*) FILTER (y = c AND p = c) AS hit
  FROM judged, classes GROUP BY c),
r AS (SELECT c, support, hit, coalesce(hit::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall FROM k),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r),
lines AS (SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1, support FROM f
UNION ALL SELECT 'accuracy', sum(hit)::DOUBLE / sum(support), sum(hit)::DOUBLE / sum(support), sum(hit)::DOUBLE / sum(support), sum(support) FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT class, round(precision, 2) AS precision, round(recall, 2) AS recall, round(f1, 2) AS f1, support::BIGINT AS support FROM lines"""


@register("a18_class_report", _report_sql(JUDGED))
def a18(spark, sf):
    return metrics.class_report(judged(spark, sf), "Anomalous", "predicted")


@register("a18_class_report_of_labels", _report_sql(LABELS))
def a18_labels(spark, sf):
    return metrics.class_report(quality_labels(spark, sf), "quality", "kept")


STEPS = JUDGED + """, s AS (SELECT score AS threshold, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM judged GROUP BY score),
c AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM s WINDOW w AS (ORDER BY threshold DESC))"""


@register(
    "a19_roc_points",
    STEPS + """SELECT threshold, round(fps::DOUBLE / nn, 9) AS fpr, round(tps::DOUBLE / np, 9) AS tpr FROM c
UNION ALL SELECT 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
)
def a19(spark, sf):
    return _rounded(metrics.roc_points(judged(spark, sf), "Anomalous", "score"), "fpr", "tpr")


RANKS = """, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM judged)
SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 9) AS auc FROM r"""


@register("a19_auc", JUDGED + RANKS)
def a19_auc(spark, sf):
    return _rounded(metrics.roc_auc(judged(spark, sf), "Anomalous", "score"), "auc")


ITEMS = """WITH judged AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice AS score FROM lineitem)"""


@register("a19_auc_many_scores", ITEMS + RANKS)
def a19_items(spark, sf):
    items = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("score")
    )
    return _rounded(metrics.roc_auc(items, "y", "score"), "auc")


@register(
    "a20_precision_recall_points",
    STEPS + """SELECT threshold, round(tps::DOUBLE / (tps + fps), 9) AS precision, round(tps::DOUBLE / np, 9) AS recall FROM c
UNION ALL SELECT 'infinity'::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE""",
)
def a20(spark, sf):
    return _rounded(metrics.precision_recall_points(judged(spark, sf), "Anomalous", "score"), "precision", "recall")


# --- correlation ---------------------------------------------------------------------

ITEM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "one"]
ITEM_VIEW = "WITH n AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, 1 AS one FROM lineitem)"


def item_measures(spark, sf):
    return table(spark, sf, "lineitem").select(*ITEM_COLUMNS[:4], F.lit(1).alias("one"))


def _corr_sql(pairs) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, "
        + ("NULL::DOUBLE" if "one" in (a, b) else f"round(corr({a}, {b}), 6)")
        + " AS correlation FROM n"
        for a, b in pairs
    )


def _one_row_each(sql: str) -> str:
    return f"SELECT DISTINCT * FROM ({sql})"


@register(
    "a14_correlation_matrix",
    ITEM_VIEW + _one_row_each(_corr_sql([(a, b) for a in ITEM_COLUMNS for b in ITEM_COLUMNS])),
)
def a14(spark, sf):
    return stats.correlation_matrix(item_measures(spark, sf)).withColumn("correlation", F.round("correlation", 6))


ACCOUNTS = """WITH n AS (SELECT c_custkey, c_nationkey, c_acctbal, c_acctbal * 2 + c_nationkey AS doubled, -c_custkey AS reversed FROM customer)"""
ACCOUNT_COLUMNS = ["c_custkey", "c_nationkey", "c_acctbal", "doubled", "reversed"]


@register(
    "a15_high_correlations",
    ACCOUNTS + "SELECT * FROM (" + _one_row_each(
        _corr_sql([(a, b) for i, a in enumerate(ACCOUNT_COLUMNS) for b in ACCOUNT_COLUMNS[i + 1 :]])
    ) + ") WHERE abs(correlation) > 0.6",
)
def a15(spark, sf):
    accounts = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal",
        (F.col("c_acctbal") * 2 + F.col("c_nationkey")).alias("doubled"), (-F.col("c_custkey")).alias("reversed"),
    )
    return stats.high_correlations(accounts, 0.6).withColumn("correlation", F.round("correlation", 6))


@register(
    "f11_numeric_columns_of_orders",
    "SELECT count(o_orderkey) AS o_orderkey, count(o_custkey) AS o_custkey, count(o_totalprice) AS o_totalprice FROM orders",
)
def f11(spark, sf):
    from accesswatch.sources.schemas import numeric_names

    orders = table(spark, sf, "orders")
    return orders.agg(*[F.count(n).alias(n) for n in numeric_names(orders)])
