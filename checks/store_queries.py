"""Files and stores that a query writes from the tables, reads back and compares."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from accesswatch.functions import temporal as T
from accesswatch.operators import model as M
from accesswatch.operators.report import keep_last
from accesswatch.operators.rolling import add_request_rates
from accesswatch.plans import refresh
from accesswatch.plans.features import build_features, fit_encoders, time_counts
from accesswatch.plans.reporting import bucketed_report_base, load_report_base
from accesswatch.plans.scoring import archive_run, batch_with_history, longest_window, score_batch
from accesswatch.sources import files, schemas
from accesswatch.sources.rules import default_rules
from accesswatch.sources.store import RunStore
from checks.clog import CLOG_SQL, DENSE_SQL, LOG_COLUMNS, RUNS_SQL, STAMP, clog, clog_dense, run_a, run_b, stamp
from checks.feature_queries import RATES
from checks.model_queries import dense_log, work_folder
from checks.registry import register
from checks.report_queries import BASE_SQL, report_base


def _one_file(df, path: str) -> None:
    """The rows as a single CSV file of that name."""
    df.coalesce(1).write.csv(f"{path}.parts", header=True)
    hadoop, fs = files._file_system(df.sparkSession, path)
    (part,) = fs.globStatus(hadoop(f"{path}.parts/part-*"))
    fs.rename(part.getPath(), hadoop(path))
    fs.delete(hadoop(f"{path}.parts"), True)


@register(
    "s1_log_files_of_three_headers",
    CLOG_SQL + f"""SELECT "LogID", "UserID", "Role", strftime("Timestamp", {STAMP}) AS "Timestamp", "HTTP_Method", "Endpoint",
  "IP_Address", "HTTP_Response", CASE WHEN event_id % 3 = 2 THEN NULL ELSE "Anomalous" END AS "Anomalous" FROM clog""",
)
def s1(spark, sf):
    log, folder = clog(spark, sf).withColumn("Timestamp", stamp("Timestamp")), work_folder(spark)
    orders = (LOG_COLUMNS, tuple(reversed(LOG_COLUMNS)), ("Role", "Timestamp", *[c for c in LOG_COLUMNS[:-1] if c not in ("Role", "Timestamp")]))
    for i, names in enumerate(orders):
        _one_file(log.where(F.col("event_id") % 3 == i).select(*names), f"{folder}/log_{i}.csv")
    return files.read_log_csv(spark, folder).select(*LOG_COLUMNS)


@register(
    "s1_s4_values_with_line_breaks",
    CLOG_SQL + """SELECT "LogID", 'results_' || (CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '3' END) AS file,
  CASE WHEN event_id % 3 < 2 THEN "Role" || CASE WHEN event_id % 30 = 0 THEN chr(10) || 'second, "line"' WHEN event_id % 30 = 10 THEN chr(10) || chr(10) || 'end' ELSE '' END END AS "Note",
  CASE WHEN event_id % 3 = 1 THEN NULL ELSE "HTTP_Response" END AS "HTTP_Response" FROM clog""",
)
def s1_breaks(spark, sf):
    """Files of three headers, two of which have values that go on over lines."""
    log, folder = clog(spark, sf), work_folder(spark)
    more = F.when(F.col("event_id") % 30 == 0, '\nsecond, "line"').when(F.col("event_id") % 30 == 10, "\n\nend").otherwise("")
    noted = log.withColumn("Note", F.concat("Role", more))
    for i, names in enumerate((["LogID", "Note", "HTTP_Response"], ["Note", "LogID"], ["HTTP_Response", "LogID"])):
        _one_file(noted.where(F.col("event_id") % 3 == i).select(*names), f"{folder}/results_{i + 1}.csv")
    rows = files.read_csv_by_name(spark, folder, {"HTTP_Response": schemas.RAW_LOG["HTTP_Response"].dataType})
    file = F.regexp_extract("_path", r"(results_\d)", 1).alias("file")
    return rows.select("LogID", file, "Note", "HTTP_Response")


@register(
    "s4_result_files",
    RUNS_SQL + """SELECT "LogID", run_id, predicted_anomaly, anomaly_score, NULL::VARCHAR AS "Endpoint", "Role" FROM run_a
UNION ALL SELECT "LogID", run_id, predicted_anomaly, anomaly_score, "Endpoint", NULL::VARCHAR FROM run_b""",
)
def s4(spark, sf):
    log, folder = clog(spark, sf), work_folder(spark)
    _one_file(run_a(log).select("anomaly_score", "LogID", "predicted_anomaly", "Role"), f"{folder}/results_202401010000.csv")
    _one_file(run_b(log).select("LogID", "Endpoint", "predicted_anomaly", "anomaly_score"), f"{folder}/results_202401010100.csv")
    return files.read_result_csvs(spark, folder).select("LogID", "run_id", "predicted_anomaly", "anomaly_score", "Endpoint", "Role")


@register(
    "s9_append_and_rerun",
    CLOG_SQL + f"""SELECT "LogID", 'a' AS run_id, strftime("Timestamp" - INTERVAL 2 DAY, {STAMP}) AS "Timestamp" FROM clog WHERE event_id % 3 = 0
UNION ALL SELECT "LogID", 'c', strftime("Timestamp", {STAMP}) FROM clog WHERE event_id % 3 = 2""",
)
def s9(spark, sf):
    """Run a once and again two days earlier; run b and its empty repeat; run c."""
    log, path = clog(spark, sf).select("LogID", "Timestamp", "event_id"), work_folder(spark)
    part = F.col("event_id") % 3
    moved = log.withColumn("Timestamp", F.col("Timestamp") - F.expr("INTERVAL 2 DAYS"))
    for run, rows in (("a", log.where(part == 0)), ("b", log.where(part == 1)), ("a", moved.where(part == 0)),
                      ("b", log.where("event_id < 0")), ("c", log.where(part == 2))):
        files.write_run(rows, path, run)
    stored = files.read_runs(spark, path, date(1990, 1, 1), date(2100, 1, 1))
    return stored.select("LogID", "run_id", stamp("Timestamp").alias("Timestamp"))


@register(
    "s9_u4_compacted_runs",
    CLOG_SQL + f"""SELECT "LogID", 'b' AS run_id, 2 AS arrival, strftime("Timestamp", {STAMP}) AS "Timestamp" FROM clog WHERE event_id % 3 = 1
UNION ALL SELECT "LogID", 'a', 4, strftime("Timestamp" + INTERVAL 1 DAY, {STAMP}) FROM clog WHERE event_id % 3 = 0
UNION ALL SELECT "LogID", 'c', 6, strftime("Timestamp", {STAMP}) FROM clog WHERE event_id % 3 = 2""",
)
def s9_compacted(spark, sf):
    """Runs a and b, compaction, a once more with other times, compaction, run c: each row with its run's last arrival."""
    log, store = clog(spark, sf).select("LogID", "Timestamp", "event_id"), RunStore(spark, work_folder(spark))
    part = F.col("event_id") % 3
    store.write(log.where(part == 0), "a")
    store.write(log.where(part == 1), "b")
    store.compact()
    store.write(log.where(part == 0).withColumn("Timestamp", F.col("Timestamp") + F.expr("INTERVAL 1 DAY")), "a")
    store.compact()
    store.write(log.where(part == 2), "c")
    rows = store.read()
    return rows.select("LogID", "run_id", F.col("arrival").cast("int").alias("arrival"), stamp("Timestamp").alias("Timestamp"))


@register("v4_w3_backfill_by_older_runs", RATES)
def v4_backfill(spark, sf):
    """Rates of runs whose ids go down while they arrive: the second quarter of the log first under the largest id, then the
    rest around it, half of the last quarter at first, a log of 1990 and one run twice. What arrived last is right."""
    log, folder = files.split_unlabelled(clog_dense(spark, sf)), work_folder(spark)
    first, last = log.agg(F.min(F.unix_micros("Timestamp")), F.max(F.unix_micros("Timestamp"))).first()
    quarter = F.expr(f"(unix_micros(Timestamp) - {first}L) div {(last - first) // 4 + 1}L")
    old = log.limit(1).withColumns({"LogID": F.lit("old"), "Timestamp": F.lit("1990-05-05 05:05:05").cast("timestamp")})
    runs = [("202401010900", log.where(quarter == 1)), ("202401010800", log.where((quarter == 3) & (F.col("UserID") % 2 == 0))),
            ("202401010700", log.where(quarter == 0).unionByName(old)), ("202401010600", log.where(quarter == 2)),
            ("202401010800", log.where(quarter == 3))]
    for run, rows in runs:
        moved = archive_run(rows, f"{folder}/archive", run)
        near = batch_with_history(spark, f"{folder}/archive", moved, run, longest_window())
        files.write_run(add_request_rates(near).where("_own").drop("_own"), f"{folder}/rates", run)
    stored = RunStore(spark, f"{folder}/rates").read().where("LogID <> 'old'")
    return keep_last(stored.select("LogID", "arrival", "req_freq_5min", "inventory_change_rate"), order="arrival").drop("arrival")


@register(
    "s5_archive_or_empty",
    CLOG_SQL + """SELECT "Role", count(*) AS n_logs FROM clog GROUP BY "Role" """,
)
def s5(spark, sf):
    log, path = clog(spark, sf).select("LogID", "Role"), work_folder(spark)
    log.write.parquet(f"{path}/archive")
    both = files.read_or_empty(spark, f"{path}/archive", log.schema).union(files.read_or_empty(spark, f"{path}/none", log.schema))
    return both.groupBy("Role").agg(F.count(F.lit(1)).alias("n_logs"))


@register(
    "s10_csv_written_and_read",
    CLOG_SQL + """SELECT "LogID", "Endpoint", "HTTP_Response" FROM clog""",
)
def s10(spark, sf):
    path = work_folder(spark)
    files.write_csv(clog(spark, sf).select("LogID", "Endpoint", "HTTP_Response"), path)
    return files.read_csv_by_name(spark, path, {"HTTP_Response": schemas.RAW_LOG["HTTP_Response"].dataType}).drop("_path")


@register(
    "f3_f4_absent_features",
    CLOG_SQL + """SELECT 0 AS req_freq_5min, "HTTP_Response" AS hour, 0 AS role_risk FROM clog""",
)
def f3(spark, sf):
    rows = clog(spark, sf).select("LogID", F.col("HTTP_Response").alias("hour"))
    names = ["req_freq_5min", "hour", "role_risk"]
    return schemas.model_input(schemas.with_defaults(rows, names), names)


def _time_texts(spark, sf):
    kind = F.col("event_id") % 8
    day, clock = F.date_format("Timestamp", "yyyy-MM-dd"), F.date_format("Timestamp", "HH:mm:ss")
    iso = F.concat(day, F.lit("T"), clock)
    text = (
        F.when(kind == 0, iso).when(kind == 1, F.concat(iso, F.lit("Z"))).when(kind == 2, F.concat(iso, F.lit("+00:00")))
        .when(kind == 3, F.substring(F.concat(day, F.lit(" "), clock), 1, 16)).when(kind == 4, day)
        .when(kind == 5, F.concat(day, F.lit(" "), clock, F.lit(".123456789"))).when(kind == 6, clock).otherwise("yesterday")
    )
    return clog(spark, sf).withColumn("Timestamp", text)


@register(
    "f1_iso_times",
    CLOG_SQL + f"""SELECT "LogID", strftime(CASE event_id % 8 WHEN 3 THEN date_trunc('minute', "Timestamp") WHEN 4 THEN date_trunc('day', "Timestamp")
  WHEN 5 THEN date_trunc('second', "Timestamp") + INTERVAL 123456 MICROSECOND ELSE date_trunc('second', "Timestamp") END, {STAMP}) AS "Timestamp"
FROM clog WHERE event_id % 8 < 6""",
)
def f1(spark, sf):
    parsed = _time_texts(spark, sf).withColumn("Timestamp", T.parse_timestamp(F.col("Timestamp")))
    return parsed.where("Timestamp IS NOT NULL").select("LogID", stamp("Timestamp").alias("Timestamp"))


@register(
    "f1_dropped_times",
    CLOG_SQL + "SELECT count(*) AS n_rows, count(*) FILTER (event_id % 8 >= 6) AS n_dropped FROM clog",
)
def f1_dropped(spark, sf):
    return time_counts(_time_texts(spark, sf))


_FITTED: dict[tuple, tuple] = {}


def _deleting(spark, sf, c: float = 1.0):
    """Encoders, features of all logs and a logistic model, for a label that the features say: whether the request
    deletes. Features are written once, models fitted once per session."""
    key = (spark.sparkContext.applicationId, sf, c)
    if key[:2] not in _FITTED:
        log = dense_log(spark, sf).withColumn("Anomalous", (F.col("HTTP_Method") == "DELETE").cast("int"))
        encoders, folder = fit_encoders(log), f"{work_folder(spark)}/features"
        build_features(log, default_rules(), encoders, keep_label=True).write.parquet(folder)
        _FITTED[key[:2]] = (encoders, spark.read.parquet(folder))
    if key not in _FITTED:
        encoders, rows = _FITTED[key[:2]]
        _FITTED[key] = (encoders, rows, M.fit_logistic(rows, c=c))
    return _FITTED[key]


DELETES = DENSE_SQL + """SELECT "LogID", ("HTTP_Method" = 'DELETE')::INTEGER AS predicted_anomaly FROM clog_dense"""


@register("m2_m4_deletes_by_logistic", DELETES)
def m2(spark, sf):
    _, rows, model = _deleting(spark, sf)
    return M.predict(model, rows).select("LogID", "predicted_anomaly")


@register(
    "m5_j7_predictions_of_two_models",
    DENSE_SQL + """SELECT "LogID", ("HTTP_Method" = 'DELETE')::INTEGER AS strong_predicted_anomaly,
  ("HTTP_Method" = 'DELETE')::INTEGER AS weak_predicted_anomaly FROM clog_dense""",
)
def m5(spark, sf):
    _, rows, strong = _deleting(spark, sf)
    models = {"strong": strong, "weak": _deleting(spark, sf, 0.1)[2]}
    return M.predict_with_models(models, rows, keep=("LogID",))


@register(
    "m7_t4_u3_deciding_feature",
    DENSE_SQL + """SELECT 'HTTP_Method_DELETE' AS feature FROM clog_dense WHERE "HTTP_Method" = 'DELETE' LIMIT 1""",
)
def m7(spark, sf):
    tables = [M.importances(_deleting(spark, sf, c)[2]) for c in (1.0, 0.1)]
    return M.top_feature_union([M.top_features(t) for t in tables], 1)


@register(
    "j1_report_of_a_period",
    CLOG_SQL + """SELECT "LogID", ("k" >= 70)::INTEGER AS predicted_anomaly FROM clog
WHERE "Timestamp"::DATE = (SELECT min("Timestamp")::DATE FROM clog)""",
)
def j1_period(spark, sf):
    log, folder = clog(spark, sf), work_folder(spark)
    files.write_run(files.split_unlabelled(log), f"{folder}/archive", "1")
    files.write_run(run_b(log.withColumn("event_id", F.lit(0))).drop("run_id"), f"{folder}/results", "1")
    day = log.agg(F.to_date(F.min("Timestamp"))).first()[0]
    return load_report_base(spark, f"{folder}/archive", f"{folder}/results", day, day).select("LogID", "predicted_anomaly")


@register(
    "j1_w3_bucketed_report",
    BASE_SQL + """SELECT "LogID", "UserID", "Role", "Endpoint", predicted_anomaly, anomaly_score, is_scored, is_internal_ip, "Hour", is_unusual_hour FROM base""",
)
def j1_bucketed(spark, sf):
    """The report after four refreshes of bucketed tables, one of them with a run that comes again."""
    log, folder = clog(spark, sf), work_folder(spark)
    paths = [f"{folder}/{x}" for x in ("archive", "results", "bucketed")]
    half = F.col("event_id") % 2
    for rows, run in ((log.where(half == 0), "1"), (log.where(half == 0), "2"), (log.where(half == 1), "2")):
        files.write_run(files.split_unlabelled(rows), paths[0], run)
        bucketed_report_base(spark, *paths, buckets=4)
    for rows, run in ((run_b(log), "a"), (run_a(log), "a"), (run_b(log), "b")):
        files.write_run(rows.drop("run_id"), paths[1], run)
        base = bucketed_report_base(spark, *paths, buckets=4)
    names = ["LogID", "UserID", "Role", "Endpoint", "predicted_anomaly", "anomaly_score", "is_scored", "is_internal_ip", "Hour"]
    return base.select(*names, "is_unusual_hour")


REPORT_SQL = BASE_SQL + """, t AS (
  SELECT 'all' AS tab, '' AS k, count(*) AS count_usage, count(*) FILTER (predicted_anomaly = 1) AS count_anomalies FROM base
  UNION ALL SELECT 'external', '', count(*) FILTER (predicted_anomaly = 1 AND NOT is_internal_ip), count(*) FILTER (predicted_anomaly = 1 AND is_unusual_hour) FROM base
  UNION ALL SELECT 'role', "Role", count(*), count(*) FILTER (predicted_anomaly = 1) FROM base GROUP BY "Role"
  UNION ALL SELECT 'network', CASE WHEN is_internal_ip THEN 'Internal' ELSE 'External' END, count(*), count(*) FILTER (predicted_anomaly = 1) FROM base GROUP BY 2
  UNION ALL SELECT 'endpoint', "Endpoint", count(*), count(*) FILTER (predicted_anomaly = 1) FROM base GROUP BY "Endpoint"
  UNION ALL SELECT 'unusual', "Timestamp"::DATE::VARCHAR, count(*), count(*) FILTER (predicted_anomaly = 1) FROM base WHERE is_unusual_hour GROUP BY 2)
SELECT tab, k, count_usage::BIGINT AS count_usage, count_anomalies::BIGINT AS count_anomalies FROM t"""


def _one_table(tables):
    head = tables["headline"]
    first = head.select(F.lit("all").alias("tab"), F.lit("").alias("k"), F.col("total_logs").alias("count_usage"), F.col("anomaly_count").alias("count_anomalies"))
    second = head.select(F.lit("external").alias("tab"), F.lit("").alias("k"), F.col("external_ip_anomalies").alias("count_usage"), F.col("unusual_hour_anomalies").alias("count_anomalies"))
    out = first.unionByName(second)
    for tab, name in (("role", "by_role"), ("network", "by_network"), ("endpoint", "by_endpoint"), ("unusual", "daily_unusual_hours")):
        rows = tables[name]
        out = out.unionByName(rows.select(F.lit(tab).alias("tab"), F.col(rows.columns[0]).cast("string").alias("k"), "count_usage", "count_anomalies"))
    return out


@register("a1_a6_one_scan", REPORT_SQL)
def a1_a6(spark, sf):
    return _one_table(refresh.tables_of(refresh.daily_partials(report_base(spark, sf))))


@register("a1_a6_refreshed_by_day", REPORT_SQL)
def a1_a6_refreshed(spark, sf):
    """Daily counts renewed after each of five runs, one of which comes again with other scores."""
    log, folder = clog(spark, sf), work_folder(spark)
    paths = [f"{folder}/{x}" for x in ("archive", "results", "partials")]
    half = F.dayofyear("Timestamp") % 2
    for i, rows, run in ((0, log.where(half == 0), "1"), (1, run_b(log), "a"), (0, log.where(half == 1), "2"), (1, run_a(log), "a"), (1, run_b(log), "b")):
        files.write_run(rows.drop("run_id") if i else files.split_unlabelled(rows), paths[i], run)
        refresh.refresh_report(spark, *paths)
    return _one_table(refresh.refreshed_tables(spark, paths[2]))


@register(
    "v6_scored_batch",
    DENSE_SQL + """SELECT "LogID", ("HTTP_Method" = 'DELETE' AND NOT ("Role" IN ('Doctor', 'Nurse')
  AND "Endpoint" IN ('/patient/appointments/confirm', '/patient/appointments/cancel')))::INTEGER AS predicted_anomaly FROM clog_dense""",
)
def v6_batch(spark, sf):
    """A whole batch from training to stored results, labelled by what the features say."""
    folder = work_folder(spark)
    encoders, _, model = _deleting(spark, sf)
    score_batch(dense_log(spark, sf), default_rules(), encoders, model, f"{folder}/archive", f"{folder}/results", "1")
    return spark.read.parquet(f"{folder}/results").select("LogID", "predicted_anomaly")
