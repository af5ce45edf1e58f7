"""Feature table, split, fitted models and their explanations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from accesswatch.operators import metrics, model as M
from accesswatch.operators.quality import impute_means
from accesswatch.operators.rolling import add_request_rates
from accesswatch.operators.stats import high_correlations
from accesswatch.plans.diagnostics import diagnose
from accesswatch.plans.features import build_features, fit_encoders, row_features
from accesswatch.plans.training import Trained, load_trained, train_models
from accesswatch.plans.scoring import score_log
from accesswatch.session import checkpoint_dir
from accesswatch.sources import files
from accesswatch.sources.rules import default_rules
from accesswatch.sources.schemas import HTTP_METHODS, LABEL, MODEL_FEATURES
from checks.clog import DENSE_SQL, LOG_COLUMNS, CLOG_SQL, clog_dense, ip_sql
from checks.feature_queries import ROLE_RULES_SQL, _clean, _levels
from checks.registry import register

IP = ip_sql()


def dense_log(spark, sf):
    return clog_dense(spark, sf).select(*LOG_COLUMNS)


def work_folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/accesswatch-{uuid.uuid4().hex}"


_METHOD_FLAGS = ", ".join(
    f"""CASE WHEN "HTTP_Method" = '{m}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "HTTP_Method_{m}" """ for m in HTTP_METHODS
)
FEATURES_SQL = DENSE_SQL + ROLE_RULES_SQL + f""", parts AS (SELECT *, {_levels('"Endpoint"')}, {_clean('"Endpoint"')} AS path FROM clog_dense),
l1 AS (SELECT endpoint_level_1 AS label, dense_rank() OVER (ORDER BY endpoint_level_1) - 1 AS code FROM (SELECT DISTINCT endpoint_level_1 FROM parts)),
ro AS (SELECT "Role" AS label, dense_rank() OVER (ORDER BY "Role") - 1 AS code FROM (SELECT DISTINCT "Role" FROM parts)),
risk AS (SELECT "Role", avg("Anomalous") AS r FROM parts GROUP BY "Role"),
bad AS (SELECT DISTINCT "LogID" FROM parts p JOIN role_rules r ON r."Role" = p."Role" AND r."HTTP_Method" = p."HTTP_Method"
  AND (starts_with(p.path, r.rule_endpoint) OR starts_with(r.rule_endpoint, p.path))),
feats AS (SELECT "LogID", "UserID", parts."Role", "Endpoint", "HTTP_Response", endpoint_level_1, endpoint_level_2, endpoint_level_3,
  extract(hour FROM "Timestamp")::INTEGER AS hour, (extract(isodow FROM "Timestamp") - 1)::INTEGER AS day_of_week,
  CASE WHEN extract(hour FROM "Timestamp") >= 21 OR extract(hour FROM "Timestamp") < 6 THEN 1 ELSE 0 END AS is_unusual_time,
  {IP['internal']}::INTEGER AS is_internal_ip, CASE WHEN "LogID" IN (SELECT "LogID" FROM bad) THEN 0 ELSE 1 END AS is_authorized,
  {_METHOD_FLAGS}, round(risk.r, 9) AS role_risk, count(*) OVER w5 AS req_freq_5min,
  CASE WHEN "Endpoint" LIKE '/inventory/items%' THEN count(*) FILTER ("Endpoint" LIKE '/inventory/items%') OVER w10 ELSE 0 END AS inventory_change_rate,
  ro.code::INTEGER AS role_encoded, l1.code::INTEGER AS endpoint_l1_encoded, "Anomalous"
FROM parts JOIN l1 ON endpoint_level_1 = l1.label JOIN ro ON parts."Role" = ro.label JOIN risk ON parts."Role" = risk."Role"
WINDOW w5 AS (PARTITION BY "UserID" ORDER BY "Timestamp" RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
  w10 AS (PARTITION BY "UserID" ORDER BY "Timestamp" RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))"""


def features(spark, sf, label=True):
    log = dense_log(spark, sf)
    return build_features(log, default_rules(), fit_encoders(log), keep_label=label)


@register("feature_table", FEATURES_SQL + 'SELECT * EXCLUDE ("Anomalous") FROM feats')
def feature_table(spark, sf):
    return features(spark, sf, label=False).drop("Timestamp").withColumn("role_risk", F.round("role_risk", 9))


@register(
    "s2_training_table",
    FEATURES_SQL + "SELECT " + ", ".join(f'round(sum("{f}"), 3)::DOUBLE AS "{f}"' for f in MODEL_FEATURES)
    + ', sum("Anomalous")::DOUBLE AS "Anomalous", count(*) AS n_rows FROM feats',
)
def s2(spark, sf):
    table = features(spark, sf)
    untidy = table.toDF(*[" " + c.replace("_", " ") if c == "req_freq_5min" else c + " " for c in table.columns])
    tidy = files.read_training_table(untidy)
    sums = [F.round(F.sum(c), 3).cast("double").alias(c) for c in MODEL_FEATURES]
    return tidy.agg(*sums, F.sum(LABEL).cast("double").alias(LABEL), F.count(F.lit(1)).alias("n_rows"))


@register(
    "m1_stratified_split",
    CLOG_SQL + """, n AS (SELECT "Anomalous" AS c, count(*) AS k, sum(count(*)) OVER () AS n FROM clog GROUP BY 1),
q AS (SELECT c, floor(ceil(0.2 * n) * k / n) AS f, ceil(0.2 * n) * k / n - floor(ceil(0.2 * n) * k / n) AS rest, ceil(0.2 * n) AS total FROM n),
s AS (SELECT c, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, c) <= total - sum(f) OVER () THEN 1 ELSE 0 END AS size FROM q),
r AS (SELECT "LogID", "Anomalous", row_number() OVER (PARTITION BY "Anomalous" ORDER BY md5("LogID" || ':42')) AS pos FROM clog)
SELECT "LogID", "Anomalous", CASE WHEN pos <= size THEN 'test' ELSE 'train' END AS side FROM r JOIN s ON "Anomalous" = c""",
)
def m1(spark, sf):
    train, test = M.stratified_split(clog_dense(spark, sf).select("LogID", LABEL))
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


_TRAINED: dict[tuple[str, str], tuple[Trained, str]] = {}


def trained(spark, sf) -> tuple[Trained, str]:
    """Models of a data folder, fitted once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        folder = work_folder(spark)
        _TRAINED[key] = (train_models(dense_log(spark, sf), default_rules(), folder), folder)
    return _TRAINED[key]


def _evaluated(spark, sf, name):
    fitted, _ = trained(spark, sf)
    return M.evaluate(M.predict(fitted.models[name], fitted.test))


@register("m2_m6_logistic_evaluated")
def m2(spark, sf):
    return _evaluated(spark, sf, "logistic")


@register("m3_m6_forest_evaluated")
def m3(spark, sf):
    return _evaluated(spark, sf, "random_forest")


@register("m4_m9_scored_by_saved_model")
def m4(spark, sf):
    _, folder = trained(spark, sf)
    encoders, model = load_trained(spark, folder, "logistic")
    scored = score_log(dense_log(spark, sf), default_rules(), encoders, model)
    return scored.select("LogID", "Role", "Endpoint", "predicted_anomaly", "anomaly_score")


@register("m5_j7_predictions_per_model")
def m5(spark, sf):
    fitted, folder = trained(spark, sf)
    models = M.load_models({n: f"{folder}/{n}" for n in ("logistic", "random_forest", "boosted")})
    return M.predict_with_models(models, fitted.test)


@register("m5_anomalies_per_model")
def m5_counts(spark, sf):
    return M.anomalies_per_model(m5(spark, sf))


@register("m6_a18_class_report_of_forest")
def m6(spark, sf):
    fitted, _ = trained(spark, sf)
    return metrics.class_report(M.predict(fitted.models["random_forest"], fitted.test), LABEL, "predicted_anomaly")


@register("m7_t4_forest_importances")
def m7(spark, sf):
    fitted, _ = trained(spark, sf)
    return M.top_features(M.importances(fitted.models["random_forest"]))


@register("m7_t4_logistic_coefficients")
def m7_logistic(spark, sf):
    fitted, _ = trained(spark, sf)
    return M.top_features(M.importances(fitted.models["logistic"], signed=True))


@register("t5_u3_top_features_of_models")
def t5(spark, sf):
    fitted, _ = trained(spark, sf)
    return M.top_feature_union([M.importances(m) for m in fitted.models.values()])


@register("m8_permutation_importance")
def m8(spark, sf):
    fitted, _ = trained(spark, sf)
    return M.permutation_importance(fitted.models["logistic"], fitted.test)


_PAIRS = [(a, b) for i, a in enumerate(MODEL_FEATURES) for b in MODEL_FEATURES[i + 1 :]]


@register(
    "a14_a15_feature_correlations",
    FEATURES_SQL + ", c AS (" + "\nUNION ALL ".join(
        f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2, CASE WHEN stddev_pop("{a}") > 0 AND stddev_pop("{b}") > 0
        THEN round(covar_pop("{a}", "{b}") / (stddev_pop("{a}") * stddev_pop("{b}")), 6) END AS correlation FROM feats"""
        for a, b in _PAIRS
    ) + ") SELECT * FROM c WHERE abs(correlation) > 0.3",
)
def feature_correlations(spark, sf):
    table = features(spark, sf).select(*MODEL_FEATURES)
    clean = impute_means(table)
    return high_correlations(clean, 0.3, list(MODEL_FEATURES), complete=True).withColumn(
        "correlation", F.round("correlation", 6)
    )


@register("a14_diagnostics_of_models")
def diagnostics(spark, sf):
    _, folder = trained(spark, sf)
    table = spark.read.parquet(f"{folder}/training_features").drop("Timestamp", "Role", "Endpoint")
    report = diagnose(table)
    rows = [e.withColumn("model", F.lit(n)) for n, e in report.evaluations.items()]
    return rows[0].unionByName(rows[1])


@register(
    "flagship_risk_by_role",
    FEATURES_SQL + """SELECT "Role", count(*) AS n_logs, count(*) FILTER (is_authorized = 0) AS n_unauthorised,
  count(*) FILTER (is_unusual_time = 1) AS n_unusual_time, count(*) FILTER (is_internal_ip = 0) AS n_external,
  max(req_freq_5min) AS max_rate_5min FROM feats GROUP BY "Role" """,
)
def flagship(spark, sf):
    rated = add_request_rates(dense_log(spark, sf))
    return row_features(rated, default_rules()).groupBy("Role").agg(
        F.count(F.lit(1)).alias("n_logs"),
        F.count_if(F.col("is_authorized") == 0).alias("n_unauthorised"),
        F.count_if(F.col("is_unusual_time") == 1).alias("n_unusual_time"),
        F.count_if(F.col("is_internal_ip") == 0).alias("n_external"),
        F.max("req_freq_5min").alias("max_rate_5min"),
    )
