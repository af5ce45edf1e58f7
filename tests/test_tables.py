"""Rules, encoders, quality, reports and metrics on small hand-made tables."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from accesswatch.operators import authz, encoders, metrics, ordered, quality, report, scoring, stats
from accesswatch.plans.reporting import load_report_base, report_tables
from accesswatch.sources import rules
from accesswatch.sources.schemas import (
    feature_names, id_and_time_first, normalise_names, numeric_names, other_names, require_columns, with_defaults,
)
from tests.conftest import log_rows


def test_rule_document(spark, tmp_path):
    document = rules.default_rules()
    assert rules.role_rules(spark, document).count() == 84
    assert rules.authorization_rules(spark, document).count() == 54
    assert rules.role_users(spark, document).count() == 70
    assert rules.endpoint_parameters(spark, document).where("export").count() == 4
    with pytest.raises(ValueError, match="ROLES"):
        rules.validate_rules({k: v for k, v in document.items() if k != "ROLES"})
    import json

    path = tmp_path / "rules.json"
    path.write_text(json.dumps({k: v for k, v in document.items() if k != "FEATURE_ENGINEERING"}, indent=1))
    loaded = rules.load_rules(spark, str(path))
    assert loaded["FEATURE_ENGINEERING"]["unusual_hours"] == {"start": 21, "end": 6}
    assert rules.role_rules(spark, loaded).count() == 84


def test_authorization(spark):
    logs = log_rows(
        spark,
        [
            ("prefix", 1, None, "GET", "/patient/appointments/confirm", "", 200, "Doctor"),
            ("covered", 1, None, "DELETE", "/patient/records/1?x=1", "", 200, "Nurse"),
            ("text", 1, None, "GET", "/patient/recordsx", "", 200, "Doctor"),
            ("empty", 1, None, "GET", "", "", 200, "Doctor"),
            ("role", 1, None, "DELETE", "/patient/records/1", "", 200, "Staff"),
            ("unknown", 1, None, "DELETE", "/patient/records/1", "", 200, None),
        ],
    )
    table = rules.authorization_rules(spark, rules.default_rules())
    by_text = {r.LogID: r.is_authorized for r in authz.with_authorization(logs, table).collect()}
    assert by_text == {"prefix": 0, "covered": 0, "text": 0, "empty": 0, "role": 1, "unknown": 1}
    by_segment = {r.LogID: r.is_authorized for r in authz.with_authorization(logs, table, "segment").collect()}
    assert by_segment["text"] == 1 and by_segment["covered"] == 0 and by_segment["prefix"] == 0
    assert {r.LogID for r in authz.unauthorised(logs, table).collect()} == {"prefix", "covered", "text", "empty"}


def test_label_codes(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "x string")
    score = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    codes = encoders.fit_label_codes(train, "x")
    assert {r.x: r.c for r in codes.apply(score, "x", "c").collect()} == {"a": 0, "z": 2, None: 2}
    with pytest.raises(PySparkException, match="without a code"):
        codes.apply(score, "x", "c", unseen="error").collect()
    known = encoders.fit_label_codes(train.union(spark.createDataFrame([("unknown",), ("y",)], "x string")), "x")
    assert {r.x: r.c for r in known.apply(score, "x", "c").collect()} == {"a": 0, "z": 2, None: 2}
    assert known.n_classes == 4


def test_many_label_codes(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("x"))
    codes = encoders.fit_label_codes(df, "x")
    expected = {v: i for i, v in enumerate(sorted(str(n) for n in range(3000)))}
    assert {r.x: r.c for r in codes.apply(df, "x", "c").collect()} == expected


def test_ordered_running(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(1).alias("one"), F.col("id").alias("v"))
    rows = ordered.ordered_running(df, "k", {"n": "one", "s": "v"}, descending=True).collect()
    running = 0
    for position, row in enumerate(sorted(rows, key=lambda r: -r.k), start=1):
        running += row.v
        assert (row.n, row.s, row.total_n) == (position, running, 1000)


def test_one_hot_and_target_means(spark):
    df = spark.createDataFrame([("GET", 1), ("PUT", 0), (None, 0), ("GET", 0)], "m string, y int")
    cats = encoders.one_hot_categories(df, "m")
    assert cats == ["GET", "PUT"]
    assert [tuple(r) for r in encoders.one_hot(df, "m", cats).collect()][2] == (0, 0.0, 0.0)
    means = encoders.target_means(df, "m", "y", "risk")
    unseen = spark.createDataFrame([("GET",), ("HEAD",)], "m string")
    out = encoders.apply_target_means(unseen, means, "m", "risk", F.lit(0.25)).collect()
    assert {r.m: r.risk for r in out} == {"GET": 0.5, "HEAD": 0.25}


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted(map(tuple, encoders.fit_scaler(df, ["a", "b"]).apply(df).collect())) == [(-1.0, 0.0), (1.0, 0.0)]


def test_numeric_cleaning(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 4, nan, None), (nan, None, inf, None), (inf, 8, 2.0, None), (None, 6, 4.0, None)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double")
    assert tuple(quality.missing_and_infinite(df).first()) == (8, 2)
    clean = [tuple(r) for r in quality.impute_means(df).collect()]
    assert clean == [(1.0, 4.0, 3.0, None), (1.0, 6.0, 3.0, None), (1.0, 8.0, 2.0, None), (1.0, 6.0, 4.0, None)]
    assert numeric_names(df) == ["a", "b", "c", "d"] and other_names(df.withColumn("t", F.lit("x"))) == ["t"]


def test_correlation_of_constant_and_missing(spark):
    rows = [(1.0, 2.0, 1.0, None), (2.0, 4.0, 1.0, 1.0), (3.0, 7.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    found = {(r.feature_1, r.feature_2): r.correlation for r in stats.correlation_matrix(df).collect()}
    assert len(found) == 16 and found["a", "c"] is None and found["c", "c"] is None
    assert math.isclose(found["a", "a"], 1.0) and math.isclose(found["b", "a"], 0.9933992677987828)
    assert math.isclose(found["a", "d"], 1.0)
    assert {(r.feature_1, r.feature_2) for r in stats.high_correlations(df, 0.6).collect()} == {("a", "b"), ("a", "d"), ("b", "d")}


def test_chain_consistency(spark):
    rows = [
        ("a1", "1.1.1.1", "/patient/records/5?x=1"), ("a1", "1.1.1.1", "/inventory/items/5"), ("a1", "1.1.1.1", "/lab/results/9"),
        ("a2", "1.1.1.1", "/patient/records/5"), ("a2", "1.1.1.2", "/patient/records/6"), ("a3", "1.1.1.1", "/lab/tests/1"),
    ]
    df = spark.createDataFrame(rows, "chain string, IP_Address string, Endpoint string")
    out = {r.chain: (r.n_logs, r.same_ip, r.same_id) for r in quality.chain_consistency(df, "chain").collect()}
    assert out == {"a1": (3, True, True), "a2": (2, False, False), "a3": (1, True, True)}


SCORES = "LogID string, Timestamp timestamp, Role string, Endpoint string, predicted_anomaly int, anomaly_score double, run_id string"


def test_keep_last_and_join(spark):
    runs = spark.createDataFrame(
        [("a", None, "R1", None, 1, 0.9, "1"), ("a", None, "R3", "/x", 0, 0.1, "3"), ("a", None, "R2", None, 1, 0.8, "2"),
         ("gone", None, "R", None, 1, 1.0, "1")], SCORES,
    )
    last = report.keep_last(runs)
    assert {(r.LogID, r.run_id, r.Role) for r in last.collect()} == {("a", "3", "R3"), ("gone", "1", "R")}
    archive = spark.createDataFrame([("a", None, "8.8.8.8"), ("b", "Nurse", "10.0.0.1")], "LogID string, Role string, IP_Address string")
    merged = {r.LogID: r for r in report.join_scores(archive, last.drop("run_id"), keep_unscored_flag=True).collect()}
    assert (merged["a"].Role, merged["a"].Endpoint, merged["a"].anomaly_score, merged["a"].is_scored) == ("R3", "/x", 0.1, True)
    assert (merged["b"].Role, merged["b"].predicted_anomaly, merged["b"].anomaly_score, merged["b"].is_scored) == ("Nurse", 0, 0.0, False)
    assert [r.LogID for r in report.unscored(archive, last).collect()] == ["b"]


def test_report_of_empty_stores(spark, tmp_path):
    base = load_report_base(spark, str(tmp_path / "none"), str(tmp_path / "neither"))
    tables = report_tables(base)
    head = tables["headline"].first()
    assert (head.total_logs, head.anomaly_ratio, head.any_anomaly, head.over_threshold) == (0, 0.0, False, False)
    assert all(t.count() == 0 for n, t in tables.items() if n != "headline")


def test_thresholds(spark):
    df = spark.createDataFrame([(i, int(i < 10)) for i in range(400)], "i int, predicted_anomaly int").withColumns(
        {"is_internal_ip": F.lit(True), "is_unusual_hour": F.lit(False)}
    )
    head = report.headline(df).first()
    assert head.any_anomaly and not head.over_threshold
    assert report.headline(df, count_threshold=9).first().over_threshold


def test_override_needs_the_exact_endpoint(spark):
    rows = [("Doctor", "/patient/appointments/confirm"), ("Nurse", "/patient/appointments/cancel?x"), ("Staff", "/patient/appointments/cancel"), (None, None)]
    df = spark.createDataFrame([r + (1, 0.8) for r in rows], "Role string, Endpoint string, predicted_anomaly int, anomaly_score double")
    out = [(r.predicted_anomaly, r.anomaly_score) for r in scoring.apply_override(df).collect()]
    assert out == [(0, 0.0), (1, 0.8), (1, 0.8), (1, 0.8)]


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (0, 0, 0.5), (1, 0, 0.5)], "y int, p int, s double")
    row = metrics.binary_metrics(df, "y", "p").first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0) and math.isclose(row.accuracy, 1 / 3)
    assert metrics.roc_auc(df, "y", "s").first().auc == 0.5
    one_class = df.where("y = 1")
    assert metrics.roc_auc(one_class, "y", "s").first().auc is None
    assert metrics.confusion_matrix(df, "y", "p").where("label = 1").first().predicted_0 == 2
    assert metrics.binary_metrics(df.limit(0), "y", "p").first().accuracy == 0.0


def test_published_class_report(spark):
    # Cells that give the published figures of the logistic model: 15 930 and 4 084 rows.
    cells = [(0, 0, 15785), (0, 1, 145), (1, 0, 123), (1, 1, 3961)]
    df = spark.createDataFrame(cells, "y int, p int, n int").select("y", "p", F.explode(F.sequence(F.lit(1), F.col("n"))))
    lines = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in metrics.class_report(df, "y", "p").collect()}
    assert lines["0"] == (0.99, 0.99, 0.99, 15930) and lines["1"] == (0.96, 0.97, 0.97, 4084)
    assert lines["macro avg"][2] == 0.98 and lines["weighted avg"][2] == 0.99 and lines["accuracy"][0] == 0.99


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "` a b ` int, LogID int").withColumn("Timestamp", F.lit(None))
    tidy = normalise_names(df)
    assert tidy.columns == ["a_b", "LogID", "Timestamp"]
    assert id_and_time_first(tidy).columns == ["LogID", "Timestamp", "a_b"]
    assert with_defaults(tidy, ["a_b", "z"]).first().z == 0 and feature_names(tidy) == ["a_b"]
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(tidy, ["q"])
