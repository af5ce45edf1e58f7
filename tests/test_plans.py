"""Shapes of physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from accesswatch.operators import report, rolling
from accesswatch.plans import reporting
from accesswatch.plans.features import row_features
from accesswatch.sources import files
from accesswatch.sources.current import BucketedRows
from accesswatch.sources.rules import default_rules
from accesswatch.sources.store import RunStore
from checks import clog  # noqa: F401 - the log view
from checks.registry import QUERIES
import __spark_entry__  # noqa: F401 - registers queries

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups")
LAZY = [n for n in sorted(QUERIES) if n[0] not in "mv" and not n.startswith(("t5", "a14_diag"))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_and_no_python_workers(spark, sf_small, name):
    text = plan(QUERIES[name](spark, sf_small))
    assert [w for w in FORBIDDEN if w in text] == []


@pytest.fixture(scope="module")
def stored_log(spark, sf_small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log")
    clog.clog(spark, sf_small).select(*clog.LOG_COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


def test_row_features_need_no_shuffle_of_the_log(stored_log):
    text = plan(row_features(stored_log, default_rules()))
    assert "hashpartitioning" not in text and "ExistenceJoin" in text


def test_scans_read_only_the_columns_used(stored_log):
    text = plan(rolling.instant_counts(stored_log, ["UserID"], "Timestamp", [rolling.TrailingCount("n", 300)]))
    assert "ReadSchema: struct<UserID:bigint,Timestamp:timestamp>" in text


def test_filters_reach_the_files(stored_log):
    text = plan(report.with_report_columns(stored_log.where("HTTP_Response >= 400")).select("is_unusual_hour"))
    assert "GreaterThanOrEqual(HTTP_Response,400)" in text
    assert "Endpoint" not in text


def test_latest_row_combines_before_the_shuffle(spark):
    rows = spark.range(9).selectExpr("cast(id as string) LogID", "id arrival", "'x' v")
    text = plan(report.keep_last(rows, order="arrival"))
    assert "partial_max" in text and "Window" not in text and "SortAggregate" not in text
    text = plan(report.keep_last(rows.withColumn("run_id", F.lit("1"))))
    assert "partial_max" in text and "SortAggregate" not in text


def test_bucketed_report_shuffles_no_rows(spark, sf_small, tmp_path):
    """Latest rows of two parts and the join: no exchange by a key, nothing sorted to be grouped."""
    log, paths = clog.clog(spark, sf_small), [str(tmp_path / x) for x in "arb"]
    files.write_run(files.split_unlabelled(log), paths[0], "1")
    for run, rows in (("1", clog.run_a(log)), ("2", clog.run_b(log)), ("1", clog.run_a(log))):
        files.write_run(rows.drop("run_id"), paths[1], run)
        base = reporting.bucketed_report_base(spark, *paths, buckets=4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(reporting.bucketed_report_base(spark, *paths, buckets=4))
        assert "hashpartitioning" not in text and "SortAggregate" not in text and "SortMergeJoin" in text
        results = BucketedRows(spark, f"{paths[2]}/results", reporting.SCORED_LOG, buckets=4)
        before = sorted(map(tuple, base.collect()), key=str)
        store = RunStore(spark, paths[1])
        results.fold(store)
        assert len(list((tmp_path / "b" / "results").glob("part=*"))) == 1 and results.refresh(store) == []
        assert sorted(map(tuple, reporting.bucketed_report_base(spark, *paths, buckets=4).collect()), key=str) == before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_latest_row_of_null_keys(spark):
    rows = [(None, 1, "a"), (None, 2, "b"), ("x", 2, "c"), ("x", 2, "c"), ("x", None, "d"), ("y", None, "e")]
    last = report.keep_last(spark.createDataFrame(rows, "LogID string, arrival long, v string"), order="arrival")
    assert sorted(map(tuple, last.collect()), key=str) == [("x", 2, "c"), ("y", None, "e"), (None, 2, "b")]


@pytest.mark.parametrize("name", ["w3_keep_last_run", "w3_latest_event_per_user", "j1_f10_report_base", "a11_chain_consistency", "d22_first_seen_addresses"])
def test_groups_are_hashed_not_sorted(spark, sf_small, name):
    found = [n for n in QUERIES if n.startswith(name[:4]) and n.startswith(name[:8])]
    for n in found:
        assert "SortAggregate" not in plan(QUERIES[n](spark, sf_small)), n
    assert found


def test_features_of_two_models_are_made_once(spark, tmp_path):
    """Fits and predictions read written features; the rates' shuffles ran once, to write them."""
    from checks.store_queries import _deleting

    events = spark.range(400).selectExpr(
        "id AS event_id", "timestamp_micros(1704067200000000 + id * 7000000) AS ts", "id % 9 AS user_id",
        "element_at(array('error', 'view', 'click', 'purchase', 'signup'), cast(id % 5 + 1 AS int)) AS event_type",
        "cast(id % 100 AS double) AS value", "concat('{\"k\": ', id % 90, '}') AS props",
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    _, rows, _ = _deleting(spark, str(tmp_path))
    again = _deleting(spark, str(tmp_path), 0.1)[1]
    assert again is rows and rows.count() == 400
    assert "Exchange" not in plan(rows) and "FileScan parquet" in plan(rows)
