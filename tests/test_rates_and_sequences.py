import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from accesswatch.operators import detect
from accesswatch.operators.levels import totals_before
from accesswatch.operators.rolling import (
    TrailingCount, add_request_rates, instant_counts, request_rate_specs, trailing_counts, trailing_counts_window,
)
from accesswatch.operators.sequences import islands, operation_patterns, sequence_runs
from accesswatch.sources.rules import default_rules
from tests.conftest import log_rows

T0 = datetime(2024, 1, 1, 10, 0, 0)


def at(seconds):
    return str(T0 + timedelta(seconds=seconds))


@pytest.mark.parametrize("strategy", ["instants", "window"])
def test_ties_and_bounds(spark, strategy):
    rows = [("a", 1, at(0)), ("b", 1, at(0)), ("c", 1, at(0)), ("d", 1, at(300)), ("e", 1, at(300.000001)), ("f", 2, at(300))]
    out = {r.LogID: r.req_freq_5min for r in add_request_rates(log_rows(spark, rows), strategy).collect()}
    # Rows of one instant do not count each other; exactly five minutes earlier still counts.
    assert out == {"a": 0, "b": 0, "c": 0, "d": 3, "e": 1, "f": 0}


@pytest.mark.parametrize("strategy", ["instants", "window"])
def test_inventory_rate(spark, strategy):
    item, other = "/inventory/items/4000", "/patient/records/1"
    rows = [("a", 1, at(0), "PUT", item), ("b", 1, at(10), "GET", other), ("c", 1, at(600), "PUT", item),
            ("d", 1, at(600.000001), "GET", item)]
    out = {r.LogID: r.inventory_change_rate for r in add_request_rates(log_rows(spark, rows), strategy).collect()}
    assert out == {"a": 0, "b": 0, "c": 1, "d": 1}


def random_logs(spark, n, seed, span, users=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        # One user holds a third of the rows, and a third of those share an instant.
        user = 1 if draw.random() < 0.34 else draw.randint(2, users)
        second = 77 if user == 1 and draw.random() < 0.34 else draw.randint(0, span)
        endpoint = draw.choice(["/inventory/items/4000", "/inventory/items/4001", "/lab/results/7"])
        rows.append((f"{i:05d}", user, at(second), draw.choice(["PUT", "DELETE", "GET"]), endpoint))
    rows.append(("no-user", None, at(5)))
    rows.append(("no-time", 1, None))
    return log_rows(spark, rows)


@pytest.mark.parametrize("bucket", [600, 3600])
def test_both_forms_agree_and_keep_every_row(spark, bucket):
    logs = random_logs(spark, 1500, bucket, 7200)
    specs = request_rate_specs()
    columns = ["LogID", "req_freq_5min", "inventory_change_rate"]
    a = sorted(map(tuple, trailing_counts(logs, ["UserID"], "Timestamp", specs, bucket).select(columns).collect()))
    b = sorted(map(tuple, trailing_counts_window(logs, ["UserID"], "Timestamp", specs).select(columns).collect()))
    assert a == b and len(a) == 1502 and max(r[1] for r in a) > 50


def test_window_equal_to_bucket(spark):
    logs = random_logs(spark, 400, 3, 300)
    specs = [TrailingCount("n", 7)]
    a = sorted((r.LogID, r.n) for r in trailing_counts(logs, ["UserID"], "Timestamp", specs, 7).collect())
    b = sorted((r.LogID, r.n) for r in trailing_counts_window(logs, ["UserID"], "Timestamp", specs).collect())
    assert a == b


def brute_runs(rows, gap):
    """rows: sorted (t, op). Runs as (op, size, first, last, next start)."""
    runs = []
    for t, op in rows:
        if runs and runs[-1][0] == op and (gap is None or t - runs[-1][3] <= gap):
            runs[-1][1] += 1
            runs[-1][3] = t
        else:
            if runs:
                runs[-1][4] = t
            runs.append([op, 1, t, t, None])
    return sorted(map(tuple, runs), key=str)


@pytest.mark.parametrize("gap", [None, 4])
@pytest.mark.parametrize("bucket", [3, 20, 100000])
def test_runs_equal_brute_force_across_bucket_borders(spark, gap, bucket):
    draw = random.Random(bucket)
    rows = [(draw.randint(1, 3), draw.randint(0, 400), draw.choice("PD")) for _ in range(500)]
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=s), o) for k, s, o in rows], "k int, ts timestamp, op string")
    runs = sequence_runs(df, ["k"], "ts", "op", gap, bucket).withColumns(
        {c: F.unix_seconds(c) for c in ("started", "ended", "closed")}
    )
    base = runs.agg(F.min("started")).first()[0] - min(s for _, s, _ in rows)
    for k in (1, 2, 3):
        ours = sorted(
            ((r.op, r.n_events, r.started - base, r.ended - base, None if r.closed is None else r.closed - base)
             for r in runs.where(F.col("k") == k).collect()), key=str,
        )
        assert ours == brute_runs(sorted((s, o) for q, s, o in rows if q == k), gap)


@pytest.mark.parametrize("bucket", [15, 100000])
def test_islands(spark, bucket):
    seconds = [0, 10, 20, 31, 40, 50, 50, 100]
    df = spark.createDataFrame([(1, T0 + timedelta(seconds=s)) for s in seconds], "k int, ts timestamp")
    found = islands(df, ["k"], "ts", 10, 3, bucket).select("n_events", F.unix_seconds("ended") - F.unix_seconds("started"))
    assert sorted(map(tuple, found.collect())) == [(3, 20), (4, 19)]


@pytest.mark.parametrize("bucket", [20, 100000])
def test_patterns_equal_brute_force(spark, bucket):
    draw = random.Random(11)
    rows = [(f"{i:04d}", draw.randint(1, 2), draw.randint(0, 900), draw.choice(["PUT", "DELETE"])) for i in range(400)]
    df = spark.createDataFrame([(i, k, T0 + timedelta(seconds=s), m) for i, k, s, m in rows], "LogID string, k int, ts timestamp, m string")
    found = operation_patterns(df, ["k"], "ts", "m", ("PUT", "DELETE", "PUT"), 20, bucket_seconds=bucket)
    ours = sorted((r.event_1, r.event_2, r.event_3) for r in found.collect())
    expected = []
    for k in (1, 2):
        line = sorted((s, m, i) for i, q, s, m in rows if q == k)
        for a, b, c in zip(line, line[1:], line[2:]):
            if (a[1], b[1], c[1]) == ("PUT", "DELETE", "PUT") and c[0] - a[0] <= 20:
                expected.append((a[2], b[2], c[2]))
    assert ours == sorted(expected) and expected


def test_injection_chain_needs_address_id_and_time(spark):
    attack = "/patient/records/1234?export=true&limit=1000&query=' OR 1=1 --"
    read = "/billing/invoices/1234?export=true&limit=500"
    rows = [
        ("attack", 1, at(0), "GET", attack, "9.9.9.9", 500),
        ("hit", 1, at(300), "GET", read, "9.9.9.9", 200),
        ("late", 1, at(300.000001), "GET", read, "9.9.9.9", 200),
        ("other-ip", 1, at(60), "GET", read, "9.9.9.8", 200),
        ("other-id", 1, at(60), "GET", read.replace("1234", "1235"), "9.9.9.9", 200),
        ("other-user", 2, at(60), "GET", read, "9.9.9.9", 200),
        ("before", 1, at(-1), "GET", read, "9.9.9.9", 200),
    ]
    logs = log_rows(spark, rows)
    found = detect.injection_chains(logs, default_rules()).collect()
    assert [(r.LogID, r.n_injections) for r in found] == [("hit", 1)]
    refused = logs.withColumn("HTTP_Response", F.lit(200))
    assert detect.injection_chains(refused, default_rules()).count() == 0


def test_rapid_changes_need_one_address(spark):
    item = "/inventory/items/4000"
    rows = [("a", 1, at(0), "PUT", item), ("b", 1, at(10), "DELETE", item), ("c", 1, at(20), "PUT", item)]
    assert detect.rapid_inventory_changes(log_rows(spark, rows)).count() == 1
    moved = [rows[0], rows[1] + ("10.0.0.9",), rows[2]]
    assert detect.rapid_inventory_changes(log_rows(spark, moved)).count() == 0
    assert detect.rapid_inventory_changes(log_rows(spark, moved), same_ip=False).count() == 1


def test_failed_attempts(spark):
    rows = [(str(i), 1, at(10 * i), "DELETE", "/login/attempts/5") for i in range(3)] + [("x", 1, at(31), "DELETE", "/login/attempts/5")]
    assert [r.n_events for r in detect.failed_attempt_bursts(log_rows(spark, rows)).collect()] == [3]


@pytest.fixture()
def one_user_one_hour(spark):
    """All rows of one user, at 3000 instants of one hour, over 16 shuffle partitions that stay apart."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    rows = [(f"{i:05d}", 1, at(i * 1.2 + 1e-6 * (i % 7)), "PD"[(i // 5) % 2]) for i in range(3000)]
    yield spark.createDataFrame(rows, "LogID string, UserID bigint, ts string, op string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k, v in before.items():
        spark.conf.set(k, v)


def share_of_the_largest_task(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_rates_of_one_user_and_hour_spread(one_user_one_hour):
    counts = instant_counts(one_user_one_hour, ["UserID"], "ts", [TrailingCount("n", 300)])
    assert counts.count() == 2999 and share_of_the_largest_task(counts) < 0.25
    full = trailing_counts(one_user_one_hour, ["UserID"], "ts", [TrailingCount("n", 300)])
    frame = trailing_counts_window(one_user_one_hour, ["UserID"], "ts", [TrailingCount("n", 300)])
    assert sorted((r.LogID, r.n) for r in full.collect()) == sorted((r.LogID, r.n) for r in frame.collect())


def test_runs_of_one_user_and_hour_spread(one_user_one_hour):
    """Runs shorter than a small bucket: all but the two at its ends are done there."""
    runs = sequence_runs(one_user_one_hour, ["UserID"], "ts", "op", bucket_seconds=120)
    assert share_of_the_largest_task(runs) < 0.35
    assert sorted({r.n_events for r in runs.collect()}) == [5] and runs.count() == 600


def test_one_run_over_days(spark):
    """A run over many large buckets, with an hour's pause in it, is one; a longer pause cuts it."""
    seconds = [i * 3600 for i in range(60)] + [59 * 3600 + 3601]
    df = spark.createDataFrame([(1, T0 + timedelta(seconds=s)) for s in seconds], "k int, ts timestamp")
    runs = sequence_runs(df, ["k"], "ts", None, 3600)
    found = sorted((r.n_events, (r.ended - r.started).total_seconds(), r.closed) for r in runs.collect())
    assert found[0] == (1, 0.0, None) and found[1][:2] == (60, 59 * 3600.0) and found[1][2] is not None


@pytest.mark.parametrize("buckets", [(0.5, 3), (2, 40), (1000, 100000)])
def test_totals_before_in_levels(spark, buckets):
    draw = random.Random(8)
    rows = [(draw.randint(1, 2), draw.randint(-50, 200) * 500_000, draw.randint(0, 1), draw.randint(-3, 5)) for _ in range(300)]
    rows = sorted({r[:3]: r for r in rows}.values())
    edges = spark.createDataFrame(rows, "k int, at bigint, o int, d bigint").withColumn("own", F.col("d"))
    got = {(r.k, r.at, r.o): r.d for r in totals_before(edges, ["k"], ["d"], *buckets).collect()}
    assert got == {(k, t, o): sum(d for q, u, p, d in rows if q == k and (u, p) < (t, o)) for k, t, o, _ in rows}
