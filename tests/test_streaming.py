from datetime import datetime, timedelta

from pyspark.sql import functions as F

from accesswatch.operators.detect import failed_attempt_bursts
from accesswatch.operators.rolling import add_request_rates
from accesswatch.plans.scoring import archive_run, batch_with_history
from accesswatch.sources.files import split_unlabelled
from accesswatch.streaming import monitor, rates, score
from tests.conftest import log_rows

T0 = datetime(2024, 1, 1, 10, 0, 0)


def at(seconds):
    return str(T0 + timedelta(seconds=seconds))


def feed(spark, folder, batches):
    """A stream over one file per batch, in order."""
    for rows in batches:
        logs = split_unlabelled(log_rows(spark, rows))
        logs.coalesce(1).write.mode("append").parquet(folder)
    return monitor.read_stream(spark, folder, logs.schema, files_per_batch=1)


def finish(spark, stream, tmp_path):
    monitor.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_late_rows_are_dropped(spark, tmp_path):
    # Lateness is judged by the watermark of the batch before, so one batch passes after the jump to 14:00;
    # then the row of 10:00 is too late and that of 13:55 is not.
    hour = 3600
    batches = [
        [("a", 1, at(0))], [("b", 1, at(4 * hour))], [("c", 1, at(4 * hour + 1))],
        [("late", 1, at(10)), ("d", 1, at(4 * hour - 300))], [("e", 1, at(8 * hour))],
    ]
    hours = finish(spark, monitor.figures_per_hour(feed(spark, str(tmp_path / "in"), batches)), tmp_path)
    found = {(r.window_start.hour, r.n_logs) for r in hours.select(F.col("window_start"), "n_logs").collect()}
    assert found == {(10, 1), (13, 1), (14, 2)}


def test_copies_of_several_files_count_once(spark, tmp_path):
    batches = [[("a", 1, at(0)), ("a", 1, at(0))], [("a", 1, at(5)), ("b", 1, at(5))]]
    kept = finish(spark, monitor.first_copies(feed(spark, str(tmp_path / "in"), batches)), tmp_path)
    assert sorted(r.LogID for r in kept.collect()) == ["a", "b"]


def test_sessions_equal_the_batch_islands(spark, tmp_path):
    attempts = [(str(i), 1, at(10 * i), "DELETE", "/login/attempts/5") for i in range(4)]
    split = [(f"x{i}", 2, at(11 * i), "DELETE", "/login/attempts/6") for i in range(4)]
    end = [("end", 3, at(3600), "DELETE", "/login/attempts/7")]
    sessions = finish(spark, monitor.failed_attempt_sessions(feed(spark, str(tmp_path / "in"), [attempts[:2] + split, attempts[2:], end])), tmp_path)
    batch = failed_attempt_bursts(log_rows(spark, attempts + split + end))
    columns = ["UserID", "n_events", "started", "ended"]
    assert sorted(map(tuple, sessions.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect())) != []


def test_written_and_open_windows_are_all_windows(spark, tmp_path):
    """After each of two runs: the second goes on with what the first left open, and leaves the last open again."""
    user = [(f"{run}{i}", i % 2, at(7200 * run + 4 * (i // 2)), "DELETE", "/login/attempts/5") for run in (0, 1) for i in range(8)]
    figures = {
        "hours": (monitor.figures_per_hour, ["window_start"], (0, 1), (1, 1)),
        "rates": (monitor.sliding_request_rate, ["UserID", "window_start"], (0, 10), (10, 10)),
        "sessions": (monitor.failed_attempt_sessions, ["UserID", "started"], (0, 2), (2, 2)),
    }
    for name, (figure, keys, *counts) in figures.items():
        folder, out = str(tmp_path / f"{name}-in"), tmp_path / name
        for rows, count in zip((user[:8], user[8:]), counts, strict=True):
            written = finish(spark, figure(feed(spark, folder, [rows])), out)
            everything = figure(spark.read.parquet(folder))
            left = monitor.still_open(everything, written, keys)
            assert (written.count(), left.count()) == count, name
            assert sorted(map(tuple, written.unionByName(left).collect())) == sorted(map(tuple, everything.collect()))


def test_rates_go_on_across_batches(spark, tmp_path):
    rows = [(f"{i:03d}", i % 3, at(7 * i), "PUT", "/inventory/items/4000") for i in range(200)]
    cuts = [rows[:50], rows[50:51], rows[51:140], rows[140:]]
    stream = feed(spark, str(tmp_path / "in"), cuts)
    out = str(tmp_path / "out")
    score.rate_stream(stream, str(tmp_path / "archive"), out, str(tmp_path / "checkpoint")).awaitTermination()
    columns = ["LogID", "req_freq_5min", "inventory_change_rate"]
    streamed = spark.read.parquet(out)
    assert streamed.select("run_id").distinct().count() == 4
    expected = add_request_rates(log_rows(spark, rows))
    assert sorted(map(tuple, streamed.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))


def rated(spark, folder, run, rows):
    logs = split_unlabelled(log_rows(spark, rows))
    moved = archive_run(logs, f"{folder}/archive", run)
    near = batch_with_history(spark, f"{folder}/archive", moved, run, 600)
    return near


def test_an_early_row_reads_and_rescores_its_days_only(spark, tmp_path):
    """A batch with a row of 1990: neither days between nor other users' rows are read or scored again."""
    month = [(f"{d:02d}{i}", i % 3, str(T0 + timedelta(days=d, seconds=60 * i))) for d in range(30) for i in range(10)]
    assert rated(spark, tmp_path, "first", month).where("_own").count() == 300
    late = [("old", 1, "1990-01-01 00:00:00"), ("new", 1, str(T0 + timedelta(days=29, seconds=200)))]
    near = rated(spark, tmp_path, "late", late)
    plan = near._jdf.queryExecution().toString()
    assert plan.count("log_date=") <= 8 and "log_date=2024-01-05" not in plan
    own = {r.LogID for r in near.where("_own").collect()}
    # Of the last day, rows of user 1 after the late one: at 240 s and 420 s.
    assert own == {"old", "new", "294", "297"}
    assert {r.UserID for r in near.collect()} == {1}


def test_a_corrected_run_rescores_what_its_former_rows_decided(spark, tmp_path):
    rated(spark, tmp_path, "a", [("a1", 1, at(0)), ("a2", 2, at(0))])
    rated(spark, tmp_path, "b", [("b1", 1, at(60)), ("b2", 2, at(60))])
    near = rated(spark, tmp_path, "a", [("a2", 2, at(0))])
    assert {r.LogID for r in near.where("_own").collect()} == {"a2", "b1", "b2"}
    assert rated(spark, tmp_path, "none", [("x", 1, None)]) is None


def test_rates_from_state_are_revised_and_late_logs_refused(spark, tmp_path):
    """A log that comes after a later one revises it; one behind the watermark is refused and counted."""
    item = ("PUT", "/inventory/items/4000")
    batches = [
        [("b", 1, at(100), *item), ("n", None, at(0))], [("a", 1, at(0), *item), ("c", 1, at(700), *item), ("d", 1, at(701))],
        [("e", 1, at(86400))], [("f", 1, at(86401))], [("late", 1, at(5)), ("g", 1, at(86402))],
    ]
    stream = rates.revised_rates(feed(spark, str(tmp_path / "in"), batches), "1 hour")
    query = rates.run_rates(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.LogID, r.req_freq_5min) for r in written.where("LogID = 'b'").collect()) == [("b", 0), ("b", 1)]
    found = {r.LogID: (r.req_freq_5min, r.inventory_change_rate) for r in rates.latest_rates(written).collect()}
    assert found == {"a": (0, 0), "b": (1, 1), "c": (0, 1), "d": (1, 0), "e": (0, 0), "f": (1, 0), "g": (2, 0), "n": (0, 0)}
    assert rates.refused(query) == 1
    assert "memory" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass").lower()
