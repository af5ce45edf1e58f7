from datetime import date

import pytest
from pyspark.sql import functions as F

from accesswatch.sources import files
from accesswatch.sources.schemas import UNLABELLED_LOG
from accesswatch.sources.store import RunStore
from tests.conftest import log_rows

HEADER = "LogID,UserID,Role,Timestamp,HTTP_Method,Endpoint,IP_Address,HTTP_Response"


def test_log_csv_with_crlf_and_label(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_bytes(f"{HEADER},Anomalous\r\na,1,Nurse,2024-01-01 00:00:00,GET,/lab/tests/7,10.0.0.1,200,1\r\n".encode())
    log = files.read_log_csv(spark, str(path))
    assert dict(log.dtypes)["UserID"] == "bigint" and log.first().Anomalous == 1
    assert files.split_unlabelled(log).columns == HEADER.split(",")


def test_log_csv_without_required_column(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("LogID,Role\na,b\n")
    with pytest.raises(ValueError, match="IP_Address"):
        files.read_log_csv(spark, str(path))


def test_result_csvs_of_different_columns(spark, tmp_path):
    (tmp_path / "results_202401010000.csv").write_text("LogID,predicted_anomaly\na,1\n")
    (tmp_path / "results_202401010100.csv").write_text("LogID,anomaly_score,predicted_anomaly\nb,0.5,0\n")
    (tmp_path / "results_202401010200.csv").write_text("LogID,predicted_anomaly\nc,0\n")
    rows = files.read_result_csvs(spark, str(tmp_path)).collect()
    found = {(r.LogID, r.run_id, r.predicted_anomaly, r.anomaly_score) for r in rows}
    assert found == {("a", "202401010000", 1, None), ("b", "202401010100", 0, 0.5), ("c", "202401010200", 0, None)}


def test_absent_table_is_empty(spark, tmp_path):
    assert files.read_or_empty(spark, str(tmp_path / "no"), UNLABELLED_LOG).count() == 0


def test_a_repeated_run_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    first = log_rows(spark, [("a", 1, "2024-01-01 10:00:00"), ("b", 1, "2024-01-02 10:00:00")])
    second = log_rows(spark, [("c", 1, "2024-01-02 11:00:00")])
    for frame, run in [(first, "r1"), (second, "r2"), (first, "r1")]:
        files.write_run(frame, path, run)
    stored = spark.read.parquet(path)
    assert {(r.LogID, r.run_id) for r in stored.collect()} == {("a", "r1"), ("b", "r1"), ("c", "r2")} and stored.count() == 3
    one_day = files.read_runs(spark, path, date(2024, 1, 2), date(2024, 1, 5))
    assert {r.LogID for r in one_day.collect()} == {"b", "c"}
    long = files.read_runs(spark, path, date(2020, 1, 1), date(2024, 1, 1))
    assert {r.LogID for r in long.collect()} == {"a"}


def test_union_by_name_and_csv(spark, tmp_path):
    a, b = spark.range(1).withColumn("x", F.lit(1)), spark.range(1).withColumn("y", F.lit(2))
    files.write_csv(files.union_by_name([a, b]), str(tmp_path / "out"))
    back = files.read_table(spark, str(tmp_path / "out"), "csv")
    assert tuple(files.describe_table(back).first()) == (2, 3)


def test_log_csv_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADER}\na,1,Nurse,2024-01-01T00:00:00,GET,/lab,10.0.0.1,200\n")
    (tmp_path / "b.csv").write_text("Timestamp,Role,LogID,IP_Address,Endpoint,HTTP_Method,Note\n2024-01-02,Staff,007,10.0.0.2,\"/x,y\",PUT,n\n")
    rows = {r.LogID: r for r in files.read_log_csv(spark, str(tmp_path)).collect()}
    assert (rows["a"].Role, rows["007"].Role, rows["007"].Endpoint, rows["007"].UserID) == ("Nurse", "Staff", "/x,y", None)


def test_a_moved_and_an_empty_repeat(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = lambda day: log_rows(spark, [("a", 1, f"2024-01-0{day} 10:00:00")])
    files.write_run(rows(2), path, "r1")
    files.write_run(rows(3), path, "r2")
    files.write_run(rows(1), path, "r1")
    stored = lambda: {(r.run_id, str(r.log_date)) for r in spark.read.parquet(path).collect()}
    assert stored() == {("r1", "2024-01-01"), ("r2", "2024-01-03")}
    files.write_run(rows(3).where("false"), path, "r2")
    assert stored() == {("r1", "2024-01-01")}
    assert files.read_runs(spark, path, date(2023, 1, 1), date(2023, 2, 1)).count() == 0
    with pytest.raises(ValueError, match="run id"):
        files.write_run(rows(1), path, "../x")


def test_a_reader_sees_one_version(spark, tmp_path):
    """Killed after the rows, after the commit, and during the removal of the former rows."""
    path = str(tmp_path / "archive")
    store = RunStore(spark, path)
    rows = lambda *ids: log_rows(spark, [(i, 1, "2024-01-01 10:00:00") for i in ids])
    seen = lambda: sorted(r.LogID for r in RunStore(spark, path).read().collect())
    store.write(rows("a", "b"), "r1")

    class Killed(Exception):
        pass

    def die(*_):
        raise Killed

    for step, left in (("_commit", ["a", "b"]), ("_remove_replaced", ["c"])):
        dying = RunStore(spark, path)
        setattr(dying, step, die)
        with pytest.raises(Killed):
            dying.write(rows("c"), "r1")
        assert seen() == left
    # The next run clears what a dead writer left of replaced runs.
    store.write(rows("d"), "r2")
    assert seen() == ["c", "d"] and len(list((tmp_path / "archive").glob("attempt=*/log_date=*"))) == 3


def test_compaction_keeps_arrivals_and_reruns(spark, tmp_path):
    path = str(tmp_path / "archive")
    store = RunStore(spark, path)
    rows = lambda day, *ids: log_rows(spark, [(i, 1, f"2024-01-0{day} 10:00:00") for i in ids])
    seen = lambda: sorted((r.LogID, r.run_id, r.arrival) for r in RunStore(spark, path).read().collect())
    for n in range(4):
        assert store.write(rows(1 + n % 2, f"a{n}"), f"r{n}") == n + 1
    before = seen()
    store.compact()
    assert seen() == before == [(f"a{n}", f"r{n}", n + 1) for n in range(4)]
    files_now = [str(f) for f in (tmp_path / "archive").glob("attempt=*/log_date=*/*.parquet")]
    assert len(files_now) == 2 and len({f.split("log_date=")[1][:10] for f in files_now}) == 2
    # A run that comes again after the compaction replaces its rows in it, and so does a second compaction.
    store.write(rows(2, "new").withColumn("more", F.lit(1)), "r1")
    want = [("a0", "r0", 1), ("a2", "r2", 3), ("a3", "r3", 4), ("new", "r1", 6)]
    assert seen() == want and {r.LogID for r in store.read_run("r1").collect()} == {"new"}
    dying = RunStore(spark, path)
    dying._remove_replaced = lambda: None
    dying.compact()
    assert seen() == want and [r.LogID for r in store.read_run("r3").collect()] == ["a3"] and store.read_run("r9") is None
    store.compact()
    assert seen() == want and len(list((tmp_path / "archive").glob("attempt=*"))) == 1
    assert "more" in store.read().columns
    assert {r.LogID for r in store.read(days=["2024-01-01"]).collect()} == {"a0", "a2"}


def test_numbers_are_never_taken_twice(spark, tmp_path):
    stores = [RunStore(spark, str(tmp_path / "s")) for _ in range(3)]
    numbers = [stores[i % 3]._next() for i in range(9)]
    assert len(set(numbers)) == 9 and numbers == sorted(numbers)
    # A writer that has listed before the others went on.
    late = stores[0]
    listed, calls = late._names, []

    def names(*parts):
        calls.append(parts)
        return ["000000000002"] if len(calls) == 1 else listed(*parts)

    late._names = names
    assert late._next() > max(numbers)


def test_an_empty_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "none"))
    assert not store.exists() and store.read(UNLABELLED_LOG).count() == 0 and store.read_run("x") is None
    store.write(log_rows(spark, [("a", 1, "2024-01-01 10:00:00")]).where("false"), "r")
    assert store.exists() and store.read(UNLABELLED_LOG).count() == 0
