"""New batch of logs to archived logs and scored results."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesswatch.operators.model import predict
from accesswatch.operators.rolling import MICROS, TrailingCount, request_rate_specs
from accesswatch.operators.scoring import apply_override
from accesswatch.plans.features import FeatureEncoders, build_features, valid_rows
from accesswatch.session import checkpoint_dir
from accesswatch.sources.files import split_unlabelled, write_run
from accesswatch.sources.store import RunStore


def score_log(
    log: DataFrame, rules: dict, encoders: FeatureEncoders, model: PipelineModel, unseen_role: str = "error"
) -> DataFrame:
    """Features, prediction and analyst override in one plan."""
    return apply_override(predict(model, build_features(log, rules, encoders, unseen_role=unseen_role)))


def longest_window(specs: list[TrailingCount] | None = None) -> int:
    """Seconds of history that rates look back on."""
    return max(s.seconds for s in specs or request_rate_specs())


def _touched(rows: DataFrame, window: int) -> DataFrame:
    """(user, bucket of a window's length): where rows stand, look back to, or are looked back on from. Rows of the bucket
    after ``_since`` may look back on one of them."""
    t = F.unix_micros("Timestamp")
    near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("_i")
    steps = rows.select(F.col("UserID").alias("_u"), t.alias("_t"), F.floor(t / F.lit(window)).cast("bigint").alias("_w"), near)
    return steps.groupBy("_u", (F.col("_w") + F.col("_i")).alias("_w")).agg(
        F.min(F.when(F.col("_i") >= 0, F.col("_t"))).alias("_since")
    )


def archive_run(batch: DataFrame, archive_path: str, run_id: str) -> DataFrame:
    """Archive a batch; what decides figures of others now: its rows and, of a run that comes again, those it had before."""
    store = RunStore(batch.sparkSession, archive_path)
    moved, former = batch.select("UserID", "Timestamp"), store.read_run(run_id)
    if former is not None:
        moved = moved.unionByName(former.select("UserID", "Timestamp"))
    checkpoint_dir(batch.sparkSession)
    moved = moved.distinct().checkpoint()
    store.write(split_unlabelled(batch), run_id)
    return moved


def batch_with_history(
    spark: SparkSession, archive_path: str, moved: DataFrame, run_id: str, history_seconds: int
) -> DataFrame | None:
    """Rows whose figures an archived batch decides, marked by ``_own``, and the archived rows these look back on.

    Besides the batch these are archived rows of its users up to ``history_seconds`` after one of its rows: what came out of
    order is counted by rows that came before it. Users and times are met in buckets of that length, so a row of years ago
    costs the days around it and nothing between. ``moved`` is what ``archive_run`` gives. None if that is empty. ``spark``
    plans what follows: inside a stream give the outer session, since the stream's own has adaptive execution switched off.
    """
    window = history_seconds * MICROS
    at = [F.to_date(F.timestamp_micros(F.unix_micros("Timestamp") + i * 2 * window)).cast("string") for i in (-1, 0, 1)]
    days = [r[0] for r in moved.select(F.explode(F.array(*at))).distinct().collect() if r[0]]
    if not days:
        return None
    archive = RunStore(spark, archive_path).read(days=days)
    bucket = F.floor(F.unix_micros("Timestamp") / F.lit(window)).cast("bigint")
    touched = _touched(moved, window)
    on = F.col("UserID").eqNullSafe(F.col("_u")) & (bucket == F.col("_w"))
    after = F.coalesce(F.unix_micros("Timestamp") > F.col("_since"), F.lit(False))
    near = archive.join(touched, on).withColumn("_own", after | (F.col("run_id") == run_id))
    return near.drop("_u", "_w", "_since", "run_id", "log_date", "arrival")


def score_batch(
    log: DataFrame, rules: dict, encoders: FeatureEncoders, model: PipelineModel, archive_path: str,
    results_path: str, run_id: str, history_seconds: int | None = None, unseen_role: str = "error",
    session: SparkSession | None = None,
) -> None:
    """Archive a batch and write its results, both once per ``run_id``.

    Rates count the archived logs of the window before, as if the log had never been cut into batches. Archived logs
    that the batch precedes are scored anew under this run. Runs may come in any order and again: the row that arrived
    last is right, whatever the names of the runs. ``history_seconds`` is the longest window of the rates by default.
    """
    history_seconds = longest_window() if history_seconds is None else history_seconds
    moved = archive_run(valid_rows(log), archive_path, run_id)
    near = batch_with_history(session or log.sparkSession, archive_path, moved, run_id, history_seconds)
    if near is None:
        return
    features = build_features(near, rules, encoders, unseen_role=unseen_role).where("_own").drop("_own")
    write_run(apply_override(predict(model, features)), results_path, run_id)
