"""Exact rates, chains and scores for micro-batches.

Each batch is archived under a run id made from its number, then computed
together with the archived logs of the window before it. Archived logs that a
later batch precedes are computed anew and written under that batch's run, so
the row of the latest run is right in whatever order logs arrive. State is the
archive itself: no Python workers, nothing kept per key, and a repeated batch
replaces what it wrote.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from accesswatch.operators.detect import injection_chains
from accesswatch.operators.rolling import add_request_rates
from accesswatch.plans.features import FeatureEncoders, valid_rows
from accesswatch.plans.scoring import archive_run, batch_with_history, longest_window, score_batch
from accesswatch.sources.files import write_run


def run_id(stream_name: str, batch_no: int) -> str:
    return f"{stream_name}-{batch_no:012d}"


def _start(logs: DataFrame, on_batch, checkpoint: str, trigger: dict | None):
    def read_once(batch: DataFrame, number: int) -> None:
        # A batch is archived and measured; keeping it spares a second read of the source.
        batch.persist()
        try:
            on_batch(batch, number)
        finally:
            batch.unpersist()

    return (
        logs.writeStream.foreachBatch(read_once)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _with_history(logs: DataFrame, compute, seconds: int, archive: str, output: str, checkpoint: str, name: str, trigger):
    def on_batch(batch: DataFrame, number: int) -> None:
        run = run_id(name, number)
        moved = archive_run(valid_rows(batch), archive, run)
        near = batch_with_history(logs.sparkSession, archive, moved, run, seconds)
        if near is not None:
            write_run(compute(near).where("_own").drop("_own"), output, run)

    return _start(logs, on_batch, checkpoint, trigger)


def rate_stream(logs, archive: str, output: str, checkpoint: str, name: str = "rates", trigger: dict | None = None):
    """Request rates that do not restart with each batch."""
    return _with_history(logs, add_request_rates, longest_window(), archive, output, checkpoint, name, trigger)


def chain_stream(
    logs, rules: dict, archive: str, output: str, checkpoint: str, name: str = "chains",
    within_seconds: int = 300, trigger: dict | None = None, **options,
):
    """Reads that follow an injection, also one of an earlier batch."""

    def compute(near: DataFrame) -> DataFrame:
        return injection_chains(near, rules, within_seconds, **options)

    return _with_history(logs, compute, within_seconds, archive, output, checkpoint, name, trigger)


def score_stream(
    logs: DataFrame, rules: dict, encoders: FeatureEncoders, model: PipelineModel, archive: str, results: str,
    checkpoint: str, name: str = "scores", trigger: dict | None = None, unseen_role: str = "error",
):
    """Archive, score and correct every micro-batch."""

    def on_batch(batch: DataFrame, number: int) -> None:
        score_batch(
            batch, rules, encoders, model, archive, results, run_id(name, number), unseen_role=unseen_role,
            session=logs.sparkSession,
        )

    return _start(logs, on_batch, checkpoint, trigger)

