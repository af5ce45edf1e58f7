"""Archive and results to the tables of the analyst report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesswatch.operators import report
from accesswatch.sources.current import BucketedRows
from accesswatch.sources.files import read_or_empty
from accesswatch.sources.schemas import SCORED_LOG, UNLABELLED_LOG
from accesswatch.sources.store import RunStore

ARCHIVED_LOG = T.StructType(
    [T.StructField(f.name, T.TimestampType()) if f.name == "Timestamp" else f for f in UNLABELLED_LOG.fields]
    + [T.StructField("run_id", T.StringType())]
)
_DAY = T.StructField("log_date", T.DateType())


def report_base(archive: DataFrame, results: DataFrame) -> DataFrame:
    """One row per archived log with its latest score and the report columns.

    A log archived by several runs is kept once, a score the same way: of the run that arrived last where the rows say so, else
    of the run with the largest id.
    """

    def latest(rows: DataFrame, schema: T.StructType) -> DataFrame:
        order = "arrival" if "arrival" in rows.columns else "run_id"
        names = [f.name for f in schema.fields if f.name != "run_id"]
        return report.keep_last(rows.select(*names, order), order=order).drop(order)

    merged = report.join_scores(latest(archive, ARCHIVED_LOG), latest(results, SCORED_LOG), keep_unscored_flag=True)
    return report.with_report_columns(merged)


def load_report_base(
    spark: SparkSession, archive_path: str, results_path: str, since: date | None = None, until: date | None = None
) -> DataFrame:
    """The same from the stores; a store without any run counts as empty.

    ``since`` and ``until`` (both included) restrict the report to logs of those days; other days are not read.
    """

    def stored(path: str, schema: T.StructType) -> DataFrame:
        store = RunStore(spark, path)
        if store.exists():
            return store.read(schema, first=since, last=until)
        rows = read_or_empty(spark, path, T.StructType([*schema.fields, _DAY]))
        if since is not None:
            rows = rows.where(F.col("log_date") >= F.lit(since))
        return rows if until is None else rows.where(F.col("log_date") <= F.lit(until))

    return report_base(stored(archive_path, ARCHIVED_LOG), stored(results_path, SCORED_LOG))


def bucketed_report_base(
    spark: SparkSession, archive_path: str, results_path: str, bucketed_path: str, buckets: int = 64
) -> DataFrame:
    """The same over tables bucketed by log id, to which only runs that arrived since the last call are added: no row that was
    there before is shuffled, for the latest rows or for the join. ``BucketedRows.fold`` puts the parts of many calls together."""
    both = []
    for name, path, schema in (("archive", archive_path, ARCHIVED_LOG), ("results", results_path, SCORED_LOG)):
        store = RunStore(spark, path)
        rows = BucketedRows(spark, f"{bucketed_path}/{name}", schema, buckets=buckets)
        rows.refresh(store)
        both.append(rows.rows(store))
    return report_base(*both)


def report_tables(base: DataFrame, borderline: float = 0.3) -> dict[str, DataFrame]:
    """All tables of the report by name; cache ``base`` when several are used."""
    return {
        "headline": report.headline(base),
        "by_role": report.usage_by_role(base),
        "by_network": report.usage_by_network(base),
        "top_endpoints": report.top_endpoints(base),
        "top_endpoints_of_anomalies": report.top_endpoints(base, anomalies=True),
        "daily_unusual_hours": report.daily_unusual(base),
        "borderline": report.borderline_logs(base, borderline),
        "anomalous": report.anomalous_logs(base),
        "normal": report.normal_logs(base),
    }
