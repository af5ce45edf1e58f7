"""Readers and writers for logs, features and scored batches."""

from __future__ import annotations

import csv
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesswatch.session import checkpoint_dir
from accesswatch.sources.schemas import (
    FEATURE_COLUMNS,
    LABEL,
    MODEL_FEATURES,
    RAW_LOG,
    REQUIRED_LOG_COLUMNS,
    SCORED_LOG,
    UNLABELLED_LOG,
    model_input,
    normalise_names,
    require_columns,
)
from accesswatch.sources.store import RunStore


def read_csv_by_name(spark: SparkSession, paths, types: dict[str, T.DataType]) -> DataFrame:
    """Rows of CSV files whose headers may differ, matched by column name; ``_path`` is the row's file.

    The first line of each file is its header. Files are read once per distinct header, of which there are few. Columns in
    ``types`` have those types (null where a value does not fit), all others are text, and columns a file does not have are
    null. A file none of whose values has a line break is read line by line, so that any number of tasks share it; where a line
    has an odd number of quotes, a value goes on in the next line, and such a file is read whole by one task.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("_path"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"),
    ).where(F.length(F.trim("value")) > 0)
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    heads = lines.groupBy("_path").agg(F.min_by("value", "_at").alias("_head"), F.max(odd).alias("_broken"))
    checkpoint_dir(spark)
    heads = heads.checkpoint()
    known = [r[0] for r in heads.where("NOT _broken").select("_head").distinct().orderBy("_head").collect()]
    broken: dict[str, list[str]] = {}
    for r in heads.where("_broken").orderBy("_path").collect():
        broken.setdefault(r["_head"], []).append(r["_path"])
    if not known and not broken:
        raise ValueError(f"no lines under {paths}")

    def columns(head: str) -> str:
        names = next(csv.reader([head.lstrip("\ufeff")]))
        return ", ".join(f"`{n.replace('`', '``')}` {types.get(n, T.StringType()).simpleString()}" for n in names)

    frames = []
    plain = heads.where("NOT _broken").select("_path", "_head")
    rows = lines.join(plain, "_path") if len(known) > 1 or broken else lines.withColumn("_head", F.lit((known or [""])[0]))
    rows = rows.where("value <> _head")
    for head in known:
        parsed = F.from_csv("value", columns(head), {"mode": "PERMISSIVE"})
        frames.append(rows.where(F.col("_head") == head).select(parsed.alias("_row"), "_path").select("_row.*", "_path"))
    for head, files in broken.items():
        reader = spark.read.schema(columns(head)).option("header", True).option("multiLine", True).option("mode", "PERMISSIVE")
        frames.append(reader.csv(files).select("*", F.col("_metadata.file_path").alias("_path")))
    return union_by_name(frames)


def read_log_csv(spark: SparkSession, path) -> DataFrame:
    """Raw logs, labelled or not, columns in any order; raises when a required column is missing."""
    types = {f.name: f.dataType for f in RAW_LOG.fields}
    return require_columns(read_csv_by_name(spark, path, types).drop("_path"), REQUIRED_LOG_COLUMNS)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    return reader.load(path)


def describe_table(df: DataFrame) -> DataFrame:
    """Rows and columns of a table, as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def read_training_table(df: DataFrame, features=MODEL_FEATURES) -> DataFrame:
    """Model columns plus label from a feature table with untidy names."""
    return model_input(normalise_names(df), features, LABEL)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet table at ``path``, or an empty one while nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns are matched by name, absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_result_csvs(spark: SparkSession, paths) -> DataFrame:
    """Scored CSV files of any column set and order, with the file's time stamp as ``run_id``.

    Ids are text, known columns of logs, features and results have fixed types, others are text.
    """
    number = {n: T.DoubleType() for n in (*FEATURE_COLUMNS, *MODEL_FEATURES)}
    own = {f.name: f.dataType for f in (*RAW_LOG.fields, *SCORED_LOG.fields)}
    level = {n: T.StringType() for n in FEATURE_COLUMNS if n.startswith("endpoint_level")}
    rows = require_columns(read_csv_by_name(spark, paths, number | level | own), ["LogID"])
    return rows.withColumn("run_id", F.regexp_extract("_path", r"(\d+)\.\w+$", 1)).drop("_path")


def split_unlabelled(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in UNLABELLED_LOG.fields])


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_run(df: DataFrame, path: str, run_id: str) -> int:
    """Store one run in place of all its former rows, also on days it has no rows for any more, and return the number
    of its arrival (see ``store``)."""
    return RunStore(df.sparkSession, path).write(df, run_id)


def read_runs(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Stored runs, or those of the given days, however many; empty if no day has any. Only their folders are listed."""
    return RunStore(spark, path).read(first=first, last=last)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
