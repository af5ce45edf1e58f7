"""Label codes, one-hot columns, target means and scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accesswatch.operators.ordered import ordered_running

UNKNOWN = "unknown"


@dataclass(frozen=True)
class LabelCodes:
    """Classes of a column in text order, coded 0..n-1."""

    table: DataFrame  # label, code
    n_classes: int

    def apply(self, df: DataFrame, column: str, output: str, unseen: str = "keep") -> DataFrame:
        """Add the code of ``column``.

        ``unseen="keep"`` codes other values, and nulls, as the class
        ``unknown``: its own code if training knew it, otherwise n.
        ``unseen="error"`` fails the query on such a value.
        """
        codes = self.table.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        joined = df.join(codes, df[column] == F.col("_label"), "left")
        if unseen == "error":
            bad = F.concat(F.lit(f"value without a code in {column}: "), F.coalesce(F.col(column), F.lit("null")))
            code = F.when(F.col("_code").isNull(), F.raise_error(bad).cast("int")).otherwise(F.col("_code"))
        else:
            known = self.table.where(F.col("label") == UNKNOWN).select(F.max("code"))
            code = F.coalesce(F.col("_code"), known.scalar(), F.lit(self.n_classes))
        values = {output: code.cast("int")}
        names = [c for c in df.columns if c != output]
        return joined.withColumns(values).select(*names, output)

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)


def fit_label_codes(df: DataFrame, column: str) -> LabelCodes:
    """Distinct non-null values in text order, any number of them, numbered where they lie.

    The code table is joined by shuffle or broadcast as adaptive execution finds its size.
    """
    labels = df.select(F.col(column).cast("string").alias("label")).where("label is not null").distinct()
    coded = ordered_running(labels.withColumn("_one", F.lit(1).cast("bigint")), "label", {"_rank": "_one"})
    table = coded.select("label", (F.col("_rank") - 1).cast("int").alias("code")).checkpoint()
    return LabelCodes(table, table.count())


def load_label_codes(spark: SparkSession, path: str) -> LabelCodes:
    table = spark.read.schema("label string, code int").parquet(path)
    return LabelCodes(table, table.count())


def one_hot_categories(df: DataFrame, column: str, max_categories: int = 1_000) -> list[str]:
    """Training categories in text order. Each becomes a column, so more than ``max_categories`` are an error."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_categories + 1).collect()
    if len(rows) > max_categories:
        raise ValueError(f"{column} has over {max_categories} categories")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, column: str, categories) -> DataFrame:
    """One 0/1 column per category in place of ``column``; others get all zeros."""
    flags = {f"{column}_{c}": F.coalesce((F.col(column) == c).cast("double"), F.lit(0.0)) for c in categories}
    return df.withColumns(flags).drop(column)


def target_means(df: DataFrame, column: str, label: str, output: str = "role_risk") -> DataFrame:
    """Mean label per value of a column."""
    return df.groupBy(column).agg(F.avg(F.col(label).cast("double")).alias(output))


def apply_target_means(
    df: DataFrame, means: DataFrame, column: str, output: str, default: Column
) -> DataFrame:
    """Look the mean up; ``default`` where the value was not in training."""
    table = means.select(F.col(column).alias("_key"), F.col(output).alias("_mean"))
    joined = df.join(table, df[column] == F.col("_key"), "left")
    names = [c for c in df.columns if c != output]
    return joined.withColumn(output, F.coalesce("_mean", default)).select(*names, output)


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; a zero deviation divides by 1."""

    mean: dict[str, float]
    std: dict[str, float]

    def columns(self) -> dict[str, Column]:
        return {n: (F.col(n).cast("double") - F.lit(m)) / F.lit(self.std[n]) for n, m in self.mean.items()}

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())


def fit_scaler(df: DataFrame, columns) -> Scaler:
    aggs = []
    for c in columns:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return Scaler(
        {c: row[f"m_{c}"] if row[f"m_{c}"] is not None else 0.0 for c in columns},
        {c: row[f"s_{c}"] or 1.0 for c in columns},
    )
