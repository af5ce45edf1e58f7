"""Classification metrics over scored rows; the positive class is 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesswatch.operators.ordered import ordered_running
from accesswatch.operators.quality import ratio


def confusion_cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes=(0, 1)) -> DataFrame:
    """One row per label, one column per predicted class."""
    cells = confusion_cells(df, label, prediction)
    return cells.groupBy("label").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("prediction") == c, F.col("n"))), F.lit(0)).cast("bigint").alias(f"predicted_{c}")
            for c in classes
        ]
    )


def _f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def binary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, precision, recall and F1 in one pass; 0 where undefined."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    cells = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    return cells.withColumns(
        {
            "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("n")),
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def class_report(df: DataFrame, label: str, prediction: str, digits: int | None = 2) -> DataFrame:
    """Precision, recall, F1 and support per class, with the averages.

    Works on the confusion cells, one row per pair of classes.
    """
    cells = confusion_cells(df, label, prediction)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    classes = (
        sides.groupBy("c")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
        .withColumns({"precision": ratio(F.col("hit"), F.col("predicted")), "recall": ratio(F.col("hit"), F.col("support"))})
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )
    names = ("precision", "recall", "f1")
    summary = classes.agg(
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(f"weighted_{n}") for n in names],
        ratio(F.sum("hit"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
    )

    def line(name: str, values: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("class"), *[v.alias(n) for n, v in zip(names, values)], F.col("support"))

    averages = summary.select(
        F.explode(
            F.array(
                line("accuracy", [F.col("accuracy")] * 3),
                line("macro avg", [F.col(f"macro_{n}") for n in names]),
                line("weighted avg", [F.col(f"weighted_{n}") for n in names]),
            )
        ).alias("r")
    ).select("r.*")
    report = classes.select(F.col("c").cast("string").alias("class"), *names, "support").unionByName(averages)
    if digits is None:
        return report
    return report.withColumns({n: F.round(n, digits) for n in names})


def score_steps(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score, descending, with cumulated class counts.

    Rows collapse to distinct scores before anything is ordered.
    """
    y = F.col(label) == 1
    steps = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(y).alias("positives"), F.count_if(~y).alias("negatives")
    )
    return ordered_running(steps, "threshold", {"tps": "positives", "fps": "negatives"}, descending=True)


def _curve(steps: DataFrame, points: dict[str, Column], end: dict[str, float]) -> DataFrame:
    first = [F.lit(float("inf")).alias("threshold"), *[F.lit(v).alias(n) for n, v in end.items()]]
    origin = steps.sparkSession.range(1).select(*first)
    return steps.select("threshold", *[c.alias(n) for n, c in points.items()]).unionByName(origin)


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rates per distinct score, and the origin at an infinite threshold."""
    steps = score_steps(df, label, score)
    rates = {"fpr": ratio(F.col("fps"), F.col("total_fps")), "tpr": ratio(F.col("tps"), F.col("total_tps"))}
    return _curve(steps, rates, {"fpr": 0.0, "tpr": 0.0})


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve; tied scores count half. Null with one class only."""
    steps = score_steps(df, label, score)
    half = F.col("tps").cast("double") - F.col("positives").cast("double") / F.lit(2.0)
    return steps.agg(
        F.try_divide(
            F.sum(F.col("negatives").cast("double") * half),
            F.max("total_tps").cast("double") * F.max("total_fps").cast("double"),
        ).alias("auc")
    )


def precision_recall_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall per distinct score, and the closing point (1, 0)."""
    steps = score_steps(df, label, score)
    points = {
        "precision": ratio(F.col("tps"), F.col("tps") + F.col("fps")),
        "recall": ratio(F.col("tps"), F.col("total_tps")),
    }
    return _curve(steps, points, {"precision": 1.0, "recall": 0.0})
