"""Labelled log to saved encoders and models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from accesswatch.operators import model as M
from accesswatch.plans.features import FeatureEncoders, build_features, fit_encoders, load_encoders
from accesswatch.sources.schemas import LABEL, MODEL_FEATURES


@dataclass(frozen=True)
class Trained:
    encoders: FeatureEncoders
    models: dict[str, PipelineModel]
    test: DataFrame


def train_models(log: DataFrame, rules: dict, model_dir: str, trees: int = M.TREES, max_depth: int = 30) -> Trained:
    """Fit encoders and both models, save all below ``model_dir``.

    The feature table is written there once: every later pass, of the split and
    of the iterative fits, reads narrow columnar files instead of the log.
    """
    spark = log.sparkSession
    encoders = fit_encoders(log)
    encoders.save(f"{model_dir}/encoders")
    columns = ["LogID", "Timestamp", "Role", "Endpoint", *MODEL_FEATURES, LABEL]
    build_features(log, rules, encoders, keep_label=True).select(*dict.fromkeys(columns)).write.mode(
        "overwrite"
    ).parquet(f"{model_dir}/training_features")
    features = spark.read.parquet(f"{model_dir}/training_features")
    train, test = M.stratified_split(features)
    models = {
        "logistic": M.fit_logistic(train),
        "random_forest": M.fit_forest(train, trees=trees, max_depth=max_depth),
    }
    for name, fitted in models.items():
        fitted.write().overwrite().save(f"{model_dir}/{name}")
    return Trained(encoders, models, test)


def load_trained(spark: SparkSession, model_dir: str, name: str = "random_forest") -> tuple[FeatureEncoders, PipelineModel]:
    return load_encoders(spark, f"{model_dir}/encoders"), PipelineModel.load(f"{model_dir}/{name}")
