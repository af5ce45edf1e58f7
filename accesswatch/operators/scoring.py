"""Corrections and summaries of scored batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Requests analysts have cleared.
CLEARED_ROLES = ("Doctor", "Nurse")
CLEARED_ENDPOINTS = ("/patient/appointments/confirm", "/patient/appointments/cancel")


def apply_override(df: DataFrame, roles=CLEARED_ROLES, endpoints=CLEARED_ENDPOINTS) -> DataFrame:
    """Cleared requests become normal with score 0; the endpoint must match exactly."""
    cleared = F.coalesce(F.col("Role").isin(*roles) & F.col("Endpoint").isin(*endpoints), F.lit(False))
    return df.withColumns(
        {
            "predicted_anomaly": F.when(cleared, 0).otherwise(F.col("predicted_anomaly")).cast("int"),
            "anomaly_score": F.when(cleared, 0.0).otherwise(F.col("anomaly_score")),
        }
    )


def scoring_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.coalesce(F.sum("predicted_anomaly"), F.lit(0)).cast("bigint").alias("n_anomalies"),
        F.count(F.lit(1)).alias("n_logs"),
    )
