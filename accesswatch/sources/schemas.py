"""Table layouts and the column checks made on load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names, order and categories that files and models share.
HTTP_METHODS = ("DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT")
REQUIRED_LOG_COLUMNS = ("LogID", "Role", "Endpoint", "HTTP_Method", "IP_Address", "Timestamp")
SCALED_FEATURES = ("req_freq_5min", "inventory_change_rate", "role_risk")
MODEL_FEATURES = (
    "HTTP_Method_POST", "HTTP_Method_HEAD", "endpoint_l1_encoded", "HTTP_Method_OPTIONS",
    "inventory_change_rate", "is_unusual_time", "is_internal_ip", "HTTP_Method_PATCH",
    "HTTP_Method_GET", "HTTP_Method_DELETE", "hour", "is_authorized", "day_of_week",
    "role_risk", "req_freq_5min", "role_encoded", "HTTP_Method_PUT",
)
FEATURE_COLUMNS = (
    "LogID", "Timestamp", "UserID", "Role", "Endpoint", "HTTP_Response",
    "endpoint_level_1", "endpoint_level_2", "endpoint_level_3",
    "hour", "day_of_week", "is_unusual_time", "is_internal_ip", "is_authorized",
    "HTTP_Method_DELETE", "HTTP_Method_GET", "HTTP_Method_HEAD", "HTTP_Method_OPTIONS",
    "HTTP_Method_PATCH", "HTTP_Method_POST", "HTTP_Method_PUT", "role_risk",
)
LABEL = "Anomalous"
METADATA = ("LogID", "Timestamp", LABEL)

# Times stay text in files so that bad ones can be dropped instead of failing the read.
UNLABELLED_LOG = T.StructType(
    [
        T.StructField("LogID", T.StringType()),
        T.StructField("UserID", T.LongType()),
        T.StructField("Role", T.StringType()),
        T.StructField("Timestamp", T.StringType()),
        T.StructField("HTTP_Method", T.StringType()),
        T.StructField("Endpoint", T.StringType()),
        T.StructField("IP_Address", T.StringType()),
        T.StructField("HTTP_Response", T.IntegerType()),
    ]
)
RAW_LOG = T.StructType(UNLABELLED_LOG.fields + [T.StructField(LABEL, T.IntegerType())])
SCORED_LOG = T.StructType(
    [
        T.StructField("LogID", T.StringType()),
        T.StructField("Timestamp", T.TimestampType()),
        T.StructField("Role", T.StringType()),
        T.StructField("Endpoint", T.StringType()),
        T.StructField("predicted_anomaly", T.IntegerType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("run_id", T.StringType()),
    ]
)


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def normalise_names(df: DataFrame) -> DataFrame:
    """Names without outer blanks, inner blanks as underscores."""
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def with_defaults(df: DataFrame, names, default=0) -> DataFrame:
    """Add every absent column of ``names`` as a constant."""
    return df.withColumns({n: F.lit(default) for n in names if n not in df.columns})


def id_and_time_first(df: DataFrame) -> DataFrame:
    lead = ["LogID", "Timestamp"]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def model_input(df: DataFrame, features=MODEL_FEATURES, label: str | None = None) -> DataFrame:
    """The ordered model columns, and the label when one is asked for."""
    names = list(features) + ([label] if label else [])
    return require_columns(df, names).select(*names)


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in METADATA]


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def other_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
