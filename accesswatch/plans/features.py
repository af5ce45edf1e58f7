"""From raw logs to the feature table, with encoders fitted once and reused."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesswatch.functions import endpoint as E
from accesswatch.functions import ip as I
from accesswatch.functions import temporal as T
from accesswatch.operators.authz import with_authorization
from accesswatch.operators.encoders import (
    LabelCodes,
    apply_target_means,
    fit_label_codes,
    load_label_codes,
    one_hot,
    one_hot_categories,
)
from accesswatch.operators.rolling import add_request_rates
from accesswatch.session import checkpoint_dir
from accesswatch.sources.rules import authorization_rules, validate_rules
from accesswatch.sources.schemas import (
    FEATURE_COLUMNS,
    LABEL,
    REQUIRED_LOG_COLUMNS,
    id_and_time_first,
    require_columns,
    with_defaults,
)


def valid_rows(log: DataFrame) -> DataFrame:
    """Timestamps parsed; rows without a valid one are dropped."""
    require_columns(log, REQUIRED_LOG_COLUMNS)
    if dict(log.dtypes)["Timestamp"] == "string":
        log = log.withColumn("Timestamp", T.parse_timestamp(F.col("Timestamp")))
    return log.where(F.col("Timestamp").isNotNull())


def time_counts(log: DataFrame) -> DataFrame:
    """Rows, and rows that ``valid_rows`` drops for their time, as one row."""
    ts = F.col("Timestamp")
    if dict(log.dtypes)["Timestamp"] == "string":
        ts = T.parse_timestamp(ts)
    return log.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ts.isNull()).alias("n_dropped"))


def row_features(log: DataFrame, rules: dict, match: str = "prefix") -> DataFrame:
    """Features that need only the row and the rule table: no shuffle."""
    settings = validate_rules(rules)["FEATURE_ENGINEERING"]
    hours = (settings["unusual_hours"]["start"], settings["unusual_hours"]["end"])
    ts = F.col("Timestamp")
    depth = settings.get("endpoint_parse_depth", 3)
    levels = {f"endpoint_level_{i + 1}": c for i, c in enumerate(E.endpoint_levels(F.col("Endpoint"), depth))}
    featured = log.withColumns(
        {
            **levels,
            "hour": T.hour_of(ts),
            "day_of_week": T.day_of_week(ts),
            "is_unusual_time": T.is_unusual_time(ts, hours),
            "is_internal_ip": I.is_internal_ip(F.col("IP_Address")).cast("int"),
        }
    )
    return with_authorization(featured, authorization_rules(log.sparkSession, rules), match).drop("IP_Address")


@dataclass(frozen=True)
class FeatureEncoders:
    """What training learned about the categories; reused unchanged when scoring."""

    roles: LabelCodes
    levels: dict[int, LabelCodes]
    methods: list[str]
    risk: DataFrame | None = None
    mean_risk: float = 0.0

    def apply(self, df: DataFrame, unseen_role: str = "error") -> DataFrame:
        """Codes, one-hot columns and role risk in place of the raw categories.

        ``endpoint_l1_encoded`` codes level 1; further fitted levels get
        ``endpoint_level_<i>_code``.
        """
        df = self.roles.apply(df, "Role", "role_encoded", unseen=unseen_role)
        for level, codes in self.levels.items():
            output = "endpoint_l1_encoded" if level == 1 else f"endpoint_level_{level}_code"
            df = codes.apply(df, f"endpoint_level_{level}", output)
        df = one_hot(df, "HTTP_Method", self.methods)
        if self.risk is None:
            return with_defaults(df, ["role_risk"], 0.0)
        return apply_target_means(df, self.risk, "Role", "role_risk", F.lit(self.mean_risk))

    def save(self, path: str) -> None:
        spark = self.roles.table.sparkSession
        self.roles.save(f"{path}/roles")
        for level, codes in self.levels.items():
            codes.save(f"{path}/level_{level}")
        if self.risk is not None:
            self.risk.write.mode("overwrite").parquet(f"{path}/risk")
        meta = {
            "levels": sorted(self.levels), "methods": self.methods, "risk": self.risk is not None,
            "mean_risk": self.mean_risk,
        }
        row = spark.range(1).select(F.lit(json.dumps(meta)).alias("value"))
        row.coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_encoders(spark: SparkSession, path: str) -> FeatureEncoders:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    return FeatureEncoders(
        roles=load_label_codes(spark, f"{path}/roles"),
        levels={n: load_label_codes(spark, f"{path}/level_{n}") for n in meta["levels"]},
        methods=meta["methods"],
        risk=spark.read.parquet(f"{path}/risk") if meta["risk"] else None,
        mean_risk=meta["mean_risk"],
    )


def fit_encoders(log: DataFrame, coded_levels: tuple[int, ...] = (1,)) -> FeatureEncoders:
    """Learn codes, method columns and, from a labelled log, the risk per role.

    One pass over the raw columns counts the log by role, method and first path
    level; everything small is learnt from that. Deeper levels hold record ids:
    coding them is possible, takes a pass each, and is off by default.
    """
    log = valid_rows(log)
    checkpoint_dir(log.sparkSession)
    depth = max(coded_levels, default=1)
    parts = E.endpoint_levels(F.col("Endpoint"), depth)
    label = F.col(LABEL).cast("double") if LABEL in log.columns else F.lit(None).cast("double")
    profile = (
        log.groupBy("Role", "HTTP_Method", parts[0])
        .agg(F.sum(label).alias("s"), F.count(label).alias("n"))
        .checkpoint()
    )
    levels = {
        n: fit_label_codes(profile if n == 1 else log.select(parts[n - 1]), f"endpoint_level_{n}") for n in coded_levels
    }
    risk, mean_risk = None, 0.0
    if LABEL in log.columns:
        mean_risk = profile.agg(F.try_divide(F.sum("s"), F.sum("n"))).first()[0] or 0.0
        risk = profile.groupBy("Role").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("role_risk"))
    return FeatureEncoders(
        roles=fit_label_codes(profile, "Role"),
        levels=levels,
        methods=one_hot_categories(profile, "HTTP_Method"),
        risk=risk,
        mean_risk=float(mean_risk),
    )


def build_features(
    log: DataFrame, rules: dict, encoders: FeatureEncoders, keep_label: bool = False,
    strategy: str = "instants", unseen_role: str = "error",
) -> DataFrame:
    """The feature table of a log: one row per log with a valid time.

    Rates come first, so that only raw columns go through their shuffle.
    """
    log = valid_rows(log)
    if not keep_label and LABEL in log.columns:
        log = log.drop(LABEL)
    rated = add_request_rates(log, strategy)
    featured = encoders.apply(row_features(rated, rules), unseen_role)
    return id_and_time_first(with_defaults(featured, FEATURE_COLUMNS))
