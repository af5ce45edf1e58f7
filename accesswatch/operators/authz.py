"""Matching requests against role and scenario rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesswatch.functions.endpoint import clean_endpoint, resource_path


def _related(path: Column, rule: Column, match: str) -> Column:
    if match == "segment":
        a, b = F.concat(path, F.lit("/")), F.concat(rule, F.lit("/"))
        return a.startswith(b) | b.startswith(a)
    return path.startswith(rule) | rule.startswith(path)


def _rule_side(rules: DataFrame) -> DataFrame:
    """Rules under names of their own, closed off so that no log column resolves here."""
    own = rules.select(*[F.col(c).alias(f"_r_{c}") for c in ("Role", "HTTP_Method", "rule_endpoint")])
    return own.alias("_rules")


def _covers(role: Column, method: Column, endpoint: Column, match: str) -> Column:
    return (
        (F.col("_r_Role") == role)
        & (F.col("_r_HTTP_Method") == method)
        & _related(clean_endpoint(endpoint), F.col("_r_rule_endpoint"), match)
    )


def with_authorization(df: DataFrame, rules: DataFrame, match: str = "prefix") -> DataFrame:
    """Add ``is_authorized``: 0 where a rule of the role covers the request.

    A rule covers a request of its role and method when one path begins with
    the other: as text (``prefix``), or by whole segments (``segment``). The
    rule table is probed by (role, method) as an existence join, broadcast if Spark
    finds it small enough; rows keep their place and number.
    """
    role, method, endpoint = (F.col(c).outer() for c in ("Role", "HTTP_Method", "Endpoint"))
    covered = _rule_side(rules).where(_covers(role, method, endpoint, match))
    return df.withColumn("is_authorized", F.when(covered.exists(), 0).otherwise(1))


def unauthorised(df: DataFrame, rules: DataFrame, match: str = "prefix") -> DataFrame:
    """Only the requests a rule covers."""
    covered = _covers(F.col("Role"), F.col("HTTP_Method"), F.col("Endpoint"), match)
    return df.join(_rule_side(rules), covered, "left_semi")


def scenario_combinations(df: DataFrame, signatures: DataFrame) -> DataFrame:
    """Requests whose resource and method are exactly those of some scenario."""
    pairs = signatures.select(F.col("rule_endpoint").alias("_e"), F.col("HTTP_Method").alias("_m")).coalesce(1).distinct()
    on = (resource_path(F.col("Endpoint")) == F.col("_e")) & (F.col("HTTP_Method") == F.col("_m"))
    return df.join(pairs, on, "left_semi")
