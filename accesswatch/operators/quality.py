"""Checks of labels, addresses, request chains and numeric columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesswatch.functions.endpoint import item_key
from accesswatch.functions.ip import is_global_ip, is_valid_ip
from accesswatch.sources.schemas import LABEL, numeric_names


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def class_totals(df: DataFrame, label: str = LABEL) -> DataFrame:
    y = F.col(label)
    return df.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(y), F.lit(0)).cast("bigint").alias("anomalies")).withColumn(
        "anomaly_ratio", ratio(F.col("anomalies"), F.col("total"))
    )


def label_ratio_check(df: DataFrame, expected: float, tolerance: float = 0.05, label: str = LABEL) -> DataFrame:
    totals = class_totals(df, label)
    within = F.abs(F.col("anomaly_ratio") - F.lit(float(expected))) <= F.lit(float(tolerance))
    return totals.withColumns({"expected_ratio": F.lit(float(expected)), "within_tolerance": within})


def external_address_check(df: DataFrame, threshold: float = 0.3, label: str = LABEL) -> DataFrame:
    """Public addresses, the anomalous ones among them, and their share."""
    public = is_global_ip(F.col("IP_Address"))
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(public).alias("external_ips"),
        F.count_if(public & (F.col(label) == 1)).alias("anomalous_external_ips"),
        F.count_if(~is_valid_ip(F.col("IP_Address"))).alias("invalid_ips"),
    )
    return counts.withColumns(
        {
            "external_ratio": ratio(F.col("external_ips"), F.col("total")),
            "anomalous_external_ratio": ratio(F.col("anomalous_external_ips"), F.col("total")),
            "anomalous_share_of_external": ratio(F.col("anomalous_external_ips"), F.col("external_ips")),
        }
    ).withColumn("high_correlation", F.col("anomalous_share_of_external") > F.lit(float(threshold)))


def _one_value(c: Column) -> Column:
    """Aggregate: whether all values that are there are the same, told by 128 bits of hash.

    Smallest and largest hash differ exactly when there are several values. Unlike a distinct count or the text itself,
    numbers of fixed width combine in hash tables before the shuffle.
    """
    hashes = [F.when(c.isNotNull(), F.xxhash64(F.lit(seed), c)) for seed in (0, 1)]
    return F.coalesce((F.min(hashes[0]) == F.max(hashes[0])) & (F.min(hashes[1]) == F.max(hashes[1])), F.lit(True))


def chain_consistency(df: DataFrame, chain: str | list[str]) -> DataFrame:
    """Per chain: does it keep one address and one item or record id."""
    keys = [chain] if isinstance(chain, str) else chain
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_logs"),
        _one_value(F.col("IP_Address")).alias("same_ip"),
        _one_value(item_key(F.col("Endpoint"))).alias("same_id"),
    )


def _finite(name: str, dtype: str) -> Column:
    c = F.col(name)
    if dtype in ("double", "float"):
        return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    return c


def missing_and_infinite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Totals over the numeric columns: missing cells and infinite cells."""
    types = dict(df.dtypes)
    names = columns or numeric_names(df)
    aggs = []
    for n in names:
        c = F.col(n)
        real = types[n] in ("double", "float")
        aggs.append(F.count_if(c.isNull() | F.isnan(c) if real else c.isNull()).alias(f"m_{n}"))
        aggs.append((F.count_if(F.abs(c) == F.lit(float("inf"))) if real else F.lit(0).cast("bigint")).alias(f"i_{n}"))
    total = lambda prefix: reduce(lambda a, b: a + b, [F.col(f"{prefix}_{n}") for n in names])
    return df.agg(*aggs).select(total("m").alias("missing_cells"), total("i").alias("infinite_cells"))


def finite_means(df: DataFrame, columns: list[str] | None = None) -> dict[str, float | None]:
    """Mean of the finite values of each numeric column: one pass, one row."""
    types = dict(df.dtypes)
    names = columns or numeric_names(df)
    row = df.agg(*[F.avg(_finite(n, types[n]).cast("double")).alias(n) for n in names]).first()
    return row.asDict()


def impute_means(df: DataFrame, means: dict[str, float | None] | None = None) -> DataFrame:
    """Every missing, NaN or infinite cell becomes its column's finite mean."""
    types = dict(df.dtypes)
    means = finite_means(df) if means is None else means
    return df.withColumns(
        {
            n: F.coalesce(_finite(n, types[n]).cast("double"), F.lit(m).cast("double"))
            for n, m in means.items()
        }
    )
