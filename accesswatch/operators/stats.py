"""Correlation of numeric columns, from one matrix of sums."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesswatch.sources.schemas import numeric_names

#: Rows whose means are taken from the columns before their products are summed, so that sums of like size do not cancel.
CENTRE_ROWS = 1000
#: A variance this small beside the sum of squares is that of a constant.
CONSTANT = 1e-12


def pairwise_sums(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, ...]:
    """Over the rows that have both values, for each pair of columns: number, sums of either less its centre, of their
    squares, and of the products.

    A row becomes a vector of its values, their squares and its marks for values that are there, with zeros for nulls. The
    product of the matrix of all rows with itself, which tasks add up to one small matrix each, holds all these sums:
    one pass and one aggregate for any number of columns, and a result of three columns squared.
    """
    numbers = [F.col(c).cast("double") for c in columns]
    means = df.select(*[x.alias(f"c{i}") for i, x in enumerate(numbers)]).limit(CENTRE_ROWS)
    centre = [0.0 if m is None or not np.isfinite(m) else m for m in means.agg(*[F.avg(c) for c in means.columns]).first()]
    zero = F.lit(0.0)
    values = [F.coalesce(x - F.lit(m), zero) for x, m in zip(numbers, centre)]
    marks = [F.when(x.isNotNull(), 1.0).otherwise(0.0) for x in numbers]
    rows = df.select(array_to_vector(F.array(*values, *[v * v for v in values], *marks)).alias("v"))
    # A row of zeros adds nothing and gives an empty table its sums.
    rows = rows.unionByName(df.sparkSession.range(1).select(array_to_vector(F.array_repeat(zero, 3 * len(columns))).alias("v")))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), 0, 3 * len(columns)).computeGramianMatrix().toArray()
    d = len(columns)
    x, s, m = slice(0, d), slice(d, 2 * d), slice(2 * d, 3 * d)
    return gram[m, m], gram[x, m], gram[m, x], gram[s, m], gram[m, s], gram[x, x]


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson correlation of each pair over the rows that have both values; NaN where one is constant there."""
    if not columns:
        return np.zeros((0, 0))
    n, sx, sy, sxx, syy, sxy = pairwise_sums(df, columns)
    with np.errstate(all="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        found = (sxy - sx * sy / n) / np.sqrt(vx * vy)
        found[~((vx > CONSTANT * sxx) & (vy > CONSTANT * syy))] = np.nan
    return np.clip(found, -1, 1)


def _long(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    found = correlations(df, columns)
    cells = [None if np.isnan(found[i, j]) else float(found[i, j]) for i, j in pairs]
    names = [pa.array([columns[k[side]] for k in pairs], pa.string()) for side in (0, 1)]
    table = pa.Table.from_arrays([*names, pa.array(cells, pa.float64())], names=["feature_1", "feature_2", "correlation"])
    return df.sparkSession.createDataFrame(table)


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, complete: bool = False) -> DataFrame:
    """Strict upper triangle of the Pearson matrix; null where a column is constant. Columns with and without nulls go
    the same way, whatever ``complete`` promises."""
    columns = columns or numeric_names(df)
    return _long(df, columns, list(combinations(range(len(columns)), 2)))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, complete: bool = False) -> DataFrame:
    """Every pair in both directions, and the diagonal."""
    columns = columns or numeric_names(df)
    return _long(df, columns, list(product(range(len(columns)), repeat=2)))


def high_correlations(
    df: DataFrame, threshold: float = 0.6, columns: list[str] | None = None, complete: bool = False
) -> DataFrame:
    return correlation_pairs(df, columns, complete).where(F.abs("correlation") > F.lit(float(threshold)))
