"""Running sums over a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accesswatch.session import checkpoint_dir


def ordered_running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Add running and overall sums of columns in the order of ``order``.

    ``sums`` maps an output name to the column it adds up; ``total_<name>``
    is the overall sum. ``order`` must be unique. Rows are range-partitioned and
    kept (checkpoint), so that every later step sees the same ranges; running
    sums inside a range are shifted by the sums of the ranges before it, which
    are as few as there are partitions.
    """
    checkpoint_dir(df.sparkSession)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    ranged = df.orderBy(direction).checkpoint().withColumn("_p", F.spark_partition_id())
    per_range = ranged.groupBy("_p").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_range.select(
        F.col("_p"),
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(everything).alias(f"total_{n}") for n in sums],
    )
    inside = Window.partitionBy("_p").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_l_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    return local.join(F.broadcast(offsets), "_p").select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
        *[f"total_{n}" for n in sums],
    )
