"""Dense 0-based row numbers per group that survive a hot group.

``row_number() over (partition by g order by k)`` puts a whole group into
one task.  That is fine for prompt-sized tables but not for a group that
holds a third of the data, so groups are split by size:

* ordinary groups (fewer than ``hot_rows`` rows) use the window;
* hot groups are range-partitioned on (group, order) so one group spans
  many tasks; each task numbers its rows locally, a tiny per-(group, task)
  count table gives each task its offset, and the offset is added back.

The hot branch is written once (Parquet, in the session's checkpoint
folder) before its two uses, so both see the same partition ids even after
a retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_HOT_ROWS = 5_000_000
BROADCAST_GROUPS = 100_000


def _order_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]


def row_index(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    out: str = "row_idx",
    hot_rows: int = DEFAULT_HOT_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = 0-based position of each row within its group by ``order``.

    ``order`` must be a total order inside each group (tie-break on a key),
    otherwise numbering is not reproducible across runs.
    """
    group = list(group)
    spark = df.sparkSession
    if not group:
        return _hot_index(df, [], order, out, partitions or spark.sparkContext.defaultParallelism)

    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    hot = sizes.where(F.col("__n") >= hot_rows).select(*group)
    n_hot = hot.count()  # a count, not data: bounded by total_rows / hot_rows
    w = Window.partitionBy(*group).orderBy(*_order_cols(order))
    if n_hot == 0:
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))

    hot_side = F.broadcast(hot) if n_hot <= BROADCAST_GROUPS else hot
    cold = df.join(hot_side, group, "left_anti").withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    hot_rows_df = df.join(hot_side, group, "left_semi")
    parts = partitions or max(spark.sparkContext.defaultParallelism, 2 * n_hot)
    return cold.unionByName(_hot_index(hot_rows_df, group, order, out, parts))


def _hot_index(df: DataFrame, group: list[str], order, out: str, partitions: int) -> DataFrame:
    cols = df.columns
    keys = [F.col(c) for c in group] + _order_cols(order)
    s = (
        df.repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    # Both uses below must see identical partition ids: pin the data (Parquet
    # in the checkpoint folder; partition ids are stored as a column).
    from tabqa.session import pin

    s = pin(s, "row-index")
    stats = s.groupBy(*group, "__pid").agg(F.min("__mid").alias("__first"), F.count(F.lit(1)).alias("__n"))
    wo = Window.partitionBy(*group).orderBy("__pid") if group else Window.orderBy("__pid")
    offs = stats.withColumn(
        "__off", F.coalesce(F.sum("__n").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select(*group, "__pid", "__first", "__off")
    # One row per (group, task): bounded by the number of tasks plus groups.
    j = s.join(F.broadcast(offs), [*group, "__pid"])
    return j.select(*cols, (F.col("__off") + F.col("__mid") - F.col("__first")).cast("bigint").alias(out))
