"""Dense 1-based numbering of rows within a group, in a given order, without putting a whole
group into one task.

``row_number() over (partition by key order by …)`` sends every row of a key to one task; a key
holding a third of the data then serialises a third of the job. Here rows are range-partitioned
on ``(key, order…)`` — range bounds can fall *inside* a hot key, so its rows spread over many
partitions — and numbered by position inside their partition. A tiny table with one row per
(key, partition) carries counts; a running sum over it (a key spans at most #partitions rows)
gives each partition's offset, which is joined back.

The positioned rows are materialised once with ``checkpoint()`` (in ``spark.checkpoint.dir``):
both the count table and the join must see the *same* partitioning, and a re-run range shuffle
samples new bounds — the checkpoint pins them, and a lost executor can never renumber rows.
Sort keys must be unique within a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


HOT_GROUP_ROWS = 2_000_000
# Rows that one task sorts when the number of all rows is known.
TASK_ROWS = 1_000_000


def number_within(df: DataFrame, key: str, order_cols: list[str], out: str = "n",
                  hot_group_rows: int | None = HOT_GROUP_ROWS, biggest: int | None = None, rows: int = 0) -> DataFrame:
    """Skew-adaptive numbering: one partial aggregate finds the largest group (or pass it as
    ``biggest``); if it exceeds ``hot_group_rows`` the range-based form runs, else the
    one-shuffle window form. ``hot_group_rows=None`` always uses the range form. ``rows``: about how many
    rows there are; the window form then has a task for every ``TASK_ROWS`` of them, if that is more than
    the session's shuffle partitions."""
    if hot_group_rows is not None:
        if biggest is None:
            biggest = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0
        if biggest <= hot_group_rows:
            if rows > TASK_ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
                df = df.repartition(-(-rows // TASK_ROWS), key)
            return number_within_window(df, key, order_cols, out)
    return number_within_range(df, key, order_cols, out)


def number_within_range(df: DataFrame, key: str, order_cols: list[str], out: str = "n",
                        num_partitions: int | None = None) -> DataFrame:
    """Range-partitioned numbering (see module docstring)."""
    sort_cols = [key] + list(order_cols)
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from wardlight.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    r = (df.repartitionByRange(parts, *sort_cols).sortWithinPartitions(*sort_cols)
         .withColumn("_np", F.spark_partition_id())
         .withColumn("_nm", F.monotonically_increasing_id())
         .checkpoint(eager=True))
    g = r.groupBy(key, "_np").agg(F.count(F.lit(1)).alias("_nc"), F.min("_nm").alias("_nm0"))
    w = Window.partitionBy(key).orderBy("_np").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_nb", F.coalesce(F.sum("_nc").over(w), F.lit(0)))
    g = g.select(F.col(key).alias("_nk"), F.col("_np").alias("_np2"), "_nm0", "_nb")
    j = r.join(g, F.col(key).eqNullSafe(F.col("_nk")) & (F.col("_np") == F.col("_np2")), "inner")
    return j.withColumn(out, (F.col("_nb") + F.col("_nm") - F.col("_nm0") + 1).cast("int")) \
        .drop("_np", "_nm", "_nk", "_np2", "_nm0", "_nb")


def number_within_window(df: DataFrame, key: str, order_cols: list[str], out: str = "n") -> DataFrame:
    """The plain window form (one shuffle; a key's rows share one task)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c) for c in order_cols])
    return df.withColumn(out, F.row_number().over(w))


def running_sum_within(df: DataFrame, key: str, order_cols: list[str], value_col: str, out: str,
                       num_partitions: int | None = None) -> DataFrame:
    """Per-key running sum of ``value_col`` in ``order_cols`` order (inclusive), skew-proof.

    Same shape as ``number_within_range``: range partitions split a hot key, each row gets its
    running sum inside its (key, partition) slice — a slice is bounded by the partition size —
    and the sums of earlier slices of the key come from a tiny (key, partition) table.
    Order columns must be unique within a key.
    """
    sort_cols = [key] + list(order_cols)
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from wardlight.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    r = (df.repartitionByRange(parts, *sort_cols).sortWithinPartitions(*sort_cols)
         .withColumn("_np", F.spark_partition_id())
         .withColumn("_nm", F.monotonically_increasing_id())
         .checkpoint(eager=True))
    local = Window.partitionBy(key, "_np").orderBy("_nm").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("_loc", F.sum(value_col).over(local))
    g = r.groupBy(key, "_np").agg(F.sum(value_col).alias("_ps"))
    w = Window.partitionBy(key).orderBy("_np").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_off", F.coalesce(F.sum("_ps").over(w), F.lit(0)))
    g = g.select(F.col(key).alias("_rk"), F.col("_np").alias("_rp"), "_off")
    j = r.join(g, F.col(key).eqNullSafe(F.col("_rk")) & (F.col("_np") == F.col("_rp")), "inner")
    return j.withColumn(out, F.col("_off") + F.col("_loc")).drop("_np", "_nm", "_loc", "_rk", "_rp", "_off")
