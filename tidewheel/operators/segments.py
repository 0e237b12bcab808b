"""Ordered work over long groups, cut into segments so that no group has to fit one task.

A frame table has `ep` (its episode) and `fi` (a dense index from 0 within it). Look-around windows run over (ep, segment) with a few
rows copied over the segments' edges; running values are taken within segments and carried over by one row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import cut

#: Frames of a segment.
LENGTH = 65_536
#: Microseconds of a time bucket while frames have no index yet.
BUCKET_US = 24 * 3600 * 1_000_000

RUNNING = (Window.unboundedPreceding, Window.currentRow)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    day, second = f"unix_date(cast({ts} as date))", f"cast(extract(second from {ts}) * 1000000 as bigint)"
    return F.expr(f"{day} * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + {second}")


def number_frames(rows: DataFrame, tie: str, bucket_us: int = BUCKET_US) -> DataFrame:
    """Add fi (dense from 0 by us, then tie), t (seconds since the episode's first row) to rows of ep and us.

    Rows are numbered within (ep, time bucket); the bucket's offset is a running sum over one row per bucket. Rows of null ep are left out;
    null us sort first, with null t.
    """
    rows = rows.where("ep is not null").withColumn("_b", F.coalesce(F.floor(F.col("us") / bucket_us), F.lit(-(1 << 62))))
    buckets = rows.groupBy("ep", "_b").agg(F.count("*").alias("_n"), F.min("us").alias("_first"))
    w = Window.partitionBy("ep").orderBy("_b")
    offsets = buckets.select(
        "ep", "_b", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.min("_first").over(Window.partitionBy("ep")).alias("_start")
    )
    inner = rows.withColumn("_k", F.row_number().over(Window.partitionBy("ep", "_b").orderBy("us", tie)))
    # numbered and joined on the same partitioning: the rows are shuffled once
    joined = inner.join(offsets, ["ep", "_b"])
    return joined.withColumn("fi", F.col("_before") + F.col("_k") - 1).withColumn("t", (F.col("us") - F.col("_start")) / 1e6).drop("_b", "_k", "_before", "_start")


def event_frames(events: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """events as frames: ep (user), fi, t, us, event_id, event_type, value."""
    rows = events.select(F.col("user_id").alias("ep"), micros("ts").alias("us"), "event_id", "event_type", "value")
    return number_frames(rows, "event_id", bucket_us)


def look_around(frames: DataFrame, before: int = 0, after: int = 0, length: int = LENGTH) -> DataFrame:
    """Frames with their segment `seg`; those within so many rows of another segment are copied to it. Keep the own ones with own_rows."""
    at = lambda x: F.floor(x / F.lit(length))
    fi = F.col("fi")
    return frames.withColumn("seg", F.explode(F.sequence(F.greatest(F.lit(0), at(fi - after)), at(fi + before))))


def own_rows(frames: DataFrame, length: int = LENGTH) -> DataFrame:
    return frames.where(F.floor(F.col("fi") / F.lit(length)) == F.col("seg")).drop("seg")


def nearby() -> Window:
    """The window of look_around's rows."""
    return Window.partitionBy("ep", "seg").orderBy("fi")


def _per_segment(frames: DataFrame, length: int) -> DataFrame:
    return frames.withColumn("seg", F.floor(F.col("fi") / F.lit(length)))


def running_sum(frames: DataFrame, value: Column, name: str, length: int = LENGTH) -> DataFrame:
    """Add the sum of value over the episode's rows up to and with each row."""
    rows = _per_segment(frames, length).withColumn("_v", value)
    sums = rows.groupBy("ep", "seg").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy("ep").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("ep", "seg", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))
    inner = rows.withColumn("_in", F.sum("_v").over(nearby().rowsBetween(*RUNNING)))
    return inner.join(base, ["ep", "seg"]).withColumn(name, F.col("_base") + F.coalesce("_in", F.lit(0))).drop("_v", "_in", "_base", "seg")


def carry_last(frames: DataFrame, value: Column, name: str, length: int = LENGTH) -> DataFrame:
    """Add the last non-null value at or before each row of the episode (backward as-of hold)."""
    rows = _per_segment(frames, length).withColumn("_v", value)
    lasts = rows.groupBy("ep", "seg").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("fi"))).alias("_l"))
    w = Window.partitionBy("ep").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    base = lasts.select("ep", "seg", F.last("_l", ignorenulls=True).over(w).alias("_base"))
    inner = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(nearby().rowsBetween(*RUNNING)))
    return inner.join(base, ["ep", "seg"]).withColumn(name, F.coalesce("_in", "_base")).drop("_v", "_in", "_base", "seg")


def positions(df: DataFrame, order: list[str], size: Column | None = None, name: str = "position") -> DataFrame:
    """Add the dense position from 0 in a total order over the whole table, or, with size, the sum of the sizes before each row.

    The table is range-partitioned and kept; the partitions' totals are summed over one row per partition.
    """
    size = F.lit(1).cast("long") if size is None else size
    rows = cut(df.withColumn("_size", size).repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    totals = rows.groupBy("_pid").agg(F.sum("_size").alias("_total"))
    before = totals.select("_pid", F.coalesce(F.sum("_total").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row per partition
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("_size").over(w), F.lit(0))).join(F.broadcast(before), "_pid")
    return placed.withColumn(name, F.col("_base") + F.col("_in")).drop("_pid", "_size", "_in", "_base")


def numbered(groups: DataFrame, size: str, name: str, length: int = LENGTH) -> DataFrame:
    """Every row once for each number from 0 to its size - 1, in two steps, so that no row makes a list longer than a segment."""
    n = F.col(size).cast("long")
    parts = groups.where(n > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(length).cast("long"))))
    return parts.withColumn(name, F.explode(F.sequence("_from", F.least(F.col("_from") + length, n) - 1))).drop("_from")
