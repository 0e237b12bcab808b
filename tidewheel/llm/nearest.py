"""Problem 1: records of two tables paired by nearest time within the same entity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import exact

#: Width in seconds of a time range, or as many tolerances if that is more; with the margins it bounds what one entity brings to one group.
RANGE_S, RANGE_TOLERANCES = 32.0, 4.0
#: Rows of both tables aimed at in a co-grouped shard.
SHARD_ROWS = 150_000


def _search(left: pa.Table, right: pa.Table, tolerance: float) -> pa.Table:
    """For each left row, the nearest right row of the same (entity, range), by binary search over (group, time) codes."""
    le, lb, lt = (left.column(c).to_numpy() for c in ("_entity", "_range", "_t"))
    re_, rb, rt, rv = (right.column(c).to_numpy() for c in ("_entity", "_range", "_t", "_value"))
    none = pa.table({"_id": pa.array([], pa.int64()), "_value": pa.array([], pa.int64()), "_gap": pa.array([], pa.float64())})
    if not len(le) or not len(re_):
        return none
    code = lambda a, b: np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    ec, bc, tc = code(le, re_), code(lb, rb), code(lt, rt)
    group = ec * (bc.max() + 1) + bc
    group = np.unique(group, return_inverse=True)[1]
    key = group * np.int64(tc.max() + 1) + tc
    lk, rk, n = key[: len(le)], key[len(le) :], len(rt)
    order = np.lexsort((rv, rk))
    rk, rt, rv, rg = rk[order], rt[order], rv[order], group[len(le) :][order]
    lg = group[: len(le)]
    after = np.searchsorted(rk, lk, "left")
    before = after - 1
    inf = np.inf
    a, b = np.minimum(after, n - 1), np.maximum(before, 0)
    gap_a = np.where((after < n) & (rg[a] == lg), np.abs(rt[a] - lt), inf)
    gap_b = np.where((before >= 0) & (rg[b] == lg), np.abs(lt - rt[b]), inf)
    b = np.searchsorted(rk, rk[b], "left")  # the smallest value of those at the same time
    pick, gap = np.where(gap_b <= gap_a, b, a), np.minimum(gap_a, gap_b)
    ok = np.flatnonzero(gap <= tolerance)
    ids = left.column("_id").to_numpy()[ok]
    _, once = np.unique(ids, return_index=True)
    ok = ok[once]
    return pa.table({"_id": left.column("_id").to_numpy()[ok], "_value": rv[pick[ok]], "_gap": gap[ok]})


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: str, time: str, left_id: str, right_value: str, tolerance: float, range_s: float | None = None, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """One row (left_id, right_value, gap_s) per left row that has a right row of its entity at most tolerance seconds away.

    Both tables are co-grouped by shards of (entity, time range); right rows near an edge of a range go to both sides, so that the
    nearest one is always at hand. A range is never narrower than the tolerance, so a right row goes to three ranges at most. An entity with
    a third of all rows is spread over its ranges; rows of one entity at one and the same time stay together.
    Rows whose entity, time or id is null, or whose time isn't finite, take no part; repeated left rows (same id, entity and time) give one row; of two
    right rows equally near, the earlier is taken, of those at the same time the smallest right_value. Empty tables give no row.
    Other columns are never read, so their names can't clash.
    """
    spark = left.sparkSession
    left, right = exact(left, left_id, entity, time), exact(right, right_value, entity, time)
    rows = left.count() + right.count()  # Parquet metadata only
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // shard_rows))
    t = F.col(f"`{time}`").cast("double")
    fine = F.col(f"`{entity}`").isNotNull() & t.isNotNull() & ~F.isnan(t) & (F.abs(t) < F.lit(float("inf")))
    range_s = max(RANGE_S, RANGE_TOLERANCES * tolerance) if range_s is None else max(range_s, tolerance)
    at = lambda x: F.floor(x / range_s)
    margin = tolerance + 1e-6
    one = left.where(fine & F.col(f"`{left_id}`").isNotNull()).select(
        F.col(f"`{left_id}`").cast("long").alias("_id"), F.col(f"`{entity}`").cast("long").alias("_entity"), t.alias("_t"), at(t).alias("_range")
    )
    two = right.where(fine & F.col(f"`{right_value}`").isNotNull()).select(
        F.col(f"`{right_value}`").cast("long").alias("_value"), F.col(f"`{entity}`").cast("long").alias("_entity"), t.alias("_t"), F.explode(F.sequence(at(t - margin), at(t + margin))).alias("_range")
    )
    shard = F.pmod(F.xxhash64("_entity", "_range"), F.lit(shards)).alias("_shard")
    one, two = one.select("*", shard), two.select("*", shard)
    found = one.groupBy("_shard").cogroup(two.groupBy("_shard")).applyInArrow(lambda x, y: _search(x, y, tolerance), "_id long, _value long, _gap double")
    return found.select(F.col("_id").alias(left_id), F.col("_value").alias(right_value), F.col("_gap").alias("gap_s"))


def marker_frames(readings: DataFrame, frames: DataFrame) -> DataFrame:
    """Touch readings with the frame of their episode nearest in time, at most 0.04 s away."""
    return nearest_in_time(readings, frames, "episode_index", "timestamp", "reading_id", "frame_index", 0.04)
