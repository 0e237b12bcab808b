"""Samples, batches and mixes whose sizes are exact and whose choice depends on keys and seeds alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.segments import numbered, positions
from tidewheel.session import cut, partitions

#: Draws that one row is unfolded to at once.
DRAWS = 65_536


def linspace(i: Column, n: Column, m: Column) -> Column:
    """The i-th of m evenly spaced points from 0 to n - 1; the last is exactly n - 1."""
    step = (n - 1).cast("double") / F.greatest(m - 1, F.lit(1))
    return F.when(m == 1, F.lit(0.0)).when(i == m - 1, (n - 1).cast("double")).otherwise(i * step)


def spaced(groups: DataFrame, most: int, rounding: str = "even") -> DataFrame:
    """Explode groups with a size n to `pick`: at most `most` evenly spaced indices, rounded half to even or truncated."""
    m = F.least(F.col("n"), F.lit(most))
    rows = groups.where("n > 0").withColumn("_m", m).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    at = linspace(F.col("_i"), F.col("n"), F.col("_m"))
    return rows.withColumn("pick", (F.rint(at) if rounding == "even" else F.floor(at)).cast("long")).drop("_m", "_i")


def hash_order(key: Column, seed: int) -> Column:
    """MD5 of seed and key, as any engine can take it: an order that is the same at every run and everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of their key: a sample of exact size that is the same at every run.

    The first n places are found by counting rows by the hash's leading digits, so no task holds the sample; only the rows up to the
    digits in which the n-th lies are numbered.
    """
    rows = df.withColumn("_h", hash_order(F.col(key), seed))
    lead = F.substring("_h", 1, 4)
    counts = rows.groupBy(lead.alias("_lead")).agg(F.count("*").alias("_n"))  # at most 65,536 rows
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_lead")))
    last = upto.where(F.col("_upto") >= n).agg(F.min("_lead")).first()[0]
    held = rows if last is None else rows.where(lead <= last)
    return positions(held, ["_h", key]).where(F.col("position") < n).drop("position", "_h")


def batches(df: DataFrame, order: list[str], size: int, drop_last: bool = True) -> DataFrame:
    """Add batch_id and its place `pos` in the batch, counted over the whole table in the given order; an incomplete last batch is dropped or kept."""
    placed = positions(df, order).withColumn("batch_id", F.floor(F.col("position") / size)).withColumn("pos", F.col("position") % size)
    if drop_last:
        n = F.broadcast(df.agg(F.count("*").alias("_n")))  # one row
        placed = placed.crossJoin(n).where((F.col("batch_id") + 1) * size <= F.col("_n")).drop("_n")
    return placed.drop("position")


def shuffled(df: DataFrame, key: str, seed: int, epochs: int = 1) -> DataFrame:
    """Every row once per epoch with `shuffle`, its place's hash: sort or batch by (epoch, shuffle, key)."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return rows.withColumn("shuffle", F.xxhash64(key, "epoch", F.lit(seed)))


def resample(df: DataFrame, source: str, key: str, weights: dict[str, float], seed: int = 0) -> DataFrame:
    """Draws with replacement: floor(total * weight) of each source, each a row of it picked by a hash. Weights must add up to 1.

    Columns: those of df and draw, counted from 0 within a source. A source that is asked for and has no row gives none.
    """
    if abs(sum(weights.values()) - 1) > 1e-6 or min(weights.values()) < 0:
        raise ValueError("weights must be positive and add up to 1")
    counted = df.where(F.col(source).isin(list(weights))).withColumn("_k", hash_order(F.col(key), seed))
    placed = cut(positions(counted, [source, "_k", key]))
    sizes = placed.groupBy(source).agg(F.min("position").alias("_first"), F.count("*").alias("_size"))
    total = F.broadcast(df.agg(F.count("*").alias("_total")))  # one row
    weight = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, float(w))))
    due = sizes.crossJoin(total).withColumn("_due", F.floor(F.col("_total") * F.element_at(weight, F.col(source))))
    draws = numbered(due, "_due", "draw", DRAWS).repartition(partitions(df), "draw")
    # 60 bits of a hash, so that rows of a source are drawn alike
    pick = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(source), F.lit(":"), F.col("draw").cast("string"))), 1, 15), 16, 10).cast("long")
    draws = draws.select("draw", (F.col("_first") + F.pmod(pick, F.col("_size"))).alias("position"))
    return draws.join(placed, "position").drop("position", "_k")
