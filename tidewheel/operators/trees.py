"""Tables of parameters by path, merged and compared: path, shape, dtype, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(reference: DataFrame, loaded: DataFrame, missing: str) -> DataFrame:
    """Loaded values of the paths that the reference has, in the reference's type, and the reference's own of those not loaded whose whole path matches."""
    took = loaded.select("path", F.col("value").alias("_value")).join(reference, "path").select("path", "shape", "dtype", F.col("_value").alias("value"), F.lit("loaded").alias("origin"))
    kept = reference.join(loaded, "path", "left_anti").where(F.col("path").rlike(f"^(?:{missing})$")).select("path", "shape", "dtype", "value", F.lit("reference").alias("origin"))
    return took.unionByName(kept)


def merge_partial(reference: DataFrame, loaded: DataFrame, allowed: str) -> DataFrame:
    """Each path of the reference with its origin: loaded where the shapes are equal; reference where they differ or nothing is loaded and the path matches; else error."""
    l_ = loaded.select("path", F.col("shape").alias("_shape"), F.col("value").alias("_value"))
    both = reference.join(l_, "path", "left")
    fits = F.coalesce(F.col("shape") == F.col("_shape"), F.lit(False))
    origin = F.when(fits, "loaded").when(F.col("path").rlike(f"^(?:{allowed})$"), "reference").otherwise("error")
    return both.select("path", "shape", "dtype", F.when(fits, F.col("_value")).otherwise(F.col("value")).alias("value"), origin.alias("origin"))


def align(reference: DataFrame, loaded: DataFrame) -> DataFrame:
    """The reference's keys with the loaded values, keys compared as text; missing ones null, others dropped."""
    l_ = loaded.select(F.col("key").cast("string").alias("_k"), "value")
    return reference.join(l_, F.col("key").cast("string") == F.col("_k"), "left").select("key", "value")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths at which two tables differ: which side lacks it, or shape, or dtype."""
    one = a.select("path", F.col("shape").alias("s1"), F.col("dtype").alias("d1"), F.lit(True).alias("in1"))
    two = b.select("path", F.col("shape").alias("s2"), F.col("dtype").alias("d2"), F.lit(True).alias("in2"))
    both = one.join(two, "path", "full")
    why = F.when(F.col("in1").isNull(), "only second").when(F.col("in2").isNull(), "only first").when(F.col("s1") != F.col("s2"), "shape").when(F.col("d1") != F.col("d2"), "dtype")
    return both.select("path", why.alias("why")).where("why is not null")
