"""Sessions, durable cuts of lineage and size-checked joins."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, as Spark estimates them, up to which a dimension is broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes of stored input that one shuffle partition is made for.
PARTITION_BYTES = 32 << 20
#: Copies of a dimension row, and salts of the fact rows, in a shuffled join.
JOIN_SALTS = 16


def get_spark(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewheel")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEWHEEL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir. Where none is named, a local session gets one of its own; a cluster must name one."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or f"{tempfile.gettempdir()}/tidewheel-{uuid.uuid4().hex}")
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as a Parquet table in the checkpoint folder, so that lost executors cost nothing that was finished.

    Unlike a checkpoint it is read by columns and Spark knows its true size: of a checkpoint it keeps the estimate of what was computed,
    which multiplies with each join until planning alone takes minutes. The table is removed when the program ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes of df as the optimizer estimates them: of files their size, of what is computed an upper guess."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(*inputs: DataFrame) -> int:
    """Shuffle partitions for rows read from these tables: the session's number, or more if the tables are larger. Those of unknown size count for nothing."""
    least = int(inputs[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = sum(n for n in map(size_of, inputs) if n < 1 << 50)
    return max(least, math.ceil(known / PARTITION_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of exactly these names, whatever else the table has: also names that differ in case alone, or twice."""
    there = df.columns
    if missing := [n for n in names if n not in there]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    first = {n: there.index(n) for n in names}
    return df.toDF(*(c if first.get(c) == i else f"__other_{i}" for i, c in enumerate(there))).select(*(F.col(f"`{n}`") for n in names))


def _bytes(df: DataFrame) -> int:
    """Bytes of df's values, measured: strings, lists and maps by their own length."""
    size = F.lit(16)
    for c, kind in df.dtypes:
        c = F.col(f"`{c}`")
        long = F.octet_length(c) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) if kind.startswith(("array", "map", "struct")) else F.lit(0)
        size = size + 16 + F.coalesce(long, F.lit(0))
    return df.agg(F.sum(size)).first()[0] or 0


def attach(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a narrow dimension with one row per key to a fact table.

    The dimension is measured first (one whose inputs may be large is written, so that this costs no second run): up to max_bytes it is
    broadcast; a larger one is copied JOIN_SALTS times and joined on (key, salt), so that a key with a third of all facts is still
    spread over JOIN_SALTS tasks. The salt is a hash of the fact's plain columns: the same again if a lost task is run again.
    """
    if size_of(dim) * 4 > max_bytes:
        dim = cut(dim, "dimension")
    if _bytes(dim) <= max_bytes:
        return fact.join(F.broadcast(dim), key, how)
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(JOIN_SALTS - 1).cast("long"))))
    plain = [F.col(f"`{c}`") for c, kind in fact.dtypes if not kind.startswith(("array", "struct", "map"))]
    spread = fact.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(JOIN_SALTS).cast("long")))
    return spread.join(salted, [key, "_salt"], how).drop("_salt")
