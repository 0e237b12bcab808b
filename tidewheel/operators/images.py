"""Images in columns: read from bytes or paths, thinned out, and their statistics by channel. An image is a struct of data, h, w and c, row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.projections import is_rgb
from tidewheel.operators.sampling import linspace
from tidewheel.operators.segments import LENGTH, numbered

# How many images of an episode are looked at, and from which size on and to about which size they are thinned out.
FEWEST, MOST, POWER = 100, 10_000, 0.75
LARGE, TARGET = 300, 150

_SUMS = "ep long, channel int, low int, high int, total long, squares long, pixels long"


def embedded(df: DataFrame, column: str, root: str, name: str = "content") -> DataFrame:
    """Add an image column's bytes: those it holds, else the file's that its path names, from root on if it is relative; else null.

    column: a struct of bytes and path. The files are read in tasks, by Spark's own reader, and joined by path, so they may lie in any file
    system it knows.
    """
    path = F.col(f"`{column}`.path")
    full = F.when(path.rlike("^(/|[a-z][a-z0-9+.-]*:)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    bare = lambda p: F.regexp_replace(p, "^file:/*", "/")
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(bare(F.col("path")).alias("_path"), F.col("content").alias("_content"))
    needed = F.when(F.col(f"`{column}`.bytes").isNull(), bare(full))
    return df.withColumn("_path", needed).join(files, "_path", "left").withColumn(name, F.coalesce(F.col(f"`{column}`.bytes"), "_content")).drop("_path", "_content")


def sample_size(n: Column) -> Column:
    """How many of n images are looked at: all up to FEWEST, then n to the power of POWER."""
    return F.greatest(F.least(n, F.lit(FEWEST)), F.least(F.floor(F.pow(n.cast("double"), F.lit(POWER))), F.lit(MOST))).cast("long")


def stride(height: int, width: int) -> int:
    """Of how many pixels one is kept along both sides."""
    return 1 if max(height, width) < LARGE else max(1, max(height, width) // TARGET)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for ep, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h, w, c = (image[k].as_py() for k in ("h", "w", "c"))
            k = stride(h, w)
            x = np.frombuffer(image["data"].as_buffer(), np.uint8).reshape(h, w, c)[::k, ::k].reshape(-1, c)
            wide = x.astype(np.int64)
            rows += zip([ep] * c, range(c), x.min(0).tolist(), x.max(0).tolist(), wide.sum(0).tolist(), (wide * wide).sum(0).tolist(), [len(x)] * c, strict=True)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in _SUMS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def channel_stats(frames: DataFrame, image: str, lengths: DataFrame) -> DataFrame:
    """(ep, channel, min, max, mean, std, count) of an evenly spaced sample of each episode's images, values divided by 255.

    frames: ep, fi and the image; lengths: ep, n. std is the population's; count is the number of images. Large images are thinned out.
    Images that are null or no whole RGB rows are left out. The sample is the operator's definition, as the format's statistics are.
    """
    wanted = numbered(lengths.where("n > 0").withColumn("_m", sample_size(F.col("n"))), "_m", "_i", LENGTH)
    picks = wanted.select("ep", F.rint(linspace(F.col("_i"), F.col("n"), F.col("_m"))).cast("long").alias("fi")).distinct()
    chosen = frames.where(is_rgb(image)).select("ep", "fi", F.col(f"`{image}`").alias("image")).join(picks, ["ep", "fi"], "left_semi")
    sums = chosen.select("ep", "image").mapInArrow(_sums, _SUMS)
    g = sums.groupBy("ep", "channel").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.sum("total").alias("t"), F.sum("squares").alias("s"), F.sum("pixels").alias("n"), F.count("*").alias("count"))
    mean = F.col("t") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("s") / F.col("n") - mean * mean))
    return g.select("ep", "channel", (F.col("a") / 255).alias("min"), (F.col("b") / 255).alias("max"), (mean / 255).alias("mean"), (std / 255).alias("std"), "count")
