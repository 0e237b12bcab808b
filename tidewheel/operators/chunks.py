"""Frames in bounded, ordered chunks for vectorised work in Arrow batches.

An episode is cut by frame_index, so that one that holds a third of all rows is still spread over many tasks; within a task whole chunks
are handed on, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import partitions

#: Rows gathered before a block of whole groups is handed on.
BLOCK_ROWS = 60_000


def plain(name: str) -> str:
    """A column's name without dots, which the Arrow stages can't resolve."""
    return name.replace(".", "_")


def chunk_rows(frames: DataFrame, columns: list[str], length: int) -> DataFrame:
    """Rows with their chunk = frame_index // length, not yet gathered.

    Dots in column names become underscores. Rows without episode_index or frame_index belong to no chunk and are left out.
    """
    base = frames.where("episode_index is not null and frame_index is not null")
    picked = ["episode_index", "frame_index", *columns, "received_at"]
    return base.select(*(F.col(f"`{c}`").alias(plain(c)) for c in dict.fromkeys(picked)), F.floor(F.col("frame_index") / F.lit(length)).alias("chunk"))


def in_chunks(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Rows by (episode_index, chunk), ordered by frame_index and received_at, in as many partitions as the source's size asks for.

    The rows must not be a union of tables partitioned so already: Spark would take that union for partitioned and gather nothing.
    """
    return rows.repartition(partitions(source), "episode_index", "chunk").sortWithinPartitions("episode_index", "chunk", "frame_index", "received_at")


def frame_chunks(frames: DataFrame, columns: list[str], length: int) -> DataFrame:
    """chunk_rows, gathered by in_chunks."""
    return in_chunks(chunk_rows(frames, columns, length), frames)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys: at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held)
        start = starts_of(whole, keys)
        if (last := int(start[-1])) > 0:
            yield whole.slice(0, last).combine_chunks()
            held = whole.slice(last).to_batches()
            n -= last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a new group of a sorted table begins."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        x = ints(table, k)
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def floats(table: pa.Table, name: str) -> np.ndarray:
    """A float column as doubles, null as NaN."""
    return table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def matrix(table: pa.Table, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of float lists as (rows, width) doubles, and which rows hold a list.

    Null lists, null elements and elements a short list lacks are NaN; elements beyond width are left out.
    """
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    there = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if there.all() and (size == width).all():
        return flat.reshape(-1, width), there
    out = np.full((len(column), width), np.nan)
    begin = np.cumsum(size) - size
    for j in range(width):
        ok = size > j
        out[ok, j] = flat[begin[ok] + j]
    return out, there


def first_deliveries(table: pa.Table) -> pa.Table:
    """A frame delivered twice counts once: the first of equal (episode_index, chunk, frame_index) in the order of frame_chunks."""
    keep = starts_of(table, ["episode_index", "chunk", "frame_index"])
    return table if len(keep) == table.num_rows else table.take(pa.array(keep))
