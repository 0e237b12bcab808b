"""Problem 4: runs of near-identical consecutive records collapsed to one row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.chunks import first_deliveries, floats, frame_chunks, ints, matrix, plain, starts_of, whole_groups
from tidewheel.session import cut, exact

#: Frame indexes of one chunk of an episode.
CHUNK = 32_768
_PART = (
    "episode_index long, chunk long, kind int, first_frame_index long, last_frame_index long, n long, first_s double, last_s double,"
    " head array<double>, tail array<double>"
)


def _parts(field: str, width: int, tolerance: float, least: int):  # noqa: ANN202
    """Per chunk: kind 0 for a run inside it, 1 for its first run, 2 for its last, 3 for its only one.

    Boundary lookup: the positions at which a run starts are gathered, sorted, and each record finds its run by binary search in them.
    head and tail are the chunk's first and last value, given with kinds 1 to 3.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, ["episode_index", "chunk"]):
            t = first_deliveries(block)
            x, there = matrix(t, field, width)
            if not there.all():
                t, x = t.filter(pa.array(there)), x[there]
            if not t.num_rows:
                continue
            ep, ch, fi, s = ints(t, "episode_index"), ints(t, "chunk"), ints(t, "frame_index"), floats(t, "timestamp")
            groups = starts_of(t, ["episode_index", "chunk"])
            with np.errstate(invalid="ignore"):
                start = np.ones(len(fi), bool)
                start[1:] = ~(np.abs(x[1:] - x[:-1]) <= tolerance).all(1)
            start[groups] = True
            starts = np.flatnonzero(start)
            run = np.searchsorted(starts, np.arange(len(fi)), "right") - 1
            n = np.bincount(run, minlength=len(starts))
            last = starts + n - 1
            s_min, s_max = np.full(len(starts), np.inf), np.full(len(starts), -np.inf)
            ok = np.isfinite(s)
            np.minimum.at(s_min, run[ok], s[ok])
            np.maximum.at(s_max, run[ok], s[ok])
            is_first = np.isin(starts, groups, assume_unique=True)
            is_last = np.append(is_first[1:], True)
            kind = is_first.astype(np.int32) + 2 * is_last.astype(np.int32)
            keep = np.flatnonzero((kind > 0) | (n >= least))
            starts, last, n, kind, s_min, s_max = (a[keep] for a in (starts, last, n, kind, s_min, s_max))
            edge = kind > 0
            values = lambda at: pa.array([x[p].tolist() if e else None for p, e in zip(at, edge, strict=True)], pa.list_(pa.float64()))
            some = np.isfinite(s_min)
            yield pa.RecordBatch.from_pydict(
                {
                    "episode_index": ep[starts], "chunk": ch[starts], "kind": kind, "first_frame_index": fi[starts], "last_frame_index": fi[last], "n": n,
                    "first_s": pa.array(s_min, mask=~some), "last_s": pa.array(s_max, mask=~some), "head": values(starts), "tail": values(last),
                }
            )

    return work


def collapse_runs(frames: DataFrame, field: str = "observation.state", width: int = 7, tolerance: float = 0.0015, least: int = 5, chunk: int = CHUNK) -> DataFrame:
    """One row per longest stretch of at least `least` frames of an episode in which every element differs by at most `tolerance` from the frame before.

    Columns: episode_index, first_frame_index, last_frame_index, n_frames, duration_s (largest less smallest timestamp; null without one).
    Frames are ordered by frame_index; a frame delivered twice counts once; frames whose field is null are left out, so that missing
    rows do not end a stretch; a null or not-finite element ends it. Rows without episode_index or frame_index are left out.
    A chunk's runs at its edges are joined with those of its neighbours over one row per chunk end, so an episode of any length is
    spread over tasks. An empty table gives no row; other columns are not read.
    """
    frames = exact(frames, "episode_index", "frame_index", "timestamp", field, "received_at")
    rows = frame_chunks(frames, ["timestamp", field], chunk)
    # Small: runs of at least `least` frames and two rows per chunk. It is read twice, so it is cut here.
    parts = cut(rows.mapInArrow(_parts(plain(field), width, tolerance, least), _PART))
    w = Window.partitionBy("episode_index").orderBy("first_frame_index")
    near = F.forall(F.zip_with("head", F.lag("tail").over(w), lambda a, b: F.abs(a - b) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))
    goes_on = (F.lag("chunk").over(w) != F.col("chunk")) & near  # NaN is above any tolerance
    edges = (
        parts.where("kind > 0")
        .withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("episode_index", "_run")
        .agg(*(f(c).alias(c) for f, c in ((F.min, "first_frame_index"), (F.max, "last_frame_index"), (F.sum, "n"), (F.min, "first_s"), (F.max, "last_s"))))
        .drop("_run")
    )
    runs = parts.where("kind = 0").select(*edges.columns).unionByName(edges)
    return runs.where(F.col("n") >= least).select(
        "episode_index", "first_frame_index", "last_frame_index", F.col("n").alias("n_frames"), (F.col("last_s") - F.col("first_s")).alias("duration_s")
    )
