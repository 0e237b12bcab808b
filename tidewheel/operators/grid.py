"""Problem 3: irregular readings onto a regular grid, missing cells filled by a low-rank factorisation."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.chunks import floats, ints, matrix, starts_of, whole_groups
from tidewheel.session import attach, cut, exact, partitions

#: Rank of the factorisation, and alternations.
RANK, ROUNDS = 16, 3
#: Readings that a row of the matrix needs in its window, and how near one must be on each side of a filled cell.
SUPPORT, REACH = 8, 12
#: Grid points that a window hands out, and those it sees on either side: all in reach of them.
CORE, MARGIN = 24, REACH
WIDE = CORE + 2 * MARGIN
#: A reading that stands out from those up to BESIDE before and after it by more than so many usual steps of its row takes no part in the
#: fit; others are weighed down as their residual grows beyond so many times what is common.
BESIDE, OUTLYING, COMMON, REWEIGHTED = 3, 10.0, 4.0, 2
#: Noise of a reading, as a share of its row's variance, in the first alternation; later ones measure it.
FIRST_NOISE = 1e-3
#: Residuals are counted by their binary logarithm, in steps of an eighth.
_LOG_LEAST, _LOG_BINS = -60, 800
#: Windows worked on at once, and blocks of an episode's grid made from one row.
_SLICE, _BLOCKS = 1_000, 4_096

_WINDOW = "episode_index long, block long, fps int, points long, seen array<boolean>, used array<boolean>, cells array<float>"
_GRID = "episode_index long, grid_index long, time_s double, state array<float>, status string"


def _windows(width: int):  # noqa: ANN202
    """Rows of one (episode, block), the window's own row first, to one matrix of width x WIDE cells; of several frames at a point the nearest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["episode_index", "block"]):
            starts = starts_of(t, ["episode_index", "block"])
            ep, block = ints(t, "episode_index"), ints(t, "block")
            points, fps = floats(t, "points")[starts], floats(t, "fps")[starts]
            k = floats(t, "k")
            group = np.zeros(t.num_rows, np.int64)
            group[starts] = 1
            group = np.cumsum(group) - 1
            at = np.full(t.num_rows, -1.0)
            frame = ~np.isnan(k)
            at[frame] = k[frame] - block[frame] * CORE + MARGIN
            new = np.ones(t.num_rows, bool)
            new[1:] = (group[1:] != group[:-1]) | (at[1:] != at[:-1])
            rows = np.flatnonzero(frame & new)
            x, _ = matrix(t.take(pa.array(rows)), "state", width)
            cells = np.full((len(starts), WIDE, width), np.nan, np.float32)
            seen = np.zeros((len(starts), WIDE), bool)
            cells[group[rows], at[rows].astype(np.int64)] = x
            seen[group[rows], at[rows].astype(np.int64)] = True
            use = np.flatnonzero(~np.isnan(points))
            n = len(use)
            by_element = cells[use].transpose(0, 2, 1)
            x = by_element.reshape(n * width, WIDE).astype(np.float64)
            used = np.isfinite(x)
            used &= ~outlying(x, used)
            lists = lambda a, size: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(a.ravel()))
            yield pa.RecordBatch.from_pydict(
                {
                    "episode_index": ep[starts][use], "block": block[starts][use], "fps": fps[use].astype(np.int32), "points": points[use].astype(np.int64),
                    "seen": lists(seen[use], WIDE), "used": lists(used, WIDE * width), "cells": lists(by_element, WIDE * width),
                }
            )

    return work


@dataclass
class Model:
    """What is known of the cells of a row: basis @ factors, with the factors' variances and the variance of a reading's noise (None: not yet)."""

    basis: np.ndarray
    variance: np.ndarray
    noise: float | None = None


@dataclass
class Cells:
    """Rows (window x element) of WIDE cells, centred and scaled by row; which are finite readings, and which of them take part in the fit."""

    y: np.ndarray
    ok: np.ndarray
    used: np.ndarray
    middle: np.ndarray
    scale: np.ndarray


def outlying(x: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Which readings lie above, or below, one of the BESIDE readings before them and one after them by more than OUTLYING usual steps.

    The first and the last reading of a row must lie so far from all BESIDE readings next to them, for each point up to the nearest. The usual step of a row is the median
    of its non-zero changes; a row without any has no such reading.
    """
    n = ok.sum(1)
    order = np.argsort(~ok, axis=1, kind="stable")
    v = np.take_along_axis(np.where(ok, x, np.nan), order, 1)
    steps = np.abs(np.diff(v, axis=1))
    steps[~(steps > 0)] = np.inf
    steps.sort(axis=1)
    moved = np.isfinite(steps).sum(1)
    usual = np.where(moved > 0, np.take_along_axis(steps, np.maximum(moved - 1, 0)[:, None] // 2, 1)[:, 0], np.inf)
    beside = np.pad(v, ((0, 0), (BESIDE, BESIDE)), constant_values=np.nan)
    wide = v.shape[1]
    side = lambda f, sign: functools.reduce(f, (beside[:, BESIDE + sign * j : BESIDE + sign * j + wide] for j in range(1, BESIDE + 1)))
    least, most = [side(np.fmin, -1), side(np.fmin, 1)], [side(np.fmax, -1), side(np.fmax, 1)]
    away = np.ones(v.shape)
    for x in range(2):  # the first and the last reading are held against all on the one side they have
        lone = np.isnan(least[x])
        least[x], most[x] = np.where(lone, most[1 - x], least[x]), np.where(lone, least[1 - x], most[x])
        points = np.abs(np.diff(order, axis=1, append=order[:, -1:]) if x == 0 else np.diff(order, axis=1, prepend=order[:, :1]))
        away = np.where(lone, np.maximum(points, 1), away)
    above, below = np.fmin(v - least[0], v - least[1]), np.fmin(most[0] - v, most[1] - v)
    above, below = (np.where(np.isnan(d), -np.inf, d) for d in (above, below))
    bad = (np.fmax(above, below) > OUTLYING * usual[:, None] * away) & (np.arange(wide) < n[:, None])
    out = np.zeros_like(ok)
    np.put_along_axis(out, order, bad, 1)
    return out


def _flat(batch: pa.RecordBatch, name: str, *shape: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, *shape)


def _cells(x: np.ndarray, used: np.ndarray) -> Cells:
    """Rows of WIDE cells, centred on their median and scaled by their spread."""
    ok, n = np.isfinite(x), used.sum(1)
    sorted_ = np.sort(np.where(used, x, np.inf), axis=1)
    pick = lambda k: np.take_along_axis(sorted_, k[:, None], 1)[:, 0]
    middle = np.where(n > 0, (pick(np.maximum(n - 1, 0) // 2) + pick(np.minimum(n // 2, WIDE - 1))) / 2, 0.0)
    y = np.where(ok, x - middle[:, None], 0.0)
    spread = np.sqrt((y * y * used).sum(1) / np.maximum(n, 1))
    scale = np.where(spread > 0, spread, 1.0)
    return Cells(y / scale[:, None], ok, used, middle, scale)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            yield whole.slice(at, _SLICE)


def _noise(c: Cells, m: Model) -> np.ndarray:
    return np.full(len(c.scale), FIRST_NOISE) if m.noise is None else m.noise / c.scale**2


def _sources(c: Cells, weight: np.ndarray, m: Model) -> np.ndarray:
    """The half step for the sources: each row's factors by weighted least squares over its own readings, drawn to 0 as noise is to variance."""
    r = m.basis.shape[1]
    products = (m.basis[:, :, None] * m.basis[:, None, :]).reshape(WIDE, r * r).astype(np.float32)
    floor = np.maximum(m.variance, 1e-9 * max(m.variance.max(), 1e-9))
    left = (weight.astype(np.float32) @ products).reshape(-1, r, r) + np.minimum(_noise(c, m), 1e12)[:, None, None] * np.diag(1 / floor) + 1e-6 * np.eye(r)
    return np.linalg.solve(left, ((weight * c.y) @ m.basis)[:, :, None])[:, :, 0]


def _weights(c: Cells, u: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the readings by their residuals, 0 for those far off, and the residuals."""
    residual = np.abs(c.y - u @ m.basis.T)
    n = c.used.sum(1)
    common = np.take_along_axis(np.sort(np.where(c.used, residual, np.inf), axis=1), np.maximum(n - 1, 0)[:, None] // 2, 1)[:, 0]
    common = 1.4826 * np.where(n > 0, common, 0.0) + np.sqrt(_noise(c, m) if m.noise is not None else 0.0) + 1e-6
    weight = np.where(c.ok, 1 / (1 + (residual / (COMMON * common[:, None])) ** 2) ** 2, 0.0)
    return np.where(weight < 0.05, 0.0, weight), residual * c.scale[:, None]


def _times(width: int, m: Model):  # noqa: ANN202
    """The half step for the times: this partition's share of the normal equations of each grid column, of the factors' moments and of the residuals' counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = m.basis.shape[1]
        left, right, moments, bins = np.zeros((WIDE, r * r)), np.zeros((WIDE, r)), np.zeros((r, r)), np.zeros(_LOG_BINS)
        n = 0
        for batch in _slices(batches):
            used = _flat(batch, "used", width, WIDE).reshape(-1, WIDE)
            fit = used.sum(1) >= SUPPORT
            c = _cells(_flat(batch, "cells", width, WIDE).reshape(-1, WIDE)[fit].astype(np.float64), used[fit])
            u = _sources(c, c.used, m)
            weight, residual = _weights(c, u, m)
            trusted = (u / (1e-3 + _noise(c, m))[:, None]).astype(np.float32)
            left += weight.T.astype(np.float32) @ (trusted[:, :, None] * u.astype(np.float32)[:, None, :]).reshape(len(u), r * r)
            right += (weight * c.y).T @ trusted
            moments += u.T @ u
            n += len(u)
            some = residual[(weight > 0) & (residual > 0)]
            bins += np.bincount(np.clip(np.floor(8 * np.log2(some)).astype(np.int64) - 8 * _LOG_LEAST, 0, _LOG_BINS - 1), minlength=_LOG_BINS)
        total = np.concatenate([left.ravel(), right.ravel(), moments.ravel(), bins, [n]])
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size), "value": total})

    return work


def _next_model(total: np.ndarray, r: int) -> Model:
    """The times' half step solved; the basis is made orthogonal, its vectors in the order of the factors' variances."""
    left, right, moments, bins, n = np.split(total, np.cumsum([WIDE * r * r, WIDE * r, r * r, _LOG_BINS]))
    left, moments = left.reshape(WIDE, r, r), moments.reshape(r, r) / n[0]
    ridge = max(1e-6 * np.trace(left, axis1=1, axis2=2).max(), 1e-12)
    q, upper = np.linalg.qr(np.linalg.solve(left + ridge * np.eye(r), right.reshape(WIDE, r, 1))[:, :, 0])
    variance, turn = np.linalg.eigh(upper @ moments @ upper.T)
    middle = np.searchsorted(np.cumsum(bins), max(bins.sum(), 1) / 2)
    return Model(q @ turn[:, ::-1], variance[::-1], (1.4826 * 2.0 ** ((middle + 0.5) / 8 + _LOG_LEAST)) ** 2)


def _fill(width: int, m: Model):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = np.arange(MARGIN, MARGIN + CORE)
        for batch in _slices(batches):
            n = batch.num_rows
            k = ints(batch, "block")[:, None] * CORE + np.arange(CORE)
            inside = k < ints(batch, "points")[:, None]
            seen = _flat(batch, "seen", WIDE)[:, core]
            cells, used = _flat(batch, "cells", width, WIDE), _flat(batch, "used", width, WIDE)
            value = cells[:, :, core].transpose(0, 2, 1).copy()
            null = np.zeros(value.shape, bool)
            open_ = np.flatnonzero((inside & ~seen).any(1))  # the other windows have nothing to fill
            if len(open_):
                c = _cells(cells[open_].reshape(-1, WIDE).astype(np.float64), used[open_].reshape(-1, WIDE))
                u = _sources(c, c.used, m)
                for _ in range(REWEIGHTED):
                    u = _sources(c, _weights(c, u, m)[0], m)
                guess = (u @ m.basis.T * c.scale[:, None] + c.middle[:, None]).reshape(-1, width, WIDE)[:, :, core].transpose(0, 2, 1)
                place = np.where(c.used, np.arange(WIDE), -WIDE)
                before = np.arange(WIDE) - np.maximum.accumulate(place, axis=1)
                place = np.where(c.used, np.arange(WIDE), 3 * WIDE)
                after = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1] - np.arange(WIDE)
                supported = (before <= REACH) & (after <= REACH) & (c.used.sum(1) >= SUPPORT)[:, None]
                missing = ~seen[open_][:, :, None]
                null[open_] = missing & ~supported.reshape(-1, width, WIDE)[:, :, core].transpose(0, 2, 1)
                with np.errstate(over="ignore"):
                    value[open_] = np.where(missing, guess.astype(np.float32), value[open_])
            status = np.where(seen, "observed", np.where(null.any(2), "marked", "filled"))[inside]
            value, null = value[inside], null[inside]
            ep, fps = (np.repeat(ints(batch, c), CORE).reshape(n, CORE)[inside] for c in ("episode_index", "fps"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(k[inside]) + 1, dtype=np.int32) * width), pa.array(value.ravel(), pa.float32(), mask=null.ravel()))
            yield pa.RecordBatch.from_pydict({"episode_index": ep, "grid_index": k[inside], "time_s": k[inside] / fps, "state": lists, "status": pa.array(status)})

    return work


def first_model(rank: int = RANK) -> Model:
    """Cosines of rising frequency over a window, of falling variance: where the alternation begins."""
    t = (np.arange(WIDE) + 0.5) / WIDE
    return Model(np.cos(np.pi * t[:, None] * np.arange(rank)) * np.sqrt(2 / WIDE), WIDE / (1.0 + np.arange(rank)) ** 4)


def onto_grid(frames: DataFrame, episodes: DataFrame, field: str = "observation.state", width: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """One row per grid point k / fps of each episode: episode_index, grid_index, time_s, state, status.

    The grid runs from 0 to the point nearest the episode's last timestamp. A point with a frame within half a period is `observed` and
    keeps that frame's value exactly (of several frames the nearest in time, then the smallest frame_index), not-finite elements
    included. The others are filled from a factorisation of the matrix whose rows are the sources (window of an episode x element) and
    whose columns are the grid times within a window, fitted by alternating least squares over the readings of all episodes: the
    sources' factors are solved in place, the times' normal equations are summed over the cluster, about 14,000 numbers per
    alternation. Spikes take no part (`outlying`) and the other readings are weighed by their residuals, so wrong readings, which stay
    in the result where they were observed, do not bend the fill. A missing cell is `filled` if its row has SUPPORT readings that take
    part and one of them within REACH points on both sides; otherwise its element is null and the point is `marked`.

    The windows are written once, as a Parquet table in the checkpoint folder, and read by each alternation; it is
    removed when the program ends.

    Frames with null or not-finite timestamp, null field or null episode_index take no part (but any timestamp counts for the last one);
    null elements are missing cells; episodes without a row in episodes, without a positive fps or without any timestamp give no row.
    Repeated rows change nothing; of several fps of one episode the smallest counts. Empty tables give no row.
    """
    frames, episodes = exact(frames, "episode_index", "frame_index", "timestamp", field), exact(episodes, "episode_index", "fps")
    t = F.col("timestamp").cast("double")
    fine = frames.where(F.col("episode_index").isNotNull() & t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")))
    rates = episodes.where("episode_index is not null and fps > 0").groupBy("episode_index").agg(F.min("fps").cast("int").alias("fps"))
    nearest = F.floor(t * F.col("fps") + 0.5)
    # Last timestamps first, on two narrow columns with partial aggregation; then one row per window of each episode.
    last = fine.groupBy("episode_index").agg(F.max(t).alias("timestamp")).join(rates, "episode_index")
    plan = last.select("episode_index", "fps", (nearest + 1).alias("points")).where("points > 0")
    nulls = [F.lit(None).cast(x).alias(c) for c, x in (("k", "long"), ("gap", "double"), ("frame_index", "long"), ("state", "array<float>"))]
    # two steps, so that one far timestamp makes no endless list
    far = plan.withColumn("_far", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("points") - 1) / (CORE * _BLOCKS)))))
    most = F.least(F.floor((F.col("points") - 1) / CORE), F.col("_far") * _BLOCKS + _BLOCKS - 1)
    own = far.select("episode_index", F.explode(F.sequence(F.col("_far") * _BLOCKS, most)).alias("block"), "fps", "points", *nulls)
    k = F.col("k")
    blocks = F.sequence(F.greatest(F.lit(0), F.floor((k - MARGIN) / CORE)), F.floor((k + MARGIN) / CORE))
    state = F.col(f"`{field}`")
    read = attach(fine.where(state.isNotNull()).select("episode_index", "timestamp", "frame_index", state.cast("array<float>").alias("state")), rates, "episode_index")
    read = read.withColumn("k", nearest).where(k >= 0).withColumn("gap", F.abs(t - k / F.col("fps")))
    given = read.select("episode_index", F.explode(blocks).alias("block"), F.lit(None).cast("int").alias("fps"), F.lit(None).cast("long").alias("points"), "k", "gap", "frame_index", "state")
    rows = own.unionByName(given).repartition(partitions(frames), "episode_index", "block").sortWithinPartitions("episode_index", "block", "k", "gap", "frame_index")
    windows = cut(rows.mapInArrow(_windows(width), _WINDOW), "grid")
    model = first_model()
    r = model.basis.shape[1]
    for _ in range(rounds):
        sums = windows.select("used", "cells").mapInArrow(_times(width, model), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # about 14,000 rows
        total = np.zeros(WIDE * (r * r + r) + r * r + _LOG_BINS + 1)
        total[[x["cell"] for x in sums]] = [x["value"] for x in sums]
        if not total[-1]:
            break
        model = _next_model(total, r)
    return windows.mapInArrow(_fill(width, model), _GRID)
