"""Problem 5: implausible readings per source, by a Kalman filter over each channel and an exact check of what it points at."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.vectors import nonfinite
from tidewheel.operators.chunks import chunk_rows, first_deliveries, frame_chunks, in_chunks, ints, matrix, plain, starts_of, whole_groups
from tidewheel.operators.stats import exact_percentiles
from tidewheel.session import attach, cut, exact

#: Frame indexes of one chunk of an episode.
CHUNK = 65_536
#: Kalman filter per channel, in usual steps of that channel: standard deviation of the level's walk and of a reading, and the gate.
WALK, READING, GATE = 1.0, 0.5, 4.0
#: After so many withheld updates in a row the filter takes the reading as its new level.
WITHHELD = 3
#: Innovations under this share of the usual step over QUIET readings count as vanished.
VANISHED, QUIET = 0.05, 8
#: Usable readings of a channel that a chunk sees of its neighbours on either side: the longest spike and the reading beyond it.
BESIDE = 4
#: The definition: longest spike, its height in usual steps, shortest stuck stretch, and the range of the other field in it.
SPIKE_LENGTH, SPIKE_STEPS, STUCK_LENGTH, OTHER_RANGE = 3, 10.0, 15, 0.05

_FLAGS = "episode_index long, frame_index long, field string, joint_index long, impossible boolean, stuck boolean, spike boolean, usual_step double"
_STEPS = "episode_index long, channel int, step double, n long"
_EDGES = "episode_index long, channel int, chunk long, frame_index long, value double"
_ENDS = "episode_index long, channel int, chunk long, kind int, first long, last long, n long, low double, high double, value double"


def usual_steps(x: np.ndarray, ok: np.ndarray, group: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Median of the non-zero absolute changes between consecutive ok readings, by group and channel; NaN where there is none."""
    steps = step_sizes(x, ok, group)
    out = np.full((len(starts), x.shape[1]), np.nan)
    ends = np.append(starts[1:], len(x))
    for g, (i, j) in enumerate(zip(starts, ends, strict=True)):
        d = np.sort(steps[i:j], axis=0)
        n = (d < np.inf).sum(0)
        some = np.flatnonzero(n)
        out[g, some] = (d[(n[some] - 1) // 2, some] + d[n[some] // 2, some]) / 2
    return out


def step_sizes(x: np.ndarray, ok: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Non-zero absolute change from the ok reading before, at each reading; infinite where there is none."""
    out = np.full(x.shape, np.inf)
    for c in range(x.shape[1]):
        at = np.flatnonzero(ok[:, c])
        v = x[at, c]
        d = np.abs(v[1:] - v[:-1])
        use = (group[at[1:]] == group[at[:-1]]) & (d > 0)
        out[at[1:][use], c] = d[use]
    return out


def kalman(x: np.ndarray, ok: np.ndarray, starts: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local-level filter over all groups and channels at once, stepping through time.

    Returns which readings have a standardised innovation above the gate, and at which the innovations of the last QUIET readings have
    all but vanished. Updates of flagged readings are withheld, up to WITHHELD in a row. Readings that are not ok change nothing: the walk
    goes on per ok reading, so that after one that was taken the gate is under 5 usual steps, whatever lies between.
    """
    n, channels = x.shape
    length = np.diff(np.append(starts, n))
    order = np.argsort(-length, kind="stable")
    begin, length, scale = starts[order], length[order], np.where(scale > 0, scale, 1e-6)[order]
    groups = len(begin)
    flagged, quiet = np.zeros((n, channels), bool), np.zeros((n, channels), bool)
    level, var = np.zeros((groups, channels)), np.full((groups, channels), np.inf)
    held, calm = np.zeros((groups, channels), np.int16), np.zeros((groups, channels), np.int16)
    walk, noise, small = (WALK * scale) ** 2, (READING * scale) ** 2, VANISHED * scale
    active = np.searchsorted(-length, -np.arange(1, (length[0] if groups else 0) + 1), "right")
    for t, m in enumerate(active):
        rows = begin[:m] + t
        v, use = x[rows], ok[rows]
        fresh = np.isinf(var[:m])
        ahead = var[:m] + walk[:m]
        innovation = np.abs(v - level[:m])
        total = ahead + noise[:m]
        out = use & ~fresh & (innovation > GATE * np.sqrt(total))
        flagged[rows] = out
        take = use & (~out | (held[:m] >= WITHHELD))
        restart = take & (fresh | out)
        with np.errstate(invalid="ignore"):
            gain = np.where(restart, 1.0, ahead / total)
            level[:m] = np.where(restart, v, np.where(take, level[:m] + gain * (v - level[:m]), level[:m]))
            var[:m] = np.where(restart, noise[:m], np.where(take, (1 - gain) * ahead, np.where(use, ahead, var[:m])))
        held[:m] = np.where(use, np.where(out & ~take, held[:m] + 1, 0), held[:m])
        calm[:m] = np.where(use, np.where(~fresh & (innovation < small[:m]), calm[:m] + 1, 0), calm[:m])
        quiet[rows] = calm[:m] >= QUIET
    return flagged, quiet


def _spikes(v: np.ndarray, group: np.ndarray, candidate: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Which readings of a channel belong to one to three that stand out from both neighbours; only candidates and those near them are looked at."""
    n = len(v)
    out = np.zeros(n, bool)
    at = np.flatnonzero(candidate)
    if not len(at):
        return out
    at = np.unique(np.clip((at[:, None] + np.arange(-SPIKE_LENGTH, SPIKE_LENGTH + 1)).ravel(), 0, n - 1))
    for length in range(1, SPIKE_LENGTH + 1):
        i = at[(at > 0) & (at + length < n)]
        i = i[(group[i - 1] == group[i + length])]
        if not len(i):
            continue
        body = v[i[:, None] + np.arange(length)]
        before, after, least = v[i - 1], v[i + length], SPIKE_STEPS * step[i]
        low, high = body.min(1), body.max(1)
        hit = ((low - before > least) & (low - after > least)) | ((before - high > least) & (after - high > least))
        out[(i[hit][:, None] + np.arange(length)).ravel()] = True
    return out


def _stretches(v: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of equal values of a channel begin, and their lengths. Not-finite values are no stretch but by themselves."""
    start = np.ones(len(v), bool)
    start[1:] = ~((v[1:] == v[:-1]) & np.isfinite(v[1:])) | (group[1:] != group[:-1])
    begin = np.flatnonzero(start)
    return begin, np.diff(np.append(begin, len(v)))


def _stuck(v: np.ndarray, other: np.ndarray, group: np.ndarray, quiet: np.ndarray, fi: np.ndarray, across: dict[int, list[tuple[int, int]]]) -> np.ndarray:
    """Which readings of a channel lie in a stretch of equal values that the filter calls quiet, while the other field moves.

    across: by group, the stuck stretches over chunk borders; a stretch that is part of one is stuck, however little of it lies here.
    """
    begin, length = _stretches(v, group)
    out = np.zeros(len(v), bool)
    long = length >= STUCK_LENGTH
    for i, k in zip(begin[long], length[long], strict=True):
        if quiet[i : i + k].any():
            o = other[i : i + k]
            o = o[np.isfinite(o)]
            out[i : i + k] = len(o) > 0 and o.max() - o.min() > OTHER_RANGE
    for g, stretches in across.items():
        lo, hi = np.searchsorted(group, [g, g + 1])
        for first, last in stretches:
            out[lo:hi] |= (fi[lo:hi] >= first) & (fi[lo:hi] <= last)
    return out


def _read(block: pa.Table, fields: list[str], width: int, lower: np.ndarray, upper: np.ndarray):  # noqa: ANN202
    if block.column("frame_index").null_count:
        block = block.filter(block.column("frame_index").is_valid())
    t = first_deliveries(block)
    both = [matrix(t, plain(f), width) for f in fields]
    x, there = np.hstack([m for m, _ in both]), np.repeat(np.column_stack([h for _, h in both]), width, axis=1)
    lo, hi = (np.tile(a.astype(np.float32).astype(np.float64), len(fields)) for a in (lower, upper))  # readings are single precision
    with np.errstate(invalid="ignore"):
        ok = there & np.isfinite(x) & (x >= lo) & (x <= hi)
    starts = starts_of(t, ["episode_index", "chunk"])
    group = np.zeros(t.num_rows, np.int64)
    group[starts] = 1
    return t, x, there, ok, starts, np.cumsum(group) - 1


@dataclass
class Told:
    """What a block's chunks know of their neighbours, by group: usual steps, stuck stretches over borders, and by channel the readings before and after."""

    steps: np.ndarray
    across: list[dict[int, list[tuple[int, int]]]]
    before: dict[tuple[int, int], list[float]]
    after: dict[tuple[int, int], list[float]]


def _told(block: pa.Table, t: pa.Table, starts: np.ndarray, steps: np.ndarray, channels: int) -> Told:
    """From the rows without frame_index that come before a chunk's own."""
    place = {k: g for g, k in enumerate(zip(ints(t, "episode_index")[starts].tolist(), ints(t, "chunk")[starts].tolist(), strict=True))}
    told = Told(steps.copy(), [{} for _ in range(channels)], {}, {})
    for r in block.filter(block.column("frame_index").is_null()).select(["episode_index", "chunk", "_steps", "_across", "_beside"]).to_pylist():
        g = place.get((r["episode_index"], r["chunk"]))
        if g is not None:
            told.steps[g] = [np.nan if x is None else x for x in r["_steps"] or [None] * channels]
            for x in r["_across"] or ():
                told.across[x["channel"]].setdefault(g, []).append((x["first"], x["last"]))
            for x in r["_beside"] or ():
                if x["before"]:
                    told.before[g, x["channel"]] = x["before"]
                if x["after"]:
                    told.after[g, x["channel"]] = x["after"]
    return told


def _between(x: np.ndarray, ok: np.ndarray, starts: np.ndarray, told: Told) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each group between BESIDE rows of the readings before it and as many of those after it, channel by channel.

    Such a row is no frame: what it holds in one channel was read at another time than in the next. Also where the groups begin then,
    each row's group, and the rows that are the groups' own.
    """
    sizes = np.diff(np.append(starts, len(x)))
    at = np.arange(len(x)) + np.repeat(BESIDE * (1 + 2 * np.arange(len(starts))), sizes)
    n = len(x) + 2 * BESIDE * len(starts)
    wide, usable = np.full((n, x.shape[1]), np.nan), np.zeros((n, x.shape[1]), bool)
    wide[at], usable[at] = x, ok
    begin = starts + 2 * BESIDE * np.arange(len(starts))
    for readings, where in ((told.before, begin), (told.after, begin + BESIDE + sizes)):
        for (g, c), values in readings.items():
            rows = where[g] + np.arange(len(values)) + (BESIDE - len(values) if readings is told.before else 0)
            wide[rows, c], usable[rows, c] = values, True
    return wide, usable, begin, np.repeat(np.arange(len(starts)), sizes + 2 * BESIDE), at


def _edges(fields: list[str], width: int, lower: np.ndarray, upper: np.ndarray):  # noqa: ANN202
    """The first and the last BESIDE usable readings of each channel of each chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, ["episode_index", "chunk"], 120_000):
            t, x, _, ok, _, group = _read(block, fields, width, lower, upper)
            ep, ch, fi = (ints(t, c) for c in ("episode_index", "chunk", "frame_index"))
            for c in range(2 * width):
                here = np.flatnonzero(ok[:, c])
                if not len(here):
                    continue
                starts = np.flatnonzero(np.append(True, group[here[1:]] != group[here[:-1]]))
                sizes = np.diff(np.append(starts, len(here)))
                k = np.arange(len(here)) - np.repeat(starts, sizes)
                r = here[(k < BESIDE) | (np.repeat(sizes, sizes) - k <= BESIDE)]
                yield pa.RecordBatch.from_pydict({"episode_index": ep[r], "channel": np.full(len(r), c, np.int32), "chunk": ch[r], "frame_index": fi[r], "value": x[r, c]})

    return work


def _ends(fields: list[str], width: int, lower: np.ndarray, upper: np.ndarray):  # noqa: ANN202
    """The stretches of equal values at both ends of each chunk, by channel: kind 1 the first, 2 the last, 3 the only one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, ["episode_index", "chunk"], 120_000):
            t, x, there, _, _, group = _read(block, fields, width, lower, upper)
            ep, ch, fi = (ints(t, c) for c in ("episode_index", "chunk", "frame_index"))
            for c in range(2 * width):
                here = np.flatnonzero(there[:, c])
                if not len(here):
                    continue
                begin, length = _stretches(x[here, c], group[here])
                g = group[here[begin]]
                first = np.append(True, g[1:] != g[:-1])
                kind = (first + 2 * np.append(first[1:], True)).astype(np.int32)
                o = x[here, (1 - c // width) * width + c % width]
                o = np.where(np.isfinite(o), o, np.nan)
                low, high = np.fmin.reduceat(o, begin), np.fmax.reduceat(o, begin)
                at = np.flatnonzero(kind)
                a, b = here[begin[at]], here[begin[at] + length[at] - 1]
                nan = np.isnan(low[at])
                yield pa.RecordBatch.from_pydict(
                    {
                        "episode_index": ep[a], "channel": np.full(len(at), c, np.int32), "chunk": ch[a], "kind": kind[at], "first": fi[a], "last": fi[b], "n": length[at],
                        "low": pa.array(low[at], mask=nan), "high": pa.array(high[at], mask=nan), "value": x[a, c],
                    }
                )

    return work


def _flag(fields: list[str], names: list[str], width: int, lower: np.ndarray, upper: np.ndarray, known: bool):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, ["episode_index", "chunk"], 120_000):
            t, x, there, ok, starts, group = _read(block, fields, width, lower, upper)
            if not t.num_rows:
                continue
            told = Told(usual_steps(x, ok, group, starts), [{} for _ in range(2 * width)], {}, {})
            wide, usable, begin, of, at = x, ok, starts, group, np.arange(len(x))
            if known:
                told = _told(block, t, starts, told.steps, 2 * width)
                wide, usable, begin, of, at = _between(x, ok, starts, told)
            steps = told.steps
            flagged, quiet = kalman(wide, usable, begin, steps)
            ep, fi = ints(t, "episode_index"), ints(t, "frame_index")
            for c in range(2 * width):
                f, j = divmod(c, width)
                here = np.flatnonzero(there[:, c])
                impossible = ~ok[here, c]
                # the filter sees no impossible ones
                stuck = _stuck(x[here, c], x[here, (1 - f) * width + j], group[here], quiet[at[here], c] | impossible, fi[here], told.across[c])
                spike = np.zeros(len(wide), bool)
                fine = np.flatnonzero(usable[:, c])
                step = steps[of[fine], c]
                spike[fine] = _spikes(wide[fine, c], of[fine], flagged[fine, c] & ~np.isnan(step), step)
                spike = spike[at[here]]
                hit = np.flatnonzero(impossible | stuck | spike)
                if len(hit):
                    r = here[hit]
                    u = steps[group[r], c]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "episode_index": ep[r], "frame_index": fi[r], "field": pa.array([names[f]] * len(r)), "joint_index": np.full(len(r), j, np.int64),
                            "impossible": impossible[hit], "stuck": stuck[hit], "spike": spike[hit], "usual_step": pa.array(u, mask=np.isnan(u)),
                        }
                    )

    return work


def _count_steps(fields: list[str], width: int, lower: np.ndarray, upper: np.ndarray):  # noqa: ANN202
    """How often each step occurs within a chunk, by channel."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, ["episode_index", "chunk"], 120_000):
            t, x, _, ok, starts, group = _read(block, fields, width, lower, upper)
            steps = step_sizes(x, ok, group)
            ep = ints(t, "episode_index")
            for i, k in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
                for c in range(x.shape[1]):
                    d = steps[i:k, c]
                    value, n = np.unique(d[d < np.inf], return_counts=True)
                    if len(value):
                        yield pa.RecordBatch.from_pydict({"episode_index": np.full(len(n), ep[i]), "channel": np.full(len(n), c, np.int32), "step": value, "n": n})

    return work


def implausible_readings(
    frames: DataFrame, limits: DataFrame, fields: tuple[str, str] = ("observation.state", "action"), names: tuple[str, str] = ("state", "action"), chunk: int = CHUNK
) -> DataFrame:
    """One row per reading that cannot be true, with why: impossible (not finite or outside limits), stuck, or spike.

    A Kalman filter per episode, field and joint, scaled by the joint's usual step (the median of its non-zero changes), points at
    readings whose standardised innovation is above the gate and at stretches whose innovations vanish; those and their neighbours are
    then held against the definition: a spike is one to three readings beyond both neighbours by more than ten usual steps (impossible
    readings left out beforehand), stuck are 15 or more equal readings while the other field's finite values range over more than 0.05.

    limits has joint_index, lower_rad and upper_rad (7 rows; null or missing: no limit). A frame delivered twice counts once; frames
    whose field is null are left out for that field; null elements count as not finite; rows without episode_index or frame_index are
    left out. Episodes are cut into chunks of frame indexes, so one episode may hold any part of all rows; of its neighbours a chunk is
    told, by channel, the usable readings nearest to it, however far off; the usual step of an episode in several chunks is the exact
    median over all of them, and stuck stretches over chunk borders are joined. So the result does not depend on the chunks. An empty
    table gives no row.
    """
    frames = exact(frames, "episode_index", "frame_index", *fields, "received_at")
    known = [r for r in exact(limits, "joint_index", "lower_rad", "upper_rad").where("joint_index is not null").limit(10_001).collect()]
    if len(known) > 10_000:
        raise ValueError("limits has more than 10,000 rows")
    width = 1 + max((r["joint_index"] for r in known), default=-1)
    lower, upper = np.full(width, -np.inf), np.full(width, np.inf)
    for r in known:
        if r["lower_rad"] is not None:
            lower[r["joint_index"]] = r["lower_rad"]
        if r["upper_rad"] is not None:
            upper[r["joint_index"]] = r["upper_rad"]
    columns = list(fields)
    at = lambda f: F.floor(f("frame_index") / F.lit(chunk))
    fine = frames.where("episode_index is not null and frame_index is not null")
    long = cut(fine.groupBy("episode_index").agg(at(F.min).alias("a"), at(F.max).alias("b")).where("a <> b").select("episode_index"))
    several = not long.isEmpty()
    rows = chunk_rows(frames, columns, chunk)
    if several:
        told = _over_chunks(attach(frames, long, "episode_index"), columns, width, lower, upper, chunk)
        extra = ("_steps", "_across", "_beside")
        given = rows.select("*", *(F.lit(None).cast(told.schema[c].dataType).alias(c) for c in extra))
        more = [c for c in rows.columns if c not in ("episode_index", "chunk")]
        told = told.select("episode_index", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in more), "chunk", *extra)
        rows = given.unionByName(told)
    return in_chunks(rows, frames).mapInArrow(_flag(columns, list(names), width, lower, upper, several), _FLAGS)


def _over_chunks(frames: DataFrame, columns: list[str], width: int, lower: np.ndarray, upper: np.ndarray, chunk: int) -> DataFrame:
    """What a chunk of an episode in several chunks can't see by itself: (episode_index, chunk, _steps, _across, _beside).

    Steps are the exact median by channel, over counts of equal steps, those from chunk to chunk among them. Stuck stretches that cross
    chunk borders are joined over two rows per chunk and channel; the readings beside a chunk are found among up to eight rows of each.
    """
    rows = frame_chunks(frames, columns, chunk)
    edges = cut(rows.mapInArrow(_edges(columns, width, lower, upper), _EDGES))
    w = Window.partitionBy("episode_index", "channel").orderBy("frame_index")
    told = edges.select(
        "*", (F.lag("chunk").over(w) != F.col("chunk")).alias("_new"), (F.lead("chunk").over(w) != F.col("chunk")).alias("_old"), F.abs(F.col("value") - F.lag("value").over(w)).alias("step"),
        F.collect_list("value").over(w.rowsBetween(-BESIDE, -1)).alias("before"), F.collect_list("value").over(w.rowsBetween(1, BESIDE)).alias("after"),
    )
    between = told.where("_new and step > 0").select("episode_index", "channel", "step", F.lit(1).cast("long").alias("n"))
    sides = told.where("_new or _old").groupBy("episode_index", "chunk", "channel").agg(F.max(F.when(F.col("_new"), F.col("before"))).alias("before"), F.max(F.when(F.col("_old"), F.col("after"))).alias("after"))
    beside = sides.groupBy("episode_index", "chunk").agg(F.collect_list(F.struct("channel", "before", "after")).alias("_beside"))
    counts = rows.mapInArrow(_count_steps(columns, width, lower, upper), _STEPS).unionByName(between).groupBy("episode_index", "channel", "step").agg(F.sum("n").alias("n"))
    median = exact_percentiles(counts, ["episode_index", "channel"], "step", [0.5], "n").withColumnRenamed("step", "u")
    by = median.groupBy("episode_index").agg(F.map_from_entries(F.collect_list(F.struct("channel", "u"))).alias("m"))
    steps = by.select("episode_index", F.transform(F.sequence(F.lit(0), F.lit(2 * width - 1)), lambda c: F.try_element_at("m", c)).alias("_steps"))
    ends = cut(rows.mapInArrow(_ends(columns, width, lower, upper), _ENDS))
    v = Window.partitionBy("episode_index", "channel").orderBy("first")
    goes_on = (F.lag("chunk").over(v) != F.col("chunk")) & (F.lag("value").over(v) == F.col("value")) & ~nonfinite(F.col("value"))
    numbered = ends.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    of_run = [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set("chunk").alias("chunks")]
    runs = numbered.groupBy("episode_index", "channel", "_run").agg(*of_run)
    stuck = runs.where((F.size("chunks") > 1) & (F.col("n") >= STUCK_LENGTH) & (F.col("high") - F.col("low") > OTHER_RANGE))
    by_chunk = stuck.select("episode_index", F.explode("chunks").alias("chunk"), F.struct("channel", "first", "last").alias("x")).groupBy("episode_index", "chunk").agg(F.collect_list("x").alias("_across"))
    every = ends.select("episode_index", "chunk").distinct()
    found = every.join(steps, "episode_index", "left").join(by_chunk, ["episode_index", "chunk"], "left").join(beside, ["episode_index", "chunk"], "left")
    return found.select("episode_index", "chunk", "_steps", "_across", "_beside")
