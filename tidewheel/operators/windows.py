"""Windows over frames: action chunks, kinematics, holds, sessions and replanning. Frames have ep, fi and t (operators/segments.py)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.segments import LENGTH, carry_last, look_around, nearby, own_rows, running_sum


def chunks(frames: DataFrame, columns: Sequence[str], horizon: int, length: int = LENGTH) -> DataFrame:
    """Add `<column>_chunk` (the next `horizon` values, the episode's last one repeated) and `pad` (which of them are repeated)."""
    ahead = nearby().rowsBetween(0, horizon - 1)
    rows = look_around(frames, after=0, before=0, length=length) if horizon == 1 else look_around(frames, before=0, after=horizon - 1, length=length)
    listed = rows.withColumns({f"{c}_chunk": F.collect_list(F.struct(c)).over(ahead) for c in columns})
    fill = lambda v: F.concat(v, F.array_repeat(F.element_at(v, -1), horizon - F.size(v)))
    had = F.size(f"{columns[0]}_chunk")
    listed = listed.withColumn("pad", F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda j: j >= had))
    listed = listed.withColumns({f"{c}_chunk": fill(F.col(f"{c}_chunk"))[c] for c in columns})
    return own_rows(listed, length)


def step_time(expected: float) -> Column:
    """Seconds since the frame before; the expected ones where that isn't positive and finite; null at the first frame."""
    dt = F.col("t") - F.lag("t").over(nearby())
    return F.when(F.lag("fi").over(nearby()).isNull(), F.lit(None)).when((dt > 0) & (dt < float("inf")), dt).otherwise(F.lit(expected))


def kinematics(frames: DataFrame, value: str, expected: float, length: int = LENGTH) -> DataFrame:
    """Add dt, step, velocity and acceleration (between the middles of two steps); null where too few frames lie before."""
    w = nearby()
    rows = look_around(frames, before=2, length=length).withColumn("dt", step_time(expected)).withColumn("step", F.col(value) - F.lag(value).over(w))
    rows = rows.withColumn("velocity", F.col("step") / F.col("dt"))
    rows = rows.withColumn("acceleration", (F.col("velocity") - F.lag("velocity").over(w)) / ((F.col("dt") + F.lag("dt").over(w)) / 2))
    return own_rows(rows, length)


def poll_hold(frames: DataFrame, hz: float, length: int = LENGTH) -> DataFrame:
    """Causal sample-and-hold at a rate: add held_fi, the last frame at which floor(t * hz + 1e-5) changed, and age, the seconds since."""
    tick = F.floor(F.col("t") * hz + 1e-5)
    rows = own_rows(look_around(frames, before=1, length=length).withColumn("_before", F.lag(tick).over(nearby())), length)
    polled = F.when(F.col("_before").isNull() | (tick != F.col("_before")), F.struct("fi", "t"))
    held = carry_last(rows, polled, "_held", length)
    return held.withColumn("held_fi", F.col("_held.fi")).withColumn("age", F.col("t") - F.col("_held.t")).drop("_held", "_before")


def sessions(frames: DataFrame, gap_s: float, length: int = LENGTH) -> DataFrame:
    """Add session, counted from 0 in each episode: a new one begins after more than gap_s seconds."""
    dt = F.col("t") - F.lag("t").over(nearby())
    rows = own_rows(look_around(frames, before=1, length=length).withColumn("_new", (F.coalesce(dt, F.lit(0.0)) > gap_s).cast("long")), length)
    return running_sum(rows, F.col("_new"), "session", length).drop("_new")


def replan(frames: DataFrame, horizon: int, anchor: str, length: int = LENGTH) -> DataFrame:
    """Sessions cut into count windows: add rn (from 0 in the session), chunk = rn // horizon, replanned, and the anchor's value at the chunk's start."""
    first = frames.groupBy("ep", "session").agg(F.min("fi").alias("_first"))
    rows = frames.join(first, ["ep", "session"]).withColumn("rn", F.col("fi") - F.col("_first"))
    rows = rows.withColumn("chunk", F.floor(F.col("rn") / horizon)).withColumn("replanned", F.col("rn") % horizon == 0)
    return carry_last(rows, F.when(F.col("replanned"), F.col(anchor)), "anchor", length).drop("_first")


def polls(t: np.ndarray, wait: float, last: float | None) -> np.ndarray:
    """Which of a series' times are polled: the first that lies `wait` or more after the last poll, and so on; the first of all if there was none.

    Times that rise: each time's next poll is found by binary search, all at once, and the chain of polls by doubling its jumps. Times
    that are null poll nothing; a series that goes back is followed time by time.
    """
    out = np.zeros(len(t), bool)
    at = np.flatnonzero(~np.isnan(t))
    x = t[at]
    n = len(x)
    if not n:
        return out
    if (np.diff(x) < 0).any():
        for i, v in zip(at.tolist(), x.tolist(), strict=True):
            if last is None or v - last >= wait:
                out[i], last = True, v
        return out
    first = 0 if last is None else int(np.argmax(x - last >= wait)) if x[-1] - last >= wait else n
    if first == n:
        return out
    jump = np.searchsorted(x, x + wait - 4 * np.spacing(np.abs(x) + wait), "left")
    while (early := (jump < n) & (x[np.minimum(jump, n - 1)] - x < wait)).any():  # a sum rounds where a difference doesn't
        jump[early] += 1
    jump = np.append(np.maximum(jump, np.arange(n) + 1), n)
    hit = np.zeros(n + 1, bool)
    hit[first] = True
    while True:
        more = hit.copy()
        more[jump[hit]] = True
        if (more == hit).all() and (jump == n).all():
            break
        hit, jump = more, jump[jump]
    out[at[hit[:n]]] = True
    return out


def rate_limited_hold(frames: DataFrame, value: str, hz: float) -> DataFrame:
    """Online hold: a frame is polled when 1 / hz seconds (less 1e-5) have passed since the last poll. Columns ep, fi, polled_fi, held.

    Each poll depends on the one before, so an episode is folded in order in one task, a batch at a time, with one poll carried from
    batch to batch: memory doesn't grow with it. A frame without a time holds what the one before does; before the first poll that is null.
    """
    wait = 1.0 / hz - 1e-5

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        episode = last = fi0 = held = None
        for b in batches:
            if not b.num_rows:
                continue
            ep, fi = b.column(0).to_numpy(), b.column(1).to_numpy()
            t, v = (b.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in (2, 3))
            starts = np.flatnonzero(np.append(True, ep[1:] != ep[:-1]))
            source = np.full(len(ep), -1)
            for i, k in zip(starts, np.append(starts[1:], len(ep)), strict=True):
                hit = i + np.flatnonzero(polls(t[i:k], wait, last if ep[i] == episode else None))
                source[hit] = hit
                source[i:k] = np.maximum.accumulate(source[i:k])
                carried = source[i:k] < 0
                keep = ep[i] == episode and fi0 is not None
                out_f, out_v = fi[source[i:k]].astype(float), v[source[i:k]]
                out_f[carried], out_v[carried] = (fi0, held) if keep else (np.nan, np.nan)
                whole = pa.array(np.where(np.isnan(out_f), 0, out_f).astype(np.int64), mask=np.isnan(out_f))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k - i), b.column(1).slice(i, k - i), whole, pa.array(out_v, from_pandas=True)], ["ep", "fi", "polled_fi", "held"])
                if len(hit):
                    last, fi0, held = t[hit[-1]], fi[hit[-1]], v[hit[-1]]
                elif not keep:
                    last = fi0 = held = None
                episode = ep[i]

    rows = frames.select("ep", "fi", "t", F.col(value).cast("double").alias("v")).where("ep is not null").repartition("ep").sortWithinPartitions("ep", "fi")
    return rows.mapInArrow(fold, "ep long, fi long, polled_fi long, held double")


def attention_mask(tokens: DataFrame, valid: str, block: str) -> DataFrame:
    """(key, i, j, may): position i of a sequence may see j if j's block isn't later and both are valid. tokens: key, pos, and the two flags.

    The pairs are the operator's output: a sequence has a bounded number of positions.
    """
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    one = tokens.withColumn("_b", F.sum(F.col(block).cast("int")).over(w))
    seq = one.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "_b", F.col(valid).alias("ok")))).alias("s"))
    pairs = seq.select("key", F.explode("s").alias("a"), "s").select("key", "a", F.explode("s").alias("b"))
    return pairs.select("key", F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), ((F.col("b._b") <= F.col("a._b")) & F.col("a.ok") & F.col("b.ok")).alias("may"))
