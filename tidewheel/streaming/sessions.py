"""Stateful streams: clocks that must rise, stale and future stamps, rate-limited holds, sessions, count windows and resets.

One key is one session of a client. Its state is the last time, the stamps and last polls of its sensors, the held value and the frame
count of the running chunk; an error resets the state, as an explicit reset does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Seconds: a stamp may be later than now by FUTURE, older by STALE; a longer pause than GAP begins anew.
FUTURE_S, STALE_S, GAP_S = 1e-6, 0.5, 0.5
#: Seconds without a message after which a client's state is dropped.
IDLE_S = 86_400.0

INPUT = "client string, kind string, now double, sensor string, stamp double, value double"
_OUT = "client string, now double, status string, session long, frame long, replanned boolean, anchor double, held double, polled boolean"
_STATE = "last double, session long, frame long, anchor double, stamps map<string,double>, polled double, held double"


def freshness(now: Column, stamp: Column) -> Column:
    """future, stale or ok: an event's stamp against the present; null stamps are stale."""
    return F.when(stamp.isNull(), "stale").when(stamp > now + FUTURE_S, "future").when(now - stamp > STALE_S, "stale").otherwise("ok")


class Session:
    """The state of one client and what a message does to it; the same for streams and for the batch twin."""

    def __init__(self, horizon: int, hz: float, gap_s: float = GAP_S, state: tuple | None = None) -> None:
        self.horizon, self.wait, self.gap = horizon, 1.0 / hz - 1e-5, gap_s
        self.session = 0
        self.clear()
        if state is not None:
            self.last, self.session, self.frame, self.anchor, stamps, self.polled, self.held = state
            self.stamps = dict(stamps or {})

    def clear(self) -> None:
        self.last = self.anchor = self.polled = self.held = None
        self.frame, self.stamps = 0, {}

    def state(self) -> tuple:
        return (self.last, self.session, self.frame, self.anchor, self.stamps, self.polled, self.held)

    def take(self, kind: str, now: float, sensor: str, stamp: float, value: float) -> tuple:
        """(status, session, frame, replanned, anchor, held, polled)"""
        status = "ok"
        if kind == "reset":
            status = "reset"
        elif now is None or not math.isfinite(now) or (self.last is not None and now <= self.last):
            status = "time not rising"
        elif stamp is None or not math.isfinite(stamp) or now - stamp > STALE_S:
            status = "stale"
        elif stamp > now + FUTURE_S:
            status = "future"
        elif sensor in self.stamps and stamp < self.stamps[sensor]:
            status = "sensor clock went back"
        if status != "ok":
            self.clear()
            self.session += 1
            return (status, self.session, None, False, None, None, False)
        if self.last is not None and now - self.last > self.gap:
            self.clear()
            self.session += 1
        polled = self.polled is None or now - self.polled >= self.wait
        if polled:
            self.polled, self.held = now, value
        self.last, self.stamps[sensor] = now, stamp
        replanned = self.frame % self.horizon == 0
        if replanned:
            self.anchor = value
        out = (status, self.session, self.frame, replanned, self.anchor, self.held, polled)
        self.frame += 1
        return out


def _none(x):  # noqa: ANN001, ANN202
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


def _take_all(session: Session, client: str, pdf: pd.DataFrame) -> pd.DataFrame:
    """What a client's messages come to: one step of the machine each, over plain lists."""
    columns = [[_none(x) for x in pdf[c].tolist()] for c in ("now", "stamp", "value")]
    rows = [(client, n, *session.take(k, n, s, t, v)) for k, s, n, t, v in zip(pdf["kind"].tolist(), pdf["sensor"].tolist(), *columns, strict=True)]
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"now": float, "session": "Int64", "frame": "Int64"})


def infer_stream(messages: DataFrame, horizon: int, hz: float, gap_s: float = GAP_S, idle_s: float | None = None) -> DataFrame:
    """One row per message, in the order of `now` within each micro-batch, from a streaming DataFrame of INPUT.

    With idle_s (a stream that runs for good takes IDLE_S) a client that sends nothing for so many seconds of processing time is forgotten,
    so the state doesn't grow with all clients there ever were; such a stream has no end at which all is processed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = Session(horizon, hz, gap_s, state.get if state.exists else None)
        pdf = pd.concat(list(batches)).sort_values("now", kind="stable")  # a client's messages of one micro-batch
        yield _take_all(session, key[0], pdf)
        state.update(session.state())
        if idle_s is not None:
            state.setTimeoutDuration(int(idle_s * 1000))

    return messages.where("client is not null").groupBy("client").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout" if idle_s is None else "ProcessingTimeTimeout")


def infer_batch(messages: DataFrame, horizon: int, hz: float, gap_s: float = GAP_S) -> DataFrame:
    """The same over a table: each client's messages in order, in batches, so that memory doesn't grow with a client."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, session = None, None
        for pdf in batches:
            for key, part in pdf.groupby("client", sort=False):
                if session is None or key != client:
                    client, session = key, Session(horizon, hz, gap_s)
                yield _take_all(session, key, part)

    rows = messages.where("client is not null").repartition("client").sortWithinPartitions("client", "now")
    return rows.mapInPandas(work, _OUT)


def windowed_counts(events: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Tumbling counts and sums of value with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def session_counts(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts by session window: an event exactly `gap` after the last one still belongs to the session."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
