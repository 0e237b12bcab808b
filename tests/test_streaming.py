import json
import os
import time

import pandas as pd
from pyspark.sql import functions as F

from tidewheel.streaming import sessions

NAMES = [c.split()[0] for c in sessions.INPUT.split(", ")]


def messages():
    rows = [("a", "infer", i / 30, "thumb", (i // 3) / 10, float(i)) for i in range(17)]
    rows += [("a", "infer", 40 / 30, "thumb", 0.0, 99.0)]  # stale
    rows += [("a", "reset", 1.5, None, None, None), ("a", "infer", 2.0, "thumb", 2.0, 5.0), ("a", "infer", 2.0, "thumb", 2.0, 6.0)]
    rows += [("b", "infer", 0.0, "thumb", 0.5, 1.0), ("b", "infer", 0.1, "thumb", 0.1, 2.0), ("b", "infer", 0.2, "thumb", 0.05, 3.0), ("b", "infer", 1.0, "thumb", 1.0, 4.0)]
    return rows


def shown(rows):
    return sorted((r["client"], r["now"], r["status"], r["session"], r["frame"] if pd.notna(r["frame"]) else None, r["replanned"], r["anchor"], r["held"], r["polled"]) for r in rows)


def batch(spark, horizon=16, hz=10.0):
    return sessions.infer_batch(spark.createDataFrame(messages(), sessions.INPUT), horizon, hz)


def test_batch(spark):
    got = {(r["client"], round(r["now"] * 30), r["status"]): r for r in batch(spark).collect()}
    assert [k[1] for k, r in sorted(got.items()) if k[0] == "a" and k[1] <= 16 and r["replanned"]] == [0, 16]
    assert [k[1] for k, r in sorted(got.items()) if k[0] == "a" and k[1] <= 16 and r["polled"]] == [0, 3, 6, 9, 12, 15]
    assert ("a", 40, "stale") in got and ("a", 45, "reset") in got
    after = got["a", 60, "ok"]
    assert after["replanned"] and after["frame"] == 0 and ("a", 60, "time not rising") in got
    assert {k[2] for k in got if k[0] == "b"} == {"future", "ok", "sensor clock went back"}


def test_stream_equals_batch(spark, tmp_path):
    rows = messages()
    (tmp_path / "in").mkdir()
    for i in range(0, len(rows), 4):  # in order, a few at a time
        (tmp_path / f"in/{i:03d}.json").write_text("".join(json.dumps(dict(zip(NAMES, r, strict=True))) + "\n" for r in rows[i : i + 4]))
        os.utime(tmp_path / f"in/{i:03d}.json", (1e9 + i, 1e9 + i))  # files come in this order
    stream = spark.readStream.schema(sessions.INPUT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = sessions.infer_stream(stream, 16, 10.0).writeStream.format("memory").queryName("inferred").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert shown(spark.table("inferred").collect()) == shown(batch(spark).collect())


def test_no_future_in_the_past(spark):
    """What is answered until a time doesn't depend on later messages."""
    some = [r for r in messages() if r[2] <= 0.3]
    early = sessions.infer_batch(spark.createDataFrame(some, sessions.INPUT), 16, 10.0)
    assert shown(early.collect()) == [r for r in shown(batch(spark).collect()) if r[1] <= 0.3]


def test_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = pd.to_datetime(["2026-01-01 00:00", "2026-01-01 00:10", "2026-01-01 00:15", "2026-01-01 02:00", "2026-01-02 00:00"])
    pd.DataFrame({"ts": at.strftime("%Y-%m-%d %H:%M:%S"), "k": "x", "value": 1.0}).to_json(tmp_path / "in/a.json", orient="records", lines=True)
    stream = spark.readStream.schema("ts timestamp, k string, value double").json(str(tmp_path / "in"))
    for name, df in (("tumbling", sessions.windowed_counts(stream, "ts", "1 hour", "1 hour", "k")), ("by_session", sessions.session_counts(stream, "ts", "5 minutes", "1 hour", "k"))):
        q = df.select("k", "n").writeStream.format("memory").outputMode("append").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["n"] for r in spark.table("tumbling").collect()) == [1, 3]
    assert sorted(r["n"] for r in spark.table("by_session").collect()) == [1, 1, 2]


def test_freshness(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.5), (1.0, 0.49), (1.0, 1.1), (1.0, None)], "now double, stamp double")
    assert [r[0] for r in df.coalesce(1).select(sessions.freshness(F.col("now"), F.col("stamp"))).collect()] == ["ok", "ok", "stale", "future", "stale"]


def test_idle_clients_are_forgotten(spark, tmp_path):
    """A client's state is dropped after its idle time: when it comes back it begins a first session again."""
    (tmp_path / "in").mkdir()
    put = lambda name, row: (tmp_path / f"in/{name}.json").write_text(json.dumps(dict(zip(NAMES, row, strict=True))) + "\n")
    put("0", ("a", "infer", 5.0, "thumb", 5.0, 1.0))
    stream = spark.readStream.schema(sessions.INPUT).json(str(tmp_path / "in"))
    query = sessions.infer_stream(stream, 16, 10.0, idle_s=0.5).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        deadline = time.time() + 60
        while spark.table("idle").count() < 1 and time.time() < deadline:
            time.sleep(0.2)
        time.sleep(3)
        put("1", ("a", "infer", 1.0, "thumb", 1.0, 2.0))  # earlier than the last message: an error, were that not forgotten
        while spark.table("idle").count() < 2 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted((r["now"], r["status"], r["session"]) for r in spark.table("idle").collect()) == [(1.0, "ok", 0), (5.0, "ok", 0)]
