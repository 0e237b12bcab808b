"""Audits of clocks, starts, images and videos, written trims and streams as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.operators import images, quality, segments, trim
from tidewheel.plans.pipelines import _L, _PLAN, measures, rewritten
from tidewheel.plans.registry import FRAMES, Registry
from tidewheel.plans.relations import rounded
from tidewheel.plans.scans import frames
from tidewheel.plans.timelines import _GAP
from tidewheel.session import cut, ensure_checkpoint_dir, table
from tidewheel.streaming import sessions

query = Registry()

_LIMITS = quality.Limits(fps=1 / 43_200, time_tolerance=172_800.0, sync_tolerance=1.75, offset_most=60.0, home=300.0)

# Starts and ends


@query(
    f"""with {FRAMES}, s as (select *, value - lag(value) over w step, t - lag(t) over w raw from f window w as (partition by ep order by fi)),
    v as (select ep, fi, step / case when raw > 0 and isfinite(raw) then raw else 43200.0 end velocity from s),
    m as (select ep, min(fi) a, max(fi) b from v where abs(velocity) >= 0.002 group by 1), n as (select ep, count(*) n from f group by 1)
    select ep, greatest(0, a - 1 - 2) "first", least(n - 1, b + 2) "last" from m join n using (ep)"""
)
def suggested_trim(spark: SparkSession, d: str) -> DataFrame:
    return quality.suggested_trim(measures(spark, d), _L)


@query(
    f"""with {FRAMES}, a as (select ep, value x from f where fi = 0), h as (select median(x) home from a)
    select ep, 'home_position_mismatch' code, 'error' severity, round(abs(x - home), 6) observed from a, h where abs(x - home) > 300"""
)
def audit_home(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.home_issues(measures(spark, d), _LIMITS, key="value").select("ep", "code", "severity", "observed"), ["observed"])


# Clocks

_CLOCK = "(t + (ep % 4) * 1.25 + (event_id % 17) * 0.125) * case ep % 3 when 0 then 1e9::double when 1 then 1e3::double else 1.0::double end"


@query(
    f"""with {FRAMES}, a as (select ep, fi, t, {_CLOCK} x from f), d as (select *, x - lag(x) over (partition by ep order by fi) d from a), p as (select ep, median(d) p from d where d > 0 group by 1),
    q as (select ep, arg_min(s, (abs(log10(greatest(p * s, 1e-15) / 43200)), i)) s from p, (values (0, 1.0::double), (1, 1e-3::double), (2, 1e-6::double), (3, 1e-9::double)) v(i, s) group by 1),
    o as (select ep, fi, x * coalesce(s, 1.0) - t y from a left join q using (ep)), m as (select ep, median(y) o from o group by 1), r as (select ep, max(abs(y - o)) r, any_value(o) o from o join m using (ep) group by 1)
    select ep, 'sensor_timestamp_misaligned' code, 'error' severity, round(r, 3) observed from r where r > 1.75
    union all select ep, 'sensor_timestamp_offset', 'warning', round(o, 3) from r where abs(o) > 1.75 and abs(o) < 60"""
)
def audit_clocks(spark: SparkSession, d: str) -> DataFrame:
    scale = F.when(F.col("ep") % 3 == 0, 1e9).when(F.col("ep") % 3 == 1, 1e3).otherwise(1.0)
    rows = frames(spark, d).withColumn("sensor", (F.col("t") + (F.col("ep") % 4) * 1.25 + (F.col("event_id") % 17) * 0.125) * scale)
    return quality.clock_issues(rows, "sensor", _LIMITS).select("ep", "code", "severity", F.round("observed", 3).alias("observed"))


@query("select distinct user_id ep, 'independent_timestamps_missing' code, 'warning' severity from events where user_id is not null")
def audit_missing_clocks(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return quality.missing_clock_issues(f.select("ep").distinct(), f.columns, ["cam"]).select("ep", "code", "severity")


# Images and videos


@query(
    f"""with {FRAMES} select ep, 'camera_frame_missing' code, min(fi) frame_start, max(fi) frame_end, cast(count(*) as double) observed from f where event_type = 'view' group by 1
    union all select ep, 'camera_column_missing', null, null, null from f group by 1"""
)
def audit_images(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    found = quality.image_issues(f, "cam", F.col("event_type") != "view").unionByName(quality.image_issues(f, "other", None))
    return found.select("ep", "code", "frame_start", "frame_end", "observed")


_PTS = "v as (select ep, row_number() over (partition by ep order by fi) - 1 fi, t + (event_id % 29) * 0.25 pts from f where event_id % 31 <> 0)"


@query(
    f"""with {FRAMES}, {_PTS}, n as (select ep, count(*) n, arg_min(t, fi) t0 from f group by 1), g as (select *, pts - lag(pts) over (partition by ep order by fi) gap from v),
    m as (select ep, count(*) m, arg_min(pts, fi) p0, arg_max(fi, (gap, -fi)) filter (where gap > 43200 + 172800) gf, max(gap) filter (where gap > 43200 + 172800) gx from g group by 1),
    b as (select n.ep, n, t0, coalesce(m, 0) m, p0, gf, gx, n.ep % 11 <> 0 there, n.ep % 11 <> 0 and n.ep % 7 <> 0 decoded from n left join m using (ep)),
    r as (select ep, max(abs((pts - p0) - (f.t - t0))) r, arg_max(fi, (abs((pts - p0) - (f.t - t0)), -fi)) rf from f join v using (ep, fi) join b using (ep) group by 1)
    select ep, 'camera_file_missing' code, null frame_start, null frame_end, null observed from b where not there
    union all select ep, 'camera_decode_failed', null, null, null from b where there and not decoded
    union all select ep, 'camera_frame_count', null, null, m from b where decoded and m <> n
    union all select ep, 'camera_dropped_frame', greatest(0, gf - 1), least(gf, n - 1), round(gx, 3) from b where decoded and gx is not null
    union all select ep, 'camera_timestamp_misaligned', rf, rf, round(r, 3) from b join r using (ep) where decoded and r > 1.75"""
)
def audit_videos(spark: SparkSession, d: str) -> DataFrame:
    """Video times against frames that lost some of theirs; every eleventh video is gone and every seventh can't be read."""
    f = frames(spark, d)
    w = Window.partitionBy("ep").orderBy("_fi")
    pts = f.where("event_id % 31 <> 0").select("ep", F.col("fi").alias("_fi"), (F.col("t") + (F.col("event_id") % 29) * 0.25).alias("pts"))
    pts = segments.number_frames(pts.withColumn("us", F.col("_fi")), "_fi", segments.LENGTH).select("ep", "fi", "pts")
    files = f.select("ep").distinct().select("ep", (F.col("ep") % 11 != 0).alias("exists"), (F.col("ep") % 7 != 0).alias("decoded"))
    found = quality.video_issues(f, pts, files, "cam", _LIMITS)
    return found.select("ep", "code", "frame_start", "frame_end", F.round("observed", 3).alias("observed"))


@query(
    """with p as (select label ep, row_number() over (partition by label order by vec_id) - 1 fi, count(*) over (partition by label) n, embedding from embeddings),
    z as (select distinct ep, n, greatest(least(n, 100), least(floor(power(n::double, 0.75)), 10000))::bigint m from p), i as (select ep, n, m, unnest(range(m)) i from z),
    k as (select distinct ep, cast(round_even(case when i = m - 1 then n - 1 else i * ((n - 1)::double / greatest(m - 1, 1)) end, 0) as bigint) fi from i),
    x as (select ep, j % 3 channel, least(255, greatest(0, floor((cast(embedding[j + 1] as double) + 1) * 127))) v, fi from p join k using (ep, fi), range(60) r(j))
    select cast(ep as bigint) ep, cast(channel as int) channel, min(v) / 255 low, max(v) / 255 high, round(avg(v) / 255, 6) mean, round(stddev_pop(v) / 255, 6) std, cast(count(distinct fi) as bigint) n from x group by all"""
)
def image_stats(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as little images of 4 x 5 pixels, those of a label as an episode."""
    one = lambda x: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x + 1) * 127)))), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 60), lambda x: one(x.cast("double"))), ""))
    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("ep"), F.col("vec_id").alias("us"), F.struct(data.alias("data"), F.lit(4).alias("h"), F.lit(5).alias("w"), F.lit(3).alias("c")).alias("image"))
    f = segments.number_frames(rows, "us", segments.LENGTH)
    got = images.channel_stats(f, "image", f.groupBy("ep").agg(F.count("*").alias("n")))
    return rounded(got.withColumnsRenamed({"min": "low", "max": "high", "count": "n"}), ["mean", "std"])


# Trims, written and read again

_BROKEN = """bad as (select ep, fi, case when event_id % 83 = 0 then 0.0 else t end t, "index" + cast(event_id % 89 = 0 as int) "index" from rw where event_id % 97 <> 0),
    nb as (select *, lag(t) over (partition by ep order by fi) pt from bad),
    g as (select ep, count(*) c, count(distinct fi) d, min(fi) lo, max(fi) hi, min("index" - fi) i0, max("index" - fi) i1, count(*) filter (where fi = 0 and t <> 0) t0, count(*) filter (where t <= pt) back from nb group by 1),
    j as (select * from pb full join g using (ep))"""


@query(
    f"""with {FRAMES}, {_PLAN}, {_BROKEN} select 'length' "rule", cast(count(*) filter (where not coalesce(c = b - a, false)) as bigint) violations from j
    union all select 'time', cast(coalesce(sum(t0 + back), 0) as bigint) from j
    union all select 'frame_index', cast(count(*) filter (where not coalesce(d = c and lo = 0 and hi = c - 1, false)) as bigint) from j
    union all select 'index', cast(count(*) filter (where not coalesce(i0 = base and i1 = base, false)) as bigint) from j"""
)
def trim_validate(spark: SparkSession, d: str) -> DataFrame:
    """A rewritten dataset with frames lost, times set back and indices shifted, written, read again and validated."""
    new, plans = rewritten(spark, d)
    bad = new.where("event_id % 97 <> 0").withColumn("t", F.when(F.col("event_id") % 83 == 0, 0.0).otherwise(F.col("t"))).withColumn("index", F.col("index") + (F.col("event_id") % 89 == 0).cast("int"))
    return trim.validate(cut(bad, "trimmed"), plans)


# Streams


def _streamed(df: DataFrame, mode: str) -> DataFrame:
    """What a stream over the tables that are there comes to: its result is written by each micro-batch, and the last one is read."""
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    write = (lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/out")) if mode == "complete" else (lambda rows, k: rows.write.mode("overwrite").parquet(f"{at}/out/batch={k}"))
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a single file is no folder
    return events.withColumn("ts", F.timestamp_micros(segments.micros("ts")))


@query("select event_type, epoch_us(date_trunc('hour', ts)) hour_us, cast(count(*) as bigint) n, round(sum(value), 4) total from events where ts is not null group by all")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    counted = sessions.windowed_counts(_event_stream(spark, d), "ts", "1 hour", "2 hours", "event_type")
    rows = _streamed(counted.select("event_type", F.unix_micros("window.start").alias("hour_us"), "n", F.col("value").alias("total")), "complete")
    return rows.select("event_type", "hour_us", "n", F.round("total", 4).alias("total"))


_MESSAGES = f"""m as (select ep, t, min_by(value, event_id) v from f group by 1, 2), g as (select *, case when t - lag(t) over (partition by ep order by t) > {_GAP} then 1 else 0 end nw from m),
    s as (select *, sum(nw) over (partition by ep order by t) session from g), r as (select *, row_number() over (partition by ep, session order by t) - 1 rn from s)"""


@query(
    f"""with {FRAMES}, {_MESSAGES} select cast(ep as varchar) client, round(t, 6) now, 'ok' status, cast(session as bigint) session, rn frame, rn % 4 = 0 replanned,
    first_value(v) over (partition by ep, session, rn // 4 order by t) anchor from r"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every user's events as the messages of one client, through the state machine of the streams."""
    m = frames(spark, d).groupBy("ep", "t").agg(F.min_by("value", "event_id").alias("value"))
    m = m.select(F.col("ep").cast("string").alias("client"), F.lit("infer").alias("kind"), F.col("t").alias("now"), F.lit("thumb").alias("sensor"), F.col("t").alias("stamp"), "value")
    given = cut(m, "messages")
    stream = spark.readStream.schema(given.schema).parquet(given.inputFiles()[0].rsplit("/", 1)[0])
    got = _streamed(sessions.infer_stream(stream, 4, 1 / 86_400, _GAP), "append")
    return got.select("client", F.round("now", 6).alias("now"), "status", "session", "frame", "replanned", "anchor")
