"""Numeric functions, and the composite pipelines: training samples, audits and trims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import schedules, vectors
from tidewheel.operators import quality, stats, trim, windows
from tidewheel.operators.projections import checked
from tidewheel.plans.registry import FRAMES, Registry
from tidewheel.plans.relations import _CHUNK_VALUES, _NORM, _RANGES, dims, hist_sql, ranges, rounded
from tidewheel.plans.scans import exploded, frames
from tidewheel.plans.timelines import _KIN
from tidewheel.session import attach, table

query = Registry()

# Vectors

_MASK = [True, False, True, True]
_MATRIX = "m as (select vec_id, r step, k dim, cast(embedding[r * 8 + k + 1] as double) x, cast(embedding[k + 1] as double) s from embeddings, range(8) a(r), range(8) b(k))"


def matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("e"))
    return rows.select("vec_id", vectors.rows_of(F.col("e"), 8).alias("m"), F.slice("e", 1, 8).alias("s"))


def steps(df: DataFrame) -> DataFrame:
    rows = df.select("vec_id", F.posexplode("m").alias("step", "v"))
    return exploded(rows.withColumn("step", F.col("step").cast("long")), "vec_id", "step")


@query(f"with {_MATRIX} select vec_id, step, dim, case when dim in (0, 2, 3) then x - s else x end x from m")
def delta_actions(spark: SparkSession, d: str) -> DataFrame:
    return steps(matrix(spark, d).withColumn("m", vectors.delta(F.col("m"), F.col("s"), _MASK)))


@query(f"with {_MATRIX} select vec_id, step, dim, round(x, 6) + 0.0 x from m")
def absolute_actions(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d).withColumn("m", vectors.delta(F.col("m"), F.col("s"), _MASK))
    back = steps(m.withColumn("m", vectors.absolute(F.col("m"), F.col("s"), _MASK)))
    return back.withColumn("x", F.round("x", 6) + 0.0)


@query("select n_nationkey, cast(i as bigint) pos, i < n_nationkey % 4 or i >= n_nationkey % 4 + 2 flag from nation, range(0, 10) r(i) where i < n_nationkey % 4 + 2 + n_nationkey % 3")
def bool_mask(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    mask = vectors.bool_mask_column(F.array(k % 4, F.lit(-2), k % 3))
    return table(spark, d, "nation").select("n_nationkey", F.posexplode(mask).alias("pos", "flag")).withColumn("pos", F.col("pos").cast("long"))


@query("select vec_id, cast(row_number() over (partition by vec_id order by i) - 1 as bigint) dim, cast(embedding[i + 1] as double) x from embeddings, range(60) r(i) where i % 6 >= 4")
def channel_slice(spark: SparkSession, d: str) -> DataFrame:
    return exploded(table(spark, d, "embeddings").select("vec_id", vectors.channels(F.slice("embedding", 1, 60), 6, 4).alias("v")), "vec_id")


@query("select vec_id, cast(i as bigint) dim, cast(greatest(-1, least(255, floor((cast(embedding[i + 1] as double) * 4 + 1) * 128))) as bigint) bin from embeddings, range(64) r(i)")
def discretize_state(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: vectors.discretize(x.cast("double") * 4))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(v).alias("dim", "bin")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.col("bin").cast("long").alias("bin"))


def with_stats(spark: SparkSession, d: str) -> DataFrame:
    s = F.broadcast(stats.as_vectors(stats.norm_stats(dims(spark, d), "dim")))  # one row
    return table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v")).crossJoin(s)


def normalised(spark: SparkSession, d: str, f, back=None) -> DataFrame:  # noqa: ANN001
    rows = with_stats(spark, d).withColumn("v", f)
    rows = rows if back is None else rows.withColumn("v", back)
    return exploded(rows, "vec_id").withColumn("x", F.round("x", 5) + 0.0)


_BACK = "x as (select vec_id, i dim, cast(embedding[i + 1] as double) x from embeddings, range(64) r(i)) select vec_id, dim, round(x, 5) + 0.0 x from x"


@query(f"with {_NORM} select vec_id, dim, round((x - mean) / (std + 1e-6), 5) + 0.0 x from x join st using (dim)")
def normalize_zscore(spark: SparkSession, d: str) -> DataFrame:
    return normalised(spark, d, vectors.zscore(F.col("v"), F.col("mean"), F.col("std")))


@query(f"with {_NORM} select vec_id, dim, round((x - q01) / (q99 - q01 + 1e-6) * 2 - 1, 5) + 0.0 x from x join hq using (dim)")
def normalize_quantile(spark: SparkSession, d: str) -> DataFrame:
    return normalised(spark, d, vectors.quantile_scale(F.col("v"), F.col("q01"), F.col("q99")))


@query(f"with {_BACK}")
def unnormalize_zscore(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return normalised(spark, d, vectors.zscore(c("v"), c("mean"), c("std")), vectors.zscore_back(c("v"), c("mean"), c("std")))


@query(f"with {_BACK}")
def unnormalize_quantile(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return normalised(spark, d, vectors.quantile_scale(c("v"), c("q01"), c("q99")), vectors.quantile_scale_back(c("v"), c("q01"), c("q99")))


@query(
    f"""with {FRAMES}, q as (select ep, quantile_cont(value, 0.05) lo, quantile_cont(value, 0.95) hi from f group by 1)
    select ep, fi, round(least(1, greatest(0, (value - lo) / (hi - lo))), 6) + 0.0 x from f join q using (ep)"""
)
def robust_normalize(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    fine = F.when(~vectors.nonfinite(F.col("value")), F.col("value"))
    ends = stats.exact_percentiles(f, ["ep"], "value", [0.05, 0.95]).groupBy("ep").agg(F.max(F.when(F.col("p") < 0.5, F.col("value"))).alias("q0"), F.max(F.when(F.col("p") > 0.5, F.col("value"))).alias("q1"))
    q = f.groupBy("ep").agg(F.min(fine).alias("a"), F.max(fine).alias("b")).join(ends, "ep", "left")
    wide = F.col("q1") > F.col("q0")
    q = q.select("ep", F.when(wide, F.col("q0")).otherwise(F.col("a")).alias("lo"), F.when(wide, F.col("q1")).otherwise(F.col("b")).alias("hi"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return attach(f, q, "ep").select("ep", "fi", (F.round(F.when(F.col("hi") > F.col("lo"), scaled).otherwise(0.0), 6) + 0.0).alias("x"))


@query(
    """with m as (select vec_id, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))) / 64 + 1e-6) r, embedding from embeddings)
    select vec_id, cast(i as bigint) dim, round(cast(embedding[i + 1] as double) / r * 1.5, 5) + 0.0 x from m, range(64) t(i)"""
)
def rms_norm(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.rms_norm(vectors.doubles(F.col("embedding")), 0.5)
    return exploded(table(spark, d, "embeddings").select("vec_id", v.alias("v")), "vec_id").withColumn("x", F.round("x", 5) + 0.0)


@query(
    """with a as (select vec_id, i, vec_id % 32 * power(10000.0::double, -2.0 * i / 64) ang, cast(embedding[i + 1] as double) a, cast(embedding[i + 33] as double) b from embeddings, range(32) r(i))
    select vec_id, cast(i as bigint) dim, round(a * cos(ang) - b * sin(ang), 5) + 0.0 x from a union all select vec_id, i + 32, round(b * cos(ang) + a * sin(ang), 5) + 0.0 from a"""
)
def rope(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.rope(vectors.doubles(F.col("embedding")), (F.col("vec_id") % 32).cast("double"), 64)
    return exploded(table(spark, d, "embeddings").select("vec_id", v.alias("v")), "vec_id").withColumn("x", F.round("x", 5) + 0.0)


_PERIOD = "(0.004::double * power(4.0::double / 0.004::double, i / 7.0::double))"


@query(
    f"""with p as (select n_nationkey k, n_nationkey / 25.0::double pos, i, 2 * pi() / {_PERIOD} r from nation, range(8) t(i))
    select k, cast(i as bigint) dim, round(sin(pos * r), 5) + 0.0 x from p union all select k, i + 8, round(cos(pos * r), 5) + 0.0 from p"""
)
def posemb(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.sincos(F.col("n_nationkey") / 25.0, 16, 4e-3, 4.0)
    return exploded(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), v.alias("v")), "k").withColumn("x", F.round("x", 5) + 0.0)


# Schedules

_RTC = "case when i < 4 then 1.0 when i < 8 then (1 - (i - 3) / 5.0) * (exp(1 - (i - 3) / 5.0) - 1) / (exp(1.0) - 1) else 0.0 end"


@query(f"select i step, round({_RTC}, 6) w from range(16) r(i)")
def rtc_weights(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(16).select(F.col("id").alias("step"), F.round(schedules.prefix_weight(F.col("id"), 4, 8, 10, 16), 6).alias("w"))


@query(
    f"""with {FRAMES}, n as (select ep, max(fi) m from f group by 1), c as (select f.ep, f.fi, i, case when f.fi + i <= m then g.value - f.value else 0 end dx from f join n using (ep), range(16) r(i), f g where g.ep = f.ep and g.fi = least(f.fi + i, m))
    select ep, fi, i step, round(dx * {_RTC}, 5) + 0.0 x from c"""
)
def rtc_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.chunks(frames(spark, d), ["value"], 16)
    step = F.posexplode(F.arrays_zip(F.col("value_chunk").alias("x"), "pad")).alias("step", "c")
    shifted = rows.select("ep", "fi", "value", step).withColumn("step", F.col("step").cast("long"))
    moved = F.when(F.col("c.pad"), 0.0).otherwise(F.col("c.x") - F.col("value"))
    return shifted.select("ep", "fi", "step", (F.round(moved * schedules.prefix_weight(F.col("step"), 4, 8, 10, 16), 5) + 0.0).alias("x"))


@query(
    """with s as (select i step from range(0, 40000, 250) r(i)) select step,
    round(1e6 * case when step < 1000 then 2.5e-5 / 1001 + (2.5e-5 - 2.5e-5 / 1001) * step / 1000.0 else 2.5e-6 + (2.5e-5 - 2.5e-6) * 0.5 * (1 + cos(pi() * least(1.0, (step - 1000) / 29000.0))) end, 6) cosine,
    round(1e6 * case when step < 1000 then 5e-5 / 1001 + (5e-5 - 5e-5 / 1001) * step / 1000.0 else 5e-5 / sqrt((10000.0 + step - 1000) / 10000.0) end, 6) rsqrt, round(1e6 * 1e-4 * least((step + 1) / 500.0, 1.0), 6) linear from s"""
)
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("step")
    shown = lambda c, name: F.round(c * 1e6, 6).alias(name)
    rows = spark.range(0, 40_000, 250).withColumnRenamed("id", "step")
    return rows.select("step", shown(schedules.warmup_cosine(s, 2.5e-5, 1000, 30_000, 2.5e-6), "cosine"), shown(schedules.warmup_rsqrt(s, 5e-5, 1000, 10_000.0), "rsqrt"), shown(schedules.warmup_linear(s, 1e-4), "linear"))


_BAR = "power(cos(({} + 0.008) / 1.008 * pi() / 2), 2)"
_BETAS = f"b as (select i, least(1 - {_BAR.format('(i + 1) / 100.0')} / {_BAR.format('i / 100.0')}, 0.999) beta from range(100) r(i)), c as (select i, beta, exp(sum(ln(1 - beta)) over (order by i)) kept from b)"


def betas(spark: SparkSession) -> DataFrame:
    b = spark.range(100).select(F.col("id").alias("i"), schedules.cosine_betas(F.col("id"), 100).alias("beta"))
    all_ = b.agg(F.array_sort(F.collect_list(F.struct("i", "beta"))).alias("s"))  # a schedule of bounded length
    kept = F.aggregate(F.slice("s", 1, F.col("k.i").cast("int") + 1), F.lit(1.0), lambda a, x: a * (1 - x["beta"]))
    return all_.select(F.explode("s").alias("k"), "s").select("k.i", "k.beta", kept.alias("kept"))


@query(f"with {_BETAS} select i, round(beta, 6) beta, round(kept, 6) kept from c")
def diffusion_schedule(spark: SparkSession, d: str) -> DataFrame:
    return rounded(betas(spark), ["beta", "kept"])


@query(
    f"""with {_BETAS}, s as (select c.i, c.kept a, coalesce(p.kept, 1.0) b, n_nationkey k, n_nationkey / 25.0 - 0.5 x, n_nationkey % 7 / 7.0 - 0.4 e, n_nationkey % 5 / 5.0 z from c left join c p on p.i = c.i - 1, nation where c.i % 10 = 9),
    q as (select *, (x - sqrt(1 - a) * e) / sqrt(a) raw, greatest(-1.0, least(1.0, (x - sqrt(1 - a) * e) / sqrt(a))) cl, a / b st from s)
    select i, k, round(sqrt(b) * raw + sqrt(1 - b) * e, 5) + 0.0 ddim, round(sqrt(b) * (1 - st) / (1 - a) * cl + sqrt(st) * (1 - b) / (1 - a) * x + sqrt(greatest(0.0, (1 - b) / (1 - a) * (1 - st))) * z, 5) + 0.0 ddpm from q"""
)
def denoise_step(spark: SparkSession, d: str) -> DataFrame:
    b = betas(spark)
    before = b.select((F.col("i") + 1).alias("i"), F.col("kept").alias("b"))
    k = F.col("n_nationkey")
    data = table(spark, d, "nation").select(k.alias("k"), (k / 25.0 - 0.5).alias("x"), (k % 7 / 7.0 - 0.4).alias("e"), (k % 5 / 5.0).alias("z"))
    some = b.join(before, "i", "left").where("i % 10 = 9").select("i", F.col("kept").alias("a"), F.coalesce("b", F.lit(1.0)).alias("b"))
    rows = data.crossJoin(F.broadcast(some))  # ten steps
    step = lambda sampler, clip: F.round(schedules.denoise(F.col("x"), F.col("e"), F.col("a"), F.col("b"), F.col("z"), sampler, clip), 5) + 0.0
    return rows.select("i", "k", step("ddim", False).alias("ddim"), step("ddpm", True).alias("ddpm"))


@query(
    """with p as (select p_partkey, p_size * 17 + 100 h, p_partkey % 900 + 64 w from part), r as (select *, greatest(w / 224.0::double, h / 224.0::double) ratio from p), s as (select *, cast(floor(h / ratio) as bigint) rh, cast(floor(w / ratio) as bigint) rw from r)
    select p_partkey, rh, rw, (224 - rh) // 2 top, (224 - rw) // 2 "left" from s"""
)
def letterbox_dims(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 17 + 100).alias("h"), (F.col("p_partkey") % 900 + 64).alias("w"))
    return p.select("p_partkey", *(c.cast("long").alias(n) for n, c in schedules.letterbox(F.col("h"), F.col("w"), 224, 224).items()))


@query("select event_id, round(event_id % 256 / 255.0 * 2 - 1, 6) + 0.0 unit, cast(floor(event_id % 256 / 256.0 * 255) as bigint) pixel from events")
def pixel_scale(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("event_id") % 256
    return table(spark, d, "events").select("event_id", (F.round(schedules.pixel_to_unit(p), 6) + 0.0).alias("unit"), schedules.unit_to_pixel(p / 256.0).cast("long").alias("pixel"))


# Training samples

_TASK = "task as (select distinct user_id ep, n_name prompt from events join nation on user_id % 25 = n_nationkey)"


def samples(spark: SparkSession, d: str, horizon: int = 4) -> DataFrame:
    """ep, fi, value, prompt and v: the next values less the present one."""
    tasks = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("task"), F.col("n_name").alias("prompt"))
    f = attach(frames(spark, d).withColumn("task", F.col("ep") % 25), tasks, "task", "left")
    f = f.withColumn("prompt", checked(F.col("prompt"), F.col("prompt").isNotNull(), "unknown task"))
    rows = windows.chunks(f, ["value"], horizon)
    return rows.select("ep", "fi", "value", "prompt", F.transform("value_chunk", lambda x: x - F.col("value")).alias("v"))


def scaled(spark: SparkSession, d: str) -> DataFrame:
    """Samples with the statistics of all of them."""
    rows = samples(spark, d)
    s = F.broadcast(stats.as_vectors(stats.norm_stats(stats.per_dim(rows, F.col("v")), "dim")))  # one row
    return rows.crossJoin(s)


@query(
    f"""with {_CHUNK_VALUES}, {hist_sql('x', 'dim')}, {_TASK}, n6 as (select f.ep, f.fi, j dim, g.value - f.value x from f join n using (ep), range(4) r(j), f g where g.ep = f.ep and g.fi = least(f.fi + j, m)),
    s as (select ep, fi, dim, (x - q01) / (q99 - q01 + 1e-6) * 2 - 1 x from n6 join hq using (dim) union all select ep, fi, j + 4, 0.0 from f, range(2) r(j))
    select ep, fi, prompt, dim, round(x, 4) + 0.0 x from s join task using (ep)"""
)
def pipeline_forward(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.pad(vectors.quantile_scale(F.col("v"), F.col("q01"), F.col("q99")), 6)
    return exploded(scaled(spark, d).withColumn("v", v), "ep", "fi", "prompt").withColumn("x", F.round("x", 4) + 0.0)


@query(f"with {FRAMES}, n as (select ep, max(fi) m from f group by 1) select f.ep, f.fi, j dim, round(g.value, 4) + 0.0 x from f join n using (ep), range(4) r(j), f g where g.ep = f.ep and g.fi = least(f.fi + j, m)")
def pipeline_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = scaled(spark, d).withColumn("v", vectors.pad(vectors.quantile_scale(c("v"), c("q01"), c("q99")), 6))
    back = rows.withColumn("v", vectors.quantile_scale_back(c("v"), c("q01"), c("q99"))).withColumn("v", F.transform("v", lambda x: x + c("value"))).withColumn("v", vectors.take(c("v"), 4))
    return exploded(back, "ep", "fi").withColumn("x", F.round("x", 4) + 0.0)


# Audits

_L = quality.Limits(fps=1 / 43_200, time_tolerance=172_800.0, start_idle=86_400.0, end_idle=86_400.0, min_speed=0.002, step=400.0, velocity=0.05, acceleration=1e-5)


def measures(spark: SparkSession, d: str) -> DataFrame:
    return quality.measure(frames(spark, d).withColumn("v", F.array("value")), _L)


def issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.episode_issues(measures(spark, d), _L, "value")


_AT = "arg_max(fi, (abs({0}), -fi))"
_ISSUES = f"""{_KIN}, mv as (select ep, min(fi) a, max(fi) b from a where abs(velocity) >= 0.002 group by 1), nn as (select ep, count(*) n, max(t) t1 from f group by 1),
    iss as (
    select ep, 'timestamp_non_increasing' code, 'error' severity, min(fi) - 1 frame_start, min(fi) frame_end from a where raw <= 0 group by 1
    union all select ep, 'dropped_sample', 'error', arg_max(fi, (raw, -fi)) - 1, arg_max(fi, (raw, -fi)) from a where raw > 43200 + 172800 group by 1
    union all select ep, 'timestamp_jitter', 'warning', arg_max(fi, (abs(raw - 43200), -fi)) - 1, arg_max(fi, (abs(raw - 43200), -fi)) from a where abs(raw - 43200) > 172800 group by 1 having count(*) filter (where raw > 43200 + 172800) = 0
    union all select ep, 'joint_step_jump', 'error', {_AT.format('step')} - 1, {_AT.format('step')} from a where step is not null group by 1 having max(abs(step)) > 400
    union all select ep, 'velocity_limit', 'error', {_AT.format('velocity')} - 1, {_AT.format('velocity')} from a where step is not null group by 1 having max(abs(velocity)) > 0.05
    union all select ep, 'velocity_jump', 'error', {_AT.format('acceleration')} - 1, {_AT.format('acceleration')} from a where acceleration is not null group by 1 having max(abs(acceleration)) > 1e-5
    union all select ep, 'too_short', 'error', null, null from nn where n < 2
    union all select ep, 'episode_static', 'error', 0, n - 1 from nn left join mv using (ep) where n >= 2 and mv.a is null
    union all select ep, 'start_idle', 'error', 0, mv.a - 1 from nn join mv using (ep) join f on f.ep = nn.ep and f.fi = mv.a - 1 where n >= 2 and f.t > 86400
    union all select ep, 'end_idle', 'error', mv.b, n - 1 from nn join mv using (ep) join f on f.ep = nn.ep and f.fi = mv.b where n >= 2 and t1 - f.t > 86400)"""


@query(f"with {FRAMES}, {_ISSUES} select ep, code, severity, frame_start, frame_end from iss")
def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).select("ep", "code", "severity", "frame_start", "frame_end")


@query(
    f"""with {FRAMES}, {_ISSUES} select (select cast(count(*) as bigint) from nn) episodes, (select cast(sum(n) as bigint) from nn) frames, cast(count(*) filter (where severity = 'error') as bigint) errors,
    cast(count(*) filter (where severity = 'warning') as bigint) warnings, count(*) filter (where severity = 'error') = 0 passed from iss"""
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    m = measures(spark, d)
    return quality.report(quality.episode_issues(m, _L, "value"), m).drop("by_code")


_KINEMATIC = "('joint_step_jump', 'velocity_limit', 'velocity_jump')"


@query(f"with {FRAMES}, {_ISSUES} select ep, cast(count(*) as bigint) n, string_agg(code, ',' order by code) codes from iss where code in {_KINEMATIC} group by 1")
def anomaly_groups(spark: SparkSession, d: str) -> DataFrame:
    found = issues(spark, d).where(f"code in {_KINEMATIC}")
    return found.groupBy("ep").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))


@query(
    f"""with {FRAMES}, {_ISSUES}, w as (select ep, greatest(0, min(frame_start) - 2) a, max(frame_end) + 2 b from iss where code in {_KINEMATIC} group by 1)
    select ep, fi, value, coalesce(step, 0) step from a join w using (ep) where fi between w.a and w.b"""
)
def anomaly_window_rows(spark: SparkSession, d: str) -> DataFrame:
    m = measures(spark, d)
    found = quality.windows_around(quality.episode_issues(m, _L, "value").where(f"code in {_KINEMATIC}"), m.select("ep", "n"), 2)
    k = windows.kinematics(frames(spark, d), "value", 43_200.0)
    return attach(k, found.select("ep", "first", "last"), "ep").where("fi between first and last").select("ep", "fi", "value", F.coalesce("step", F.lit(0.0)).alias("step"))


# Trims

_PLAN = f"""{_RANGES}, pf as (select f.*, t >= coalesce(start_s, 0) and (end_s is null or t <= end_s) keep from f left join ranges using (ep)),
    pl as (select ep, min(fi) filter (where keep) a, max(fi) filter (where keep) + 1 b, min(t) filter (where keep) s, count(*) n from pf group by 1),
    pb as (select *, coalesce(sum(b - a) over (order by ep rows between unbounded preceding and 1 preceding), 0) base from pl),
    rw as (select f.ep, event_id, f.fi - a fi, t - s t, cast(base + f.fi - a as bigint) "index" from f join pb using (ep) where f.fi >= a and f.fi < b)"""


@query(f"with {FRAMES}, {_PLAN} select ep, a start_frame, b end_frame, b - a new_length, n old_length, cast(base as bigint) base from pb")
def trim_range(spark: SparkSession, d: str) -> DataFrame:
    return trim.plan(frames(spark, d), ranges(spark)).select("ep", "start_frame", "end_frame", "new_length", "old_length", "base")


def rewritten(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, d)
    plans = trim.plan(f, ranges(spark))
    return trim.rewrite(f, plans), plans


@query(f"with {FRAMES}, {_PLAN} select ep, event_id, fi, t, \"index\" from rw")
def trim_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return rewritten(spark, d)[0].select("ep", "event_id", "fi", "t", "index")
