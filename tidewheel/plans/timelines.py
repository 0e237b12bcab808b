"""Windows, sessions, samples, batches and the batch twins of the streams as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions import vectors
from tidewheel.operators import sampling, segments, windows
from tidewheel.plans.registry import FRAMES, Registry
from tidewheel.plans.relations import rounded
from tidewheel.plans.scans import frames
from tidewheel.session import attach, table

query = Registry()

# Action chunks

_N = "n as (select ep, max(fi) m from f group by 1)"


@query(f"with {FRAMES}, {_N} select f.ep, f.fi, j step, g.value x from f join n using (ep), range(4) r(j), f g where g.ep = f.ep and g.fi = least(f.fi + j, m)")
def chunk_clamp(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.chunks(frames(spark, d), ["value"], 4)
    return rows.select("ep", "fi", F.posexplode("value_chunk").alias("step", "x")).select("ep", "fi", F.col("step").cast("long").alias("step"), "x")


@query(f"with {FRAMES}, {_N} select ep, fi, j step, fi + j > m pad from f join n using (ep), range(4) r(j)")
def chunk_pad_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.chunks(frames(spark, d), ["value"], 4)
    return rows.select("ep", "fi", F.posexplode("pad").alias("step", "pad")).select("ep", "fi", F.col("step").cast("long").alias("step"), "pad")


@query(f"with {FRAMES}, {_N} select f.ep, f.fi, j step, g.value a, g.event_id b from f join n using (ep), range(3) r(j), f g where g.ep = f.ep and g.fi = least(f.fi + j, m)")
def chunk_two_cols(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.chunks(frames(spark, d), ["value", "event_id"], 3)
    both = F.posexplode(F.arrays_zip(F.col("value_chunk").alias("a"), F.col("event_id_chunk").alias("b"))).alias("step", "x")
    return rows.select("ep", "fi", both).select("ep", "fi", F.col("step").cast("long").alias("step"), "x.a", "x.b")


# Kinematics

_KIN = """s as (select *, value - lag(value) over w step, t - lag(t) over w raw from f window w as (partition by ep order by fi)),
    dts as (select *, case when fi = 0 then null when raw > 0 and isfinite(raw) then raw else 43200.0 end dt from s),
    v as (select *, step / dt velocity from dts),
    a as (select *, (velocity - lag(velocity) over w) / ((dt + lag(dt) over w) / 2) acceleration from v window w as (partition by ep order by fi))"""


def kinematic(spark: SparkSession, d: str) -> DataFrame:
    return windows.kinematics(frames(spark, d), "value", 43_200.0)


@query(f"with {FRAMES}, {_KIN} select ep, fi, step from a where step is not null")
def joint_step(spark: SparkSession, d: str) -> DataFrame:
    return kinematic(spark, d).where("step is not null").select("ep", "fi", "step")


@query(f"with {FRAMES}, {_KIN} select ep, fi, round(dt, 6) dt from a where dt is not null")
def valid_dt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kinematic(spark, d).where("dt is not null").select("ep", "fi", "dt"), ["dt"])


@query(f"with {FRAMES}, {_KIN} select ep, fi, round(velocity * 1e4, 6) + 0.0 velocity, round(acceleration * 1e8, 4) + 0.0 acceleration from a where acceleration is not null")
def kinematics(spark: SparkSession, d: str) -> DataFrame:
    k = kinematic(spark, d).where("acceleration is not null")
    return k.select("ep", "fi", *shown())


def shown() -> list:
    """Velocity and acceleration at a scale at which rounding keeps their digits; adding 0 makes -0 plain."""
    return [(F.round(F.col("velocity") * 1e4, 6) + 0.0).alias("velocity"), (F.round(F.col("acceleration") * 1e8, 4) + 0.0).alias("acceleration")]


@query(f"with {FRAMES}, {_KIN} select ep, fi, coalesce(step, 0) step, coalesce(round(velocity * 1e4, 6), 0) + 0.0 velocity, coalesce(round(acceleration * 1e8, 4), 0) + 0.0 acceleration from a")
def kinematics_padded(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0.0)
    k = kinematic(spark, d)
    return k.select("ep", "fi", F.coalesce("step", zero).alias("step"), *(F.coalesce(c, zero).alias(n) for c, n in zip(shown(), ("velocity", "acceleration"), strict=True)))


@query(f"with {FRAMES}, {_KIN} select ep, max(abs(step)) max_step, round(max(abs(velocity)) * 1e4, 6) max_velocity from a group by 1")
def kinematic_max(spark: SparkSession, d: str) -> DataFrame:
    top = lambda c: F.max(F.when(~F.isnan(c), F.abs(c)))
    return kinematic(spark, d).groupBy("ep").agg(top("step").alias("max_step"), F.round(top("velocity") * 1e4, 6).alias("max_velocity"))


_LIMITS = (("joint_step_jump", "step", 400.0), ("velocity_limit", "velocity", 0.05), ("velocity_jump", "acceleration", 1e-5))
_LIMIT_SQL = " union all ".join(f"select ep, '{c}' code, round(max(abs({x})), 8) worst from a group by 1 having max(abs({x})) > {v}" for c, x, v in _LIMITS)


@query(f"with {FRAMES}, {_KIN} {_LIMIT_SQL}")
def kinematic_issues(spark: SparkSession, d: str) -> DataFrame:
    tops = kinematic(spark, d).groupBy("ep").agg(*(F.max(F.when(~F.isnan(x), F.abs(x))).alias(x) for _, x, _ in _LIMITS))
    found = tops.select("ep", F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(x).alias("worst"), F.lit(v).alias("limit")) for c, x, v in _LIMITS))).alias("i"))
    return found.where("i.worst > i.limit").select("ep", "i.code", F.round("i.worst", 8).alias("worst"))


@query(f"with {FRAMES}, {_KIN} select ep, arg_max(fi, (abs(step), -fi)) frame, max(abs(step)) worst from a where step is not null group by 1")
def largest_jump(spark: SparkSession, d: str) -> DataFrame:
    k = kinematic(spark, d).where("step is not null")
    size = F.abs(F.nanvl(F.col("step"), F.lit(-1.0)))
    return k.groupBy("ep").agg(F.max_by("fi", F.struct(size, -F.col("fi"))).alias("frame"), F.max(size).alias("worst"))


@query(
    """with e as (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 fi, embedding v, lag(embedding) over (partition by label order by vec_id) p from embeddings)
    select label, vec_id, round(coalesce(sqrt(list_sum(list_transform(range(1, 65), lambda i: power(cast(v[i] as double) - cast(p[i] as double), 2)))), 0) * 30, 5) motion from e"""
)
def motion_signal(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("label").alias("ep"), F.col("vec_id").alias("us"), "vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    ordered = segments.look_around(segments.number_frames(rows, "vec_id", 1_000_000), before=1).withColumn("p", F.lag("v").over(segments.nearby()))
    moved = F.coalesce(vectors.norm_of_difference(F.col("v"), F.col("p")), F.lit(0.0)) * 30
    return segments.own_rows(ordered).select(F.col("ep").alias("label"), "vec_id", F.round(moved, 5).alias("motion"))


_MOVING = "abs(velocity) >= 0.002"


@query(
    f"""with {FRAMES}, {_KIN}, m as (select ep, min(fi) - 1 first, max(fi) last, count(*) moving from a where {_MOVING} group by 1), n as (select ep, max(fi) last_fi from f group by 1)
    select n.ep, coalesce(m.first, -1) first_moving, coalesce(m.last, -1) last_moving, round(b.t, 3) start_idle_s, round(e.t - c.t, 3) end_idle_s, coalesce(moving, 0) = 0 static
    from n left join m using (ep) left join f b on b.ep = n.ep and b.fi = m.first left join f c on c.ep = n.ep and c.fi = m.last left join f e on e.ep = n.ep and e.fi = last_fi"""
)
def boundary_idle(spark: SparkSession, d: str) -> DataFrame:
    k = kinematic(spark, d).select("ep", "fi", "t", (F.abs("velocity") >= 0.002).alias("moves"))
    moving = F.col("moves")
    g = k.groupBy("ep").agg(
        F.min(F.when(moving, F.col("fi"))).alias("a"), F.max(F.when(moving, F.col("fi"))).alias("b"), F.max("t").alias("end"), F.max_by("t", F.when(moving, F.col("fi"))).alias("last_t"), F.count_if(moving).alias("n")
    )
    starts = attach(k, g.select("ep", (F.col("a") - 1).alias("a1")), "ep").where("fi = a1").select("ep", F.col("t").alias("first_t"))
    both = g.join(starts, "ep", "left")
    return both.select(
        "ep", F.coalesce(F.col("a") - 1, F.lit(-1)).alias("first_moving"), F.coalesce("b", F.lit(-1)).alias("last_moving"), F.round("first_t", 3).alias("start_idle_s"),
        F.round(F.col("end") - F.col("last_t"), 3).alias("end_idle_s"), (F.col("n") == 0).alias("static"),
    )


# Holds

_HZ = 1 / 86_400
_TICK = f"floor(t * {_HZ!r}::double + 1e-5)"
_POLLS = f"p as (select ep, fi, t, value, case when fi = 0 or {_TICK} <> lag({_TICK}) over (partition by ep order by fi) then fi end poll from f), h as (select *, max(poll) over (partition by ep order by fi) held_fi from p)"


@query(f"with {FRAMES}, {_POLLS} select h.ep, h.fi, h.held_fi, round(h.t - g.t, 6) age from h join f g on h.ep = g.ep and h.held_fi = g.fi")
def hold_age(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.poll_hold(frames(spark, d), _HZ).select("ep", "fi", "held_fi", "age"), ["age"])


@query(
    f"""with recursive {FRAMES}, r as (select ep, fi, t, fi polled_fi, t last_t, value held from f where fi = 0
        union all select f.ep, f.fi, f.t, case when f.t - last_t >= 86400 - 1e-5 then f.fi else polled_fi end, case when f.t - last_t >= 86400 - 1e-5 then f.t else last_t end,
        case when f.t - last_t >= 86400 - 1e-5 then f.value else held end from r join f on f.ep = r.ep and f.fi = r.fi + 1)
    select ep, fi, polled_fi, held from r"""
)
def rate_limited_hold(spark: SparkSession, d: str) -> DataFrame:
    return windows.rate_limited_hold(frames(spark, d), "value", _HZ)


# Sessions

_GAP = 21_600.0
_SESSIONS = f"g as (select *, case when t - lag(t) over (partition by ep order by fi) > {_GAP} then 1 else 0 end nw from f), s as (select *, sum(nw) over (partition by ep order by fi) session from g)"


@query(f"with {FRAMES}, {_SESSIONS} select ep, fi, cast(session as bigint) session from s")
def sessionize_gap(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(frames(spark, d), _GAP).select("ep", "fi", "session")


@query(
    f"""with {FRAMES}, {_SESSIONS}, r as (select *, row_number() over (partition by ep, session order by fi) - 1 rn from s)
    select ep, fi, cast(session as bigint) session, rn // 4 chunk, rn % 4 = 0 replanned, first_value(value) over (partition by ep, session, rn // 4 order by fi) anchor from r"""
)
def replan_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.replan(windows.sessions(frames(spark, d), _GAP), 4, "value")
    return rows.select("ep", "fi", "session", "chunk", "replanned", "anchor")


@query("""select event_id, case when k > 95 then 'future' when k < 20 then 'stale' else 'ok' end class from (select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events)""")
def late_classify(spark: SparkSession, d: str) -> DataFrame:
    from tidewheel.streaming.sessions import freshness

    k = F.get_json_object("props", "$.k").cast("double")
    now, stamp = F.lit(0.0), (k - 95.0) / 150.0  # 0.5 s are 75 of k
    return table(spark, d, "events").select("event_id", freshness(now, stamp).alias("class"))


@query(
    """with m as (select user_id client, event_id, case event_type when 'signup' then 1 when 'click' then 2 when 'view' then 3 else 0 end kind from events),
    s as (select *, max(case when kind = 1 then event_id end) over w d_, max(case when kind = 2 then event_id end) over w l_ from m window w as (partition by client order by event_id rows between unbounded preceding and 1 preceding))
    select client, event_id, case when kind = 1 then 'described' when kind = 2 then case when d_ is null then 'error' else 'loaded' end when kind = 3 then case when l_ is null or d_ is null then 'error' else 'inferred' end else 'ignored' end state from s"""
)
def protocol_state(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).otherwise(0)
    rows = table(spark, d, "events").select(F.col("user_id").alias("ep"), F.col("event_id").alias("us"), "event_id", kind.alias("kind"))
    f = segments.number_frames(rows, "event_id", 1_000_000)
    f = segments.carry_last(segments.carry_last(f, F.when(F.col("kind") == 1, F.col("fi")), "d_"), F.when(F.col("kind") == 2, F.col("fi")), "l_")
    described, loaded = F.col("d_") < F.col("fi"), F.col("l_") < F.col("fi")
    no = F.lit(False)
    state = (
        F.when(F.col("kind") == 1, "described").when(F.col("kind") == 2, F.when(F.coalesce(described, no), "loaded").otherwise("error"))
        .when(F.col("kind") == 3, F.when(F.coalesce(loaded, no) & F.coalesce(described, no), "inferred").otherwise("error")).otherwise("ignored")
    )
    return f.select(F.col("ep").alias("client"), "event_id", state.alias("state"))


# Masks and positions

_FLAGS = "(k + pos) % 5 <> 0 ok, (k + pos) % 3 = 0 bl"
_BLOCKS = """tb as (select k, pos, {0} from tk), tc as (select *, sum(cast(bl as int)) over (partition by k order by pos) b, sum(cast(ok as int)) over (partition by k order by pos) - 1 p from tb)""".format(_FLAGS)


def flagged(rows: DataFrame) -> DataFrame:
    s = F.col("key") + F.col("pos")
    return rows.select("key", "pos", (s % 5 != 0).alias("ok"), (s % 3 == 0).alias("bl"))


@query(f"with tk as (select p_partkey k, unnest(range(len(str_split(p_name, ' ')))) pos from part), {_BLOCKS} select a.k \"key\", a.pos i, b.pos j, b.b <= a.b and a.ok and b.ok may from tc a join tc b on a.k = b.k")
def attn_mask(spark: SparkSession, d: str) -> DataFrame:
    """Masks over the words of each part's name: sequences that are short by nature, as the result is quadratic in their length."""
    words = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    return windows.attention_mask(flagged(words.withColumn("pos", F.col("pos").cast("long"))), "ok", "bl")


@query(f"with tk as (select doc_id k, unnest(range(n_chars)) pos from documents where n_chars > 0), {_BLOCKS} select k \"key\", pos, cast(p as bigint) p from tc")
def position_ids(spark: SparkSession, d: str) -> DataFrame:
    """Positions of every character of every document."""
    rows = segments.numbered(table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("n")), "n", "pos").drop("n")
    f = flagged(rows).withColumnsRenamed({"key": "ep", "pos": "fi"})
    summed = segments.running_sum(f, F.col("ok").cast("long"), "p")
    return summed.select(F.col("ep").alias("key"), F.col("fi").alias("pos"), (F.col("p") - 1).alias("p"))


# Index, time and trims

_E = "e as (select ep, count(*) n from f group by 1), o as (select ep, n, coalesce(sum(n) over (order by ep rows between unbounded preceding and 1 preceding), 0) base from e)"


@query(f"with {FRAMES}, {_E} select f.ep, fi, event_id, cast(base + fi as bigint) \"index\" from f join o using (ep)")
def global_index(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    base = segments.positions(f.groupBy("ep").agg(F.count("*").alias("n")), ["ep"], F.col("n"), "base")
    return attach(f, base.select("ep", "base"), "ep").select("ep", "fi", "event_id", (F.col("base") + F.col("fi")).alias("index"))


@query(f"with {FRAMES} select ep, event_id, round(t - min(t) over (partition by ep), 6) rebased from f where t >= 86400")
def rebase_time(spark: SparkSession, d: str) -> DataFrame:
    kept = frames(spark, d).where("t >= 86400")
    first = kept.groupBy("ep").agg(F.min("t").alias("t0"))
    return attach(kept, first, "ep").select("ep", "event_id", F.round(F.col("t") - F.col("t0"), 6).alias("rebased"))


# Samples and batches

_LIN = "case when i = m - 1 then n - 1 else i * ((n - 1)::double / greatest(m - 1, 1)) end"


def episode_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("ep")).agg(F.count("*").alias("n"))


_SIZES = "z as (select user_id ep, count(*) n, least(count(*), 24) m from events group by 1), p as (select ep, n, m, unnest(range(m)) i from z)"


@query(f"with {_SIZES} select ep, cast(round_even({_LIN}, 0) as bigint) pick from p")
def linspace_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.spaced(episode_sizes(spark, d), 24).select("ep", "pick")


@query(f"with {_SIZES} select distinct ep, cast(round_even({_LIN}, 0) as bigint) pick from p")
def downsample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.spaced(episode_sizes(spark, d), 24).select("ep", "pick").distinct()


@query(f"with {_SIZES} select ep, cast(floor({_LIN}) as bigint) pick from p")
def linspace_trunc(spark: SparkSession, d: str) -> DataFrame:
    return sampling.spaced(episode_sizes(spark, d), 24, "floor").select("ep", "pick")


@query("select event_id, value from events order by value desc, event_id limit 20")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "value")


@query("select event_id, value from events order by md5('7:' || event_id), event_id limit 640")
def hash_sample_limit(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_sample(table(spark, d, "events").select("event_id", "value"), "event_id", 640, 7)


@query("with p as (select event_id, row_number() over (order by event_id) - 1 k, count(*) over () n from events) select event_id, k // 32 batch_id, k % 32 pos from p where (k // 32 + 1) * 32 <= n")
def batching(spark: SparkSession, d: str) -> DataFrame:
    return sampling.batches(table(spark, d, "events").select("event_id"), ["event_id"], 32)


_DRAWN = """w as (select * from (values ('click', 0.5::double), ('view', 0.3::double), ('purchase', 0.2::double)) v(event_type, weight)),
    k as (select event_id, event_type, value, row_number() over (partition by event_type order by md5('11:' || event_id), event_id) - 1 k from events join w using (event_type)),
    z as (select event_type, count(*) n, cast(floor((select count(*) from events) * any_value(weight)) as bigint) due from k join w using (event_type) group by 1),
    x as (select event_type, n, unnest(range(due)) draw from z), y as (select event_type, draw, cast('0x' || substr(md5('11:' || event_type || ':' || draw), 1, 15) as bigint) % n k from x)"""


@query(f"with {_DRAWN} select event_id, event_type, value, draw from y join k using (event_type, k)")
def weighted_mix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    return sampling.resample(rows, "event_type", "event_id", {"click": 0.5, "view": 0.3, "purchase": 0.2}, 11)
