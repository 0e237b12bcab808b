"""Scans, sinks, projections, filters and text functions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import text, vectors
from tidewheel.operators import projections, segments
from tidewheel.plans.registry import FRAMES, Registry
from tidewheel.session import table
from tidewheel.sources import episodic

query = Registry()


def frames(spark: SparkSession, d: str) -> DataFrame:
    return segments.event_frames(table(spark, d, "events"))


# Sources


@query("select event_id, user_id, value from events where event_type = 'purchase'")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "value")


@query("select event_id, event_type, value from events where user_id = 7")
def scan_episode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("user_id = 7").select("event_id", "event_type", "value").orderBy("event_id")


@query("select distinct user_id, printf('data/chunk-%03d/episode_%06d.parquet', user_id // 1000, user_id) path from events")
def episode_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct().select("user_id", episodic.episode_path(F.col("user_id")).alias("path"))


_LINES = ("0,0.5", "1,abc", "2,-1", "3,nan", "4,1.25", "x,1", "5,0", "6,inf")


@query(
    "with l as (select unnest([" + ",".join(f"'{x}'" for x in _LINES) + """]) l),
    p as (select try_cast(split_part(l, ',', 1) as bigint) episode, try_cast(split_part(l, ',', 2) as double) trim_s from l)
    select episode, trim_s from p where episode is not null and trim_s is not null and isfinite(trim_s) and trim_s >= 0"""
)
def manifest_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in _LINES], "line string").select(F.expr("try_cast(split(line, ',')[0] as bigint) episode"), F.expr("try_cast(split(line, ',')[1] as double) trim_s"))
    return rows.where(F.col("episode").isNotNull() & F.col("trim_s").isNotNull() & ~vectors.nonfinite(F.col("trim_s")) & (F.col("trim_s") >= 0))


@query("""select cast(key as bigint) episode, cast(value as double) trim_s from json_each('{"0": 0.5, "3": 0.8, "12": 2}')""")
def manifest_explode(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([('{"0": 0.5, "3": 0.8, "12": 2}',)], "doc string")
    return rows.select(F.explode(F.from_json("doc", "map<string,double>")).alias("k", "trim_s")).select(F.col("k").cast("long").alias("episode"), "trim_s")


@query("select vec_id, cast(i as bigint) dim, cast(embedding[i + 1] as double) x from embeddings, range(64) r(i)")
def flatten_nested(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "embeddings").select("vec_id", vectors.rows_of(F.col("embedding"), 8).alias("m"))
    return nested.select("vec_id", F.posexplode(F.flatten("m")).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


@query("select cast(count(*) as bigint) n, cast(min(len(embedding)) as bigint) least, cast(max(len(embedding)) as bigint) most, count(distinct len(embedding)) = 1 regular from embeddings")
def regular_width(spark: SparkSession, d: str) -> DataFrame:
    size = F.size("embedding").cast("long")
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most")).withColumn("regular", F.col("least") == F.col("most"))


@query()
def fake_source(spark: SparkSession, d: str) -> DataFrame:
    return episodic.fake_frames(spark, 1_000, {"state": ("float", 7), "tokens": ("int", 16), "image": ("zero", 4)})


@query(
    """with e as (select distinct episode_index e from episodes), r as (select e, row_number() over (order by e) - 1 k from e)
    select cast(count(*) as bigint) episodes, cast(count(*) filter (where e <> k) as bigint) violations from r"""
)
def episodes_contiguous(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "episodes").where("episode_index is not null").select("episode_index").distinct()
    return segments.positions(known, ["episode_index"]).agg(F.count("*").alias("episodes"), F.count_if(F.col("episode_index") != F.col("position")).alias("violations"))


_DT = "g as (select *, t - lag(t) over (partition by ep order by fi) dt from f)"


@query(f"with {FRAMES}, {_DT} select ep, cast(count(*) as bigint) steps, cast(count(*) filter (where abs(dt - 43200) <= 21600) as bigint) on_time from g where dt is not null group by ep")
def time_tolerance(spark: SparkSession, d: str) -> DataFrame:
    dt = F.col("t") - F.lag("t").over(segments.nearby())
    rows = segments.own_rows(segments.look_around(frames(spark, d), before=1).withColumn("dt", dt)).where("dt is not null")
    return rows.groupBy("ep").agg(F.count("*").alias("steps"), F.count_if(F.abs(F.col("dt") - 43_200) <= 21_600).alias("on_time"))


# Sinks


@query(
    """with x as (select distinct episode_index, frame_index, i joint_index, cast("observation.state"[i + 1] as double) v from frames, range(7) r(i)
        where "observation.state" is not null and episode_index is not null and frame_index is not null)
    select episode_index, frame_index, cast(joint_index as bigint) joint_index, cast(case when isfinite(v) then v end as double) x from x where not isfinite(v)"""
)
def nan_to_null(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "frames").where("episode_index is not null and frame_index is not null").select("episode_index", "frame_index", F.posexplode("`observation.state`").alias("joint_index", "v"))
    bad = vectors.nonfinite(F.col("v"))
    return rows.where(bad).select("episode_index", "frame_index", F.col("joint_index").cast("long").alias("joint_index"), F.when(~bad, F.col("v").cast("double")).alias("x")).distinct()


@query("select event_id, user_id ep, case when user_id = (select max(user_id) from events) then 'val' else 'train' end split from events")
def cache_split(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    last = F.broadcast(events.agg(F.max("user_id").alias("last")))  # one row
    return events.crossJoin(last).select("event_id", F.col("user_id").alias("ep"), F.when(F.col("user_id") == F.col("last"), "val").otherwise("train").alias("split"))


@query(
    f"""with {FRAMES}, e as (select ep, max(t) s, count(*) n from f group by 1),
    o as (select ep, s, n, coalesce(sum(n) over w, 0) first_frame, coalesce(sum(s) over w, 0) offset_s from e window w as (order by ep rows between unbounded preceding and 1 preceding))
    select ep, cast(n as bigint) n, cast(first_frame as bigint) first_frame, round(offset_s, 3) offset_s from o"""
)
def global_timeline(spark: SparkSession, d: str) -> DataFrame:
    e = frames(spark, d).groupBy("ep").agg(F.max("t").alias("s"), F.count("*").alias("n"))
    placed = segments.positions(segments.positions(e, ["ep"], F.col("n"), "first_frame"), ["ep"], F.col("s"), "offset_s")
    return placed.select("ep", "n", "first_frame", F.round("offset_s", 3).alias("offset_s"))


# Projections


@query("select event_id, user_id a_b, value d from events")
def repack(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "events").select(F.struct(F.struct("user_id").alias("who"), "value").alias("in"), "event_id")
    packed = projections.repack(source, {"event_id": "event_id", "a": {"b": "in/who/user_id"}, "d": "in/value"})
    return packed.select("event_id", F.col("a.b").alias("a_b"), "d")


@query('select event_id "event_id", user_id "a/b/u", value "a/v" from events')
def flatten_struct(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "events").select("event_id", F.struct(F.struct(F.col("user_id").alias("u")).alias("b"), F.col("value").alias("v")).alias("a"))
    return projections.flatten(nested)


@query("select event_id, user_id c_b, value c_v from events")
def rename_regex(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "events").select("event_id", F.struct(F.col("user_id").alias("b"), F.col("value").alias("v"), "props").alias("a"))
    renamed = projections.flatten(projections.rename(nested, {r"a/(b|v)": r"c/\1", r"a/.+": None}))
    return renamed.toDF(*(c.replace("/", "_") for c in renamed.columns))


@query("select event_id, 'move' prompt from events")
def default_prompt(spark: SparkSession, d: str) -> DataFrame:
    return projections.with_default(table(spark, d, "events"), "prompt", "move").select("event_id", "prompt")


@query("select event_id, user_id, event_type, value from (select event_id, ts, user_id, event_type, value from events)")
def drop_col(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").drop("props", "ts", "not_there")


@query("select event_id, user_id, value from events")
def drop_strings(spark: SparkSession, d: str) -> DataFrame:
    return projections.without_strings(table(spark, d, "events")).drop("ts")


_PICK = [5, 0, 63, 7]


@query("select vec_id, cast(k as bigint) dim, cast(embedding[[6, 1, 64, 8][k + 1]] as double) x from embeddings, range(4) r(k)")
def vector_select(spark: SparkSession, d: str) -> DataFrame:
    return exploded(table(spark, d, "embeddings").select("vec_id", vectors.select(F.col("embedding"), _PICK).alias("v")), "vec_id")


def exploded(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of (keys, dim, x) from a vector column v."""
    return df.select(*keys, F.posexplode("v").alias("dim", "x")).select(*keys, F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


@query("select vec_id, cast(k as bigint) dim, cast(embedding[k + 9] as double) x from embeddings, range(56) r(k)")
def vector_slice(spark: SparkSession, d: str) -> DataFrame:
    return exploded(table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 9, 56).alias("v")), "vec_id")


@query("select event_id, event_type prompt, value state, true left_mask, true right_mask from events")
def make_observation(spark: SparkSession, d: str) -> DataFrame:
    made = projections.observation(table(spark, d, "events"), {"state": F.col("value")}, ["left", "right"], F.col("event_type"))
    return made.select("event_id", F.col("observation.prompt").alias("prompt"), F.col("observation.state").alias("state"), F.col("observation.image_mask.left").alias("left_mask"), F.col("observation.image_mask.right").alias("right_mask"))


@query("select vec_id, cast(r as bigint) step, cast(k as bigint) dim, cast(embedding[r * 8 + k + 1] as double) x from embeddings, range(8) a(r), range(3) b(k)")
def truncate_dims(spark: SparkSession, d: str) -> DataFrame:
    m = F.transform(vectors.rows_of(F.col("embedding"), 8), lambda r: vectors.take(r, 3))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(m).alias("step", "v"))
    return exploded(rows.withColumn("step", F.col("step").cast("long")), "vec_id", "step")


@query("select vec_id, cast(k as bigint) dim, cast(embedding[k * 5 + 1] as double) x from embeddings, range(13) r(k)")
def subsample(spark: SparkSession, d: str) -> DataFrame:
    return exploded(table(spark, d, "embeddings").select("vec_id", vectors.every(F.col("embedding"), 5).alias("v")), "vec_id")


@query("select vec_id, cast(k as bigint) dim, coalesce(cast(embedding[k + 1] as double), 0) x from embeddings, range(70) r(k)")
def pad_vector(spark: SparkSession, d: str) -> DataFrame:
    return exploded(table(spark, d, "embeddings").select("vec_id", vectors.pad(vectors.doubles(F.col("embedding")), 70).alias("v")), "vec_id")


@query("select unnest(range(56)) dim, unnest(list_concat(range(14, 21), range(28, 49), range(21, 28), range(49, 70))) source")
def dims_spec(spark: SparkSession, d: str) -> DataFrame:
    spec = spark.createDataFrame([("14:21,28:49,21:28,49:70",)], "spec string")
    return spec.select(F.posexplode(text.spec_ranges(F.col("spec"), ":", False)).alias("dim", "source")).select(F.col("dim").cast("long").alias("dim"), F.col("source").cast("long").alias("source"))


@query("select event_id, user_id from events where user_id in (0, 2, 5, 6, 7, 8, 9)")
def episode_spec(spark: SparkSession, d: str) -> DataFrame:
    spec = spark.createDataFrame([("0,2,5-9",)], "spec string").select(F.explode(text.spec_ranges(F.col("spec"), "-", True).cast("array<long>")).alias("user_id"))
    return table(spark, d, "events").join(F.broadcast(spec), "user_id", "left_semi").select("event_id", "user_id")  # numbers of one spec


# Filters and checks


@query(f"with {FRAMES} select ep, fi, event_id from f where t >= 86400")
def trim_prefix(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).where("t >= 86400").select("ep", "fi", "event_id")


@query(f"with {FRAMES} select ep, fi, event_id from f where fi >= 3 and fi < 10")
def frame_slice(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).where("fi >= 3 and fi < 10").select("ep", "fi", "event_id")


@query(
    """with x as (select distinct episode_index e, frame_index fi, i j, cast("observation.state"[i + 1] as double) v from frames, range(7) r(i)
        where "observation.state" is not null and episode_index is not null and frame_index is not null)
    select e episode_index, cast(count(*) as bigint) n, min(fi) first_frame, cast(arg_min(j, fi * 7 + j) as bigint) first_dim from x where not isfinite(v) group by 1"""
)
def nonfinite(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "frames").where("episode_index is not null and frame_index is not null").select("episode_index", "frame_index", F.posexplode("`observation.state`").alias("j", "v"))
    bad = rows.where(vectors.nonfinite(F.col("v"))).select("episode_index", "frame_index", "j").distinct()
    first = F.min(F.struct("frame_index", "j"))
    return bad.groupBy("episode_index").agg(F.count("*").alias("n"), first.alias("f")).select("episode_index", "n", F.col("f.frame_index").alias("first_frame"), F.col("f.j").cast("long").alias("first_dim"))


@query(f"with {FRAMES}, g as (select *, lag(value) over (partition by ep order by fi) p from f) select ep, fi, value from g where value <= p")
def non_increasing(spark: SparkSession, d: str) -> DataFrame:
    rows = segments.look_around(frames(spark, d), before=1).withColumn("p", F.lag("value").over(segments.nearby()))
    return segments.own_rows(rows).where("value <= p").select("ep", "fi", "value")


@query(
    """with f as (select distinct episode_index e, frame_index fi from frames where episode_index is not null and frame_index is not null)
    select e episode_index, cast(count(*) as bigint) n, cast(max(fi) + 1 - count(*) as bigint) missing, max(fi) + 1 = count(*) and min(fi) = 0 dense from f group by 1"""
)
def dense_index(spark: SparkSession, d: str) -> DataFrame:
    g = delivered(spark, d).groupBy("episode_index").agg(F.count("*").alias("n"), F.max("frame_index").alias("b"), F.min("frame_index").alias("a"))
    return g.select("episode_index", "n", (F.col("b") + 1 - F.col("n")).alias("missing"), ((F.col("b") + 1 == F.col("n")) & (F.col("a") == 0)).alias("dense"))


def delivered(spark: SparkSession, d: str) -> DataFrame:
    """(episode_index, frame_index), each frame once."""
    return table(spark, d, "frames").where("episode_index is not null and frame_index is not null").groupBy("episode_index", "frame_index").agg(F.lit(1).alias("one")).drop("one")


@query(
    """with n as (select episode_index e, count(distinct frame_index) n from frames where episode_index is not null group by 1),
    m as (select episode_index e, max(length) length from episodes where episode_index is not null group by 1)
    select coalesce(n.e, m.e) episode_index, coalesce(cast(n.n as bigint), 0) n, length, coalesce(n.n = length, false) equal from n full join m on n.e = m.e"""
)
def length_check(spark: SparkSession, d: str) -> DataFrame:
    n = delivered(spark, d).groupBy("episode_index").agg(F.count("*").alias("n"))
    m = table(spark, d, "episodes").where("episode_index is not null").groupBy("episode_index").agg(F.max("length").alias("length"))
    both = n.join(m, "episode_index", "full").withColumn("equal", F.coalesce(F.col("n") == F.col("length"), F.lit(False)))
    return both.select("episode_index", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "length", "equal")


@query(
    """with f as (select distinct episode_index e, frame_index fi from frames where episode_index is not null and frame_index is not null),
    m as (select episode_index e, max(length) length from episodes where length > 0 group by 1)
    select e episode_index, fi frame_index from (select e, unnest(range(length)) fi from m) anti join f using (e, fi)"""
)
def missing_frames(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "episodes").where("length > 0 and episode_index is not null").groupBy("episode_index").agg(F.max("length").alias("length"))
    due = m.select("episode_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("frame_index"))
    return due.join(delivered(spark, d), ["episode_index", "frame_index"], "left_anti")


@query(
    """select vec_id, len(embedding) = 64 width_ok, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) finite_ok, cast(8 as bigint) steps from embeddings"""
)
def group_actions(spark: SparkSession, d: str) -> DataFrame:
    m = vectors.rows_of(F.col("embedding"), 8)
    fine = F.forall("embedding", lambda x: ~vectors.nonfinite(x))
    return table(spark, d, "embeddings").select("vec_id", (F.size("embedding") == 64).alias("width_ok"), fine.alias("finite_ok"), F.size(m).cast("long").alias("steps"))


# Text


@query(r"""select doc_id, md5(translate(regexp_replace(text, '^\s+|\s+$', '', 'g'), '_' || chr(10), '  ')) prompt from documents where text is not null""")
def clean_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.clean_prompt(F.col("text"))).alias("prompt"))


_BINS = "greatest(-1, least(255, cast(floor((cast(x as double) + 1) * 128) as bigint)))"


@query(
    f"""select vec_id, 'Task: reach ' || label || ', State: ' || array_to_string(list_transform(embedding[1:4], lambda x: {_BINS}), ' ') || ';' || chr(10) || 'Action: ' prompt from embeddings"""
)
def prompt_template(spark: SparkSession, d: str) -> DataFrame:
    bins = F.transform(F.slice("embedding", 1, 4), vectors.discretize)
    return table(spark, d, "embeddings").select("vec_id", text.prompt_with_state(F.concat(F.lit("reach "), F.col("label").cast("string")), bins).alias("prompt"))


@query(
    """with w as (select p_partkey, str_split(p_name, ' ') w from part)
    select p_partkey, cast(i as bigint) pos, coalesce(w[i + 1], '') token, i < len(w) used from w, range(6) r(i)"""
)
def pad_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    both = w.select("p_partkey", F.posexplode(F.arrays_zip(text.pad_tokens(F.col("w"), 6).alias("token"), text.token_mask(F.col("w"), 6).alias("used"))).alias("pos", "x"))
    return both.select("p_partkey", F.col("pos").cast("long").alias("pos"), "x.token", "x.used")


@query("""select doc_id, coalesce(nullif(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'item') "name" from documents where text is not null""")
def safe_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.safe_name(F.col("text")).alias("name"))


@query(
    """with p as (select user_id, printf('ep%05d_dim%02d_joint %d.png', user_id, user_id % 7, user_id) f from (select distinct user_id from events))
    select user_id, cast(regexp_extract(f, '^ep(\\d+)_dim(\\d+)_(.+)\\.png$', 1) as bigint) ep, cast(regexp_extract(f, '^ep(\\d+)_dim(\\d+)_(.+)\\.png$', 2) as bigint) dim,
    regexp_extract(f, '^ep(\\d+)_dim(\\d+)_(.+)\\.png$', 3) "name" from p"""
)
def parse_name(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    f = F.format_string("ep%05d_dim%02d_joint %d.png", "user_id", F.col("user_id") % 7, "user_id")
    part = lambda i: F.regexp_extract(f, r"^ep(\d+)_dim(\d+)_(.+)\.png$", i)
    return users.select("user_id", part(1).cast("long").alias("ep"), part(2).cast("long").alias("dim"), part(3).alias("name"))


@query("select vec_id, cast(i as bigint) dim, coalesce(['x', 'y', 'z'][i + 1], printf('dim_%02d', i)) \"name\" from embeddings, range(6) r(i)")
def dim_names(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in "xyz"))
    rows = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("dim"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), text.dim_name(names, F.col("dim")).alias("name"))


@query("select p_partkey, case when starts_with(p_name, 'red') or starts_with(p_name, 'blue') then 'left' when ends_with(p_name, '1') then 'right' when contains(p_name, 'e') then 'hand' end grp from part")
def classify_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    grp = projections.first_match([(n.startswith("red") | n.startswith("blue"), "left"), (n.endswith("1"), "right"), (n.contains("e"), "hand")])
    return table(spark, d, "part").select("p_partkey", grp.alias("grp"))


@query("select doc_id, sha256(text) sha from documents where text is not null")
def doc_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("""select event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') sha from events""")
def canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.sha2(text.canonical_json({c: F.col(c) for c in ("user_id", "event_type", "event_id")}), 256).alias("sha"))


@query("""select event_id, event_id % 50 <> 3 intact from events""")
def tamper_check(spark: SparkSession, d: str) -> DataFrame:
    fields = {c: F.col(c) for c in ("user_id", "event_id")}
    stored = table(spark, d, "events").select("event_id", "user_id", F.sha2(text.canonical_json(fields), 256).alias("stored"))
    edited = stored.withColumn("user_id", F.when(F.col("event_id") % 50 == 3, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return edited.select("event_id", (F.sha2(text.canonical_json(fields), 256) == F.col("stored")).alias("intact"))


@query("""select event_id, k "key", cast(json_extract_string(props, '$.' || k) as bigint) value from events, (select unnest(['k']) k) where json_extract_string(props, '$.' || k) is not null""")
def feature_schema(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value")).where("value is not null")


@query(f"with {FRAMES} select ep, fi, cast(round(value * 30) as bigint) frame, round(fi / 30.0, 6) sec from f")
def seconds_to_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("ep", "fi", F.round(F.col("value") * 30).cast("long").alias("frame"), F.round(F.col("fi") / 30.0, 6).alias("sec"))
