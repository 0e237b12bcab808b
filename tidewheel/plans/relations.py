"""Joins, aggregations, set operations and tree merges as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions import vectors
from tidewheel.operators import segments, stats, trees
from tidewheel.operators.projections import checked, concatenated
from tidewheel.plans.registry import FRAMES, Registry
from tidewheel.plans.scans import exploded, frames
from tidewheel.session import attach, table

query = Registry()


def trims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 3600.0), (3, 86400.0), (7, 200000.0), (9999999, 1.0)], "ep long, trim_s double")


_TRIMS = "trims as (select * from (values (1, 3600.0::double), (3, 86400.0::double), (7, 200000.0::double), (9999999, 1.0::double)) v(ep, trim_s))"
_RANGES = "ranges as (select * from (values (1, 3600.0::double, null), (3, 86400.0::double, 700000.0::double), (7, 0.0::double, 200000.0::double)) v(ep, start_s, end_s))"


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 3600.0, None), (3, 86400.0, 700000.0), (7, 0.0, 200000.0)], "ep long, start_s double, end_s double")


# Joins


@query("select c_custkey, n_name prompt from customer join nation on c_nationkey = n_nationkey")
def prompt_from_task(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("prompt"))
    joined = attach(table(spark, d, "customer"), tasks, "c_nationkey", "left")
    return joined.select("c_custkey", checked(F.col("prompt"), F.col("prompt").isNotNull(), "unknown task").alias("prompt"))


@query(f"with {_TRIMS} select e.ep, coalesce(trim_s, 0) trim_s from (select distinct user_id ep from events) e left join trims using (ep)")
def trim_plan(spark: SparkSession, d: str) -> DataFrame:
    eps = table(spark, d, "events").select(F.col("user_id").alias("ep")).distinct()
    return attach(eps, trims(spark), "ep", "left").select("ep", F.coalesce("trim_s", F.lit(0.0)).alias("trim_s"))


@query(f"with {_RANGES} select e.ep, coalesce(start_s, 0) start_s, end_s from (select distinct user_id ep from events) e left join ranges using (ep)")
def range_plan(spark: SparkSession, d: str) -> DataFrame:
    eps = table(spark, d, "events").select(F.col("user_id").alias("ep")).distinct()
    return attach(eps, ranges(spark), "ep", "left").select("ep", F.coalesce("start_s", F.lit(0.0)).alias("start_s"), "end_s")


@query(f"with {_TRIMS} select cast(ep as bigint) ep from trims where ep not in (select user_id from events)")
def unknown_episodes(spark: SparkSession, d: str) -> DataFrame:
    return trims(spark).join(table(spark, d, "events").select(F.col("user_id").alias("ep")), "ep", "left_anti").select("ep")


@query(
    f"""with {_TRIMS}, k as (select user_id ep, dense_rank() over (order by user_id) - 1 new_ep from events where user_id in (select ep from trims) group by 1)
    select event_id, user_id ep, new_ep from events join k on user_id = ep"""
)
def selected_only(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.col("user_id").alias("ep"))
    kept = events.join(F.broadcast(trims(spark)), "ep", "left_semi")  # a manifest
    numbered = segments.positions(kept.select("ep").distinct(), ["ep"], name="new_ep")
    return attach(kept, numbered, "ep").select("event_id", "ep", "new_ep")


@query(
    """with s as (select event_type, count(*) n from events group by 1), o as (select event_type, n, coalesce(sum(n) over (order by event_type rows between unbounded preceding and 1 preceding), 0) a from s)
    select i idx, event_type dataset, cast(i - a as bigint) local_idx from o, unnest(range(a::bigint, (a + n)::bigint)) r(i)"""
)
def concat_index(spark: SparkSession, d: str) -> DataFrame:
    """Every index of the concatenated datasets with its owner and its place there."""
    n = segments.positions(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), ["event_type"], F.col("n"), "first")
    starts = n.select(F.col("first").alias("idx"), F.lit(0).alias("kind"), F.col("event_type").alias("dataset"))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    asked = spark.range(total).select(F.col("id").alias("idx"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("dataset"))
    # one ordered pass in place of an interval join: the starts are few, the indices are spread by range
    placed = segments.number_frames(starts.unionByName(asked).withColumn("ep", F.lit(0)).withColumn("us", F.col("idx")), "kind", 1 << 20)
    held = segments.carry_last(segments.carry_last(placed, F.col("dataset"), "owner"), F.when(F.col("kind") == 0, F.col("idx")), "first")
    return held.where("kind = 1").select("idx", F.col("owner").alias("dataset"), (F.col("idx") - F.col("first")).alias("local_idx"))


@query(f"with {FRAMES} select ep, fi, last_value(case when event_type = 'click' then value end ignore nulls) over (partition by ep order by fi) held from f")
def sample_hold(spark: SparkSession, d: str) -> DataFrame:
    return segments.carry_last(frames(spark, d), F.when(F.col("event_type") == "click", F.col("value")), "held").select("ep", "fi", "held")


@query(
    f"""with {FRAMES}, h as (select ep, fi, last_value(case when event_type = 'click' then fi end ignore nulls) over (partition by ep order by fi) src from f)
    select h.ep, h.fi, src, g.value from h join f g on h.ep = g.ep and h.src = g.fi"""
)
def sample_hold_join(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    held = segments.carry_last(f, F.when(F.col("event_type") == "click", F.col("fi")), "src").where("src is not null").select("ep", "fi", "src")
    return held.join(f.select("ep", F.col("fi").alias("src"), "value"), ["ep", "src"]).select("ep", "fi", "src", "value")


@query("select vec_id, cast(i as bigint) dim, cast(embedding[4 - i] as double) x from embeddings, range(4) r(i)")
def named_reorder(spark: SparkSession, d: str) -> DataFrame:
    names, wanted = ["j1", "j2", "j3", "j4"], ["j4", "j3", "j2", "j1"]
    by_name = F.map_from_arrays(vectors.literal(names), F.slice("embedding", 1, 4))
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(vectors.literal(wanted), lambda n: F.try_element_at(by_name, n)).alias("v"))
    return exploded(rows.withColumn("v", checked(F.col("v"), F.forall("v", lambda x: x.isNotNull()), "a joint is missing")), "vec_id")


@query("select 'base' view_, 'cam_high' camera union all select 'left', 'cam_left'")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([("base", "cam_high"), ("base", "top"), ("left", "cam_left"), ("left", "wrist_l"), ("right", "cam_right")], "view_ string, camera string")
    there = spark.createDataFrame([("cam_high",), ("cam_left",), ("other",)], "camera string")
    return aliases.join(F.broadcast(there), "camera").groupBy("view_").agg(F.count("*").alias("n"), F.first("camera").alias("camera")).where("n = 1").drop("n")


@query(
    f"""with {FRAMES}, v as (select ep, fi, t + case when fi % 5 = 0 then 0.4 else 0.1 end pts from f where fi % 11 <> 10), j as (select f.ep, abs(v.pts - f.t) gap from f join v on f.ep = v.ep and f.fi = v.fi)
    select ep, cast(count(*) as bigint) n, round(max(gap), 4) worst, max(gap) <= 0.25 aligned from j group by ep"""
)
def pts_alignment(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("ep", "fi", "t")
    pts = f.where("fi % 11 <> 10").select("ep", "fi", (F.col("t") + F.when(F.col("fi") % 5 == 0, 0.4).otherwise(0.1)).alias("pts"))
    gaps = f.join(pts, ["ep", "fi"]).withColumn("gap", F.abs(F.col("pts") - F.col("t")))
    return gaps.groupBy("ep").agg(F.count("*").alias("n"), F.round(F.max("gap"), 4).alias("worst"), (F.max("gap") <= 0.25).alias("aligned"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") % 5).cast("string").alias("shape"), F.lit("float32").alias("dtype"), F.col("p_retailprice").alias("value"))


_TREE = "ref as (select p_brand || '/' || p_partkey path, cast(p_size % 5 as varchar) shape, 'float32' dtype, p_retailprice value, p_partkey k from part)"
_LOADED = "ld as (select path, case when k % 4 = 0 then '9' else shape end shape, case when k % 6 = 0 then 'bfloat16' else dtype end dtype, value + 1 value from ref where k % 3 <> 0)"


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d).withColumn("k", F.element_at(F.split("path", "/"), -1).cast("long")).where("k % 3 <> 0")
    shape, dtype = F.when(F.col("k") % 4 == 0, "9").otherwise(F.col("shape")), F.when(F.col("k") % 6 == 0, "bfloat16").otherwise(F.col("dtype"))
    return t.select("path", shape.alias("shape"), dtype.alias("dtype"), (F.col("value") + 1).alias("value"))


@query(
    f"""with {_TREE}, {_LOADED} select ref.path, ref.shape, ref.dtype, ld.value, 'loaded' origin from ref join ld using (path)
    union all select path, shape, dtype, value, 'reference' from ref anti join ld using (path) where regexp_full_match(path, 'Brand#1.*')"""
)
def merge_trees(spark: SparkSession, d: str) -> DataFrame:
    return trees.merge(_tree(spark, d), _loaded(spark, d), "Brand#1.*")


@query(
    f"""with {_TREE}, {_LOADED} select ref.path, ref.shape, ref.dtype, case when ref.shape = ld.shape then ld.value else ref.value end value,
    case when ref.shape = ld.shape then 'loaded' when regexp_full_match(ref.path, 'Brand#1.*') then 'reference' else 'error' end origin from ref left join ld using (path)"""
)
def merge_trees_partial(spark: SparkSession, d: str) -> DataFrame:
    return trees.merge_partial(_tree(spark, d), _loaded(spark, d), "Brand#1.*")


@query("select n_nationkey \"key\", c.n value from nation left join (select cast(c_nationkey as varchar) k, count(*) n from customer where c_nationkey % 2 = 0 group by 1) c on cast(n_nationkey as varchar) = k")
def align_keys(spark: SparkSession, d: str) -> DataFrame:
    loaded = table(spark, d, "customer").where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").cast("string").alias("key")).agg(F.count("*").alias("value"))
    return trees.align(table(spark, d, "nation").select(F.col("n_nationkey").alias("key")), loaded)


@query(
    f"""with {_TREE}, {_LOADED} select coalesce(ref.path, ld.path) path, case when ref.path is null then 'only second' when ld.path is null then 'only first' when ref.shape <> ld.shape then 'shape' else 'dtype' end why
    from ref full join ld on ref.path = ld.path where ref.path is null or ld.path is null or ref.shape <> ld.shape or ref.dtype <> ld.dtype"""
)
def tree_diff(spark: SparkSession, d: str) -> DataFrame:
    return trees.diff(_tree(spark, d), _loaded(spark, d))


@query("select fi frame, max(s) severity from (select unnest(range(a, b + 1)) fi, s from (select event_id % 1000 a, event_id % 1000 + event_id % 13 b, event_id % 3 + 1 s from events where event_type = 'error')) group by 1")
def severity_by_frame(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    issues = table(spark, d, "events").where("event_type = 'error'").select((e % 1000).alias("a"), (e % 1000 + e % 13).alias("b"), (e % 3 + 1).alias("s"))
    return issues.select(F.explode(F.sequence("a", "b")).alias("frame"), "s").groupBy("frame").agg(F.max("s").alias("severity"))


# Set operations


@query("select event_id, value, 0 dataset_idx from events where event_type = 'click' union all select event_id, value * 2, 1 from events where event_type = 'view' union all select event_id, value, 2 from events where event_type = 'error'")
def concat_union(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    parts = [("click", 1), ("view", 2), ("error", 1)]
    sets = [events.where(F.col("event_type") == t).select("event_id", (F.col("value") * k).alias("value"), F.lit(i).alias("dataset_idx")) for i, (t, k) in enumerate(parts)]
    return sets[0].unionByName(sets[1]).unionByName(sets[2])


@query(
    """select event_id, 'Press ' || event_type prompt, 0 dataset_idx from events where event_type = 'click' union all select event_id, event_type, 1 from events where event_type = 'view'
    union all select event_id, upper(event_type), 2 from events where event_type = 'error'"""
)
def concat_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Datasets concatenated, each with its own change of the prompt, or none."""
    events = table(spark, d, "events")
    sets = [events.where(F.col("event_type") == t).select("event_id", F.col("event_type").alias("prompt")) for t in ("click", "view", "error")]
    return concatenated(sets, [lambda x: x.withColumn("prompt", F.concat(F.lit("Press "), "prompt")), None, lambda x: x.withColumn("prompt", F.upper("prompt"))])


@query(f"with {_RANGES} select ep, unnest(range(cast(start_s / 3600 as bigint), cast(coalesce(end_s, 90000) / 3600 as bigint))) idx from ranges")
def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Half-open ranges to one row per index."""
    r = ranges(spark).select("ep", F.floor(F.col("start_s") / 3600).alias("a"), F.round(F.coalesce("end_s", F.lit(90_000.0)) / 3600).cast("long").alias("b"))
    return segments.numbered(r.withColumn("n", F.col("b") - F.col("a")), "n", "i").select("ep", (F.col("a") + F.col("i")).alias("idx"))


@query("select user_id ep, list_has_all(['click', 'view', 'purchase', 'signup'], list(distinct event_type)) subset from events group by 1")
def subset_check(spark: SparkSession, d: str) -> DataFrame:
    known = vectors.literal(["click", "view", "purchase", "signup"])
    return table(spark, d, "events").groupBy(F.col("user_id").alias("ep")).agg((F.size(F.array_except(F.collect_set("event_type"), known)) == 0).alias("subset"))


@query("select p_name \"name\", cast(count(*) as bigint) n from part group by 1 having count(*) > 1")
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query("with s as (select n_regionkey ds, cast(count(*) as bigint) n, min(length(n_name)) w from nation group by 1) select ds, n = (select n from s where ds = 0) and w = (select w from s where ds = 0) compatible from s")
def schema_compat(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("ds")).agg(F.count("*").alias("n"), F.min(F.length("n_name")).alias("w"))
    first = F.broadcast(s.where("ds = 0").select(F.col("n").alias("n0"), F.col("w").alias("w0")))  # one row
    return s.crossJoin(first).select("ds", ((F.col("n") == F.col("n0")) & (F.col("w") == F.col("w0"))).alias("compatible"))


# Aggregations

_DIMS = "x as (select vec_id, label, i dim, cast(embedding[i + 1] as double) x from embeddings, range(64) r(i))"
_MOMENTS = "avg(x) mean, sqrt(greatest(0, avg(x * x) - avg(x) * avg(x))) std"


def dims(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return stats.per_dim(table(spark, d, "embeddings"), F.col("embedding"), *keys)


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(f"with {_DIMS} select dim, cast(count(*) as bigint) n, round(avg(x), 6) mean from x group by 1")
def running_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.moments(dims(spark, d), "dim").drop("std"), ["mean"])


def hist_sql(rows: str, key: str) -> str:
    """SQL of the histogram quantiles of x by key."""
    return f"""mm as (select {key}, min(x) - 1e-10 lo, max(x) + 1e-10 hi, count(*) n from {rows} group by all),
    hb as (select {key}, lo, hi, n, least(cast(floor((x - lo) / (hi - lo) * 5000) as bigint), 4999) bin, count(*) c from {rows} join mm using ({key}) group by all),
    hc as (select *, sum(c) over (partition by {key} order by bin) cum from hb),
    hq as (select {key}, lo + (hi - lo) * min(bin) filter (where cum >= 0.01 * n) / 5000.0::double q01, lo + (hi - lo) * min(bin) filter (where cum >= 0.99 * n) / 5000.0::double q99 from hc group by {key}, lo, hi)"""


_NORM = f"{_DIMS}, {hist_sql('x', 'dim')}, st as (select dim, {_MOMENTS} from x group by 1)"


_NORM_STATS = f"with {_NORM} select dim, round(mean, 6) mean, round(std, 6) std, round(q01, 6) q01, round(q99, 6) q99 from st join hq using (dim)"


@query(_NORM_STATS)
def norm_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.norm_stats(dims(spark, d), "dim").drop("n"), ["mean", "std", "q01", "q99"])


@query(f"with x as (select 1 g, value x from events), {hist_sql('x', 'g')} select q01, q99 from hq")
def hist_quantile(spark: SparkSession, d: str) -> DataFrame:
    return stats.hist_quantiles(table(spark, d, "events").select(F.col("value").alias("x")), {"q01": 0.01, "q99": 0.99}).drop("n")


_CHUNK_VALUES = f"{FRAMES}, n as (select ep, max(fi) m from f group by 1), x as (select j dim, g.value - f.value x from f join n using (ep), range(4) r(j), f g where g.ep = f.ep and g.fi = least(f.fi + j, m))"


@query(f"with {_CHUNK_VALUES}, {hist_sql('x', 'dim')}, st as (select dim, {_MOMENTS} from x group by 1) select dim, round(mean, 6) mean, round(std, 6) std, round(q01, 6) q01, round(q99, 6) q99 from st join hq using (dim)")
def norm_stats_chunks(spark: SparkSession, d: str) -> DataFrame:
    from tidewheel.operators.windows import chunks

    rows = chunks(frames(spark, d), ["value"], 4).select(F.transform("value_chunk", lambda x: x - F.col("value")).alias("v"))
    return rounded(stats.norm_stats(stats.per_dim(rows, F.col("v")), "dim").drop("n"), ["mean", "std", "q01", "q99"])


@query(_NORM_STATS)
def norm_stats_json(spark: SparkSession, d: str) -> DataFrame:
    """The statistics as the JSON document they are kept in, read again."""
    s = stats.as_vectors(stats.norm_stats(dims(spark, d), "dim"))
    names = ["mean", "std", "q01", "q99"]
    doc = s.select(F.to_json(F.struct(F.struct(*names).alias("state"))).alias("doc"))
    back = doc.select(F.from_json("doc", "state struct<" + ", ".join(f"{c}: array<double>" for c in names) + ">").alias("x")).select("x.state.*")
    rows = back.select(F.posexplode(F.arrays_zip(*names)).alias("dim", "v")).select(F.col("dim").cast("long").alias("dim"), "v.*")
    return rounded(rows, names)


@query()
def growing_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.growing_quantiles(table(spark, d, "embeddings"), F.col("embedding"), ["vec_id"], 50, [0.01, 0.99])


@query(f"with {_DIMS} select label, dim, min(x) low, max(x) high, round(avg(x), 6) mean, round(stddev_pop(x), 6) std, cast(count(*) as bigint) n from x group by all")
def episode_stats(spark: SparkSession, d: str) -> DataFrame:
    g = dims(spark, d, "label").groupBy("label", "dim").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("*").alias("n"))
    return rounded(g, ["mean", "std"])


_FIRST = "first as (select label, arg_min(embedding, vec_id) v from embeddings group by 1), fx as (select label, i dim, cast(v[i + 1] as double) x from first, range(64) r(i)), home as (select dim, quantile_cont(x, 0.5) home from fx group by 1)"


@query(f"with {_FIRST} select dim, home from home")
def home_reference(spark: SparkSession, d: str) -> DataFrame:
    return median(first_values(spark, d), "dim", "x").withColumnRenamed("x", "home")


def median(rows: DataFrame, key: str, value: str) -> DataFrame:
    return stats.exact_percentiles(rows, [key], value, [0.5]).drop("p")


def first_values(spark: SparkSession, d: str) -> DataFrame:
    firsts = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return exploded(firsts, "label")


@query(f"with {_FIRST} select label, round(max(abs(x - home)), 6) deviation, max(abs(x - home)) > 0.25 flagged from fx join home using (dim) group by 1")
def home_deviation(spark: SparkSession, d: str) -> DataFrame:
    x = first_values(spark, d)
    home = F.broadcast(median(x, "dim", "x").withColumnRenamed("x", "home"))  # one row per dimension
    off = F.max(F.abs(F.col("x") - F.col("home")))
    return x.join(home, "dim").groupBy("label").agg(F.round(off, 6).alias("deviation"), (off > 0.25).alias("flagged"))


@query(f"with {_FIRST} select label, dim, x from fx")
def first_frame(spark: SparkSession, d: str) -> DataFrame:
    return first_values(spark, d)


@query(f"with {FRAMES}, o as (select ep, t - us / 1e6 + event_id % 17 * 0.25 off from f), m as (select ep, median(off) med from o group by 1) select ep, round(max(abs(off - med)), 4) residual from o join m using (ep) group by 1")
def clock_alignment(spark: SparkSession, d: str) -> DataFrame:
    o = frames(spark, d).select("ep", (F.col("t") - F.col("us") / 1e6 + F.col("event_id") % 17 * 0.25).alias("off"))
    med = median(o, "ep", "off").withColumnRenamed("off", "med")
    return attach(o, med, "ep").groupBy("ep").agg(F.round(F.max(F.abs(F.col("off") - F.col("med"))), 4).alias("residual"))


@query(
    """with g as (select n_regionkey k, median(n_nationkey) * power(10.0, 3 * n_regionkey - 3) + 0.001 dt from nation group by 1),
    s as (select k, scale, abs(log10(dt * scale / 0.0333)) e, i from g, (values (0, 1.0::double), (1, 1e-3::double), (2, 1e-6::double), (3, 1e-9::double)) v(i, scale)) select k, arg_min(scale, e) scale from s group by 1"""
)
def timestamp_scale(spark: SparkSession, d: str) -> DataFrame:
    g = median(table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").cast("double").alias("m")), "k", "m")
    dt = F.col("m") * F.pow(F.lit(10.0), 3 * F.col("k") - 3) + 0.001
    scales = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("scale")) for i, x in enumerate((1.0, 1e-3, 1e-6, 1e-9))))).alias("s")
    rows = g.select("k", dt.alias("dt"), scales)
    return rows.groupBy("k").agg(F.min_by("s.scale", F.struct(F.abs(F.log10(F.col("dt") * F.col("s.scale") / 0.0333)), F.col("s.i"))).alias("scale"))


@query("select event_type code, case when event_type = 'error' then 'error' else 'warning' end severity, cast(count(*) as bigint) n from events group by all")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("code"), severity).agg(F.count("*").alias("n"))


@query("select cast(count(distinct user_id) as bigint) episodes, cast(count(*) as bigint) frames, cast(ceil(count(distinct user_id) / 1000) as bigint) chunks from events")
def dataset_totals(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("episodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("frames")).withColumn("chunks", F.ceil(F.col("episodes") / 1000))


@query(
    """with m as (select distinct reading_id, episode_index e, finger, "timestamp" t, force_n x from marker_readings where "timestamp" is not null and force_n is not null),
    c as (select *, x <> lag(x) over (partition by e, finger order by t, reading_id) ch from m)
    select e episode_index, finger, cast(count(*) filter (where x <> 0) as bigint) nonzero, round(avg(cast(ch as int)), 6) changed, min(x) low, max(x) high from c group by all"""
)
def sensor_audit(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "marker_readings").where("`timestamp` is not null and force_n is not null").select("reading_id", "episode_index", "finger", F.col("timestamp").alias("t"), F.col("force_n").alias("x")).distinct()
    w = Window.partitionBy("episode_index", "finger").orderBy("t", "reading_id")
    c = m.withColumn("ch", (F.col("x") != F.lag("x").over(w)).cast("int"))
    return c.groupBy("episode_index", "finger").agg(F.count_if(F.col("x") != 0).alias("nonzero"), F.round(F.avg("ch"), 6).alias("changed"), F.min("x").alias("low"), F.max("x").alias("high"))


@query("with x as (select vec_id, i dim, cast(embedding[i + 1] as double) x from embeddings, range(64) r(i)) select a.dim i, b.dim j, round(covar_samp(a.x, b.x), 6) cov from x a join x b using (vec_id) where a.dim <= b.dim group by all")
def covariance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.covariance(table(spark, d, "embeddings"), F.col("embedding"), 64), ["cov"])


@query()
def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    mean, parts, scales, _ = stats.principal_components(rows, F.col("embedding"), 64, 5)
    return rows.select("vec_id", F.transform(stats.encode(F.col("embedding"), mean, parts, scales), lambda x: F.round(x, 6)).alias("scores"))


@query()
def pca_residual(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    mean, parts, scales, _ = stats.principal_components(rows, F.col("embedding"), 64, 5)
    rows = rows.select("embedding", stats.encode(F.col("embedding"), mean, parts, scales).alias("scores"))
    back = stats.reconstruct(F.col("scores"), mean, parts, scales)
    square = lambda a, b: vectors.total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / 64
    v = vectors.doubles(F.col("embedding"))
    return rows.agg(F.avg(square(v, back)).alias("mse"), F.avg(square(v, vectors.literal([float(m) for m in mean]))).alias("baseline")).withColumn("residual", F.round(F.col("mse") / F.col("baseline"), 6))


@query("with x as (select i dim, cast(embedding[i + 1] as double) x from embeddings, range(64) r(i) where vec_id < 64 * 4) select dim, round(avg(x), 6) mean, round(greatest(stddev_samp(x), 1e-3), 6) std from x group by 1")
def latent_stats(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "embeddings").where("vec_id < 64 * 4")  # the first 64 batches of 4: that many is the operator's definition
    g = stats.per_dim(first, F.col("embedding")).groupBy("dim").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_samp("x"), F.lit(1e-3)).alias("std"))
    return rounded(g, ["mean", "std"])


@query(f"with {FRAMES} select ep, fi // 16 step, round(avg(value), 6) mean, cast(count(*) as bigint) n from f group by all")
def log_mean(spark: SparkSession, d: str) -> DataFrame:
    g = frames(spark, d).groupBy("ep", F.floor(F.col("fi") / 16).alias("step")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return rounded(g, ["mean"])


@query(f"with {FRAMES}, n as (select ep, max(fi) m from f group by 1) select ep, round(sum(value * power(0.9::double, m - fi) * case when fi = 0 then 1 else 0.1 end), 4) ema from f join n using (ep) group by ep")
def ema(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    n = f.groupBy("ep").agg(F.max("fi").alias("m"))
    weight = F.pow(F.lit(0.9), F.col("m") - F.col("fi")) * F.when(F.col("fi") == 0, 1.0).otherwise(0.1)
    return attach(f, n, "ep").groupBy("ep").agg(F.round(F.sum(F.col("value") * weight), 4).alias("ema"))


@query("select event_type dataset, cast(count(*) as bigint) n, round(count(*) * 100.0 / sum(count(*)) over (), 6) share from events group by 1")
def dataset_share(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("n"))
    total = F.broadcast(g.agg(F.sum("n").alias("total")))  # one row
    return g.crossJoin(total).select("dataset", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("share"))


@query(f"with {FRAMES} select ep, round(max(t) - min(t), 6) duration_s from f group by 1")
def episode_duration(spark: SparkSession, d: str) -> DataFrame:
    us = segments.micros("ts")
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("ep")).agg(((F.max(us) - F.min(us)) / 1e6).alias("duration_s"))
    return rounded(g, ["duration_s"])
