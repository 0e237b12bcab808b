"""Episodes trimmed to ranges of elapsed time: plan, rewrite, validation, and a whole dataset rewritten."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.segments import look_around, nearby, own_rows, positions
from tidewheel.operators.stats import per_dim
from tidewheel.session import attach, cut
from tidewheel.sources.episodic import Dataset, Publish, copy_auxiliary, snapshot, write_json, write_jsonl


def plan(frames: DataFrame, ranges: DataFrame, only: list[int] | None = None) -> DataFrame:
    """One row per episode: start_frame, end_frame (exclusive), first_s, last_s, old_length, new_length, new_ep, base (first global index).

    ranges: ep, start_s, end_s (both included; null: from 0, to the end). With `only`, other episodes are left out and the rest
    numbered anew. Elapsed times must rise strictly; see check_plan.
    """
    with_ranges = attach(frames.select("ep", "fi", "t"), ranges, "ep", "left")
    if only is not None:
        with_ranges = with_ranges.where(F.col("ep").isin([int(x) for x in only]))
    kept = (F.col("t") >= F.coalesce("start_s", F.lit(0.0))) & (F.col("end_s").isNull() | (F.col("t") <= F.col("end_s")))
    f = F.when(kept, F.col("fi"))
    g = with_ranges.groupBy("ep").agg(
        F.min(f).alias("start_frame"), (F.max(f) + 1).alias("end_frame"), F.min(F.when(kept, F.col("t"))).alias("first_s"), F.max(F.when(kept, F.col("t"))).alias("last_s"), F.count("*").alias("old_length")
    )
    g = g.withColumn("new_length", F.coalesce(F.col("end_frame") - F.col("start_frame"), F.lit(0)))
    based = positions(g, ["ep"], F.col("new_length"), "base")
    return based.withColumn("new_ep", F.col("ep")) if only is None else positions(based, ["ep"], name="new_ep")


def check_plan(frames: DataFrame, plans: DataFrame, ranges: DataFrame) -> None:
    """Raise ValueError for a range of an unknown episode, one that keeps nothing, or times that don't rise."""
    if unknown := [r["ep"] for r in ranges.join(frames, "ep", "left_anti").select("ep").limit(10).collect()]:
        raise ValueError(f"ranges of unknown episodes: {unknown}")
    if empty := [r["ep"] for r in plans.where("new_length = 0").select("ep").limit(10).collect()]:
        raise ValueError(f"nothing would be kept of episodes {empty}")
    rising = own_rows(look_around(frames.select("ep", "fi", "t"), before=1).withColumn("_b", F.lag("t").over(nearby()))).where("t <= _b")
    if bad := [r["ep"] for r in rising.select("ep").limit(10).collect()]:
        raise ValueError(f"times don't rise strictly in episodes {bad}")


def rewrite(frames: DataFrame, plans: DataFrame) -> DataFrame:
    """The kept frames with new ep, fi from 0, t from exactly 0 in the type it had, and global index; other columns as they are."""
    p = plans.select("ep", "start_frame", "end_frame", "first_s", "base", "new_ep")
    kept = attach(frames, p, "ep").where("fi >= start_frame and fi < end_frame")
    moved = kept.withColumn("fi", F.col("fi") - F.col("start_frame")).withColumn("t", (F.col("t") - F.col("first_s")).cast(frames.schema["t"].dataType)).withColumn("index", F.col("base") + F.col("fi")).withColumn("ep", F.col("new_ep"))
    return moved.drop("start_frame", "end_frame", "first_s", "base", "new_ep")


def validate(written: DataFrame, plans: DataFrame) -> DataFrame:
    """(rule, violations): length, time from 0 and rising, dense fi, global index. One aggregation and one look at neighbours."""
    before = own_rows(look_around(written.select("ep", "fi", "t", "index"), before=1).withColumn("_t", F.lag("t").over(nearby())))
    p = plans.select(F.col("new_ep").alias("ep"), "new_length", "base")
    g = before.groupBy("ep").agg(
        F.count("*").alias("n"), F.count_distinct("fi").alias("d"), F.min("fi").alias("a"), F.max("fi").alias("b"), F.min(F.col("index") - F.col("fi")).alias("i0"), F.max(F.col("index") - F.col("fi")).alias("i1"),
        F.count_if((F.col("fi") == 0) & (F.col("t") != 0)).alias("t0"), F.count_if(F.col("t") <= F.col("_t")).alias("back"),
    )
    j = p.join(g, "ep", "full")
    no = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    one = j.agg(
        no(F.col("n") == F.col("new_length")).alias("length"), F.coalesce(F.sum(F.col("t0") + F.col("back")), F.lit(0)).alias("time"),
        no((F.col("d") == F.col("n")) & (F.col("a") == 0) & (F.col("b") == F.col("n") - 1)).alias("frame_index"), no((F.col("i0") == F.col("base")) & (F.col("i1") == F.col("base"))).alias("index"),
    )
    return one.select(F.expr("stack(4, 'length', length, 'time', time, 'frame_index', frame_index, 'index', index) as (rule, violations)"))


def feature_stats(rows: DataFrame, columns: list[str], key: str = "episode_index") -> DataFrame:
    """(key, feature, dim, min, max, mean, std of the population, count) of scalar and vector columns."""
    out = None
    for c in columns:
        kind = rows.schema[c].dataType.typeName()
        v = F.col(f"`{c}`") if kind == "array" else F.array(F.col(f"`{c}`").cast("double"))
        g = per_dim(rows.select(key, v.alias("_v")), F.col("_v"), key).groupBy(key, "dim").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("*").alias("count"))
        g = g.withColumn("feature", F.lit(c))
        out = g if out is None else out.unionByName(g)
    if out is None:
        raise ValueError("no columns")
    return out


def rewrite_dataset(source: Dataset, target: str | Path, ranges: dict[int, tuple[float, float | None]], only: list[int] | None = None, dry_run: bool = False) -> list[dict]:
    """Write the trimmed dataset to target and return its plan; nothing is written in a dry run or on an error.

    Each episode becomes one Parquet file with the columns and types of the source; metadata, statistics and provenance are made anew.
    The source must not change meanwhile.
    """
    spark = source.spark
    before = snapshot(source.root)
    raw = source.frames()
    types = dict(raw.dtypes)
    first = raw.groupBy("episode_index").agg(F.min("timestamp").cast("double").alias("_t0"))
    frames = attach(raw, first, "episode_index").withColumn("t", F.col("timestamp").cast("double") - F.col("_t0")).withColumnsRenamed({"episode_index": "ep", "frame_index": "fi"}).drop("_t0", "index", "timestamp")
    rows = [(int(k), float(a), b) for k, (a, b) in ranges.items()]
    given = spark.createDataFrame(rows, "ep long, start_s double, end_s double")
    plans = cut(plan(frames, given, only))
    check_plan(frames, plans, given)
    listed = [r.asDict() for r in plans.orderBy("new_ep").collect()]  # one row per episode, as meta/episodes.jsonl has
    if dry_run:
        return listed
    with Publish(target, source.root) as work:
        new = rewrite(frames, plans).withColumnsRenamed({"ep": "episode_index", "fi": "frame_index", "t": "timestamp"})
        new = new.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) for c in raw.columns))
        staged = new.withColumn("_e", F.col("episode_index")).repartition("_e").sortWithinPartitions("_e", "frame_index")
        staged.write.partitionBy("_e").option("compression", "snappy").parquet(str(work / "_staged"))
        chunk = int(source.info.get("chunks_size", 1000))
        for p in listed:
            e = p["new_ep"]
            (part,) = (work / f"_staged/_e={e}").glob("part-*.parquet")
            to = work / source.info.get("data_path", "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet").format(episode_chunk=e // chunk, episode_index=e)
            to.parent.mkdir(parents=True, exist_ok=True)
            part.rename(to)
        for f in sorted((work / "_staged").rglob("*"), reverse=True):
            f.rmdir() if f.is_dir() else f.unlink()
        (work / "_staged").rmdir()
        (work / "meta").mkdir()
        total = sum(p["new_length"] for p in listed)
        write_json(work / "meta/info.json", source.info | {"total_episodes": len(listed), "total_frames": total, "total_chunks": -(-len(listed) // chunk), "splits": {"train": f"0:{len(listed)}"}})
        write_jsonl(work / "meta/episodes.jsonl", [source.episodes[p["ep"]] | {"episode_index": p["new_ep"], "length": p["new_length"]} for p in listed])
        write_jsonl(work / "meta/tasks.jsonl", source.tasks)
        numeric = [c for c, t in raw.dtypes if t in ("float", "double", "bigint", "int") or t in ("array<float>", "array<double>")]
        by: dict[int, dict] = {p["new_ep"]: {} for p in listed}
        written = spark.read.parquet(*(str(p) for p in sorted((work / "data").rglob("*.parquet"))))
        for r in feature_stats(written, numeric).orderBy("episode_index", "feature", "dim").collect():  # a few rows per episode, as the format has
            s = by[r["episode_index"]].setdefault(r["feature"], {k: [] for k in ("min", "max", "mean", "std")} | {"count": [r["count"]]})
            for k in ("min", "max", "mean", "std"):
                s[k].append(r[k])
        write_jsonl(work / "meta/episodes_stats.jsonl", [{"episode_index": e, "stats": s} for e, s in by.items()])
        provenance = [{"source_episode": p["ep"], "output_episode": p["new_ep"], "start_frame": p["start_frame"], "end_frame": p["end_frame"], "start_s": p["first_s"], "end_s": p["last_s"]} for p in listed]
        write_json(work / "meta/trim.json", {"source": str(source.root), "built_at": datetime.now(UTC).isoformat(), "episodes": provenance})
        copy_auxiliary(source.root, work)
        checked = validate(written.select(F.col("episode_index").alias("ep"), F.col("frame_index").alias("fi"), F.col("timestamp").alias("t"), "index"), plans)
        if wrong := [r["rule"] for r in checked.where("violations > 0").collect()]:
            raise ValueError(f"the written dataset breaks: {', '.join(wrong)}")
        if snapshot(source.root) != before:
            raise ValueError("the source changed meanwhile")
    return listed


