"""The queries of this folder's operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import components, leaks, mixing, nearest, percentiles, pieces, runs
from tidewheel.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.marker_frames(table(spark, d, "marker_readings"), table(spark, d, "frames")).select("reading_id", "frame_index")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.related_episodes(table(spark, d, "episodes")).select("episode_index", "group_id")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return components.split_related(table(spark, d, "episodes"), table(spark, d, "frames"), table(spark, d, "split_targets"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return components.split_shares(p2_splits(spark, d), table(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "frames")).select("episode_index", "first_frame_index", "last_frame_index")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "frames")).withColumn("duration_s", F.round("duration_s", 6))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.bisect_percentiles(percentiles.day_counts(table(spark, d, "frames"), table(spark, d, "episodes")))


def p6_day_counts(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.open_counts(percentiles.day_counts(table(spark, d, "frames"), table(spark, d, "episodes")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return leaks.without_leaks(documents, leaks.leaks(documents, table(spark, d, "heldout_items"))).select("doc_id", "source", "n_chars")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(mixing.token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    counts, targets = mixing.token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixing.reached_shares(counts, targets, mixing.mix(counts, targets))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "documents")).where("piece_index = 0").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_RUNS = """
    with a as (select episode_index e, frame_index fi, any_value(cast("timestamp" as double)) t, any_value("observation.state") s from frames
        where episode_index is not null and frame_index is not null group by 1, 2),
    b as (select *, lag(s) over (partition by e order by fi) p from a where s is not null),
    c as (select *, case when list_bool_and(list_transform(list_zip(s, p), lambda x: coalesce(isfinite(x[1]) and isfinite(x[2]) and abs(cast(x[1] as double) - cast(x[2] as double)) <= 0.0015, false))) then 0 else 1 end b from b),
    d as (select *, sum(b) over (partition by e order by fi) r from c)
    select e episode_index, min(fi) first_frame_index, max(fi) last_frame_index, cast(count(*) as bigint) n_frames, round(max(t) - min(t), 6) duration_s
    from d group by e, r having count(*) >= 5"""

_VALUES = """
    with a as (select episode_index e, frame_index fi, min(received_at) r, any_value("observation.state") s, any_value(action) a from frames
        where episode_index is not null and frame_index is not null group by 1, 2),
    b as (select episode_index e, min(robot_id) robot_id from episodes where robot_id is not null group by 1),
    x as (select e, r, 'state' field, cast(j as bigint) joint_index, cast(s[j + 1] as double) v from a, range(7) t(j)
        union all select e, r, 'action', cast(j as bigint), cast(a[j + 1] as double) from a, range(7) t(j)),
    y as (select cast(r at time zone 'UTC' as date) "day", robot_id, field, joint_index, v from x join b on x.e = b.e where v is not null and isfinite(v) and r is not null)"""

_MIDDLE = "coalesce(sign(v) * (floor(abs(v) / power(2, floor(log2(nullif(abs(v), 0))) - 10)) + 0.5) * power(2, floor(log2(nullif(abs(v), 0))) - 10), 0)"

SQL: dict[str, str] = {
    "p1_found": """
        with r as (select distinct reading_id, episode_index, cast("timestamp" as double) t from marker_readings where "timestamp" is not null),
        f as (select episode_index, cast("timestamp" as double) t, min(frame_index) frame_index from frames where "timestamp" is not null group by all)
        select reading_id, frame_index from (
            select reading_id, f.frame_index, row_number() over (partition by reading_id order by abs(r.t - f.t), f.t, f.frame_index) k
            from r join f on r.episode_index = f.episode_index and f.t between r.t - 0.05 and r.t + 0.05 where abs(r.t - f.t) <= 0.04)
        where k = 1""",
    "p4_found": f"select episode_index, first_frame_index, last_frame_index from ({_RUNS})",
    "p4_runs": _RUNS,
    "p2_found": """
        with recursive e as (select distinct episode_index v, lower(trim(session_id)) s, source_episode_index o from episodes where episode_index is not null),
        m as (select 's' || s k, v from e where s is not null union select 'o' || o, v from e where o is not null union select 'o' || o, o from e where o is not null),
        n as (select distinct x.v a, y.v b from m x join m y on x.k = y.k),
        r as (select a v, a w from n union select r.v, n.b from r join n on r.w = n.a),
        g as (select r.v, min(r.w) group_id, count(*) n from r join (select distinct v from e) k on r.w = k.v group by 1)
        select g.v episode_index, group_id from g join (select distinct v from e) k on g.v = k.v where n > 1""",
    "p6_percentiles": _VALUES + f""",
        z as (select *, row_number() over (partition by robot_id, field, joint_index order by v) k, count(*) over (partition by robot_id, field, joint_index) n from y)
        select robot_id, field, joint_index, p percentile, n, {_MIDDLE} estimate, coalesce(power(2, floor(log2(nullif(abs(v), 0))) - 11), power(2, -1032)) error_bound
        from z, (values (0.01::double), (0.05::double), (0.5::double), (0.95::double), (0.99::double)) q(p) where k = greatest(1, ceil(p * n))""",
    "p6_day_counts": _VALUES + f" select \"day\", robot_id, field, joint_index, {_MIDDLE} middle, cast(count(*) as bigint) n from y group by all",
}
