"""Queries of the core's operators on robot recordings (problems 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import grid, spikes
from tidewheel.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    filled = grid.onto_grid(table(spark, d, "frames"), table(spark, d, "episodes"))
    return filled.where("status <> 'observed'").select("episode_index", "grid_index")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.onto_grid(table(spark, d, "frames"), table(spark, d, "episodes"))


def p3_observed(spark: SparkSession, d: str) -> DataFrame:
    """The readings that the grid keeps, one row per finite element."""
    kept = grid.onto_grid(table(spark, d, "frames"), table(spark, d, "episodes")).where("status = 'observed'")
    rows = kept.select("episode_index", "grid_index", F.posexplode("state").alias("joint_index", "x"))
    return rows.where("x is not null and not isnan(x) and abs(x) < double('infinity')").select("episode_index", "grid_index", F.col("joint_index").cast("long").alias("joint_index"), F.col("x").cast("double").alias("x"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = spikes.implausible_readings(table(spark, d, "frames"), table(spark, d, "joint_limits"))
    return found.select("episode_index", "frame_index", "field", "joint_index")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, d, "frames"), table(spark, d, "joint_limits")).drop("usual_step")


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "p" and k[1:2].isdigit()}

_IMPLAUSIBLE = """
    with a as (select episode_index e, frame_index fi, any_value("observation.state") s, any_value(action) a from frames
        where episode_index is not null and frame_index is not null group by 1, 2),
    x as (select e, fi, 'state' field, j, cast(s[j + 1] as double) v, cast(a[j + 1] as double) o from a, range(7) r(j) where s is not null
        union all select e, fi, 'action', j, cast(a[j + 1] as double), cast(s[j + 1] as double) from a, range(7) r(j) where a is not null),
    y as (select x.*, coalesce(not isfinite(v) or v < cast(cast(lower_rad as float) as double) or v > cast(cast(upper_rad as float) as double), true) impossible
        from x left join joint_limits on j = joint_index),
    r as (select *, case when v = lag(v) over w and isfinite(v) then 0 else 1 end b from y window w as (partition by e, field, j order by fi)),
    r2 as (select *, sum(b) over (partition by e, field, j order by fi) run from r),
    stuck as (select e, field, j, run, true stuck from r2 group by all having count(*) >= 15 and max(o) filter (where isfinite(o)) - min(o) filter (where isfinite(o)) > 0.05),
    g as (select e, fi, field, j, v, v - lag(v) over w d from y where not impossible window w as (partition by e, field, j order by fi)),
    u as (select e, field, j, median(abs(d)) u from g where d <> 0 group by all),
    n as (select g.e, g.fi, g.field, g.j, v, 10 * u u, lag(v) over w p, lead(v, 1) over w n1, lead(v, 2) over w n2, lead(v, 3) over w n3,
        lead(g.fi, 1) over w f1, lead(g.fi, 2) over w f2 from g join u on g.e = u.e and g.field = u.field and g.j = u.j window w as (partition by g.e, g.field, g.j order by g.fi)),
    hit as (select *, (v - p > u and v - n1 > u) or (p - v > u and n1 - v > u) h1,
        (least(v, n1) - p > u and least(v, n1) - n2 > u) or (p - greatest(v, n1) > u and n2 - greatest(v, n1) > u) h2,
        (least(v, n1, n2) - p > u and least(v, n1, n2) - n3 > u) or (p - greatest(v, n1, n2) > u and n3 - greatest(v, n1, n2) > u) h3 from n),
    spike as (select distinct e, field, j, fi, true spike from (
        select e, field, j, fi from hit where h1 or (h2 and n2 is not null) or (h3 and n3 is not null)
        union all select e, field, j, f1 from hit where (h2 and n2 is not null) or (h3 and n3 is not null)
        union all select e, field, j, f2 from hit where h3 and n3 is not null))
    select r2.e episode_index, r2.fi frame_index, r2.field, r2.j joint_index, impossible, coalesce(stuck, false) stuck, coalesce(spike, false) spike
    from r2 left join stuck on r2.e = stuck.e and r2.field = stuck.field and r2.j = stuck.j and r2.run = stuck.run
    left join spike on r2.e = spike.e and r2.field = spike.field and r2.j = spike.j and r2.fi = spike.fi
    where impossible or stuck or spike"""

SQL = {
    "p3_found": """
        with p as (select episode_index e, cast(min(fps) as double) fps from episodes where fps > 0 group by 1),
        f as (select e, fps, cast("timestamp" as double) t, "observation.state" is not null there from frames join p on episode_index = e where "timestamp" is not null and isfinite("timestamp")),
        g as (select e, unnest(range(0, cast(floor(max(t) * any_value(fps) + 0.5) as bigint) + 1)) k from f group by 1)
        select e episode_index, k grid_index from g anti join (select distinct e, cast(floor(t * fps + 0.5) as bigint) k from f where there) o using (e, k)""",
    "p3_observed": """
        with p as (select episode_index e, cast(min(fps) as double) fps from episodes where fps > 0 group by 1),
        f as (select e, frame_index fi, cast("timestamp" as double) t, fps, cast(floor(cast("timestamp" as double) * fps + 0.5) as bigint) k, "observation.state" s from frames join p on episode_index = e
            where "timestamp" is not null and isfinite("timestamp") and "observation.state" is not null),
        o as (select e, k, s, row_number() over (partition by e, k order by abs(t - k / fps), fi) r from f where k >= 0)
        select e episode_index, k grid_index, cast(j as bigint) joint_index, cast(s[j + 1] as double) x from o, range(7) g(j) where r = 1 and isfinite(s[j + 1])""",
    "p5_found": f"select episode_index, frame_index, field, joint_index from ({_IMPLAUSIBLE})",
    "p5_reasons": _IMPLAUSIBLE,
}
