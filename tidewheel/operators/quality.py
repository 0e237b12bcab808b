"""Audit of recorded episodes: issues by code, severity and frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.vectors import nonfinite
from tidewheel.operators.segments import LENGTH, look_around, nearby, own_rows
from tidewheel.operators.stats import exact_percentiles
from tidewheel.session import attach

ISSUE = "ep long, code string, severity string, key string, frame_start long, frame_end long, observed double"


@dataclass(frozen=True)
class Limits:
    """Thresholds; a value must exceed one to be an issue, but motion begins at min_speed. Angles in radians, times in seconds."""

    fps: float = 30.0
    time_tolerance: float = 0.005
    sync_tolerance: float = 0.02
    offset_most: float = 60.0
    start_idle: float = 0.30
    end_idle: float = 0.30
    min_speed: float = 0.02
    step: float = 0.35
    velocity: float = 6.0
    acceleration: float = 100.0
    home: float = 0.10
    padding: int = 2
    width: int | None = None


def _issue(condition: Column, code: str, severity: str, key: str | None, start: Column | None, end: Column | None, observed: Column | None) -> Column:
    null = lambda x, t: F.lit(None).cast(t) if x is None else x.cast(t)
    fields = [F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(key).cast("string").alias("key"), null(start, "long").alias("frame_start"), null(end, "long").alias("frame_end"), null(observed, "double").alias("observed")]
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(*fields))


def measure(frames: DataFrame, limits: Limits, length: int = LENGTH) -> DataFrame:
    """One row of measures per episode from frames of ep, fi, t and the vector v (array<double>), in one shuffle and one aggregation.

    The largest step, velocity and acceleration come with frame and dimension: the lowest of equal ones; NaN counts as -1.
    """
    w, due = nearby(), 1.0 / limits.fps
    dt = F.col("t") - F.lag("t").over(w)
    usable = (dt > 0) & (dt < float("inf"))
    rows = look_around(frames.select("ep", "fi", "t", "v"), before=2, length=length).withColumn("raw", dt).withColumn("_t1", F.lag("t").over(w)).withColumn("_v1", F.lag("v").over(w))
    rows = rows.withColumn("dt", F.when(usable, dt).otherwise(F.lit(due))).withColumn("step", F.zip_with("v", "_v1", lambda a, b: a - b))
    rows = rows.withColumn("velocity", F.transform("step", lambda x: x / F.col("dt")))
    between = (F.col("dt") + F.lag("dt").over(w)) / 2
    rows = rows.withColumn("_mid", between).withColumn("_w1", F.lag("velocity").over(w)).withColumn("acceleration", F.zip_with("velocity", "_w1", lambda a, b: (a - b) / F.col("_mid")))
    rows = own_rows(rows, length)
    fi, raw = F.col("fi"), F.when(~F.isnan("raw"), F.col("raw"))
    top = lambda c: F.array_max(F.transform(c, lambda x, i: F.struct(F.nanvl(F.abs(x), F.lit(-1.0)).alias("x"), (-i).alias("i"))))
    rows = rows.withColumns({f"_{c}": top(c) for c in ("step", "velocity", "acceleration")})
    best = lambda c: F.max(F.when(F.col(f"_{c}").isNotNull(), F.struct(F.col(f"_{c}.x").alias("x"), (-fi).alias("f"), F.col(f"_{c}.i").alias("i")))).alias(c)
    moving = F.col("_velocity.x") >= limits.min_speed
    bad_t, bad_v = nonfinite(F.col("t")), F.exists("v", lambda x: x.isNull() | nonfinite(x))
    irregular, dropped = F.abs(raw - due) > limits.time_tolerance, raw > due + limits.time_tolerance
    if_ = F.when
    return rows.groupBy("ep").agg(
        F.count("*").alias("n"), F.count_if(bad_t).alias("bad_t"), F.min(if_(bad_t, fi)).alias("bad_t0"), F.max(if_(bad_t, fi)).alias("bad_t1"),
        F.count_if(raw <= 0).alias("back"), F.min(if_(raw <= 0, fi)).alias("back0"),
        F.count_if(dropped).alias("dropped"), F.max(if_(dropped, F.struct(raw.alias("x"), (-fi).alias("f")))).alias("gap"),
        F.count_if(irregular).alias("irregular"), F.max(if_(irregular, F.struct(F.abs(raw - due).alias("x"), (-fi).alias("f")))).alias("off"),
        F.count_if(bad_v).alias("bad_v"), F.min(if_(bad_v, fi)).alias("bad_v0"), F.count_if(F.size("v") != (limits.width if limits.width is not None else F.size("v"))).alias("wrong_width"),
        best("step"), best("velocity"), best("acceleration"),
        F.count_if(moving).alias("moving"), F.min(if_(moving, fi)).alias("move0"), F.max(if_(moving, fi)).alias("move1"),
        F.min_by("_t1", if_(moving, fi)).alias("move0_t"), F.max_by("t", if_(moving, fi)).alias("move1_t"), F.min_by("t", "fi").alias("t0"), F.max_by("t", "fi").alias("t1"), F.min_by("v", "fi").alias("first"),
    )


def suggested_trim(measures: DataFrame, limits: Limits) -> DataFrame:
    """(ep, first, last): the frames to keep, from `padding` before the first motion to `padding` after the last; none without motion."""
    return measures.where("moving > 0").select(
        "ep", F.greatest(F.lit(0), F.col("move0") - 1 - limits.padding).alias("first"), F.least(F.col("n") - 1, F.col("move1") + limits.padding).alias("last")
    )


def episode_issues(measures: DataFrame, limits: Limits, key: str = "observation.state") -> DataFrame:
    """Issues of time, values, kinematics and idle ends from measure()."""
    c = F.col
    n, enough = c("n"), c("n") >= 2
    start, end = c("move0_t") - c("t0"), c("t1") - c("move1_t")
    jump = lambda m, limit, code, offset: _issue(c(f"{m}.x") > limit, code, "error", key, F.greatest(F.lit(0), -c(f"{m}.f") - 1), -c(f"{m}.f"), c(f"{m}.x"))
    found = [
        _issue(c("bad_t") > 0, "timestamp_nonfinite", "error", None, c("bad_t0"), c("bad_t1"), c("bad_t")),
        _issue(c("back") > 0, "timestamp_non_increasing", "error", None, c("back0") - 1, c("back0"), c("back")),
        _issue(c("dropped") > 0, "dropped_sample", "error", None, -c("gap.f") - 1, -c("gap.f"), c("gap.x")),
        _issue((c("dropped") == 0) & (c("irregular") > 0), "timestamp_jitter", "warning", None, -c("off.f") - 1, -c("off.f"), c("off.x")),
        _issue(c("bad_v") > 0, "nonfinite_value", "error", key, c("bad_v0"), c("bad_v0"), c("bad_v")),
        _issue(c("wrong_width") > 0, "action_dimension" if key == "action" else "state_dimension", "error", key, None, None, c("wrong_width")),
        jump("step", limits.step, "joint_step_jump", 1), jump("velocity", limits.velocity, "velocity_limit", 1), jump("acceleration", limits.acceleration, "velocity_jump", 2),
        _issue(~enough, "too_short", "error", None, None, None, n),
        _issue(enough & (c("moving") == 0), "episode_static", "error", key, F.lit(0), n - 1, None),
        _issue(enough & (start > limits.start_idle), "start_idle", "error", key, F.lit(0), c("move0") - 1, start),
        _issue(enough & (end > limits.end_idle), "end_idle", "error", key, c("move1"), n - 1, end),
    ]
    return measures.select("ep", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("ep", "i.*")


def home_issues(measures: DataFrame, limits: Limits, home: list[float] | None = None, key: str = "observation.state") -> DataFrame:
    """Episodes that begin more than `home` off a reference: the given one, else the median of all first frames by dimension."""
    first = measures.select("ep", F.posexplode("first").alias("dim", "x"))
    if home is None:
        reference = exact_percentiles(first, ["dim"], "x", [0.5]).select("dim", F.col("x").alias("home"))
    else:
        reference = measures.sparkSession.createDataFrame(list(enumerate(float(x) for x in home)), "dim int, home double")
    off = first.join(F.broadcast(reference), "dim").groupBy("ep").agg(F.max(F.abs(F.col("x") - F.col("home"))).alias("worst"))  # one row per dimension
    issue = _issue(F.col("worst") > limits.home, "home_position_mismatch", "error", key, F.lit(0), F.lit(0), F.col("worst"))
    return off.select("ep", issue.alias("i")).where("i is not null").select("ep", "i.*")


def clock_issues(frames: DataFrame, aux: str, limits: Limits) -> DataFrame:
    """A second clock against t: its unit guessed from the median period, then its residual after the median offset, and that offset."""
    due = 1.0 / limits.fps
    dt = F.col(aux) - F.lag(aux).over(nearby())
    rows = own_rows(look_around(frames.select("ep", "fi", "t", F.col(aux).cast("double").alias(aux)), before=1).withColumn("_d", dt))
    period = exact_percentiles(rows.where("_d > 0"), ["ep"], "_d", [0.5]).select("ep", F.col("_d").alias("_p"))
    scales = (1.0, 1e-3, 1e-6, 1e-9)
    far = lambda s: F.abs(F.log10(F.greatest(F.col("_p") * s, F.lit(1e-15)) / due))
    scale = F.array_min(F.array(*(F.struct(far(s).alias("e"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(scales))))
    scaled = attach(rows, period.select("ep", scale["s"].alias("_s")), "ep", "left").withColumn("_x", F.col(aux) * F.coalesce("_s", F.lit(1.0)) - F.col("t")).where(~F.isnan("_x"))
    offset = exact_percentiles(scaled, ["ep"], "_x", [0.5]).select("ep", F.col("_x").alias("_o"))
    g = attach(scaled, offset, "ep").withColumn("_r", F.abs(F.col("_x") - F.col("_o"))).groupBy("ep").agg(F.max("_r").alias("r"), F.max_by("fi", F.struct("_r", -F.col("fi"))).alias("f"), F.first("_o").alias("o"))
    found = F.array(
        _issue(F.col("r") > limits.sync_tolerance, "sensor_timestamp_misaligned", "error", aux, F.col("f"), F.col("f"), F.col("r")),
        _issue((F.abs("o") > limits.sync_tolerance) & (F.abs("o") < limits.offset_most), "sensor_timestamp_offset", "warning", aux, None, None, F.col("o")),
    )
    return g.select("ep", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("ep", "i.*")


def missing_clock_issues(episodes: DataFrame, columns: list[str], cameras: list[str]) -> DataFrame:
    """A warning per episode if there are cameras but no column with a time of its own."""
    lacking = bool(cameras) and not any("timestamp" in c.lower() and c != "timestamp" for c in columns)
    issue = _issue(F.lit(lacking), "independent_timestamps_missing", "warning", None, None, None, None)
    return episodes.select("ep", issue.alias("i")).where("i is not null").select("ep", "i.*")


def image_issues(frames: DataFrame, camera: str, there: Column | None) -> DataFrame:
    """Frames without an image; without the column (there is None) each episode has one issue."""
    if there is None:
        issue = _issue(F.lit(True), "camera_column_missing", "error", camera, None, None, None)
        return frames.select("ep").distinct().select("ep", issue.alias("i")).select("ep", "i.*")
    gone = ~F.coalesce(there, F.lit(False))
    g = frames.groupBy("ep").agg(F.count_if(gone).alias("n"), F.min(F.when(gone, F.col("fi"))).alias("a"), F.max(F.when(gone, F.col("fi"))).alias("b"))
    issue = _issue(F.col("n") > 0, "camera_frame_missing", "error", camera, F.col("a"), F.col("b"), F.col("n"))
    return g.select("ep", issue.alias("i")).where("i is not null").select("ep", "i.*")


def video_issues(frames: DataFrame, pts: DataFrame, files: DataFrame, camera: str, limits: Limits) -> DataFrame:
    """Video times (ep, fi, pts) against frames; files (ep, exists, decoded) says which videos could be read."""
    due = 1.0 / limits.fps
    n = frames.groupBy("ep").agg(F.count("*").alias("n"), F.min_by("t", "fi").alias("t0"))
    gap = F.col("pts") - F.lag("pts").over(nearby())
    v = own_rows(look_around(pts, before=1).withColumn("gap", gap))
    large = F.col("gap") > due + limits.time_tolerance
    m = v.groupBy("ep").agg(F.count("*").alias("m"), F.min_by("pts", "fi").alias("p0"), F.count_if(large).alias("gaps"), F.max(F.when(large, F.struct(F.col("gap").alias("x"), (-F.col("fi")).alias("f")))).alias("g"))
    base = n.join(files, "ep", "left").join(m, "ep", "left").fillna(0, ["m", "gaps"])
    starts = base.select("ep", "t0", "p0")
    both = attach(frames.select("ep", "fi", "t").join(pts, ["ep", "fi"]), starts, "ep").withColumn("r", F.abs((F.col("pts") - F.col("p0")) - (F.col("t") - F.col("t0"))))
    worst = both.groupBy("ep").agg(F.max("r").alias("r"), F.max_by("fi", F.struct("r", -F.col("fi"))).alias("f"))
    all_ = base.join(worst, "ep", "left")
    there = F.coalesce("exists", F.lit(False))
    read = there & F.coalesce("decoded", F.lit(False))
    found = F.array(
        _issue(~there, "camera_file_missing", "error", camera, None, None, None),
        _issue(there & ~read, "camera_decode_failed", "error", camera, None, None, None),
        _issue(read & (F.col("m") != F.col("n")), "camera_frame_count", "error", camera, None, None, F.col("m")),
        _issue(read & (F.col("gaps") > 0), "camera_dropped_frame", "error", camera, F.greatest(F.lit(0), -F.col("g.f") - 1), F.least(-F.col("g.f"), F.col("n") - 1), F.col("g.x")),
        _issue(read & (F.col("r") > limits.sync_tolerance), "camera_timestamp_misaligned", "error", camera, F.col("f"), F.col("f"), F.col("r")),
    )
    return all_.select("ep", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("ep", "i.*")


def report(issues: DataFrame, measures: DataFrame) -> DataFrame:
    """One row: episodes, frames, errors, warnings, whether it passed, and counts by code."""
    totals = measures.agg(F.count("*").alias("episodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("frames"))
    by = issues.groupBy("code", "severity").agg(F.count("*").alias("n"))
    error = F.col("severity") == "error"
    zero = F.lit(0).cast("long")
    counts = by.agg(
        F.coalesce(F.sum(F.when(error, F.col("n"))), zero).alias("errors"), F.coalesce(F.sum(F.when(~error, F.col("n"))), zero).alias("warnings"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("by_code"),
    )
    return totals.crossJoin(F.broadcast(counts)).withColumn("passed", F.col("errors") == 0)  # one row each


def windows_around(issues: DataFrame, lengths: DataFrame, context: int) -> DataFrame:
    """(ep, key, first, last, issues): the frames around each episode's issues of one key, cut to the episode. lengths: ep, n."""
    g = issues.groupBy("ep", "key").agg(F.min("frame_start").alias("a"), F.max("frame_end").alias("b"), F.count("*").alias("issues"))
    return attach(g, lengths, "ep").select("ep", "key", F.greatest(F.lit(0), F.col("a") - context).alias("first"), F.least(F.col("n") - 1, F.col("b") + context).alias("last"), "issues")
