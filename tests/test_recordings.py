"""Problems 3 and 5 on small tables with every kind of dirt."""

import bisect
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import duck, rows_of
from tidewheel.operators import grid, spikes
from tidewheel.plans import recordings

FRAMES = "timestamp float, frame_index long, episode_index long, `observation.state` array<float>, action array<float>, received_at timestamp"
LIMITS = "joint_index long, joint_name string, lower_rad double, upper_rad double"
EPISODES = "episode_index long, fps int"
T0 = dt.datetime(2026, 1, 1)


def made(rng, episodes=4, n=90, dirty=True):
    rows = []
    for e in range(episodes):
        x, a = rng.uniform(-1, 1, 7), rng.uniform(-1, 1, 7)
        for i in range(n):
            if dirty and rng.random() < 0.05:
                continue
            x = x + rng.choice([0.0, 0.001, 0.002, -0.003], 7)
            a = a + rng.choice([0.0, 0.002, -0.002, 0.004], 7)
            s, c = x.copy(), a.copy()
            if dirty and rng.random() < 0.03:
                s[rng.integers(7)] += rng.choice([0.2, -0.5, 9.0, math.nan, math.inf])
            if i > 60:
                s[0] = 0.25
            state = None if dirty and rng.random() < 0.02 else [float(round(v, 3)) for v in s]
            if state and dirty and rng.random() < 0.01:
                state[3] = None
            action = None if dirty and rng.random() < 0.02 else [float(round(v, 3)) for v in c]
            t = None if dirty and rng.random() < 0.02 else float(i / 30 + rng.normal(0, 0.002) * dirty)
            row = (t, i, e, state, action, T0 + dt.timedelta(seconds=i))
            rows.append(row)
            if dirty and rng.random() < 0.05:
                rows.append((*row[:5], T0 + dt.timedelta(days=1)))
    if dirty:
        rows += [(1.0, None, 0, [0.0] * 7, None, T0), (1.0, 3, None, [0.0] * 7, None, T0)]
    rng.shuffle(rows)
    return rows


def tables(spark, tmp_path, rows, episodes=((0, 30), (0, 30), (1, 30), (2, 10), (77, 30), (None, 30), (3, None))):
    spark.createDataFrame(rows, FRAMES).repartition(3).write.parquet(f"{tmp_path}/frames.parquet")
    spark.createDataFrame(list(episodes), EPISODES).coalesce(1).write.parquet(f"{tmp_path}/episodes.parquet")
    limits = [(j, f"j{j}", -2.0, 2.0) for j in range(7)]
    spark.createDataFrame(limits, LIMITS).coalesce(1).write.parquet(f"{tmp_path}/joint_limits.parquet")
    import duckdb

    con = duckdb.connect()
    for t in ("frames", "episodes", "joint_limits"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p5_reasons"])
def test_dirty_tables_as_sql(spark, tmp_path, seed, name):
    con = tables(spark, tmp_path, made(np.random.default_rng(seed)))
    df = recordings.QUERIES[name](spark, str(tmp_path))
    result = con.execute(recordings.SQL[name])
    columns = [x[0] for x in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_spikes_in_chunks(spark):
    """Small chunks and large ones agree, also in the usual step, which is taken over the whole episode."""
    rows = spark.createDataFrame(made(np.random.default_rng(5), 2, 400), FRAMES)
    limits = spark.createDataFrame([(j, "", -2.0, 2.0) for j in range(7)], LIMITS)
    whole, parts = (sorted(map(tuple, spikes.implausible_readings(rows, limits, chunk=c).collect())) for c in (65_536, 97))
    assert {r[4:7] for r in whole} >= {(True, False, False), (False, True, False), (False, False, True)}
    assert rows_of(range(8), whole) == rows_of(range(8), parts)


@pytest.mark.parametrize("chunk", [5, 16, 40])
def test_spikes_over_long_gaps(spark, tmp_path, chunk):
    """Stretches without a usable reading, longer than several chunks, between the readings of a spike, a stretch or a step: the same as SQL and as one chunk."""
    rng = np.random.default_rng(chunk)
    rows = []
    for i, (t, fi, e, s, a, r) in enumerate(sorted(made(rng, 3, 300, dirty=False), key=lambda x: (x[2], x[1]))):
        s = [v + (0.5 if rng.random() < 0.05 else 0.0) for v in s]
        if fi // 50 % 2:
            s = None if e == 0 else [9.0 if fi % 7 else v for v in s] if e == 1 else [math.nan, *s[1:6], s[6] if fi % 43 == 0 else None]
        rows.append((t, fi, e, s, a, r))
    con = tables(spark, tmp_path, rows)
    df = spikes.implausible_readings(spark.read.parquet(f"{tmp_path}/frames.parquet"), spark.read.parquet(f"{tmp_path}/joint_limits.parquet"), chunk=chunk).drop("usual_step")
    result = con.execute(recordings.SQL["p5_reasons"])
    columns = [x[0] for x in result.description]
    got = rows_of(df.columns, df.collect())
    assert got == rows_of(columns, result.fetchall())
    assert {r[4:] for r in map(tuple, df.collect())} >= {(True, False, False), (False, False, True)}


def test_spike_kinds(spark):
    flat = [(i / 30, i, 1, [0.1 * i * 0.01] * 7, [0.5 + 0.02 * i] * 7, T0) for i in range(60)]

    def changed(f, *at):
        return [(t, i, e, [f(v) for v in s] if i in at else s, a, r) for t, i, e, s, a, r in flat]

    limits = spark.createDataFrame([(j, "", -2.0, 2.0) for j in range(7)], LIMITS)

    def found(rows):
        got = spikes.implausible_readings(spark.createDataFrame(rows, FRAMES), limits).where("joint_index = 0 and field = 'state'")
        return {r["frame_index"]: (r["impossible"], r["stuck"], r["spike"]) for r in got.collect()}

    assert found(flat) == {}
    assert found(changed(lambda v: v + 0.5, 20, 21, 22)) == {i: (False, False, True) for i in (20, 21, 22)}
    assert found(changed(lambda v: v + 0.5, 20, 21, 22, 23)) == {}
    assert found(changed(lambda v: math.nan, 0, 59)) == {0: (True, False, False), 59: (True, False, False)}
    assert found(changed(lambda v: 7.0, 30)) == {30: (True, False, False)}
    assert found(changed(lambda v: 0.5, *range(30, 45))) == {i: (False, True, False) for i in range(30, 45)}
    assert found(changed(lambda v: 0.5, *range(30, 44))) == {}


def of_first_state(spark, states, limit=2.0):
    """Flags (impossible, stuck, spike) by frame, of a series of states (None: the field is null), while the action moves by 0.02 a frame."""
    rows = [(i / 30, i, 1, None if v is None else [v] * 7, [-0.5 + 0.02 * i] * 7, T0) for i, v in enumerate(states)]
    limits = spark.createDataFrame([(j, "", -limit, limit) for j in range(7)], LIMITS)
    got = spikes.implausible_readings(spark.createDataFrame(rows, FRAMES), limits).where("joint_index = 0 and field = 'state'")
    return {r["frame_index"]: (r["impossible"], r["stuck"], r["spike"]) for r in got.collect()}


@pytest.mark.parametrize("nulls", [{38}, {39}, {36, 42}, set(range(31, 70, 2)), set(range(33, 70, 4))])
def test_stuck_between_null_frames(spark, nulls):
    """Frames whose field is null do not end a stretch, nor hide it from the filter."""
    readings = [i for i in range(30, 90) if i not in nulls][:15]
    states = [None if i in nulls else 0.005 if i in readings else 0.001 * i for i in range(100)]
    assert of_first_state(spark, states) == {i: (False, True, False) for i in readings}
    states[readings[7]] = 0.006
    assert of_first_state(spark, states) == {}


@pytest.mark.parametrize("bad", [None, 7.0])
@pytest.mark.parametrize(("every", "height"), [(7, 10.5), (10, 12.0), (20, 17.0)])
def test_spikes_behind_unusable_readings(spark, bad, every, height):
    """Null frames and impossible readings before and after a spike do not widen the gate."""
    states = [0.01 * (i // every % 2) if i % every == 0 else bad for i in range(20 * every)]
    at = 10 * every
    states[at] = 0.01 + 0.01 * height
    assert [i for i, x in of_first_state(spark, states).items() if x[2]] == [at]
    states[at] = 0.01 + 0.01 * 9.5
    assert not [i for i, x in of_first_state(spark, states).items() if x[2]]


def test_filter_points_at_every_case(spark):
    """Rough random series: every spike has a candidate near it and every stuck stretch a quiet reading, whatever is unusable between them."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        x = np.column_stack([np.cumsum(rng.choice([0.0, 1.0, -1.0, 3.0, -6.0], 600)), *rng.choice([0.0, 1.0], (2, 600))])
        x += rng.choice([0.0, 11.2, -11.2, 40.0], x.shape, p=[0.9, 0.04, 0.04, 0.02])
        x[200:217] = x[200]
        ok = rng.random(x.shape) > rng.choice([0.0, 0.5, 0.95])
        starts, group = np.array([0]), np.zeros(600, np.int64)
        step = spikes.usual_steps(x, ok, group, starts)
        flagged, quiet = spikes.kalman(x, ok, starts, step)
        for c in range(3):
            at = np.flatnonzero(ok[:, c])
            v, g, u = x[at, c], group[at], np.full(len(at), step[0, c])
            assert (spikes._spikes(v, g, flagged[at, c], u) == spikes._spikes(v, g, np.ones(len(at), bool), u)).all()
            begin, length = spikes._stretches(v, g)
            assert all(quiet[at[i : i + k], c].any() for i, k in zip(begin, length, strict=True) if k >= spikes.STUCK_LENGTH)


def test_stuck_outside_limits(spark):
    """A stretch of impossible readings is stuck as well."""
    states = [7.0 if 30 <= i < 45 else 0.001 * i for i in range(60)]
    assert of_first_state(spark, states) == {i: (True, True, False) for i in range(30, 45)}


def test_kalman_gate():
    x = np.cumsum(np.full((200, 1), 0.01), axis=0)
    x[50] += 1.0
    flagged, quiet = spikes.kalman(x, np.ones_like(x, bool), np.array([0]), np.array([[0.01]]))
    assert flagged[50, 0] and flagged.sum() <= 3
    x[100:130] = x[100]
    flagged, quiet = spikes.kalman(x, np.ones_like(x, bool), np.array([0]), np.array([[0.01]]))
    assert quiet[115:130].all() and not quiet[:100].any()


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], FRAMES)
    limits = spark.createDataFrame([], LIMITS)
    episodes = spark.createDataFrame([], EPISODES)
    assert spikes.implausible_readings(empty, limits).count() == 0
    assert grid.onto_grid(empty, episodes).count() == 0
    rows = spark.createDataFrame(made(np.random.default_rng(3), 1, 60), FRAMES)
    odd = rows.select("*", *(F.lit("x").alias(c) for c in ("chunk", "block", "k", "fps", "points", "_steps", "TIMESTAMP", "Frame_Index", "gap", "seen", "state")))
    limits = spark.createDataFrame([(j, "", -2.0, 2.0) for j in range(7)], LIMITS)
    known = spark.createDataFrame([(0, 30)], EPISODES).select("*", F.lit(0).alias("timestamp"), F.lit(1).alias("FPS"))
    for a, b in ((rows, odd),):
        assert sorted(map(str, spikes.implausible_readings(a, limits).collect())) == sorted(map(str, spikes.implausible_readings(b, limits).collect()))
        assert sorted(map(str, grid.onto_grid(a, known).collect())) == sorted(map(str, grid.onto_grid(b, known).collect()))


def test_no_limits(spark):
    rows = spark.createDataFrame(made(np.random.default_rng(3), 1, 60), FRAMES)
    assert spikes.implausible_readings(rows, spark.createDataFrame([(6, "", None, None)], LIMITS)).where("impossible").count() > 0


def test_grid_keeps_and_fills(spark):
    """Observed points are exact; held-out ones come near; a long hole stays marked."""
    rng = np.random.default_rng(4)
    rows, truth, held = [], {}, set()
    for e in range(40):
        phase, amplitude, speed = rng.uniform(0, 6, 7), rng.uniform(0.2, 1, 7), rng.uniform(0.5, 2, 7)
        for k in range(200):
            x = amplitude * np.sin(speed * k / 30 + phase)
            truth[e, k] = x
            if k not in (0, 199) and (rng.random() < 0.1 or 100 <= k < 150 and e == 0):
                held.add((e, k))
                continue
            rows.append((k / 30 + rng.uniform(-0.01, 0.01) * (k > 0), k, e, [float(v) for v in x], None, T0))
    out = grid.onto_grid(spark.createDataFrame(rows, FRAMES), spark.createDataFrame([(e, 30) for e in range(40)], EPISODES))
    got = {(r["episode_index"], r["grid_index"]): r for r in out.collect()}
    assert len(got) == 40 * 200
    assert {k for k, r in got.items() if r["status"] != "observed"} == held
    for k, r in got.items():
        if r["status"] == "observed":
            assert np.array_equal(np.float32(r["state"]), np.float32(truth[k]))
    filled = [k for k, r in got.items() if r["status"] == "filled"]
    error = np.array([np.abs(np.array(got[k]["state"]) - truth[k]) for k in filled])
    assert len(filled) > 0.8 * (len(held) - 50)
    assert np.sqrt((error**2).mean()) < 0.01
    assert all(got[0, k]["status"] == "marked" and set(got[0, k]["state"]) == {None} for k in range(115, 135))


def test_grid_holes_at_window_edges(spark):
    """A hole is filled in the same cells wherever it lies in a window."""
    hole = 14
    rows = [(k / 30, k, e, [0.001 * k] * 7, None, T0) for e in range(grid.CORE) for k in range(160) if not 64 + e <= k < 64 + e + hole]
    out = grid.onto_grid(spark.createDataFrame(rows, FRAMES), spark.createDataFrame([(e, 30) for e in range(grid.CORE)], EPISODES))
    got = {(r["episode_index"], r["grid_index"] - 64 - r["episode_index"]) for r in out.where("status = 'filled'").collect()}
    assert got == {(e, i) for e in range(grid.CORE) for i in range(hole) if i + 1 <= grid.REACH and hole - i <= grid.REACH}


def recorded(spark, keep):
    """Frames of sf0.01 as delivered, those that keep() takes; the grid filled from them; and every reading by its point of the grid."""
    con = duck("/root/testdata/sf0.01")
    rows = con.execute("""select "timestamp", frame_index, episode_index, "observation.state", null, received_at from frames order by all""").fetchall()
    kept = [r for r in rows if keep(r)]
    fps = con.execute("select episode_index, min(fps) from episodes group by 1 order by 1").fetchall()
    rate = dict(fps)
    got = grid.onto_grid(spark.createDataFrame(kept, FRAMES), spark.createDataFrame(fps, EPISODES)).collect()
    state = {(r["episode_index"], r["grid_index"]): (r["status"], r["state"]) for r in got}
    truth = {(r[2], math.floor(float(np.float32(r[0])) * rate[r[2]] + 0.5)): r[3] for r in rows if r[2] in rate and None not in (r[0], r[3])}
    return state, truth


def test_grid_beats_a_line(spark):
    """The frames as delivered, wrong readings and all, a tenth held out: filled cells are as near to the truth as a straight line, and in the mean much nearer."""
    rng, out = np.random.default_rng(0), {}
    state, truth = recorded(spark, lambda r: out.setdefault(r[1:3], rng.random() > 0.1))
    known = {}
    for (e, k), (status, x) in sorted(state.items()):
        if status == "observed":
            known.setdefault(e, []).append((k, x))
    ours, line, last = [], [], []
    for (e, k), (status, x) in state.items():
        if status != "filled" or (e, k) not in truth:
            continue
        for j, t in enumerate(truth[e, k]):
            if t is None or not math.isfinite(t):
                continue
            i = bisect.bisect_left(known[e], (k,))
            fine = lambda p: p[1][j] is not None and math.isfinite(p[1][j])  # noqa: B023, E731
            a, b = next(filter(fine, reversed(known[e][:i]))), next(filter(fine, known[e][i:]))
            ours.append(abs(x[j] - t))
            line.append(abs(a[1][j] + (b[1][j] - a[1][j]) * (k - a[0]) / (b[0] - a[0]) - t))
            last.append(abs(a[1][j] - t))
    assert len(ours) > 30_000
    assert np.median(ours) <= np.median(line) < np.median(last)
    for q in (0.75, 0.9, 0.99):
        assert np.quantile(ours, q) < np.quantile(line, q)
    assert np.mean(np.minimum(ours, 3)) < np.mean(np.minimum(line, 3))


def test_grid_of_any_scale(spark):
    """Values a million times as large or as small are filled alike, and wrong readings do not bend the fill."""
    rng = np.random.default_rng(1)
    base = [(e, k, np.sin(k / 30 + e + np.arange(7))) for e in range(20) for k in range(150) if k in (0, 149) or rng.random() > 0.1]
    wrong = {i for i in range(len(base)) if rng.random() < 0.01}
    found = []
    for scale in (1e-6, 1.0, 1e6):
        rows = [(k / 30, k, e, [float(v) * scale * (900 if i in wrong and j == 2 else 1) for j, v in enumerate(x)], None, T0) for i, (e, k, x) in enumerate(base)]
        out = grid.onto_grid(spark.createDataFrame(rows, FRAMES), spark.createDataFrame([(e, 30) for e in range(20)], EPISODES)).where("status = 'filled'").collect()
        error = [np.abs(np.array(r["state"]) / scale - np.sin(r["grid_index"] / 30 + r["episode_index"] + np.arange(7))) for r in out]
        found.append((len(error), np.quantile(error, 0.99)))
    assert len({n for n, _ in found}) == 1 and found[0][0] > 200
    assert max(q for _, q in found) < 0.003


def test_grid_far_timestamp(spark):
    """One timestamp far off makes a long grid, in bounded steps."""
    rows = [(k / 30, k, 0, [0.1 * k] * 7, None, T0) for k in range(40)] + [(20_000.0, 40, 0, [1.0] * 7, None, T0)]
    out = grid.onto_grid(spark.createDataFrame(rows, FRAMES), spark.createDataFrame([(0, 30)], EPISODES))
    assert out.agg(F.count("*"), F.max("grid_index"), F.countDistinct("grid_index")).first()[:] == (600_001, 600_000, 600_001)
