"""Problems 1, 2, 4 and 6 against brute force, on tables with nulls, ties, repeats, one hot key and clashing names."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import rows_of
from tidewheel.llm import components, nearest, percentiles, runs

T0 = dt.datetime(2026, 1, 1)
FRAMES = "timestamp float, frame_index long, episode_index long, `observation.state` array<float>, action array<float>, received_at timestamp"


# 1


def nearest_tables(seed, n=400):
    rng = np.random.default_rng(seed)
    number = lambda: None if rng.random() < 0.05 else float(rng.choice([rng.uniform(0, 100), round(rng.uniform(0, 100), 1), math.nan, math.inf], p=[0.6, 0.38, 0.01, 0.01]))
    entity = lambda: None if rng.random() < 0.03 else int(rng.choice([0, 0, 0, 1, 2, 3]))
    left = [(i if rng.random() > 0.02 else None, entity(), number()) for i in range(n)]
    left += left[:20]
    right = [(int(rng.integers(50)) if rng.random() > 0.03 else None, entity(), number()) for _ in range(n)]
    return left, right


def brute_nearest(left, right, tolerance):
    out = {}
    fine = lambda x: x is not None and math.isfinite(x)
    for i, e, t in left:
        if i is None or e is None or not fine(t):
            continue
        best = min(((abs(t - u), u, v) for v, g, u in right if g == e and v is not None and fine(u) and abs(t - u) <= tolerance), default=None)
        if best:
            out[i] = best[2]
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("range_s", [0.3, 7.0, 1000.0])
def test_nearest(spark, seed, range_s):
    left, right = nearest_tables(seed)
    a = spark.createDataFrame(left, "id long, e long, t double").repartition(3).select("*", F.lit(1).alias("_range"), F.lit(2).alias("T"))
    b = spark.createDataFrame(right, "v long, e long, t double").repartition(3).select("*", F.lit("x").alias("_id"), F.lit("y").alias("id"))
    out = nearest.nearest_in_time(a, b, "e", "t", "id", "v", 0.25, range_s=range_s, shard_rows=100).collect()
    assert {r["id"]: r["v"] for r in out} == brute_nearest(left, right, 0.25) and len(out) == len({r["id"] for r in out})


def test_nearest_edges(spark):
    kind_a, kind_b = "id long, e long, t double", "v long, e long, t double"
    empty_a, empty_b = spark.createDataFrame([], kind_a), spark.createDataFrame([], kind_b)
    one = spark.createDataFrame([(1, 1, 1.0)], kind_a)
    same = spark.createDataFrame([(9, 1, 0.9), (4, 1, 0.9), (7, 1, 1.1), (3, 2, 1.0)], kind_b)
    go = lambda a, b: [tuple(r)[:2] for r in nearest.nearest_in_time(a, b, "e", "t", "id", "v", 0.25).collect()]
    assert go(empty_a, same) == go(one, empty_b) == go(empty_a, empty_b) == []
    assert go(one, spark.createDataFrame([(9, 1, 0.75), (4, 1, 0.75), (7, 1, 1.25)], kind_b)) == [(1, 4)]  # the earlier, then the smaller value
    assert go(one, spark.createDataFrame([(7, 1, 1.2500001)], kind_b)) == []


# 2


def union_find(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def found_groups(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["root"], set()).add(r["v"])
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("small", [10_000, 0])
@pytest.mark.parametrize("shape", ["random", "path", "star", "cycle", "none"])
def test_components(spark, shape, small):
    rng = np.random.default_rng(1)
    links = {
        "random": [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2)) if a != b], "path": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 100)],
        "cycle": [(i, (i + 1) % 90 if i % 90 != 89 else i - 89) for i in range(90)], "none": [],
    }[shape]
    df = spark.createDataFrame(links + links[:5], "a long, b long")
    assert found_groups(components.components(df, small)) == union_find(links)


def test_member_links(spark):
    """A key with a third of all members gives no long list of neighbours, and all members of a key hang together."""
    rows = [("hot", i) for i in range(20_000)] + [(f"k{i % 4000}", i + (i % 3 == 0) * 20_000) for i in range(40_000)] + [(None, 1), ("x", None), ("one", 70_000)]
    links = components.member_links(spark.createDataFrame(rows, "key string, v long").repartition(4)).collect()
    degree = {}
    for a, b in links:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    assert max(degree.values()) < 500
    first = {}
    star = [(v, first.setdefault(k, v)) for k, v in rows if k is not None and v is not None]
    assert union_find([(r["a"], r["b"]) for r in links]) == {g for g in union_find(star) if len(g) > 1}


def test_components_hot(spark):
    """Large enough for several partitions: a star, long paths and random parts together."""
    rng = np.random.default_rng(4)
    links = [(0, i) for i in range(1, 4000)] + [(10_000 + i, 10_001 + i) for i in range(3000)] + [(int(a), int(b)) for a, b in rng.integers(20_000, 30_000, (9000, 2)) if a != b] + [(3999, 10_000)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    for small in (500_000, 100):
        assert found_groups(components.components(df, small)) == union_find(links)


def episodes_of(spark, rows):
    return spark.createDataFrame(rows, "episode_index long, session_id string, source_episode_index long").select("*", F.lit(1).alias("v"), F.lit("k").alias("key"), F.lit(1).alias("Session_Id"))


def test_related(spark):
    rows = [
        (5, " S1", None), (5, " S1", None), (3, "s1 ", None), (7, None, 3), (8, None, 99), (9, None, 99), (10, None, None), (11, "", None), (12, "Z", 10), (13, None, 13), (None, "S1", 14), (14, "q", None), (15, None, 500),
    ]
    got = {r["episode_index"]: r["group_id"] for r in components.related_episodes(episodes_of(spark, rows)).collect()}
    assert got == {3: 3, 5: 3, 7: 3, 8: 8, 9: 8, 10: 10, 12: 10}
    assert components.related_episodes(episodes_of(spark, [])).count() == 0


def test_split(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "HOT" if i < 200 else f"s{rng.integers(150)}" if rng.random() < 0.8 else None, int(rng.integers(600)) if rng.random() < 0.1 and i >= 200 else None) for i in range(600)]
    frames = spark.createDataFrame([(e, f) for e in range(620) for f in range(e % 13)] * 2 + [(None, 1), (3, None)], "episode_index long, frame_index long")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.5)], "split string, target_share double")
    episodes = episodes_of(spark, rows)
    out = components.split_related(episodes, frames, targets).cache()
    there = [e for e in range(620) if e < 600 or e % 13]
    assert sorted(r["episode_index"] for r in out.collect()) == there
    assert out.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert out.agg(F.sum("n_frames")).first()[0] == sum(e % 13 for e in range(620))
    shares = {r["split"]: r for r in components.split_shares(out, targets.where("split is not null")).collect()}
    assert all(abs(shares[s]["actual_share"] - x) < 0.02 for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1))), shares
    none = components.split_related(episodes, frames, targets.limit(0))
    assert none.where("split is not null").count() == 0 and none.count() == len(there)
    assert components.split_related(episodes.limit(0), frames.limit(0), targets).count() == 0


# 4


def brute_runs(rows, tolerance=0.0015, least=5):
    by = {}
    for t, fi, e, s, _, _ in rows:
        if e is not None and fi is not None and s is not None:
            by.setdefault(e, {}).setdefault(fi, (t, np.array([math.nan if x is None else x for x in np.array(s, object)], np.float32).astype(float)))
    out = []
    for e, frames in by.items():
        run = []
        for fi in [*sorted(frames), None]:
            x = None if fi is None else frames[fi][1]
            if run and (fi is None or not (np.abs(x - frames[run[-1]][1]) <= tolerance).all()):
                if len(run) >= least:
                    ts = [np.float32(frames[i][0]) for i in run if frames[i][0] is not None]
                    out.append((e, run[0], run[-1], len(run), float(max(ts)) - float(min(ts)) if ts else None))
                run = []
            run.append(fi)
    return out


def run_rows(seed, n=900):
    rng = np.random.default_rng(seed)
    rows, x = [], np.zeros(2)
    for i in range(n):
        if rng.random() < 0.1:
            continue
        x = x + (0 if rng.random() < 0.85 else rng.choice([0.001, 0.002, 0.5]))
        s = None if rng.random() < 0.03 else [float(v) for v in x]
        if s and rng.random() < 0.02:
            s[0] = rng.choice([math.nan, math.inf]).item()
        if s and rng.random() < 0.01:
            s[1] = None
        rows.append((None if rng.random() < 0.3 else i / 30, i, 0 if i < 600 else 1, s, None, T0))
        if rng.random() < 0.1:
            rows.append((*rows[-1][:5], T0 + dt.timedelta(1)))
    rows += [(None, i, 2, [1.0, 1.0], None, T0) for i in range(40)] + [(0.0, None, 0, [0.0, 0.0], None, T0), (0.0, 1, None, [0.0, 0.0], None, T0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [4, 17, 32_768])
@pytest.mark.parametrize("seed", [0, 1])
def test_runs(spark, seed, chunk):
    rows = run_rows(seed)
    df = spark.createDataFrame(rows, FRAMES).repartition(3).select("*", F.lit(1).alias("n"), F.lit(2).alias("head"), F.lit(0).alias("TIMESTAMP"))
    out = runs.collapse_runs(df, width=2, chunk=chunk)
    want = brute_runs(rows)
    assert len(want) > 10
    assert rows_of(range(5), [tuple(r) for r in out.collect()]) == rows_of(range(5), want)


def test_runs_empty(spark):
    assert runs.collapse_runs(spark.createDataFrame([], FRAMES)).count() == 0


# 6


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    rows, values = [], {}
    for e in range(9):
        for i in range(60):
            s = [float(np.float32(rng.normal() * 10.0 ** rng.integers(-2, 3))) for _ in range(7)]
            if rng.random() < 0.05:
                s[int(rng.integers(7))] = rng.choice([math.nan, math.inf, 3e38]).item()
            a = None if rng.random() < 0.1 else s[::-1]
            at = T0 + dt.timedelta(hours=int(rng.integers(100)))
            rows.append((0.0, i, e, s, a, at))
            if rng.random() < 0.2:
                rows.append((0.0, i, e, s, a, at + dt.timedelta(days=2)))
            for field, v in (("state", s), ("action", a)):
                for j, x in enumerate(v or ()):
                    if math.isfinite(x) and e != 8:
                        values.setdefault(("r0" if e < 6 else "r1", field, j), []).append(float(np.float32(x)))
    frames = spark.createDataFrame(rows + [(0.0, None, 1, None, None, T0), (0.0, 1, None, None, None, None)], FRAMES).select("*", F.lit(1).alias("robot_id"), F.lit(1).alias("cell"))
    episodes = spark.createDataFrame([(e, "r0" if e < 6 else "r1") for e in range(8)] * 2 + [(8, None)], "episode_index long, robot_id string")
    counts = percentiles.day_counts(frames, episodes)
    assert counts.select("day").distinct().count() == 5 and counts.agg(F.sum("n")).first()[0] == sum(map(len, values.values()))
    out = percentiles.bisect_percentiles(counts).collect()
    assert len(out) == 5 * 28
    for r in out:
        v = sorted(values[r["robot_id"], r["field"], r["joint_index"]])
        exact = v[max(1, math.ceil(r["percentile"] * len(v))) - 1]
        assert r["n"] == len(v) and abs(r["estimate"] - exact) <= r["error_bound"] <= abs(exact) / 2**10
    # days kept apart and combined later give the same
    parts = [counts.where(F.pmod(F.hash("day"), F.lit(2)) == k) for k in (0, 1)]
    again = percentiles.bisect_percentiles(percentiles.merge_counts(parts[0].unionByName(parts[1]))).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert percentiles.bisect_percentiles(counts.limit(0)).count() == 0


def test_cells():
    """Cells lie in the order of the values, and a value is within half a cell's width of its middle, at any scale."""
    rng = np.random.default_rng(0)
    x = np.sort(np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-300, 300, 2000), [0.0, -0.0, 5e-324, -5e-324, 1.0, -1.0, 2.0, np.finfo(float).max, -np.finfo(float).max]]))
    cell = percentiles.cells_of(x)
    middle, error = percentiles.cell_middle(cell)
    assert (np.diff(cell) >= 0).all() and np.abs(cell).max() < 1 << 23
    assert (np.abs(middle - x) <= error).all()
    normal = np.abs(x) > 1e-300
    assert (error[normal] <= np.abs(x[normal]) / 2**10).all()
    packed = [(percentiles._packed(np.array(c), np.array(n)), len(c)) for c, n in (([-5, 0, 7], [1, 2, 3]), ([0, 9], [4, 5]), ([-4_000_000, 4_000_000], [1, 1 << 40]))]
    cells, n = percentiles._merged(packed * 70)
    assert dict(zip(cells.tolist(), n.tolist(), strict=True)) == {-4_000_000: 70, -5: 70, 0: 420, 7: 210, 9: 350, 4_000_000: 70 << 40}
