"""Literal cases of the core's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import schedules, text, vectors
from tidewheel.operators import images, projections, quality, sampling, segments, stats, trees, windows
from tidewheel.session import attach, exact


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Projections


def test_repack_and_rename(spark):
    df = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("c")).alias("b")).alias("x"), F.struct(F.lit(2).alias("f")).alias("e"))
    out = projections.repack(df, {"a": {"b": "x/b/c"}, "d": "e/f"}).first().asDict(True)
    assert out == {"a": {"b": 1}, "d": 2}
    with pytest.raises(ValueError, match="no field"):
        projections.repack(df, {"a": "x/y"})
    tree = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.lit(2).alias("c")).alias("a"))
    assert projections.rename(tree, {"a/b": "a/c", "a/c": None}).first().asDict(True) == {"a": {"c": 1}}
    with pytest.raises(ValueError, match="would both"):
        projections.rename(tree, {"a/b": "a/c"})
    assert projections.rename(tree, {"a": None}).first().asDict(True) == {"a": {"b": 1, "c": 2}}
    assert projections.rename(tree, {"a.+": None}).columns == []
    two = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.lit(1).alias("c")).alias("a"), F.struct(F.lit(2).alias("c")).alias("b"))
    assert projections.rename(two, {"(.+)/c": r"\1/d"}).first().asDict(True) == {"a": {"b": 1, "d": 1}, "b": {"d": 2}}
    assert projections.unflatten(projections.flatten(two)).schema == two.schema


def test_apply_tree(spark):
    tree = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.lit(2).alias("c")).alias("a"))
    assert projections.apply_tree(tree, ["a/b", "zz"], lambda c: c + 1).first().asDict(True) == {"a": {"b": 2, "c": 2}}
    with pytest.raises(ValueError, match="zz"):
        projections.apply_tree(tree, ["zz"], lambda c: c, strict=True)


def test_checked(spark):
    good, bad = (projections.checked(F.lit(1), F.lit(x), "unknown task") for x in (True, None))
    assert one(spark, good) == 1
    with pytest.raises(Exception, match="unknown task"):
        one(spark, bad)


# Vectors


def test_delta_absolute(spark):
    m, s = F.array(F.array(*map(F.lit, (3, 4, 5))), F.array(*map(F.lit, (5, 6, 7)))), F.array(*map(F.lit, (1, 2, 3)))
    assert one(spark, vectors.delta(m, s, [False, True])) == [[3, 2, 5], [5, 4, 7]]
    assert one(spark, vectors.absolute(m, s, [False, True])) == [[3, 6, 5], [5, 8, 7]]
    assert vectors.delta(m, s, None) is m


def test_masks_and_padding(spark):
    assert vectors.bool_mask((2, -2, 2)) == [True, True, False, False, True, True] and vectors.bool_mask((2, 0, 2)) == [True] * 4
    assert one(spark, vectors.bool_mask_column(F.array(F.lit(2), F.lit(-1)))) == [True, True, False]
    v = F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, vectors.pad(v, 4)) == [1, 2, 0, 0] and one(spark, vectors.pad(v, 1)) == [1, 2]


def test_discretize(spark):
    xs = np.concatenate([np.linspace(-1.2, 1.2, 999), np.linspace(-1, 1, 257), [-1.0, 1.0]])
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").coalesce(1).select(vectors.discretize(F.col("x"))).collect()]
    assert got == list(np.digitize(xs, np.linspace(-1, 1, 257)[:-1]) - 1)


def test_dims_spec(spark):
    got = one(spark, text.spec_ranges(F.lit("14:21,28:49,21:28,49:70"), ":", False))
    assert got == [*range(14, 21), *range(28, 49), *range(21, 28), *range(49, 70)]
    assert one(spark, text.spec_ranges(F.lit(" 0, 2,5-9,2"), "-", True)) == [0, 2, 5, 6, 7, 8, 9]


def test_prefix_weights(spark):
    def weights(*a):
        return [r[0] for r in spark.range(16).coalesce(1).orderBy("id").select(schedules.prefix_weight(F.col("id"), *a, 16)).collect()]

    w = weights(4, 8, 10)
    assert w[:4] == [1] * 4 and w[8:] == [0] * 8 and all(a > b for a, b in zip(w[3:7], w[4:8], strict=True))
    assert w[4] == pytest.approx(0.571, abs=0.01) and w[7] == pytest.approx(0.026, abs=0.01)
    assert weights(5, 8, 3) == [1] * 3 + [0] * 13


def test_text(spark):
    assert one(spark, text.clean_prompt(F.lit("\n pick_up\nthis \t"))) == "pick up this"
    assert one(spark, text.safe_name(F.lit("a/b  c?"))) == "a_b_c" and one(spark, text.safe_name(F.lit("??"))) == "item"
    assert one(spark, text.dim_name(F.array(F.lit("x")), F.lit(3))) == "dim_03"


# Segments: small segments agree with one


def made(spark, n=500, episodes=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(episodes)), int(rng.integers(10_000)) * 1000, i, float(rng.integers(100)), None if rng.random() < 0.7 else float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "ep long, us long, id long, value double, some double")


def test_numbering_and_running(spark):
    df = made(spark)
    pdf = df.toPandas().sort_values(["ep", "us", "id"])
    pdf["fi"] = pdf.groupby("ep").cumcount()
    pdf["sum"] = pdf.groupby("ep")["value"].cumsum()
    pdf["held"] = pdf.groupby("ep")["some"].ffill()
    for bucket, length in ((1_000_000_000, 1_000), (700_000, 7)):
        f = segments.number_frames(df, "id", bucket)
        f = segments.carry_last(segments.running_sum(f, F.col("value"), "sum", length), F.col("some"), "held", length)
        got = f.toPandas().sort_values(["ep", "fi"])
        for c in ("id", "fi", "sum", "held"):
            assert np.array_equal(got[c].to_numpy(float), pdf[c].to_numpy(float), equal_nan=True), c


def test_micros_without_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.000001' a, timestamp_ntz'1969-12-31 23:59:59.5' b")
    keep = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(segments.micros("a"), segments.micros("b")).first()[:] == (1_710_037_800_000_001, -500_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", keep)


def test_small_segments_same(spark):
    f = segments.number_frames(made(spark), "id").cache()
    for build in (
        lambda n: windows.chunks(f, ["value"], 4, n), lambda n: windows.kinematics(f, "value", 1.0, n), lambda n: windows.poll_hold(f, 2.0, n), lambda n: windows.replan(windows.sessions(f, 0.05, n), 3, "value", n),
    ):
        a, b = (sorted(map(str, build(n).select(*sorted(build(n).columns)).collect())) for n in (10_000, 5))
        assert len(a) == 500 and a == b


def test_positions(spark):
    rows = spark.createDataFrame([(int(x), int(x) % 5) for x in np.random.default_rng(1).permutation(300)], "k long, size long")
    got = segments.positions(segments.positions(rows, ["k"]), ["k"], F.col("size"), "before").toPandas().sort_values("k")
    assert list(got.position) == list(range(300)) and list(got.before) == list(np.cumsum(got["size"]) - got["size"])
    assert segments.positions(rows.limit(0), ["k"]).count() == 0


def test_attach_shuffled(spark):
    fact = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    dim = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        a, b = (sorted(map(str, attach(fact, dim, "k", how, n).select("k", "id", "v").collect())) for n in (1 << 20, 1))
        assert a == b


def test_exact(spark):
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("A"), F.lit(3).alias("b.c"), F.lit(4).alias("a"))
    assert exact(df, "b.c", "a").first()[:] == (3, 1)
    with pytest.raises(ValueError, match="zz"):
        exact(df, "zz")


# Holds


def test_hold_literal(spark):
    f = spark.createDataFrame([(1, i, i / 30) for i in range(10)], "ep long, fi long, t double")
    got = windows.poll_hold(f, 10.0).orderBy("fi").collect()
    assert [r["held_fi"] for r in got] == [0, 0, 0, 3, 3, 3, 6, 6, 6, 9]
    assert [r["age"] for r in got[:3]] == pytest.approx([0, 1 / 30, 2 / 30])


def test_offline_and_online_hold_differ(spark):
    f = spark.createDataFrame([(1, i, t, 1.0) for i, t in enumerate((0.0, 0.14, 0.20))], "ep long, fi long, t double, v double")
    assert [r["held_fi"] for r in windows.poll_hold(f, 10.0).orderBy("fi").collect()] == [0, 1, 2]
    assert [r["polled_fi"] for r in windows.rate_limited_hold(f, "v", 10.0).orderBy("fi").collect()] == [0, 1, 1]


def test_chunk_literal(spark):
    rows = [(e, i, [float(2 * e + i), 10.0]) for e, n in ((0, 2), (1, 3)) for i in range(n)]
    f = spark.createDataFrame(rows, "ep long, fi long, a array<double>")
    got = {(r["ep"], r["fi"]): (r["a_chunk"], r["pad"]) for r in windows.chunks(f, ["a"], 3).collect()}
    assert got[0, 1] == ([[1.0, 10.0]] * 3, [False, True, True])
    assert got[1, 0] == ([[2.0, 10.0], [3.0, 10.0], [4.0, 10.0]], [False] * 3)


# Statistics


def test_moments(spark):
    x = np.arange(12.0).reshape(4, 3)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(4)
    got = stats.moments(stats.per_dim(df, F.col("v")), "dim").orderBy("dim").collect()
    assert [r["mean"] for r in got] == [4.5, 5.5, 6.5] and [r["std"] for r in got] == pytest.approx([math.sqrt(11.25)] * 3)


def test_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 30)) + 4
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    mean, parts, scales, explained = stats.principal_components(df, F.col("v"), 30, 3)
    assert explained > 0.99999
    back = df.select("id", stats.encode(F.col("v"), mean, parts, scales).alias("s")).select("id", stats.reconstruct(F.col("s"), mean, parts, scales).alias("r")).orderBy("id").collect()
    assert np.allclose([r["r"] for r in back], x, atol=1e-5)
    assert (parts[np.arange(3), np.abs(parts).argmax(1)] > 0).all()
    assert np.allclose(np.cov(x.T)[np.triu_indices(30)], [r["cov"] for r in stats.covariance(df, F.col("v"), 30).orderBy("i", "j").collect()])


def test_json_round_trip(spark):
    v = spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],)], "v array<double>")
    s = stats.as_vectors(stats.norm_stats(stats.per_dim(v, F.col("v")), "dim"))
    kinds = s.schema
    back = s.select(F.from_json(F.to_json(F.struct("*")), kinds).alias("x")).select("x.*").first()
    assert back == s.first() and back["mean"] == [2.0, 3.5]


def test_normalise_inverse(spark):
    v, m, s = F.array(*map(F.lit, (1.0, 5.0, 9.0))), F.array(*map(F.lit, (2.0, 4.0))), F.array(*map(F.lit, (0.5, 2.0)))
    assert one(spark, vectors.zscore_back(vectors.zscore(v, m, s), m, s))[:2] == pytest.approx([1, 5])
    low, high = m, F.array(*map(F.lit, (3.0, 8.0)))
    assert one(spark, vectors.quantile_scale_back(vectors.quantile_scale(F.slice(v, 1, 2), low, high), low, high)) == pytest.approx([1, 5])
    assert one(spark, vectors.quantile_scale_back(v, low, high))[2] == 9.0
    assert one(spark, vectors.zscore_back(v, m, s))[2] == pytest.approx(9.0 * (1 + 1e-6))


# Trees


def test_tree_merge(spark):
    kind = "path string, shape string, dtype string, value double"
    reference = spark.createDataFrame([("base/kernel", "2x2", "f32", 0.0), ("action_out_proj/kernel", "2x2", "f32", 0.0)], kind)
    loaded = spark.createDataFrame([("base/kernel", "2x2", "bf16", 1.0), ("extra", "1", "f32", 3.0)], kind)
    got = {r["path"]: (r["value"], r["origin"], r["dtype"]) for r in trees.merge(reference, loaded, ".*proj.*").collect()}
    assert got == {"base/kernel": (1.0, "loaded", "f32"), "action_out_proj/kernel": (0.0, "reference", "f32")}
    assert {r["path"]: r["why"] for r in trees.diff(reference, loaded).collect()} == {"base/kernel": "dtype", "action_out_proj/kernel": "only first", "extra": "only second"}
    assert {r["path"]: r["origin"] for r in trees.merge_partial(reference, loaded, "x").collect()} == {"base/kernel": "loaded", "action_out_proj/kernel": "error"}


# Samples


def test_spaced(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 100, 101)], "n long")
    got = {}
    for r in sampling.spaced(df, 7).collect():
        got.setdefault(r["n"], []).append(r["pick"])
    assert {n: sorted(v) for n, v in got.items()} == {n: list(np.round(np.linspace(0, n - 1, min(n, 7))).astype(int)) for n in (1, 2, 5, 100, 101)}


def test_resample(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 100, "a").otherwise("b").alias("s"))
    out = sampling.resample(df, "s", "id", {"a": 0.7, "b": 0.3}, 3)
    assert {r["s"]: r["count"] for r in out.groupBy("s").count().collect()} == {"a": 700, "b": 300}
    assert out.where("s = 'a'").select("id").distinct().count() > 80 and out.select("s", "draw").distinct().count() == 1000
    with pytest.raises(ValueError, match="add up"):
        sampling.resample(df, "s", "id", {"a": 0.7})


def test_batches_and_shuffle(spark):
    out = sampling.batches(spark.range(10), ["id"], 4)
    assert sorted(map(tuple, out.collect())) == [(i, i // 4, i % 4) for i in range(8)]
    assert sampling.batches(spark.range(10), ["id"], 4, drop_last=False).count() == 10
    s = sampling.shuffled(spark.range(50), "id", 1, 2)
    orders = [[r["id"] for r in s.where(f"epoch = {e}").orderBy("shuffle", "id").collect()] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(50)) and orders[0] != orders[1]


# Quality


def audit(spark, t, v, limits):
    f = spark.createDataFrame([(1, i, float(a), [float(x) for x in (b if isinstance(b, list | tuple) else [b])]) for i, (a, b) in enumerate(zip(t, v, strict=True))], "ep long, fi long, t double, v array<double>")
    m = quality.measure(f, limits)
    return {r["code"]: r for r in quality.episode_issues(m, limits).collect()}, m


def test_boundary_idle(spark):
    x = [0, 0, 0, 0, 0, 1, 2, 3, 3, 3, 3, 3]
    limits = quality.Limits(fps=10, start_idle=0.2, end_idle=0.2, padding=1, step=9, velocity=99, acceleration=1e4)
    found, m = audit(spark, [i / 10 for i in range(12)], [[a, 0.0] for a in x], limits)
    assert set(found) == {"start_idle", "end_idle"}
    assert found["start_idle"]["observed"] == pytest.approx(0.4) and found["end_idle"]["observed"] == pytest.approx(0.4)
    assert quality.suggested_trim(m, limits).first()[1:] == (3, 8)


def test_dropped_sample(spark):
    found, m = audit(spark, [0, 0.1, 0.2, 0.4, 0.5], range(5), quality.Limits(fps=10, time_tolerance=0.01, step=9, velocity=99, acceleration=1e4))
    assert set(found) == {"dropped_sample"} and m.first()["dropped"] == 1 and found["dropped_sample"]["frame_end"] == 3


def test_jitter_and_back(spark):
    wide = {"fps": 10, "time_tolerance": 0.01, "step": 9, "velocity": 1e6, "acceleration": 1e9, "end_idle": 9}
    assert set(audit(spark, [0, 0.1, 0.18, 0.28], range(4), quality.Limits(**wide))[0]) == {"timestamp_jitter"}
    assert set(audit(spark, [0, 0.1, 0.1, 0.2], range(4), quality.Limits(**wide))[0]) == {"timestamp_non_increasing", "timestamp_jitter"}
    assert {"timestamp_nonfinite"} <= set(audit(spark, [0, math.nan, 0.2], range(3), quality.Limits(**wide))[0])


def test_kinematic_issues(spark):
    found, m = audit(spark, [i / 10 for i in range(5)], [0, 0, 2, 2, 2], quality.Limits(fps=10, step=0.5, velocity=5, acceleration=20, end_idle=9))
    assert set(found) == {"joint_step_jump", "velocity_limit", "velocity_jump"}
    assert found["joint_step_jump"]["observed"] == 2.0 and found["velocity_limit"]["observed"] == pytest.approx(20.0)
    assert (found["joint_step_jump"]["frame_start"], found["joint_step_jump"]["frame_end"]) == (1, 2)


def test_short_static_width_nonfinite(spark):
    assert set(audit(spark, [0], [0], quality.Limits())[0]) == {"too_short"}
    assert set(audit(spark, [0, 1 / 30], [0, 0], quality.Limits())[0]) == {"episode_static"}
    assert {"state_dimension", "nonfinite_value"} <= set(audit(spark, [0, 1 / 30], [[0, math.nan], [0, 1]], quality.Limits(width=3))[0])


def test_home(spark):
    f = spark.createDataFrame([(e, 0, 0.0, v) for e, v in enumerate(([0.0, 0.0], [0.01, 0.0], [1.0, 0.0]))], "ep long, fi long, t double, v array<double>")
    m = quality.measure(f, quality.Limits())
    got = quality.home_issues(m, quality.Limits()).collect()
    assert [r["ep"] for r in got] == [2] and got[0]["observed"] == pytest.approx(0.99)
    assert {r["ep"] for r in quality.home_issues(m, quality.Limits(), [1.0, 0.0]).collect()} == {0, 1}


def test_clocks(spark):
    rows = [(1, i, i / 10, 1000 * (i / 10 + 0.05)) for i in range(20)] + [(2, i, i / 10, 1000 * (i / 10 + (0.3 if i == 7 else 0))) for i in range(20)]
    f = spark.createDataFrame(rows, "ep long, fi long, t double, cam double")
    got = {(r["ep"], r["code"]): r for r in quality.clock_issues(f, "cam", quality.Limits(fps=10)).collect()}
    assert set(got) == {(1, "sensor_timestamp_offset"), (2, "sensor_timestamp_misaligned")}
    assert got[2, "sensor_timestamp_misaligned"]["frame_start"] == 7 and got[1, "sensor_timestamp_offset"]["observed"] == pytest.approx(0.05)


def test_images_and_videos(spark):
    f = spark.createDataFrame([(e, i, i / 10, None if (e, i) == (1, 2) else b"x") for e in (1, 2, 3, 4) for i in range(5)], "ep long, fi long, t double, img binary")
    assert [tuple(r)[:2] + tuple(r)[4:] for r in quality.image_issues(f, "img", F.col("img").isNotNull()).collect()] == [(1, "camera_frame_missing", 2, 2, 1.0)]
    assert quality.image_issues(f, "zz", None).count() == 4
    pts = spark.createDataFrame([(1, i, i / 10) for i in range(5)] + [(2, i, i / 10 + (0.2 if i > 2 else 0)) for i in range(4)], "ep long, fi long, pts double")
    files = spark.createDataFrame([(1, True, True), (2, True, True), (3, False, False), (4, True, False)], "ep long, exists boolean, decoded boolean")
    got = {(r["ep"], r["code"]) for r in quality.video_issues(f, pts, files, "cam", quality.Limits(fps=10)).collect()}
    assert got == {(2, "camera_frame_count"), (2, "camera_dropped_frame"), (2, "camera_timestamp_misaligned"), (3, "camera_file_missing"), (4, "camera_decode_failed")}
    eps = f.select("ep").distinct()
    assert quality.missing_clock_issues(eps, ["timestamp", "img"], ["img"]).count() == 4 and quality.missing_clock_issues(eps, ["cam_timestamp"], ["img"]).count() == 0


@pytest.mark.parametrize("most", [3, 50, 100_000])
def test_exact_percentiles(spark, most):
    """As NumPy gives them, however few distinct values are sorted at once; with repeated, null and not-finite values, and a hot group."""
    rng = np.random.default_rng(0)
    groups = {0: rng.normal(0, 1, 3000), 1: rng.choice([1.0, 2.0, 7.0], 400), 2: np.array([5.0]), 3: 10.0 ** rng.uniform(-30, 30, 200), 4: np.array([-1.0, 3.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [(0, None), (1, math.nan), (5, None), (2, math.inf), (None, 3.0)]
    df = spark.createDataFrame(rows, "k long, x double")
    got = {(r["k"], r["p"]): r["x"] for r in stats.exact_percentiles(df.where("k is not null"), ["k"], "x", [0.05, 0.5, 0.99], most=most).collect()}
    assert len(got) == 15
    for (k, p), x in got.items():
        assert x == pytest.approx(np.quantile(groups[k], p), rel=1e-12)
    counted = df.where("k = 1 and not isnan(x)").groupBy("k", "x").agg(F.count("*").alias("n"))
    assert stats.exact_percentiles(counted, ["k"], "x", [0.5], "n", most).first()["x"] == np.median(groups[1])
    assert stats.exact_percentiles(df.where("false"), ["k"], "x", [0.5]).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_polls(seed):
    """The chain of polls, by jumps, as it is followed time by time: rising times with ties, times that go back, and nulls."""
    rng = np.random.default_rng(seed)
    for n in (0, 1, 2, 7, 300):
        t = np.cumsum(rng.choice([0.0, 0.01, 0.03, 0.1, 0.5], n))
        if seed % 3 == 1:
            t[rng.random(n) < 0.2] = math.nan
        if seed % 3 == 2:
            t -= rng.choice([0, 1.0], n, p=[0.9, 0.1])
        for last in (None, 0.05, 1e9):
            want, at = [], last
            for x in t:
                hit = not math.isnan(x) and (at is None or x - at >= 0.1)
                at = x if hit else at
                want.append(hit)
            assert windows.polls(t, 0.1, last).tolist() == want


def test_rate_limited_hold_over_batches(spark):
    """Small Arrow batches carry the last poll on; nulls poll nothing."""
    rng = np.random.default_rng(1)
    rows = [(e, i, None if rng.random() < 0.05 else float(t), float(i) if rng.random() > 0.1 else None) for e in range(4) for i, t in enumerate(np.cumsum(rng.uniform(0, 0.1, 200)))]
    df = spark.createDataFrame(rows, "ep long, fi long, t double, v double")
    want, episode = {}, None
    for e, i, t, v in rows:
        if e != episode:
            episode, last, at, held = e, None, None, None
        if t is not None and (last is None or t - last >= 0.1 - 1e-5):
            last, at, held = t, i, v
        want[e, i] = (at, held)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r["ep"], r["fi"]): (r["polled_fi"], r["held"]) for r in windows.rate_limited_hold(df, "v", 10.0).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_numbered_and_sampled(spark):
    df = spark.createDataFrame([("a", 5), ("b", 0), ("c", 3), ("d", None)], "k string, n long")
    assert sorted((r["k"], r["i"]) for r in segments.numbered(df, "n", "i", 2).collect()) == [("a", i) for i in range(5)] + [("c", i) for i in range(3)]
    rows = spark.range(5000)
    for n in (0, 1, 700, 5000, 9000):
        got = [r["id"] for r in sampling.hash_sample(rows, "id", n, 3).collect()]
        assert len(set(got)) == len(got) == min(n, 5000)
    assert set(r["id"] for r in sampling.hash_sample(rows, "id", 10, 3).collect()) == set(r["id"] for r in rows.orderBy(sampling.hash_order(F.col("id"), 3), "id").limit(10).collect())


@pytest.mark.parametrize("seed", range(4))
def test_growing_histogram(seed):
    """Against NumPy's histograms: batches that widen the range on either side, or not at all."""
    rng = np.random.default_rng(seed)
    batches = [rng.normal(0, 1 + k * (seed > 0), (40, 3)) for k in range(5)] + [np.full((3, 3), 0.25)]
    h, counts, edges, low, high, n = stats.GrowingHistogram(50), None, None, None, None, 0
    for b in batches:
        h.add(b)
        if counts is None:
            low, high = b.min(0), b.max(0)
            edges, counts = [np.linspace(x - 1e-10, y + 1e-10, 51) for x, y in zip(low, high, strict=True)], [np.zeros(50)] * 3
        else:
            grown = (b.max(0) > high).any() or (b.min(0) < low).any()
            low, high = np.minimum(low, b.min(0)), np.maximum(high, b.max(0))
            if grown:
                new = [np.linspace(x, y, 51) for x, y in zip(low, high, strict=True)]
                counts = [np.histogram(e[:-1], f, weights=c)[0] for e, f, c in zip(edges, new, counts, strict=True)]
                edges = new
        counts = [c + np.histogram(b[:, d], edges[d])[0] for d, c in enumerate(counts)]
        n += len(b)
    assert np.array_equal(h.counts, np.column_stack(counts))
    for q in (0.01, 0.5, 0.99):
        assert h.quantile(q) == pytest.approx([e[np.searchsorted(np.cumsum(c), q * n)] for e, c in zip(edges, counts, strict=True)], abs=1e-9)


def test_growing_quantiles(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=2)]) for i in range(500)]
    h = stats.GrowingHistogram(100)
    for i in range(0, 500, 30):
        h.add(np.array([v for _, v in rows[i : i + 30]]))
    df = spark.createDataFrame([*rows, (999, None)], "i long, v array<double>").repartition(5)
    got = {(r["dim"], r["q"]): r["x"] for r in stats.growing_quantiles(df, F.col("v"), ["i"], 30, [0.1, 0.9], 100).collect()}
    assert got == {(d, q): h.quantile(q)[d] for d in (0, 1) for q in (0.1, 0.9)}
    assert stats.growing_quantiles(df.where("false"), F.col("v"), ["i"], 30, [0.1]).count() == 0


def test_images(spark, tmp_path):
    """Bytes from the column, from files by relative and whole paths, or none; statistics of sampled and thinned images against NumPy."""
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.bin").write_bytes(b"file a")
    rows = [(1, (b"own", "sub/a.bin")), (2, (None, "sub/a.bin")), (3, (None, f"{tmp_path}/sub/a.bin")), (4, (None, "sub/none.bin")), (5, (None, None)), (6, None)]
    df = spark.createDataFrame(rows, "i long, image struct<bytes: binary, path: string>")
    got = {r["i"]: r["content"] and bytes(r["content"]) for r in images.embedded(df, "image", str(tmp_path)).collect()}
    assert got == {1: b"own", 2: b"file a", 3: b"file a", 4: None, 5: None, 6: None}
    rng = np.random.default_rng(0)
    pictures = {(e, i): rng.integers(0, 256, (310 if e else 6, 155 if e else 4, 3), dtype=np.uint8) for e, n in ((0, 230), (1, 3)) for i in range(n)}
    rows = [(e, i, (x.tobytes(), *x.shape)) for (e, i), x in pictures.items()] + [(0, 230, (b"12", 1, 1, 3)), (0, 231, None)]
    f = spark.createDataFrame(rows, "ep long, fi long, image struct<data: binary, h: int, w: int, c: int>")
    lengths = spark.createDataFrame([(0, 230), (1, 3), (2, 5)], "ep long, n long")
    assert images.stride(310, 155) == 2 and images.stride(299, 299) == 1 and images.stride(300, 900) == 6
    out = {(r["ep"], r["channel"]): r for r in images.channel_stats(f, "image", lengths).collect()}
    picked = sorted({int(x) for x in np.round(np.linspace(0, 229, 100))})
    for e, at, k in ((0, picked, 1), (1, [0, 1, 2], 2)):
        x = np.stack([pictures[e, i][::k, ::k] for i in at]) / 255
        for c in range(3):
            r = out[e, c]
            assert (r["min"], r["max"], r["mean"], r["std"]) == pytest.approx((x[..., c].min(), x[..., c].max(), x[..., c].mean(), x[..., c].std()), abs=1e-9) and r["count"] == len(at)
    assert len(out) == 6


def test_concatenated(spark):
    a, b = spark.range(2), spark.range(3)
    out = projections.concatenated([a, b], [None, lambda x: x.where("id > 0")])
    assert sorted(map(tuple, out.collect())) == [(0, 0), (1, 0), (1, 1), (2, 1)]
    for sets, transforms in (([], None), ([a], [None, None])):
        with pytest.raises(ValueError, match="transforms"):
            projections.concatenated(sets, transforms)
