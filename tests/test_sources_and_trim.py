import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import trim
from tidewheel.sources import episodic


@pytest.fixture
def dataset(tmp_path):
    """Two episodes of 6 and 5 frames at 10 Hz."""
    root = tmp_path / "source"
    (root / "meta").mkdir(parents=True)
    lengths = [6, 5]
    info = {
        "codebase_version": "v2.1", "chunks_size": 1000, "fps": 10, "total_episodes": 2, "total_frames": 11, "splits": {"train": "0:2"},
        "data_path": episodic.DATA_PATH, "features": {"observation.images.cam": {"dtype": "video"}, "action": {"dtype": "float32"}},
    }
    episodic.write_json(root / "meta/info.json", info)
    episodic.write_jsonl(root / "meta/episodes.jsonl", [{"episode_index": e, "tasks": ["test"], "length": n} for e, n in enumerate(lengths)])
    (root / "meta/tasks.jsonl").write_text('{"task_index": 0, "task": "test"}\n\n')
    index = 0
    for e, n in enumerate(lengths):
        v = [i + 10.0 * e for i in range(n)]
        table = pa.table(
            {
                "timestamp": pa.array([i / 10 for i in range(n)], pa.float32()), "frame_index": pa.array(range(n), pa.int64()), "episode_index": pa.array([e] * n, pa.int64()),
                "index": pa.array(range(index, index + n), pa.int64()), "task_index": pa.array([0] * n, pa.int64()),
                "observation.state": pa.array([[x, x + 0.5] for x in v], pa.list_(pa.float32())), "action": pa.array([[x + 1, x + 1.5] for x in v], pa.list_(pa.float32())),
            }
        )
        index += n
        path = root / episodic.DATA_PATH.format(episode_chunk=0, episode_index=e)
        path.parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(table, path)
    return root


def read(root, e):
    return pq.read_table(root / episodic.DATA_PATH.format(episode_chunk=0, episode_index=e)).to_pydict()


def test_trim_all(spark, dataset, tmp_path):
    before = episodic.snapshot(dataset)
    plan = trim.rewrite_dataset(episodic.Dataset(spark, dataset), tmp_path / "out", {0: (0.2, None), 1: (0.2, None)})
    assert [p["new_length"] for p in plan] == [4, 3]
    zero, one = read(tmp_path / "out", 0), read(tmp_path / "out", 1)
    assert zero["timestamp"] == pytest.approx([0, 0.1, 0.2, 0.3], abs=1e-6) and zero["timestamp"][0] == 0
    assert zero["index"] == [0, 1, 2, 3] and one["index"] == [4, 5, 6]
    assert zero["observation.state"][0] == [2.0, 2.5] and zero["frame_index"] == [0, 1, 2, 3]
    info = episodic.read_json(tmp_path / "out/meta/info.json")
    assert info["total_frames"] == 7 and info["total_episodes"] == 2
    stats = episodic.read_jsonl(tmp_path / "out/meta/episodes_stats.jsonl")
    assert stats[0]["stats"]["action"]["count"] == [4] and stats[0]["stats"]["action"]["min"] == [3.0, 3.5]
    assert episodic.read_json(tmp_path / "out/meta/trim.json")["episodes"][0]["start_frame"] == 2
    assert episodic.snapshot(dataset) == before
    kinds = pq.read_schema(tmp_path / "out" / episodic.DATA_PATH.format(episode_chunk=0, episode_index=0))
    assert kinds.field("timestamp").type == pa.float32() and kinds.field("index").type == pa.int64()
    assert not list((tmp_path / "out").glob("_*")) and len(episodic.Dataset(spark, tmp_path / "out").episodes) == 2


def test_trim_one(spark, dataset, tmp_path):
    plan = trim.rewrite_dataset(episodic.Dataset(spark, dataset), tmp_path / "out", {1: (0.2, None)}, only=[1])
    assert [(p["ep"], p["new_ep"], p["new_length"]) for p in plan] == [(1, 0, 3)]
    out = read(tmp_path / "out", 0)
    assert out["index"] == [0, 1, 2] and out["observation.state"][0] == [12.0, 12.5] and set(out["episode_index"]) == {0}


def test_trim_errors(spark, dataset, tmp_path):
    source = episodic.Dataset(spark, dataset)
    assert len(trim.rewrite_dataset(source, tmp_path / "dry", {0: (0.2, 0.3)}, dry_run=True)) == 2
    assert not (tmp_path / "dry").exists()
    for ranges, message in (({0: (9.0, None)}, "nothing would be kept"), ({7: (0.0, None)}, "unknown")):
        with pytest.raises(ValueError, match=message):
            trim.rewrite_dataset(source, tmp_path / "bad", ranges)
        assert not (tmp_path / "bad").exists()
    with pytest.raises(ValueError, match="exists"):
        trim.rewrite_dataset(source, dataset, {})
    with pytest.raises(ValueError, match="apart"):
        trim.rewrite_dataset(source, dataset / "inside", {})


def test_range_ends_included(spark):
    frames = spark.createDataFrame([(1, i, i / 4) for i in range(9)], "ep long, fi long, t double")
    ranges = spark.createDataFrame([(1, 0.5, 1.0)], "ep long, start_s double, end_s double")
    p = trim.plan(frames, ranges).first()
    assert (p["start_frame"], p["end_frame"], p["new_length"]) == (2, 5, 3)
    bad = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 2, 0.5)], "ep long, fi long, t double")
    none = spark.createDataFrame([], "ep long, start_s double, end_s double")
    with pytest.raises(ValueError, match="rise"):
        trim.check_plan(bad, trim.plan(bad, none), none)


def test_validate_finds(spark):
    frames = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "ep long, fi long, t double")
    plans = trim.plan(frames, spark.createDataFrame([], "ep long, start_s double, end_s double"))
    good = trim.rewrite(frames, plans)
    assert {r["rule"]: r["violations"] for r in trim.validate(good, plans).collect()} == {"length": 0, "time": 0, "frame_index": 0, "index": 0}
    worse = good.withColumn("index", F.when(F.col("fi") == 2, 9).otherwise(F.col("index"))).where("fi < 4")
    assert {r["rule"]: r["violations"] for r in trim.validate(worse, plans).collect()} == {"length": 1, "time": 0, "frame_index": 0, "index": 1}


def test_projected_scan(spark, dataset):
    source = episodic.Dataset(spark, dataset)
    df = source.frames(["action"], [1])
    assert df.columns == ["timestamp", "frame_index", "episode_index", "index", "task_index", "action"] and df.count() == 5
    assert "observation.state" not in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="not_there"):
        source.frames(["not_there"])
    assert source.videos() == ["observation.images.cam"] and source.task_table().count() == 1 and source.episode_table().count() == 2


def test_open_checks(spark, dataset):
    info = episodic.read_json(dataset / "meta/info.json")
    for change, message in (({"codebase_version": "v1.6"}, "version"), ({"total_episodes": 3}, "total")):
        episodic.write_json(dataset / "meta/info.json", info | change)
        with pytest.raises(ValueError, match=message):
            episodic.Dataset(spark, dataset)
    episodic.write_json(dataset / "meta/info.json", info)
    episodic.write_jsonl(dataset / "meta/episodes.jsonl", [{"episode_index": 1, "length": 5}])
    with pytest.raises(ValueError, match="without gaps"):
        episodic.Dataset(spark, dataset)
    (dataset / "meta/episodes.jsonl").write_text("")
    with pytest.raises(ValueError, match="no episodes"):
        episodic.Dataset(spark, dataset)
    assert episodic.discover_episodes(dataset) == [0, 1]


def test_manifests(tmp_path):
    for name, text in (("a.json", '{"0": 0.5, "3": 0.8}'), ("b.json", '[{"episode_index": 0, "trim_start_s": 0.5}, {"episode_index": 3, "trim_start_s": 0.8}]'), ("c.json", '{"episodes": {"0": 0.5, "3": 0.8}}'), ("d.csv", "episode_index,trim_start_s\n0,0.5\n3,0.8\n")):
        (tmp_path / name).write_text(text)
        assert episodic.trim_manifest(tmp_path / name) == {0: 0.5, 3: 0.8}
    for bad in ("x", -1, float("nan"), float("inf"), True, None):
        with pytest.raises(ValueError, match="trim"):
            episodic.trim_value(bad)
    (tmp_path / "e.csv").write_text("episode,seconds\n1,2\n")
    with pytest.raises(ValueError, match="needs"):
        episodic.trim_manifest(tmp_path / "e.csv")
    (tmp_path / "f.csv").write_text("episode_index,trim_start_s\n1,2\n1,3\n")
    with pytest.raises(ValueError, match="twice"):
        episodic.trim_manifest(tmp_path / "f.csv")
    for doc in ({"1": {"start_s": 1.0}, "2": [0.5, 2]}, [{"episode_index": 1, "trim_start_s": 1.0}, {"episode_index": 2, "start_s": 0.5, "end_s": 2}], {"episodes": {"1": [1.0, None], "2": {"trim_start_s": 0.5, "trim_end_s": 2}}}):
        (tmp_path / "r.json").write_text(json.dumps(doc))
        assert episodic.range_manifest(tmp_path / "r.json") == {1: (1.0, None), 2: (0.5, 2.0)}
    (tmp_path / "r.json").write_text('{"1": [2, 1]}')
    with pytest.raises(ValueError, match="before"):
        episodic.range_manifest(tmp_path / "r.json")


def test_time_tolerance():
    assert episodic.time_tolerance() == 2e-4 and episodic.time_tolerance("5e-4") == 5e-4
    for bad in ("not-a-number", "0", "-0.1", "nan", "inf"):
        with pytest.raises(ValueError):
            episodic.time_tolerance(bad)


def test_json_safe_and_publish(tmp_path):
    assert episodic.json_safe({1: [float("nan"), (1.0, float("inf"))]}) == {"1": [None, [1.0, None]]}
    with pytest.raises(ValueError):
        episodic.write_json(tmp_path / "x.json", float("nan"))
    with pytest.raises(RuntimeError), episodic.Publish(tmp_path / "new") as work:
        (work / "f").write_text("x")
        raise RuntimeError
    assert not (tmp_path / "new").exists() and not [p for p in tmp_path.iterdir() if p.name.startswith(".new")]


def test_choose_vector(spark):
    schema = spark.createDataFrame([], "a array<float>, state_x array<double>, s string, names array<string>").schema
    assert episodic.choose_vector(schema, "a", [], "") == "a"
    assert episodic.choose_vector(schema, None, ["b", "a"], "") == "a"
    assert episodic.choose_vector(schema, None, [], "state") == "state_x"
    for args in (("names", [], ""), (None, [], "zzz"), (None, [], "a")):
        with pytest.raises(ValueError):
            episodic.choose_vector(schema, *args)
