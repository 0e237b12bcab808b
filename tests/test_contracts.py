import io
import json
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import vectors
from tidewheel.operators import contracts, projections, stats
from tidewheel.sources import episodic, framed

NAMES = [f"{s}_arm_joint{i}" for s in ("left", "right") for i in range(1, 8)] + [f"{s}_finger{i}_joint" for s in ("left", "right") for i in range(1, 7)]
ALL = ["left_arm", "right_arm", "left_hand", "right_hand"]


def info(names=NAMES, **more):
    vector = {"dtype": "float32", "shape": [len(names)], "names": names}
    return {"fps": 30, "features": {"observation.state": vector, "action": vector, "observation.images.cam_high": {}, "observation.images.cam_left": {}}, **more}


def test_interface():
    one = contracts.interface(info(), ALL)
    assert len(one["state_names"]) == 26 and one["group_dims"] == {"left_arm": 7, "right_arm": 7, "left_hand": 6, "right_hand": 6}
    assert contracts.interface(info(), ["right_hand"])["state_indices"] == list(range(20, 26))
    mixed = [*NAMES[:3], "eef_pose_x", *NAMES[3:]]
    assert contracts.interface(info(mixed), ALL)["state_names"] == NAMES and len(contracts.interface(info(mixed), ["right_arm", "right_hand"])["state_indices"]) == 13
    assert contracts.same_interface([one, contracts.interface(info(), ALL)]) is one
    with pytest.raises(ValueError, match="state_indices"):
        contracts.same_interface([one, contracts.interface(info(mixed), ALL)])
    for bad, message in ((["hand"], "unknown"), (["right_arm", "left_arm"], "ordered"), ([], "ordered")):
        with pytest.raises(ValueError, match=message):
            contracts.interface(info(), bad)
    for doc, message in ((info(fps=0), "fps"), (info(NAMES[:1] * 2), "duplicate"), (info(NAMES[:7]), "no joints")):
        with pytest.raises(ValueError, match=message):
            contracts.interface(doc, ALL)
    wrong = info()
    wrong["features"]["action"] = {**wrong["features"]["action"], "shape": [3]}
    with pytest.raises(ValueError, match="shape"):
        contracts.interface(wrong, ALL)


def test_group_column(spark):
    names = [*NAMES, "eef", "left_x", "right_wrist_joint"]
    got = spark.createDataFrame([(n,) for n in names], "n string").coalesce(1).select(contracts.group_column(F.col("n"))).collect()
    assert [r[0] for r in got] == [contracts.group_of(n) for n in names]


def test_aliases():
    aliases = {"base": ("cam_high", "top"), "left": ("cam_left",)}
    assert contracts.bind_aliases(["top", "cam_left"], aliases) == {"base": "top", "left": "cam_left"}
    assert contracts.bind_aliases(["top", "cam_left", "x"], aliases, True)["base"] == "top"
    for there in (["top", "cam_high", "cam_left"], ["cam_left"], ["top", "cam_left", "x"]):
        with pytest.raises(ValueError):
            contracts.bind_aliases(there, aliases)


def test_seal(tmp_path):
    contracts.save({"a": 1, "é": ["x"]}, tmp_path / "c.json", "run_step5")
    assert contracts.load(tmp_path / "c.json", "run_step5")["a"] == 1
    with pytest.raises(ValueError, match="made for"):
        contracts.load(tmp_path / "c.json", "other")
    doc = json.loads((tmp_path / "c.json").read_text())
    (tmp_path / "c.json").write_text(json.dumps(doc | {"a": 2}))
    with pytest.raises(ValueError, match="edited"):
        contracts.load(tmp_path / "c.json")
    assert contracts.checkpoint_name("run", "/x/500") == "run_step500" and contracts.checkpoint_name("run", "/x/best") == "best"


@dataclass
class Setting:
    a: int = 1
    inner: object = None


def test_plain(tmp_path):
    known = {"setting": Setting}
    x = Setting(2, [Setting(3), {"k": (1, 2)}])
    plain = contracts.to_plain(x, known)
    assert contracts.from_plain({**plain, "old_field": 1}, known) == Setting(2, [Setting(3), {"k": [1, 2]}])
    with pytest.raises(ValueError, match="unknown class"):
        contracts.from_plain({"class": "os.system"}, known)
    with pytest.raises(ValueError, match="not registered"):
        contracts.to_plain(object(), known)
    with pytest.raises(ValueError, match="did you mean setting"):
        contracts.named("seting", known)
    (tmp_path / "e.json").write_text('{"base": "act", "training": {"batch_size": 16}}')
    assert contracts.load_experiment(tmp_path / "e.json", {"act": {"training": {"batch_size": 32, "num_workers": 2}}}) == {"training": {"batch_size": 16, "num_workers": 2}}
    assert contracts.dispatch("fake", {"fake": lambda: 7}) == 7


def test_settings():
    contracts.check_indices([3, 1], 4, 2)
    for args in (([1, 1], 4), ([4], 4), ([-1], 4), ([1], 4, 2), (None, 0)):
        with pytest.raises(ValueError):
            contracts.check_indices(*args)
    assert contracts.check_strategy(None, 16, False) == {"strategy": "standard"}
    assert contracts.check_strategy({"strategy": "RTC", "rtc": {"prefix_horizon": 4}}, 16, True)["prefix_horizon"] == 4
    for s, overlap in (({"strategy": "x"}, True), ({"strategy": "rtc"}, False), *(({"strategy": "rtc", "rtc": r}, True) for r in ({"prefix_horizon": 17}, {"schedule": "lin"}, {"max_guidance_weight": float("inf")}, {"initial_delay_steps": -1}))):
        with pytest.raises(ValueError):
            contracts.check_strategy(s, 16, overlap)
    assert contracts.split_axis((1024, 4096), 8, 4) == 1 and contracts.split_axis((8, 8), 8, 4) is None and contracts.split_axis((1 << 24,), 8, 4) is None and contracts.split_axis((1023, 4095), 8, 4) is None


def test_framed(spark, tmp_path):
    first, second = {"kind": "infer", "state": np.arange(6, dtype=np.float32).reshape(2, 3), "deep": [{"x": np.int64(4)}]}, {"kind": "reset"}
    buffer = io.BytesIO()
    for m in (first, second):
        framed.write_message(buffer, m)
    got = list(framed.read_messages(io.BytesIO(buffer.getvalue())))
    assert np.array_equal(got[0]["state"], first["state"]) and got[0]["deep"] == [{"x": 4}] and got[1] == second
    with pytest.raises(EOFError):
        list(framed.read_messages(io.BytesIO(buffer.getvalue()[:-3])))
    with pytest.raises(ValueError, match="too long"):
        list(framed.read_messages(io.BytesIO(b"plain text that is no message")))
    (tmp_path / "a.msg").write_bytes(buffer.getvalue())
    (tmp_path / "b.msg").write_bytes(b"")
    framed.register(spark)
    rows = spark.read.format("framed").option("path", str(tmp_path / "*.msg")).load().orderBy("position").collect()
    assert [json.loads(r["body"])["kind"] for r in rows] == ["infer", "reset"] and rows[0]["arrays"] == {"state": [0, 1, 2, 3, 4, 5]}


def test_small_functions(spark, tmp_path):
    pe = np.array(vectors.sincos_2d(2, 3, 8))
    assert pe.shape == (6, 8) and np.allclose(pe[5], [np.sin(2), np.sin(2e-4), np.cos(2), np.cos(2e-4), np.sin(1), np.sin(1e-4), np.cos(1), np.cos(1e-4)])
    with pytest.raises(ValueError):
        vectors.sincos_2d(1, 1, 6)
    assert episodic.home_reference("[1, 2]") == [1, 2] and episodic.home_reference('{"position": [3]}') == [3] and episodic.home_reference(None) is None
    (tmp_path / "h.json").write_text('{"home": [4]}')
    assert episodic.home_reference(str(tmp_path / "h.json")) == [4]
    with pytest.raises(ValueError):
        episodic.home_reference("[[1]]")
    df = spark.createDataFrame([(1, [1.0], None, None), (2, None, b"x", None)], "a int, v array<double>, p binary, q binary")
    assert df.select(episodic.scalar_column(df, "a")).first()[0] == 1.0
    with pytest.raises(ValueError, match="no scalar"):
        episodic.scalar_column(df, "v")
    assert [r[0] for r in df.orderBy("a").select(projections.paired("p", "q")).collect()] == [True, False]
    image = spark.createDataFrame([((b"123456", 1, 2, 3),), ((b"12345", 1, 2, 3),), (None,)], "i struct<data: binary, h: int, w: int, c: int>")
    assert [r[0] for r in image.coalesce(1).select(projections.is_rgb("i")).collect()] == [True, False, False]
    s = spark.createDataFrame([(0, 1.0, None)], "dim int, q01 double, q99 double")
    with pytest.raises(Exception, match="without quantiles"):
        stats.require_quantiles(s).collect()
    m = spark.createDataFrame([(i, float(i)) for i in range(10)], "batch int, loss double")
    assert stats.mean_over_batches(m, "batch", 4, "loss").first()["loss"] == 1.5
