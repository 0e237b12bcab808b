"""Episodic datasets: meta/*.json(l), one Parquet file per episode, videos beside them (not decoded).

Layout of version 2 datasets: meta/info.json, meta/episodes.jsonl, meta/tasks.jsonl, data/chunk-XXX/episode_XXXXXX.parquet.
"""

from __future__ import annotations

import json
import math
import os
import re
import shutil
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Always kept by a projection.
BOOKKEEPING = ["timestamp", "frame_index", "episode_index", "index", "task_index"]
DATA_PATH = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
TIME_TOLERANCE_S = 2e-4


def read_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def read_jsonl(path: str | Path) -> list[dict]:
    """Records of a JSON-lines file; blank lines are skipped, a missing file has none."""
    p = Path(path)
    return [json.loads(x) for x in p.read_text().splitlines() if x.strip()] if p.exists() else []


def episode_path(episode: F.Column, chunk: int = 1000):  # noqa: ANN201
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", F.floor(episode / chunk).cast("int"), episode.cast("int"))


def time_tolerance(value: str | float | None = None) -> float:
    """Seconds a frame may be off its grid; a positive, finite number."""
    x = TIME_TOLERANCE_S if value is None else float(value)
    if not (math.isfinite(x) and x > 0):
        raise ValueError("time tolerance must be positive and finite")
    return x


class Dataset:
    """An open dataset. Raises ValueError unless it is of version 2, has episodes, numbered 0 to n - 1 in order, and totals agree."""

    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        self.spark, self.root = spark, Path(root)
        self.info = read_json(self.root / "meta/info.json")
        if not str(self.info.get("codebase_version", "")).startswith("v2."):
            raise ValueError("only version 2 datasets can be read")
        self.episodes = read_jsonl(self.root / "meta/episodes.jsonl")
        if not self.episodes:
            raise ValueError("the dataset has no episodes")
        if [e["episode_index"] for e in self.episodes] != list(range(len(self.episodes))):
            raise ValueError("episode indices must run from 0 without gaps")
        if "total_episodes" in self.info and self.info["total_episodes"] != len(self.episodes):
            raise ValueError("total_episodes differs from the listed episodes")
        self.tasks = read_jsonl(self.root / "meta/tasks.jsonl")

    def path(self, episode: int) -> Path:
        chunk = episode // int(self.info.get("chunks_size", 1000))
        return self.root / self.info.get("data_path", DATA_PATH).format(episode_chunk=chunk, episode_index=episode)

    def frames(self, columns: Sequence[str] | None = None, episodes: Sequence[int] | None = None) -> DataFrame:
        """Frames of all or the given episodes; with columns, only those and the bookkeeping ones are read. Missing columns are an error."""
        paths = [str(self.path(e)) for e in (range(len(self.episodes)) if episodes is None else episodes)]
        df = self.spark.read.parquet(*paths)
        return df if columns is None else project(df, columns)

    def videos(self) -> list[str]:
        return [k for k, f in self.info.get("features", {}).items() if f.get("dtype") == "video"]

    def task_table(self) -> DataFrame:
        return self.spark.createDataFrame([(t["task_index"], t["task"]) for t in self.tasks], "task_index long, task string")

    def episode_table(self) -> DataFrame:
        return self.spark.createDataFrame([(e["episode_index"], e.get("tasks"), e["length"]) for e in self.episodes], "episode_index long, tasks array<string>, length long")


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The bookkeeping columns that are there and the given ones; one that isn't there raises ValueError."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    keep = [c for c in df.columns if c in set(BOOKKEEPING) | set(columns)]
    return df.select(*(F.col(f"`{c}`") for c in keep))


def scalar_column(df: DataFrame, name: str, kind: str = "double") -> F.Column:
    """A scalar column in another type; one of lists, structs or maps raises ValueError."""
    if isinstance(df.schema[name].dataType, T.ArrayType | T.StructType | T.MapType):
        raise ValueError(f"{name} is no scalar")
    return F.col(f"`{name}`").cast(kind)


def home_reference(value: str | None) -> list[float] | None:
    """A home position from JSON text or a file of it: a list, or {"home": list} or {"position": list}."""
    if not value:
        return None
    p = Path(value).expanduser()
    doc = json.loads(p.read_text() if len(value) < 4096 and p.is_file() else value)
    doc = doc.get("home", doc.get("position")) if isinstance(doc, dict) else doc
    if not isinstance(doc, list) or any(isinstance(x, list) for x in doc):
        raise ValueError("a home position is one list of numbers")
    return [float(x) for x in doc]


def discover_episodes(root: str | Path) -> list[int]:
    """Episode numbers: from meta/episodes.jsonl, else from the data files' names, else 0 to total_episodes - 1."""
    root = Path(root)
    if listed := read_jsonl(root / "meta/episodes.jsonl"):
        return sorted(int(e["episode_index"]) for e in listed)
    if files := sorted(root.glob("data/**/episode_*.parquet")):
        return sorted(int(m[1]) for f in files if (m := re.search(r"episode_(\d+)\.parquet$", f.name)))
    return list(range(int(read_json(root / "meta/info.json").get("total_episodes", 0))))


def choose_vector(schema: T.StructType, requested: str | None, candidates: Sequence[str], part: str) -> str:
    """A numeric list column: the requested one, else the first candidate there is, else the only one whose name holds part."""
    vectors = [f.name for f in schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)]
    if requested is not None:
        if requested not in vectors:
            raise ValueError(f"{requested} is no numeric vector")
        return requested
    for c in candidates:
        if c in vectors:
            return c
    if len(near := [v for v in vectors if part in v]) == 1:
        return near[0]
    raise ValueError(f"no vector column is clearly meant: {', '.join(vectors)}")


def trim_manifest(path: str | Path) -> dict[int, float]:
    """Seconds to trim by episode, from CSV (episode_index, trim_start_s) or JSON: a mapping, a list of records, or {"episodes": either}."""
    p = Path(path)
    if p.suffix.lower() == ".csv":
        lines = [x.split(",") for x in p.read_text().splitlines() if x.strip()]
        head = [h.strip() for h in lines[0]] if lines else []
        if not {"episode_index", "trim_start_s"} <= set(head):
            raise ValueError("the manifest needs episode_index and trim_start_s")
        rows = [dict(zip(head, (v.strip() for v in x), strict=True)) for x in lines[1:]]
    else:
        rows = json.loads(p.read_text())
        rows = rows["episodes"] if isinstance(rows, dict) and "episodes" in rows else rows
        if isinstance(rows, dict):
            rows = [{"episode_index": k, "trim_start_s": v} for k, v in rows.items()]
    out: dict[int, float] = {}
    for r in rows:
        e = int(r["episode_index"])
        if e in out:
            raise ValueError(f"episode {e} is listed twice")
        out[e] = trim_value(r["trim_start_s"])
    return out


def trim_value(x: object) -> float:
    """A finite number that isn't negative; booleans aren't numbers here."""
    if isinstance(x, bool):
        raise ValueError("a trim must be a number")
    try:
        v = float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise ValueError("a trim must be a number") from None
    if not math.isfinite(v) or v < 0:
        raise ValueError("a trim must be finite and not negative")
    return v


def range_manifest(path: str | Path) -> dict[int, tuple[float, float | None]]:
    """Kept ranges (start, end or None) by episode, from JSON as in trim_manifest; start_s or trim_start_s, end_s or trim_end_s."""
    rows = json.loads(Path(path).read_text())
    rows = rows["episodes"] if isinstance(rows, dict) and "episodes" in rows else rows
    if isinstance(rows, dict):
        rows = [{"episode_index": k, **(v if isinstance(v, dict) else dict(zip(("start_s", "end_s"), v, strict=False)))} for k, v in rows.items()]
    out: dict[int, tuple[float, float | None]] = {}
    for r in rows:
        start = trim_value(next((r[k] for k in ("trim_start_s", "start_s") if r.get(k) is not None), 0.0))
        end = next((r[k] for k in ("trim_end_s", "end_s") if r.get(k) is not None), None)
        if end is not None and trim_value(end) < start:
            raise ValueError("a range must not end before it starts")
        out[int(r["episode_index"])] = (start, None if end is None else float(end))
    return out


def json_safe(x):  # noqa: ANN001, ANN201
    """Not-finite numbers become null, in any depth."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    return [json_safe(v) for v in x] if isinstance(x, list | tuple) else x


def write_json(path: str | Path, doc: object) -> None:
    Path(path).write_text(json.dumps(doc, indent=2, allow_nan=False, ensure_ascii=False) + "\n")


def write_jsonl(path: str | Path, rows: Sequence[dict]) -> None:
    Path(path).write_text("".join(json.dumps(r, allow_nan=False, ensure_ascii=False) + "\n" for r in rows))


class Publish:
    """Build a dataset beside its place and rename it there at the end; on an error nothing remains.

    The place must not exist, nor lie within the source or the source within it.
    """

    def __init__(self, target: str | Path, source: str | Path | None = None) -> None:
        self.target = Path(target).resolve()
        if self.target.exists():
            raise ValueError(f"{self.target} exists")
        if source is not None:
            s = Path(source).resolve()
            if self.target.is_relative_to(s) or s.is_relative_to(self.target):
                raise ValueError("source and target must lie apart")

    def __enter__(self) -> Path:
        self.target.parent.mkdir(parents=True, exist_ok=True)
        self.work = Path(tempfile.mkdtemp(prefix=f".{self.target.name}-", dir=self.target.parent))
        return self.work

    def __exit__(self, kind, value, trace) -> None:  # noqa: ANN001
        if kind is None:
            os.replace(self.work, self.target)
        else:
            shutil.rmtree(self.work, ignore_errors=True)


def copy_auxiliary(source: str | Path, work: str | Path) -> None:
    """What else a dataset has, beside data, videos and metadata that are made anew; what is there already stays."""
    for p in sorted(Path(source).rglob("*")):
        to = Path(work) / (at := p.relative_to(source))
        if p.is_file() and at.parts[0] not in ("data", "videos") and not to.exists():
            to.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(p, to)


def snapshot(root: str | Path) -> dict[str, tuple[int, int, int]]:
    """What identifies the state of each file: inode, size, time of change."""
    root = Path(root)
    return {str(p.relative_to(root)): ((s := p.stat()).st_ino, s.st_size, s.st_mtime_ns) for p in sorted(root.rglob("*")) if p.is_file()}


def fake_frames(spark: SparkSession, n: int, fields: dict[str, tuple[str, int]], seed: int = 0) -> DataFrame:
    """n records of made-up vectors, the same for the same index: float in -1..1, int in 0..2047, else zeros. fields: name to (kind, width)."""
    def cell(name: str, kind: str, i: int):  # noqa: ANN202
        h = F.xxhash64("index", F.lit(name), F.lit(i), F.lit(seed))
        if kind == "float":
            return (F.pmod(h, F.lit(1 << 24)) / (1 << 23) - 1).cast("float")
        return F.pmod(h, F.lit(2048)).cast("int") if kind == "int" else F.lit(0)

    df = spark.range(n).withColumnRenamed("id", "index")
    return df.select("index", *(F.array(*(cell(k, kind, i) for i in range(width))).alias(k) for k, (kind, width) in fields.items()))
