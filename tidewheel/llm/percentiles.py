"""Problem 6: percentiles per group from mergeable day counts, by bisection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.chunks import chunk_rows, first_deliveries, in_chunks, matrix, plain, starts_of, whole_groups
from tidewheel.session import attach, exact

#: Bits of a value's mantissa that its cell keeps; an estimate is at most one part in 2 ** (BITS + 1) from the exact percentile, whatever the scale.
BITS = 10
PERCENTILES = (0.01, 0.05, 0.5, 0.95, 0.99)
CHUNK = 32_768
GROUP = ["robot_id", "field", "joint_index"]
#: Blocks of counts added up at once.
MERGED = 64
_BLOCK = "day date, robot_id string, channel int, n long, occupied int, counts binary"
_KEPT = "day date, robot_id string, field string, joint_index long, n long, occupied int, counts binary"
_KINDS = [
    pa.field("day", pa.date32()), pa.field("robot_id", pa.string()), pa.field("field", pa.string()), pa.field("joint_index", pa.int64()),
    pa.field("n", pa.int64()), pa.field("occupied", pa.int32()), pa.field("counts", pa.binary()),
]
_FOUND = "robot_id string, field string, joint_index long, percentile double, n long, estimate double, error_bound double"


def cells_of(x: np.ndarray) -> np.ndarray:
    """The cells of finite values, in the order of the values: sign, exponent and the first BITS bits of the mantissa."""
    bits = (x.astype(np.float64) + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))) >> (52 - BITS)


def cell_middle(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width of cells; those next to 0 have 0 for their middle."""
    size = np.where(cell < 0, -cell - 1, cell).astype(np.int64)
    low, high = ((size + k) << (52 - BITS) for k in (0, 1))
    low, high = low.view(np.float64), np.minimum(high, 0x7FEF_FFFF_FFFF_FFFF).view(np.float64)
    half = (high - low) / 2
    return np.where(size == 0, 0.0, np.where(cell < 0, -(low + half), low + half)), np.where(size == 0, high, half)


def _packed(cells: np.ndarray, n: np.ndarray) -> bytes:
    return pa.compress(np.diff(cells, prepend=0).astype("<i4").tobytes() + n.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _opened(counts: bytes, occupied: int) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(counts, decompressed_size=12 * occupied, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<i4", occupied), dtype=np.int64), np.frombuffer(raw, "<i8", occupied, 4 * occupied)


def _merged(blocks: Iterable[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells in order and their counts, of all blocks together; at most MERGED of them are open at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def add() -> tuple[np.ndarray, np.ndarray]:
        if len(held) == 1:
            return held[0]
        cells, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(cells, kind="stable")
        cells, n = cells[order], n[order]
        start = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        return cells[start], np.add.reduceat(n, start)

    for b in blocks:
        held.append(_opened(*b))
        if len(held) == MERGED:
            held = [add()]
    return add()


def _count(fields: list[str], width: int):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, ["episode_index", "chunk"], 400_000):
            t = first_deliveries(block)
            t = t.filter(t.column("received_at").is_valid())
            if not t.num_rows:
                continue
            day = t.column("received_at").cast(pa.timestamp("us")).cast(pa.date32()).cast(pa.int32()).to_numpy()
            robot = t.column("robot_id").combine_chunks().dictionary_encode()
            robot = robot.chunk(0) if isinstance(robot, pa.ChunkedArray) else robot
            keys, which = np.unique(day.astype(np.int64) * len(robot.dictionary) + robot.indices.to_numpy(), return_inverse=True)
            names, out = robot.dictionary.to_pylist(), []
            for i, f in enumerate(fields):
                x, _ = matrix(t, plain(f), width)
                for j in range(width):
                    at = np.flatnonzero(np.isfinite(x[:, j]))
                    code, n = np.unique((which[at].astype(np.int64) << 24) + cells_of(x[at, j]) + (1 << 23), return_counts=True)
                    source, cell = code >> 24, (code & 0xFF_FFFF) - (1 << 23)
                    start = np.flatnonzero(np.append(True, source[1:] != source[:-1])) if len(source) else []
                    for a, b in zip(start, np.append(start[1:], len(source)), strict=True):
                        k = int(keys[source[a]])
                        out.append((k // len(names), names[k % len(names)], i * width + j, int(n[a:b].sum()), b - a, _packed(cell[a:b], n[a:b])))
            if out:
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                cols = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([cols[0].cast(pa.date32()), *cols[1:]], ["day", "robot_id", "channel", "n", "occupied", "counts"])

    return work


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Key values, cells and counts of each group of blocks sorted by keys."""
    for t in whole_groups(batches, keys, 10_000):
        starts = starts_of(t, keys)
        first = t.select(keys).take(pa.array(starts)).to_pylist()
        counts, occupied = t.column("counts"), t.column("occupied").to_numpy()
        for k, a, b in zip(first, starts, np.append(starts[1:], t.num_rows), strict=True):
            yield k, *_merged((counts[i].as_py(), int(occupied[i])) for i in range(a, b))


def _add(keys: list[str]):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [{**k, "n": int(n.sum()), "occupied": len(n), "counts": _packed(cells, n)} for k, cells, n in _groups(batches, keys)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*(f for f in _KINDS if f.name in keys), *_KINDS[-3:]]))

    return work


def _bisect(percentiles: tuple[float, ...]):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for k, cells, n in _groups(batches, GROUP):
            upto = np.concatenate([[0], np.cumsum(n)])
            rank = np.maximum(1, np.ceil(np.array(percentiles) * upto[-1])).astype(np.int64)
            low, high = np.full(len(rank), cells[0]), np.full(len(rank), cells[-1])
            while (low < high).any():
                middle = (low + high) // 2
                enough = upto[np.searchsorted(cells, middle, "right")] >= rank
                low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
            value, error = cell_middle(low)
            rows += [{**k, "percentile": p, "n": int(upto[-1]), "estimate": float(v), "error_bound": float(e)} for p, v, e in zip(percentiles, value, error, strict=True)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    return work


def day_counts(
    frames: DataFrame, episodes: DataFrame, fields: tuple[str, ...] = ("observation.state", "action"), names: tuple[str, ...] = ("state", "action"), width: int = 7
) -> DataFrame:
    """What is kept per day: one row of day, robot_id, field, joint_index, n, occupied, counts, the counts by cell of the finite values.

    A cell holds the values of one sign, exponent and first BITS bits of the mantissa, so its width follows the values, whatever their
    scale; there are at most 2 ** 22. counts is read with `open_counts`; days, partitions and re-runs are combined with merge_counts. A
    frame delivered twice counts once, on the day of its first delivery. Frames of episodes without robot_id, without received_at,
    episode_index or frame_index, null fields, null and not-finite elements are left out. Empty tables give no row. A robot with a third
    of all rows is counted in place, by chunk; only packed counts are shuffled by robot.
    """
    frames, episodes = exact(frames, "episode_index", "frame_index", *fields, "received_at"), exact(episodes, "episode_index", "robot_id")
    robots = episodes.where("episode_index is not null and robot_id is not null").groupBy("episode_index").agg(F.min("robot_id").alias("robot_id"))
    rows = in_chunks(chunk_rows(attach(frames, robots, "episode_index"), [*fields, "robot_id"], CHUNK), frames)
    blocks = rows.mapInArrow(_count(list(fields), width), _BLOCK)
    name = F.element_at(F.array(*(F.lit(x) for x in names)), F.floor(F.col("channel") / width).cast("int") + 1)
    return merge_counts(blocks.select("day", "robot_id", name.alias("field"), (F.col("channel") % width).cast("long").alias("joint_index"), "n", "occupied", "counts"))


def merge_counts(counts: DataFrame) -> DataFrame:
    """Counts of any days or partitions, in one table, added up: one row per day and group."""
    keys = ["day", *GROUP]
    return counts.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "occupied", "counts").mapInArrow(_add(keys), _KEPT)


def open_counts(counts: DataFrame) -> DataFrame:
    """day, robot_id, field, joint_index, middle, n: the occupied cells, by their middles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, cells, n in _groups(batches, ["day", *GROUP]):
            one = {c: pa.array([v] * len(n), kind) for (c, v), kind in zip(k.items(), (pa.date32(), pa.string(), pa.string(), pa.int64()), strict=True)}
            yield pa.RecordBatch.from_pydict({**one, "middle": cell_middle(cells)[0], "n": n})

    return counts.select("day", *GROUP, "occupied", "counts").mapInArrow(work, "day date, robot_id string, field string, joint_index long, middle double, n long")


def bisect_percentiles(counts: DataFrame, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """robot_id, field, joint_index, percentile, n, estimate, error_bound from day counts.

    Exact bisection: per group and percentile an interval of cells that holds the value of rank ceil(percentile * n). Each pass counts
    the rows up to the middle of each interval and halves it, until it is one cell; the rank is exact, the estimate is that cell's middle,
    at most error_bound (half the cell's width) from the exact value. A group's counts of all days are added up in one task, packed,
    at most 2 ** 22 cells however many rows they count. Groups without values give no row.
    """
    return counts.repartition(*GROUP).sortWithinPartitions(*GROUP).select(*GROUP, "occupied", "counts").mapInArrow(_bisect(tuple(percentiles)), _FOUND)
