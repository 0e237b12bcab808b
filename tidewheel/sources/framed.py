"""Files of length-prefixed messages: a JSON header, then raw arrays. Read as a Spark data source, written from rows.

A message is 8 bytes (big-endian) with the header's length, the header, and the arrays' bytes one after another.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from typing import Any, BinaryIO

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_LENGTH = struct.Struct(">Q")
#: Largest header, and largest sum of a message's arrays.
MOST_HEADER, MOST_ARRAYS = 64 << 20, 1 << 30
_MARK = "__array__"


def write_message(to: BinaryIO, message: dict[str, Any]) -> None:
    arrays: list[bytes] = []

    def plain(x: Any) -> Any:
        if isinstance(x, np.ndarray):
            arrays.append(np.ascontiguousarray(x).tobytes())
            return {_MARK: len(arrays) - 1, "dtype": x.dtype.str, "shape": list(x.shape)}
        if isinstance(x, np.generic):
            return x.item()
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x

    body = plain(message)
    head = json.dumps({"body": body, "sizes": [len(a) for a in arrays]}, separators=(",", ":"), ensure_ascii=False).encode()
    to.write(_LENGTH.pack(len(head)) + head + b"".join(arrays))


def _exactly(source: BinaryIO, n: int) -> bytes:
    parts = []
    while n:
        if not (part := source.read(n)):
            raise EOFError("the stream ends within a message")
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def read_message(source: BinaryIO) -> dict[str, Any] | None:
    """The next message; None at the end."""
    if not (begin := source.read(1)):
        return None
    (n,) = _LENGTH.unpack(begin + _exactly(source, 7))
    if n > MOST_HEADER:
        raise ValueError("header too long: no message begins here")
    head = json.loads(_exactly(source, n))
    sizes = [int(s) for s in head["sizes"]]
    if any(s < 0 for s in sizes) or sum(sizes) > MOST_ARRAYS:
        raise ValueError("arrays too large")
    arrays = [_exactly(source, s) for s in sizes]

    def full(x: Any) -> Any:
        if isinstance(x, dict):
            if _MARK in x:
                return np.frombuffer(arrays[int(x[_MARK])], np.dtype(x["dtype"])).reshape([int(s) for s in x["shape"]])
            return {k: full(v) for k, v in x.items()}
        return [full(v) for v in x] if isinstance(x, list) else x

    out = full(head["body"])
    if not isinstance(out, dict):
        raise ValueError("a message is an object")
    return out


def read_messages(source: BinaryIO) -> Iterator[dict[str, Any]]:
    while (m := read_message(source)) is not None:
        yield m


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for k, m in enumerate(read_messages(io.BufferedReader(f))):
                arrays = {name: x for name, x in m.items() if isinstance(x, np.ndarray)}
                rest = {name: x for name, x in m.items() if name not in arrays}
                yield partition.path, k, json.dumps(rest, ensure_ascii=False), {name: x.astype(float).ravel().tolist() for name, x in arrays.items()}


class FramedSource(DataSource):
    """spark.read.format("framed").option("path", pattern).load(): file, position, body (JSON), arrays (name to numbers); a partition per file."""

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return "file string, position long, body string, arrays map<string,array<double>>"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        import glob

        return _Reader(sorted(glob.glob(self.options["path"])))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramedSource)
