"""Framed fact streams as a data source: ``spark.read.format("fact_frames").load(path)``.

A frame is a four-byte big-endian length and a JSON object of at most ``MOST_BYTES``.  Planning walks the lengths alone and cuts a file
between frames, so large files are read by many tasks.  Register it with :func:`register`.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: the longest frame that is allowed.
MOST_BYTES = 64 << 20
SCHEMA = "file string, frame long, type string, group string, paths array<string>, path string, stage string, completed int, total int, payload string"
_LENGTH = struct.Struct(">I")


class DamagedFrame(ValueError):
    """A frame that is cut off, too long, or no JSON object."""


@dataclass
class Frames(InputPartition):
    """Frames ``first`` to ``first`` + ``count`` - 1 of a file, from byte ``start`` on."""

    uri: str
    start: int
    first: int
    count: int


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def files_of(uri: str) -> list[str]:
    """The files of a path, in order; those that start with a dot or an underscore are left out."""
    system, path = _open(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.is_file:
        return [uri]
    found = system.get_file_info(fs.FileSelector(path))
    prefix = uri[: len(uri) - len(path.lstrip("/"))] if "://" in uri else ""
    return sorted(prefix + (f.path.lstrip("/") if prefix else f.path) for f in found if f.is_file and f.base_name[0] not in "._")


def plan(uri: str, target: int) -> list[Frames]:
    """Runs of whole frames of about ``target`` bytes; only lengths are read."""
    system, path = _open(uri)
    size, out = system.get_file_info(path).size, []
    with system.open_input_file(path) as f:
        at, start, first, n = 0, 0, 0, 0
        while at < size:
            f.seek(at)
            head = f.read(4)
            length = _LENGTH.unpack(head)[0] if len(head) == 4 else -1
            if length < 0 or length > MOST_BYTES or at + 4 + length > size:
                raise DamagedFrame(f"{uri}: frame {first + n} at byte {at} is cut off or longer than {MOST_BYTES} bytes")
            at, n = at + 4 + length, n + 1
            if at - start >= target or at == size:
                out.append(Frames(uri, start, first, n))
                start, first, n = at, first + n, 0
    return out


def read_frames(part: Frames) -> Iterator[tuple[int, dict]]:
    system, path = _open(part.uri)
    with system.open_input_file(path) as f:
        f.seek(part.start)
        for frame in range(part.first, part.first + part.count):
            head = f.read(4)
            body = f.read(_LENGTH.unpack(head)[0]) if len(head) == 4 else b""
            try:
                value = json.loads(body)
            except ValueError as e:
                raise DamagedFrame(f"{part.uri}: frame {frame} is no JSON") from e
            if not isinstance(value, dict) or not isinstance(value.get("type"), str):
                raise DamagedFrame(f"{part.uri}: frame {frame} is no object with a type")
            yield frame, value


class _Reader(DataSourceReader):
    def __init__(self, path: str, target: int) -> None:
        self.path, self.target = path, target

    def partitions(self) -> list[InputPartition]:
        return [p for uri in files_of(self.path) for p in plan(uri, self.target)] or [Frames("", 0, 0, 0)]

    def read(self, part: Frames) -> Iterator[tuple]:
        if not part.count:
            return
        name = part.uri.rsplit("/", 1)[-1]
        for frame, v in read_frames(part):
            payload = v.get("payload")
            text = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
            paths = v.get("paths")
            yield (name, frame, v["type"], v.get("group"), list(paths) if paths is not None else None, v.get("path"), v.get("stage"), v.get("completed"), v.get("total"), text)


class FactFrames(DataSource):
    """Options: ``path``, a file or a folder, and ``targetBytes``, about how many bytes a task reads (16 MB)."""

    @classmethod
    def name(cls) -> str:
        return "fact_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("targetBytes", 16 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FactFrames)


def write(path: str, frames: list[dict]) -> None:
    """A file of frames, as an analyzer writes it."""
    system, target = _open(path)
    with system.open_output_stream(target) as f:
        for v in frames:
            body = json.dumps(v).encode()
            f.write(_LENGTH.pack(len(body)) + body)
