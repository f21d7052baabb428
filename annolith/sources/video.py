"""A Spark data source for frames of motion-JPEG videos (AVI files): only the frames that are wanted are read.

``spark.dataSource.register(VideoFrames)``, then ``spark.read.format("videoframes").option("skip", "4").load(path)``: one row per frame with its
file, number (from 1), label (the number, padded to the width of the file's count of frames), count and JPEG bytes.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import opened


def _chunks(f: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, place and size of what lies between two places; lists have their kind as a name."""
    while at + 8 <= end:
        f.seek(at)
        head = f.read(12)
        if len(head) < 8:
            return
        name, (n,) = head[:4], struct.unpack("<I", head[4:8])
        if name in (b"RIFF", b"LIST"):
            yield head[8:12], at + 12, n - 4
        else:
            yield name, at + 8, n
        at += 8 + n + n % 2


def frame_places(f: BinaryIO, size: int) -> list[tuple[int, int]]:
    """Place and size of each frame of the first video stream, by the file's index; without one, by a walk over its chunks.

    Raises ValueError for another kind of file. Frames of no bytes repeat the one before, as the format has it.
    """
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    parts = {name: (at, n) for name, at, n in _chunks(f, 12, min(size, 8 + struct.unpack("<I", head[4:8])[0]))}
    if b"movi" not in parts:
        raise ValueError("the file has no frames")
    movi, length = parts[b"movi"]
    is_frame = lambda name: name[2:] in (b"dc", b"db") and name[:2] == b"00"
    found = []
    if b"idx1" in parts:
        at, n = parts[b"idx1"]
        f.seek(at)
        index = f.read(n)
        entries = [struct.unpack_from("<4sIII", index, k) for k in range(0, len(index) - 15, 16)]
        frames = [(offset, count) for name, _, offset, count in entries if is_frame(name)]
        if frames:
            # Places are counted from the list's kind, or from the file's start.
            base = movi - 4
            f.seek(base + frames[0][0])
            if not is_frame(f.read(4)):
                base = 0
            found = [(base + offset + 8, count) for offset, count in frames]
    else:
        stack = [(movi, min(size, movi + length))]
        while stack:
            for name, at, n in _chunks(f, *stack.pop()):
                if name == b"rec ":
                    stack.append((at, at + n))
                elif is_frame(name):
                    found.append((at, n))
        found.sort()
    out: list[tuple[int, int]] = []
    for place in found:
        out.append(place if place[1] or not out else out[-1])
    return out


class _Part(InputPartition):
    def __init__(self, path: str, frames: list[tuple[int, int, int]], count: int):
        self.path, self.frames, self.count = path, frames, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.skip, self.bytes = options["path"], int(options.get("skip", 0)), int(options.get("partitionbytes", 64 << 20))
        if self.skip < 0 or self.bytes <= 0:
            raise ValueError("skip must be at least 0 and partitionBytes positive")

    def partitions(self) -> list[_Part]:
        """Runs of wanted frames of a file, of about ``partitionBytes`` each: the driver reads indexes alone."""
        store, path = opened.at(self.path)
        kind = store.get_file_info(path).type
        if kind == fs.FileType.File:
            names = [self.path]
        else:
            folder, pattern = (path, "*") if kind == fs.FileType.Directory else posixpath.split(path)
            found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            base = self.path if kind == fs.FileType.Directory else posixpath.dirname(self.path)
            names = [f"{base.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern) and f.extension.lower() == "avi"]
        out = []
        for name in names:
            store, path = opened.at(name)
            with store.open_input_file(path) as f:
                places = frame_places(f, store.get_file_info(path).size)
            run, held = [], 0
            for k in range(0, len(places), self.skip + 1):
                if run and held + places[k][1] > self.bytes:
                    out.append(_Part(name, run, len(places)))
                    run, held = [], 0
                run.append((k + 1, *places[k]))
                held += places[k][1]
            if run:
                out.append(_Part(name, run, len(places)))
        return out

    def read(self, partition: _Part | None):
        if not isinstance(partition, _Part):  # no files
            return
        store, path = opened.at(partition.path)
        width = len(str(partition.count))
        with store.open_input_file(path) as f:
            for number, at, n in partition.frames:
                f.seek(at)
                data = f.read(n)
                if len(data) < n:
                    raise ValueError(f"frame {number} of {partition.path} is cut short")
                yield partition.path, number, str(number).zfill(width), partition.count, data


class VideoFrames(DataSource):
    """Options: ``skip``: frames left out after each; ``partitionBytes``: size of a task's frames."""

    @classmethod
    def name(cls) -> str:
        return "videoframes"

    def schema(self) -> str:
        return "file string, number int, label string, frames int, jpeg binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
