"""A Spark data source for TFRecord files of tf.train.Example messages.

``spark.dataSource.register(TFRecordSource)``, then ``spark.read.format("tfrecord").load(path)``:
one row per record with its file, number, byte features (``features``: name to the first value), and all values of each feature by
kind (``bytes``, ``floats``, ``ints``). Option ``verify``: ``true``
checks each payload's sum.
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

_POLY = 0x82F63B78
_TABLE = []
for _i in range(256):
    for _ in range(8):
        _i = (_i >> 1) ^ (_POLY if _i & 1 else 0)
    _TABLE.append(_i)


def masked_crc(data: bytes) -> int:
    """CRC-32C, rotated and shifted as record files have it."""
    c = 0xFFFFFFFF
    for b in data:
        c = _TABLE[(c ^ b) & 255] ^ (c >> 8)
    c ^= 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def records(data: BinaryIO, verify: bool = False) -> Iterator[bytes]:
    """Payloads of an open record file. A damaged length and a file that is cut short end with an error.

    With ``verify`` the payloads' sums are checked as well, byte by byte.
    """
    while head := data.read(12):
        if len(head) < 12:
            raise ValueError("the file is cut short")
        (n,), (crc,) = struct.unpack("<Q", head[:8]), struct.unpack("<I", head[8:])
        if masked_crc(head[:8]) != crc:
            raise ValueError("a record's length is damaged")
        payload, tail = data.read(n), data.read(4)
        if len(payload) < n or len(tail) < 4:
            raise ValueError("the file is cut short")
        if verify and masked_crc(payload) != struct.unpack("<I", tail)[0]:
            raise ValueError("a record is damaged")
        yield payload


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return n, at
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, bytes]]:
    """Length-delimited fields of a message; others are skipped."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        kind = tag & 7
        if kind == 2:
            n, at = _varint(b, at)
            yield tag >> 3, b[at : at + n]
            at += n
        elif kind == 0:
            _, at = _varint(b, at)
        else:
            at += 8 if kind == 1 else 4


def _numbers(kind: int, b: bytes) -> Iterator[float | int]:
    """Values of a list of floats (2) or of whole numbers (3), packed or not."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        if tag & 7 == 2:
            n, at = _varint(b, at)
            part, at = b[at : at + n], at + n
        elif kind == 2:
            part, at = b[at : at + 4], at + 4
        else:
            begin = at
            _, at = _varint(b, at)
            part = b[begin:at]
        if kind == 2:
            yield from struct.unpack(f"<{len(part) // 4}f", part)
            continue
        place = 0
        while place < len(part):
            n, place = _varint(part, place)
            yield n - (1 << 64) if n >> 63 else n


def features(example: bytes) -> tuple[dict[str, list[bytes]], dict[str, list[float]], dict[str, list[int]]]:
    """All values of an Example's byte, float and integer features, by name. A name without values of a kind isn't among that kind."""
    out: tuple[dict, dict, dict] = ({}, {}, {})
    for k, entries in _fields(example):
        for j, entry in _fields(entries) if k == 1 else ():
            parts = dict(_fields(entry)) if j == 1 else {}
            if 1 not in parts or 2 not in parts:
                continue
            for kind, values in _fields(parts[2]):
                got = [v for f, v in _fields(values) if f == 1] if kind == 1 else list(_numbers(kind, values)) if kind in (2, 3) else []
                if got:
                    out[kind - 1][parts[1].decode()] = got
    return out


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.verify = options["path"], options.get("verify", "false") == "true"

    def partitions(self) -> list[_Part]:
        """One for each file of a folder, of a pattern in a folder, or a single file."""
        store, path = opened.at(self.path)
        kind = store.get_file_info(path).type
        if kind == fs.FileType.File:
            return [_Part(self.path)]
        folder, pattern = (path, "*") if kind == fs.FileType.Directory else posixpath.split(path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))
        base = self.path if kind == fs.FileType.Directory else posixpath.dirname(self.path)
        return [_Part(f"{base.rstrip('/')}/{n}") for n in names]

    def read(self, partition: _Part | None):
        if partition is None:  # no files
            return
        store, path = opened.at(partition.path)
        with store.open_input_stream(path) as f:
            for i, payload in enumerate(records(f, self.verify)):
                texts, floats, ints = features(payload)
                yield partition.path, i, {k: v[0] for k, v in texts.items()}, texts, floats, ints


class TFRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return "file string, record long, features map<string, binary>, bytes map<string, array<binary>>, floats map<string, array<float>>, ints map<string, array<long>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
