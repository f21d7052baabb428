"""Files opened inside tasks, on a local disk or in an object store, by the addresses that Spark lists."""

from __future__ import annotations

import re
import struct
from typing import BinaryIO

from pyarrow import fs


def at(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address. A plain path and file:/ are the machine's own disk, s3a: is s3:."""
    plain = re.sub(r"^file:/+", "/", address)
    if "://" not in plain:
        return fs.LocalFileSystem(), plain
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", plain))


def _jpeg(f: BinaryIO) -> tuple[int, int] | None:
    """Walk from mark to mark; only their heads are read."""
    place = 2
    while True:
        f.seek(place)
        head = f.read(9)
        if len(head) < 9 or head[0] != 0xFF:
            return None
        kind = head[1]
        if kind == 0xFF or kind == 1 or 0xD0 <= kind <= 0xD9:
            place += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", head[5:9])
            return w, h
        place += 2 + struct.unpack(">H", head[2:4])[0]


def _tiff(f: BinaryIO, head: bytes) -> tuple[int, int] | None:
    """Width and height (entries 256 and 257) of the first directory."""
    end = "<" if head[:2] == b"II" else ">"
    f.seek(struct.unpack(end + "I", head[4:8])[0])
    (n,) = struct.unpack(end + "H", f.read(2))
    entries, got = f.read(12 * n), {}
    for k in range(len(entries) // 12):
        tag, kind = struct.unpack(end + "HH", entries[12 * k : 12 * k + 4])
        value = entries[12 * k + 8 : 12 * k + 12]
        if tag in (256, 257) and kind in (3, 4):
            got[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
    return (got[256], got[257]) if len(got) == 2 else None


def _webp(head: bytes) -> tuple[int, int] | None:
    kind = head[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
    if kind == b"VP8L" and head[20] == 0x2F:
        bits = int.from_bytes(head[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and head[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", head[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def image_size(f: BinaryIO) -> tuple[int, int] | None:
    """Width and height of an open PNG, BMP, GIF, JPEG, TIFF or WebP file; None if it is another or damaged.

    At most some dozens of bytes are read, and the heads of a JPEG's segments, whatever the file's length.
    """
    head = f.read(32)
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", head[16:24])
        if head[:2] == b"BM":
            w, h = struct.unpack("<ii", head[18:26])
            return w, abs(h)
        if head[:4] == b"GIF8":
            return struct.unpack("<HH", head[6:10])
        if head[:2] == b"\xff\xd8":
            return _jpeg(f)
        if head[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(f, head)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
            return _webp(head)
    except struct.error:
        pass
    return None
