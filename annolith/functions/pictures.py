"""Pictures as rows of grey or colour bytes: cropped, turned, mirrored, resized, pasted; written as PNG and BMP files, and read from PNG. No picture library is needed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _array(pixels: bytes, width: int, height: int) -> np.ndarray:
    """height x width x 1 or 3."""
    for channels in (1, 3):
        if width > 0 and height > 0 and len(pixels) == width * height * channels:
            return np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    raise ValueError(f"{len(pixels)} bytes aren't {width} x {height} grey or colour pixels")


def as_png(pixels: bytes, width: int, height: int) -> bytes:
    """A PNG file; each row is written as the difference to the one above, which deflates well."""
    a = _array(pixels, width, height)
    rows = a.reshape(height, -1)
    up = rows - np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    lines = np.hstack([np.full((height, 1), 2, np.uint8), up])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if a.shape[2] == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def as_bmp(pixels: bytes, width: int, height: int) -> bytes:
    """A BMP file of 24 bits a pixel, rows from below, blue first, each padded to four bytes."""
    a = np.broadcast_to(_array(pixels, width, height), (height, width, 3))[::-1, :, ::-1]
    pad = -width * 3 % 4
    body = np.pad(a.reshape(height, width * 3), ((0, 0), (0, pad))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def _of_rows(make: Callable[[bytes, int, int], bytes]):
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pixels, widths, heights in batches:
            yield pd.Series([None if p is None or pd.isna(w) or pd.isna(h) else make(bytes(p), int(w), int(h)) for p, w, h in zip(pixels, widths, heights, strict=True)], dtype=object)

    return run


#: Columns: file bytes of (pixels, width, height); null if one of them is. Pixels of another count end the job.
png = F.pandas_udf(_of_rows(as_png), T.BinaryType())
bmp = F.pandas_udf(_of_rows(as_bmp), T.BinaryType())


# --- pixels --------------------------------------------------------------------------------------
def from_png(data: bytes) -> tuple[bytes, int, int]:
    """Pixels (grey, or colour without its alpha), width and height of a PNG file of 8 bits a channel, not interlaced and without a palette; others raise ValueError."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", b""
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        head, body = (part, body) if kind == b"IHDR" else (head, body + part) if kind == b"IDAT" else (head, body)
        at += 12 + n
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or laced or channels is None:
        raise ValueError("a PNG file of a kind that isn't read")
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out, before = np.zeros((height, width, channels), np.uint8), np.zeros((width, channels), np.int64)
    for y, line in enumerate(lines):
        given = line[1:].reshape(width, channels).astype(np.int64)
        if line[0] == 0:
            row = given
        elif line[0] == 1:
            row = np.cumsum(given, 0) & 255
        elif line[0] == 2:
            row = (given + before) & 255
        else:  # each pixel depends on the one before
            row, left, corner = np.empty_like(given), np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(width):
                up = before[x]
                if line[0] == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (given[x] + guess) & 255, up
                row[x] = left
        out[y], before = row, row
    return out[..., : 1 if channels < 3 else 3].tobytes(), width, height


def cropped(pixels: bytes, width: int, height: int, left: int, top: int, right: int, bottom: int) -> bytes:
    """The part between two columns and two rows; what lies outside the picture is black."""
    a = _array(pixels, width, height)
    out = np.zeros((max(0, bottom - top), max(0, right - left), a.shape[2]), np.uint8)
    y0, y1, x0, x1 = max(0, top), min(height, bottom), max(0, left), min(width, right)
    if y1 > y0 and x1 > x0:
        out[y0 - top : y1 - top, x0 - left : x1 - left] = a[y0:y1, x0:x1]
    return out.tobytes()


def turned(pixels: bytes, width: int, height: int, angle: int, mirror: bool = False) -> bytes:
    """Mirrored (left and right change), if asked, then turned clockwise by 0, 90, 180 or 270 degrees."""
    a = _array(pixels, width, height)
    a = a[:, ::-1] if mirror else a
    if angle % 90:
        raise ValueError(f"not a right angle: {angle}")
    return np.ascontiguousarray(np.rot90(a, -(angle // 90) % 4)).tobytes()


def resized(pixels: bytes, width: int, height: int, new_width: int, new_height: int) -> bytes:
    """In another size: each new pixel is the mean of the area that it covers, or lies between pixels (linear) where the picture grows."""
    a = _array(pixels, width, height).astype(np.float64)
    for axis, (old, new) in enumerate(((height, new_height), (width, new_width))):
        if old == new:
            continue
        if new < old:
            edges = np.arange(new + 1) * old / new
            sums = np.concatenate([np.zeros_like(a.take([0], axis)), np.cumsum(a, axis)], axis)
            low = np.minimum(edges.astype(int), old - 1)
            part = edges - low
            shape = [-1 if k == axis else 1 for k in range(3)]
            at = sums.take(low, axis) + part.reshape(shape) * a.take(low, axis)
            a = np.diff(at, axis=axis) * (new / old)
        else:
            at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
            low = np.minimum(at.astype(int), max(0, old - 2))
            part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
            a = a.take(low, axis) * (1 - part) + a.take(np.minimum(low + 1, old - 1), axis) * part
    return np.clip(np.rint(a), 0, 255).astype(np.uint8).tobytes()


def pasted(canvas: bytes, width: int, height: int, tile: bytes, tile_width: int, tile_height: int, x: int, y: int) -> bytes:
    """A canvas with a tile over it; what lies outside is cut off. Grey on colour becomes colour."""
    a, t = _array(canvas, width, height).copy(), _array(tile, tile_width, tile_height)
    if t.shape[2] > a.shape[2]:
        raise ValueError("a colour tile on a grey canvas")
    y0, y1, x0, x1 = max(0, y), min(height, y + tile_height), max(0, x), min(width, x + tile_width)
    if y1 > y0 and x1 > x0:
        a[y0:y1, x0:x1] = t[y0 - y : y1 - y, x0 - x : x1 - x]
    return a.tobytes()


def _rowwise(work: Callable[..., bytes]):
    """A column of a function of pixels and numbers: null if one of them is."""

    @F.pandas_udf(T.BinaryType())
    def column(*given: pd.Series) -> pd.Series:
        rows = zip(*given, strict=True)
        return pd.Series([None if any(v is None or (not isinstance(v, (bytes, bytearray)) and pd.isna(v)) for v in r) else work(*[bytes(v) if isinstance(v, (bytes, bytearray)) else v.item() if hasattr(v, "item") else v for v in r]) for r in rows], dtype=object)

    return column


crop = _rowwise(lambda pixels, *n: cropped(pixels, *map(int, n)))
turn = _rowwise(lambda pixels, w, h, angle, mirror: turned(pixels, int(w), int(h), int(angle), bool(mirror)))
resize = _rowwise(lambda pixels, *n: resized(pixels, *map(int, n)))
paste = _rowwise(lambda canvas, w, h, tile, *n: pasted(canvas, int(w), int(h), tile, *map(int, n)))


# --- overlays --------------------------------------------------------------------------------------
# Colours of boxes, edges and points.
BOX_COLOUR, EDGE_COLOUR, POINT_COLOUR = (255, 200, 0), (0, 200, 255), (255, 60, 60)


def _line(a: np.ndarray, x1: float, y1: float, x2: float, y2: float, colour: tuple[int, int, int], thick: int) -> None:
    """Every pixel column or row between two places, whichever are more."""
    n = int(max(abs(x2 - x1), abs(y2 - y1))) + 1
    xs, ys = np.rint(np.linspace(x1, x2, n + 1)).astype(int), np.rint(np.linspace(y1, y2, n + 1)).astype(int)
    reach = range(-(thick // 2), thick - thick // 2)
    for dx in reach:
        for dy in reach:
            x, y = xs + dx, ys + dy
            inside = (x >= 0) & (x < a.shape[1]) & (y >= 0) & (y < a.shape[0])
            a[y[inside], x[inside]] = colour


def overlaid(pixels: bytes, width: int, height: int, boxes: list, edges: list, points: list, thick: int = 2, radius: int = 3) -> bytes:
    """Colour pixels of a picture with boxes (cx, cy, w, h), edges (x1, y1, x2, y2) and points (x, y) over it, in shares of its size; what lies outside is cut off."""
    a = np.broadcast_to(_array(pixels, width, height), (height, width, 3)).copy()
    for b in boxes:
        left, top, right, bottom = ((b["cx"] - b["w"] / 2) * width, (b["cy"] - b["h"] / 2) * height, (b["cx"] + b["w"] / 2) * width, (b["cy"] + b["h"] / 2) * height)
        for line in ((left, top, right, top), (right, top, right, bottom), (right, bottom, left, bottom), (left, bottom, left, top)):
            _line(a, *line, BOX_COLOUR, thick)
    for e in edges:
        _line(a, e["x1"] * width, e["y1"] * height, e["x2"] * width, e["y2"] * height, EDGE_COLOUR, thick)
    y, x = np.mgrid[0:height, 0:width]
    for p in points:
        cx, cy = p["x"] * width, p["y"] * height
        x0, x1, y0, y1 = (int(max(0, v)) for v in (cx - radius, cx + radius + 1, cy - radius, cy + radius + 1))
        near = (x[y0:y1, x0:x1] - cx) ** 2 + (y[y0:y1, x0:x1] - cy) ** 2 <= radius**2
        a[y0:y1, x0:x1][near] = POINT_COLOUR
    return a.tobytes()


@F.pandas_udf(T.BinaryType())
def overlay(pixels: pd.Series, width: pd.Series, height: pd.Series, boxes: pd.Series, edges: pd.Series, points: pd.Series) -> pd.Series:
    """:func:`overlaid` as a column; null if the picture is null, nothing is drawn for null lists. For edges see ``keypoints.edges``."""
    plain = lambda items: [] if items is None else [i if isinstance(i, dict) else i.asDict() for i in items]
    return pd.Series([None if p is None else overlaid(bytes(p), int(w), int(h), plain(b), plain(e), plain(k)) for p, w, h, b, e, k in zip(pixels, width, height, boxes, edges, points, strict=True)], dtype=object)
