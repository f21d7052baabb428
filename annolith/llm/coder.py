"""Token ids in files, by an adaptive context-mixing range coder.

A file is a table of segments; a segment holds the ids of some documents, cut into blocks. A
block is coded by itself: models begin anew, and it carries its checksum, so with the segment's head it can be read
alone. The head holds what all blocks of the segment begin with:

* order 0: how frequent each id is, and
* order 1: how frequent it is after each class of ids. Classes are learned from the segment, so that what follows the ids of
  a class is alike (the head names each id's class).

While a block is coded, two more predictions adapt: the id that followed the id before (order 1) and the two before (order 2), each with
a confidence. Where one is confident enough, their hit rates and the id's frequency in its class are mixed by weights that learn (logistic mixing)
to the chance that the prediction holds, which one binary decision codes. All other ids are coded by their frequency in
the class of the id before; the first of a block by order 0.

All blocks of a segment advance together, one id at a time, as columns of arrays. Coding uses only whole
numbers, so reader and writer agree on every machine.

Segment layout (little-endian): ``AMR4``, documents, blocks, bytes of the head (u32 each); per document its id
(i64), whether it has one (u8), its ids (u32); per block its ids, words of code, CRC-32 (u32
each); the head; the blocks' code words (u16). The head: distinct ids, classes, length (u32 each), then deflated the ids (gaps, u32),
their classes (u8), and per class, then for order 0, each id's frequency on a scale of quarter octaves (u8; 0: none).

Defined results
  null text            an empty text: the end id alone
  null or repeated id  documents are ordered by id (null first), then by text
  empty table          no segments, no rows
  a damaged block      ends the job with an error
  ids of any 32 bits   are coded
  more columns         are ignored, whatever their names
"""

from __future__ import annotations

import itertools
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefix, storage, tokens

BLOCK = 4096
SEGMENT_BYTES = 32_000_000
MAGIC = b"AMR4"
SLOTS = 2048  # predictions per order
CLASSES = 32
AT_ONCE = 128  # steps of all blocks whose slots and parts are worked out at once
TOGETHER = 12_000_000  # ids of segments that are read side by side
ROUNDS = 8  # of learning classes
#: Pairs of ids are counted in a table of at most this size; if there could be more, they are sorted.
PAIR_TABLE = 1 << 23
BITS = 20  # of a coding step
TOTAL = 1 << BITS
LEAST_RANGE = np.uint64(1 << 32)
MASK = np.uint64((1 << 48) - 1)
LEAST = np.uint64(1 << 16)  # below it, two words go
STEP, U16, U32 = np.uint64(BITS), np.uint64(16), np.uint64(32)
HASH1, HASH2 = np.uint16(40503), np.uint16(60493)

#: Logistic function of x / 256 in 4096ths, for x from -2047 to 2047.
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
#: Its inverse.
STRETCH = np.array([max(-2047, min(2047, round(256 * math.log(max(p, 1) / (4096 - p))))) for p in range(4096)], np.int32)
#: Frequencies of the head's scale.
SCALE = np.array([0, *[round(2 ** (c / 4)) for c in range(81)]], np.int64)


# --- what a segment's blocks begin with ----------------------------------------------------------
def classes(x: np.ndarray, v: int) -> np.ndarray:
    """A class for each of ``v`` ids: ids after which the same ids come are together. From all pairs in ``x``."""
    n = len(x) - 1
    k = int(min(CLASSES, max(1, n // 3000)))
    if k == 1:
        return np.zeros(v, np.uint8)
    pairs = x[:-1].astype(np.uint32 if v * v <= 1 << 32 else np.int64)
    pairs *= v
    pairs += x[1:].astype(pairs.dtype)
    if v * v <= min(n, PAIR_TABLE):  # faster than sorting
        count = np.bincount(pairs, minlength=v * v)
        pairs = np.flatnonzero(count)
        count = count.take(pairs)
    else:
        pairs.sort()
        at = np.flatnonzero(np.diff(pairs, prepend=pairs[0] ^ 1))
        pairs, count = pairs[at].astype(np.int64), np.diff(at, append=n)
    first, second = pairs // v, pairs % v
    begin = np.flatnonzero(np.diff(first, prepend=-1))
    count = count.astype(np.float64)
    share = np.bincount(x[1:], minlength=v) / n
    of = np.random.default_rng(0).integers(0, k, v)
    score = np.zeros((k, v))
    for _ in range(ROUNDS):
        table = np.bincount(of.take(first) * v + second, count, k * v).reshape(k, v)
        log = np.log2((table + share + 1e-9) / (table.sum(1, keepdims=True) + 1.0))
        for c in range(k):
            score[c, first[begin]] = np.add.reduceat(log[c].take(second) * count, begin)
        new = score.argmax(0)
        if (new == of).all():
            break
        of = new
    return of.astype(np.uint8)


def _whole(codes: np.ndarray) -> np.ndarray:
    """Sizes of the ids' parts of the range in one table: they sum to TOTAL (none, if no id has a frequency)."""
    weight = SCALE[codes]
    n, sum_ = int((codes > 0).sum()), int(weight.sum())
    if not n:
        return weight
    size = np.where(codes > 0, 1 + weight * (TOTAL - n) // sum_, 0)
    size[int(size.argmax())] += TOTAL - int(size.sum())
    return size


@dataclass
class Head:
    """ids (sorted), their classes, and codes (classes + 1, ids): frequencies after each class, then in all."""

    ids: np.ndarray
    of: np.ndarray
    codes: np.ndarray

    @classmethod
    def of_ids(cls, ids: np.ndarray, block: int) -> tuple[Head, np.ndarray]:
        """The head of a segment, and its ids as places in ``ids``."""
        if ids.max() < 1 << 22:  # faster than sorting
            known = np.flatnonzero(np.bincount(ids))
            place = np.zeros(int(known[-1]) + 1, np.int32)
            place[known] = np.arange(len(known))
            x = place.take(ids)
        else:
            known, x = np.unique(ids, return_inverse=True)
            x = x.astype(np.int32)
        v = len(known)
        of = classes(x, v)
        k = int(of.max(initial=0)) + 1
        table = np.empty(len(x), np.int32)
        table[1:] = (of.astype(np.int32) * v).take(x[:-1])
        table[::block] = k * v
        table += x
        count = np.bincount(table, minlength=(k + 1) * v).reshape(k + 1, v)
        count[k] = np.bincount(x, minlength=v)
        scaled = count * (1 << 20) / np.maximum(1, count.sum(1, keepdims=True))
        codes = np.where(count > 0, 1 + np.clip(np.rint(4 * np.log2(np.maximum(scaled, 1))), 0, 80), 0)
        return cls(known.astype(np.uint32), of, codes.astype(np.uint8)), x

    def bytes(self) -> bytes:
        gaps = np.diff(self.ids, prepend=np.uint32(0)).astype("<u4")
        return struct.pack("<III", len(self.ids), len(self.codes) - 1, 0) + zlib.compress(gaps.tobytes() + self.of.tobytes() + self.codes.tobytes(), 6)

    @classmethod
    def of_bytes(cls, data: bytes) -> Head:
        v, k, _ = struct.unpack_from("<III", data)
        flat = np.frombuffer(zlib.decompress(data[12:]), np.uint8)
        return cls(np.cumsum(flat[: 4 * v].view("<u4"), dtype=np.uint32), flat[4 * v : 5 * v], flat[5 * v :].reshape(k + 1, v))

    def __post_init__(self):
        self.size = np.stack([_whole(c) for c in self.codes]) if len(self.codes) else np.zeros((1, 0), np.int64)
        start = np.cumsum(self.size, 1) - self.size
        self.start, self.flat = start.ravel().astype(np.uint64), self.size.ravel().astype(np.uint64)
        #: What a frequency says in the mix.
        self.common = STRETCH.take(np.minimum(self.size.ravel() >> (BITS - 12), 4095))
        v = len(self.ids)
        #: Of each id the table of its class and where that begins; then of order 0. Ids' places begin at ``origin``.
        self.table_of, self.row_of = self.of.astype(np.int64), self.of.astype(np.int64) * v
        self.table_first, self.first, self.origin = np.array([len(self.codes) - 1]), np.array([(len(self.codes) - 1) * v]), np.zeros(1, np.int64)


class _Joined:
    """The tables of many heads, one after the other."""

    def __init__(self, heads: list[Head]):
        before = lambda sizes: np.cumsum([0, *sizes])[:-1]
        tables, rows = before([len(h.codes) for h in heads]), before([len(h.flat) for h in heads])
        self.ids = np.concatenate([h.ids for h in heads])
        self.origin = before([len(h.ids) for h in heads])
        self.widest = max(len(h.ids) for h in heads)
        self.start, self.flat, self.common = (np.concatenate([getattr(h, name) for h in heads]) for name in ("start", "flat", "common"))
        self.table_of = np.concatenate([h.table_of + t for h, t in zip(heads, tables, strict=True)])
        self.row_of = np.concatenate([h.row_of + r for h, r in zip(heads, rows, strict=True)])
        self.table_first = np.concatenate([h.table_first + t for h, t in zip(heads, tables, strict=True)])
        self.first = np.concatenate([h.first + r for h, r in zip(heads, rows, strict=True)])
        # Entries of all tables in order, for the way back: which entry each 64th place lies in.
        self.entry = np.flatnonzero(self.flat)
        table = np.repeat(np.arange(sum(len(h.codes) for h in heads)), np.repeat([len(h.ids) for h in heads], [len(h.codes) for h in heads]))
        self.key = np.append((table[self.entry] << BITS) + self.start[self.entry].astype(np.int64), np.iinfo(np.int64).max)
        self.near = np.searchsorted(self.key, np.arange(sum(len(h.codes) for h in heads) << (BITS - 6)) << 6, "right").astype(np.int32) - 1

    def find(self, at: np.ndarray) -> np.ndarray:
        """The entries that places (table, then 2 ** BITS) lie in."""
        found = self.near.take(at >> 6)
        more = np.flatnonzero(self.key.take(found + 1) <= at)
        if len(more):
            found[more] = np.searchsorted(self.key, at.take(more), "right") - 1
        return self.entry.take(found)


# --- what adapts in a block ------------------------------------------------------------------------
class _Models:
    """The state of ``n`` blocks, as flat arrays of whole numbers; a cell is an id's place (upper bits) and its confidence (4 bits).

    All blocks are worked out side by side, those without a prediction too: that costs less than to pick the others.
    """

    def __init__(self, n: int, head: Head | _Joined, part: np.ndarray | None = None):
        self.head, self.row_of = head, head.row_of
        part = np.zeros(n, np.int64) if part is None else part  # which of the heads a block has
        self.origin = None if len(head.first) == 1 else head.origin[part]
        # Of order 1, then of order 2. Small cells stay near.
        self.cells = np.zeros(2 * n * SLOTS, np.uint16 if getattr(head, "widest", len(head.ids)) <= 1 << 12 else np.int32)
        # A slot's cells of all blocks are neighbours, so those in frequent use take few pages.
        self.n, self.base = n, np.arange(n) + np.array([[0], [SLOTS * n]])
        # Chances by order and confidence, and whether the other order says the same.
        self.hit = np.tile((np.arange(64) % 16 * 200 + 300).astype(np.int32), n)
        self.states = np.arange(n) * 64 + np.array([[0], [32]])
        self.weight = np.repeat(np.array([[20000], [30000], [16000]], np.int32), n, 1)
        self.prev, self.prev2 = np.zeros(n, np.uint16), np.zeros(n, np.uint16)  # the lower bits, which the slots are made of
        self.row = head.first[part]  # the table in use: order 0 at first

    def slots(self, prev: np.ndarray, prev2: np.ndarray) -> np.ndarray:
        """Where the cells lie, order 1 and 2 in the last but one dimension, after these ids' lower bits."""
        slot = np.empty((*prev.shape[:-1], 2, prev.shape[-1]), np.uint16)
        np.multiply(prev, HASH1, out=slot[..., 0, :])
        np.multiply(prev2, HASH2, out=slot[..., 1, :])
        slot[..., 1, :] += slot[..., 0, :]
        slot >>= 4
        slot &= SLOTS - 1
        at = np.multiply(slot, self.n, dtype=np.int64)
        at += self.base[:, : prev.shape[-1]]
        return at

    def look(self, k: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each of the first k blocks the predicted place, and the chance in 2 ** BITS that it's right: 0, if there is no prediction.

        ``at``: the cells' places, if they are known.
        """
        self.at = self.slots(self.prev[:k], self.prev2[:k]) if at is None else at
        self.cell = cell = self.cells.take(self.at).astype(np.int32, copy=False)
        self.sure = sure = cell & 15
        ids = cell >> 4
        by_two = sure[1] > 0
        guess = np.where(by_two, ids[1], ids[0])
        state = np.empty((2, k), np.int32)
        np.multiply(sure[0], ids[0] == guess, out=state[0])
        np.minimum(state[0], 1, out=state[1])
        state[1] <<= 4
        state[1] += sure[1]
        state[0] += np.left_shift(by_two, 4, dtype=np.int32)
        self.state = (self.states[:, :k] + state).ravel()
        self.hits = self.hit.take(self.state)
        self.inputs = np.empty((3, k), np.int32)
        STRETCH.take(self.hits, out=self.inputs[:2].reshape(-1), mode="clip")
        self.head.common.take(self.row[:k] + guess, out=self.inputs[2], mode="clip")
        dot = (self.inputs * self.weight[:, :k]).sum(0, dtype=np.int32)
        dot >>= 16
        dot += 2047
        self.p = SQUASH.take(dot, mode="clip")
        self.said = by_two | (sure[0] > 1)
        return guess, (self.p * self.said) << (BITS - 12)

    def fit(self, x: np.ndarray, hit: np.ndarray) -> None:
        """Where ids were and which predictions held."""
        k = len(x)
        was = np.left_shift(hit, 12, dtype=np.int32)
        error = was - self.p
        error *= 6
        error *= self.said
        weight = self.weight[:, :k]
        self.inputs *= error
        self.inputs >>= 10
        weight += self.inputs
        np.maximum(weight, -200_000, out=weight)
        np.minimum(weight, 200_000, out=weight)
        change = (was - self.hits.reshape(2, k)) >> 5
        change *= self.said
        self.hit[self.state] = self.hits + change.ravel()  # stays between 31 and 4065
        cell, sure, new = self.cell, self.sure, x << 4
        known = cell - sure
        other = np.where(sure <= 1, new | 1, known | (sure >> 1))
        # A cell without confidence says place 0: if that came, both give the same.
        self.cells[self.at] = np.where(known == new, np.minimum(cell + 1, cell | 15), other).astype(self.cells.dtype, copy=False)
        self.prev2[:k] = self.prev[:k]
        self.prev[:k] = x
        self.row_of.take(x if self.origin is None else x + self.origin[:k], out=self.row[:k], mode="clip")

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the first k blocks those with a prediction, the predicted places, and the chances in 2 ** BITS that they're right."""
        guess, chance = self.look(k)
        who = np.flatnonzero(chance)
        return who, guess[who], chance[who]

    def learn(self, x: np.ndarray, hit: np.ndarray) -> None:
        """Where ids were and, of those predicted, which predictions held."""
        held = np.zeros(len(x), bool)
        held[np.flatnonzero(self.said)] = hit
        self.fit(x, held)


class _Writer:
    """Range coders of 48 bits that give 16 bits at a time.

    Only the ranges go from step to step. What the steps add to a code, and the word from which they add it, is kept; sums by word are made for many steps at once, and
    carries go through the words at the end.
    """

    STEPS = 256  # whose parts are kept

    def __init__(self, n: int, words: int):
        self.range, self.used = np.full(n, MASK, np.uint64), np.zeros(n, np.int64)
        self.low, self.shift, self.kept = np.zeros((self.STEPS, n), np.uint64), np.zeros((self.STEPS, n), np.uint8), 0
        self.sums = np.zeros((n, words), np.int64)  # each under 2 ** 48, in units of the second word after

    def code(self, at: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        """Code the part of the range from ``start`` of ``size`` in 2 ** BITS, for the blocks ``at``."""
        if self.kept == self.STEPS:
            self._sum()
        step = self.range[at] >> STEP
        rng = size.astype(np.uint64, copy=False) * step
        short = (rng < LEAST_RANGE).view(np.uint8) + (rng < LEAST).view(np.uint8)
        self.range[at] = rng << (short << 4)
        self.low[self.kept, at] = start.astype(np.uint64, copy=False) * step
        self.shift[self.kept, at] = short
        self.kept += 1

    def code_steps(self, chance: np.ndarray, hit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Code STEPS / 2 steps or fewer (rows) of the first blocks (columns): whether the prediction held, then, where not, the id's part.

        The same code as ``code`` gives, with all that doesn't depend on ranges worked out for all steps at once.
        """
        if self.kept:
            self._sum()
        steps, k = chance.shape
        miss, wide = ~hit, chance.astype(np.uint64)
        parts = np.empty((steps, 2, k), np.uint64)
        parts[:, 0], parts[:, 1] = np.where(hit, wide, np.uint64(TOTAL) - wide), size
        step, shift, rng = np.empty((2 * steps, k), np.uint64), self.shift, self.range[:k]
        new = np.empty(k, np.uint64)
        for t in range(steps):
            for second in (0, 1):
                j = 2 * t + second
                one = step[j]
                np.right_shift(rng, STEP, out=one)
                if second:
                    np.multiply(one, parts[t, 1], out=new)
                    np.copyto(rng, new, where=miss[t])
                else:
                    np.multiply(one, parts[t, 0], out=rng)
                short = (rng < LEAST_RANGE).nonzero()[0]
                if len(short):
                    r = rng.take(short) << U16
                    again = r < LEAST_RANGE
                    if again.any():
                        r <<= again * U16
                        shift[j, short] = 1 + again.view(np.uint8)
                    else:
                        shift[j, short] = 1
                    rng[short] = r
        self.kept, step = 2 * steps, step.reshape(steps, 2, k)
        low = self.low[: self.kept].reshape(steps, 2, -1)
        np.multiply(step[:, 0], wide * miss, out=low[:, 0, :k])
        np.multiply(step[:, 1], start * miss, out=low[:, 1, :k])
        self._sum()

    def _sum(self) -> None:
        shift = self.shift[: self.kept]
        ends = np.cumsum(shift, 0, dtype=np.int32)
        width, n = int(ends[-1].max(initial=0)) + 1, len(self.used)
        place = ends - shift
        place += np.arange(n, dtype=np.int32) * width
        # What is added from one word on stays below 2 ** 48, so the sums are exact.
        sums = np.bincount(place.ravel(), self.low[: self.kept].ravel(), n * width).astype(np.int64).reshape(n, width)
        while self.used.max(initial=0) + width > self.sums.shape[1]:
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)], 1)
        self.sums[np.arange(n)[:, None], self.used[:, None] + np.arange(width)] += sums
        self.used += ends[-1]
        self.low[:], self.shift[:], self.kept = 0, 0, 0

    def finish(self) -> list[np.ndarray]:
        if self.kept:
            self._sum()
        n, words = len(self.used), int(self.used.max(initial=0)) + 3
        out, carry = np.zeros((words, n), np.uint16), np.zeros(n, np.int64)
        sums = np.ascontiguousarray(self.sums[:, : words - 2].T)
        for q in range(words - 1, -1, -1):
            if q > 1:
                carry += sums[q - 2]
            out[q] = carry & 0xFFFF
            carry >>= 16
        out = np.ascontiguousarray(out.T)
        return [out[i, : u + 3] for i, u in enumerate(self.used)]


class _Reader:
    def __init__(self, codes: list[np.ndarray]):
        n = len(codes)
        self.width = max(map(len, codes), default=0) + 8
        words = np.zeros((n, self.width), np.uint16)
        for i, c in enumerate(codes):
            words[i, : len(c)] = c
        self.words = words.ravel()
        self.range, self.at = np.full(n, MASK, np.uint64), np.arange(n) * self.width + 3
        w = words[:, :3].astype(np.uint64)
        self.ahead = (w[:, 0] << U32) | (w[:, 1] << U16) | w[:, 2]  # how far the code is above the range's start

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in 2 ** BITS the code lies, and the size of one part."""
        step = self.range[at] >> STEP
        return np.minimum(self.ahead[at] // step, np.uint64(TOTAL - 1)).astype(np.int64), step

    def _fill(self, at: np.ndarray | None, ahead: np.ndarray, rng: np.ndarray) -> None:
        short = np.flatnonzero(rng < LEAST_RANGE)
        while len(short):  # twice at most
            b = short if at is None else at[short]
            where, r = self.at[b], rng[short] << U16
            # A damaged block may ask for more words than there are; its checksum tells.
            ahead[short] = (ahead[short] << U16) | self.words.take(where, mode="clip")
            self.at[b] = where + 1
            rng[short] = r
            short = short[r < LEAST_RANGE]

    def decide(self, k: int, chance: np.ndarray) -> np.ndarray:
        """For each of the first k blocks, whether the code lies below the chance."""
        ahead, rng = self.ahead[:k], self.range[:k]
        step = rng >> STEP
        bound = chance.astype(np.uint64) * step
        hit = ahead < bound
        step <<= STEP
        step -= bound
        rng[:] = np.where(hit, bound, step)
        bound *= ~hit
        ahead -= bound
        self._fill(None, ahead, rng)
        return hit

    def take(self, at: np.ndarray, step: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        ahead = self.ahead[at] - start.astype(np.uint64, copy=False) * step
        rng = size.astype(np.uint64, copy=False) * step
        self._fill(at, ahead, rng)
        self.ahead[at], self.range[at] = ahead, rng


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[tuple[int, int, np.ndarray]]]:
    """The head, and per block: ids, CRC-32, code words."""
    n = -(-len(ids) // block)
    if not n:
        return b"", []
    head, x = Head.of_ids(np.asarray(ids), block)
    sizes = np.full(n, block)
    sizes[-1] = len(ids) - (n - 1) * block
    padded = np.zeros(n * block, np.int32)
    padded[: len(x)] = x
    columns = np.ascontiguousarray(padded.reshape(n, block).T)
    models, out = _Models(n, head), _Writer(n, block // 2 + 16)
    # What comes before each id, and the tables in use.
    before = np.zeros((len(columns) + 2, n), np.uint16)
    before[2:] = columns
    first, last = int(sizes[-1]), int(sizes.max())
    # The last block may be shorter: then steps go on without it.
    edges = [*range(0, first, AT_ONCE), *range(first, last, AT_ONCE), last]
    for lo, hi in itertools.pairwise(edges):
        k = n if lo < first else n - 1
        x = columns[lo:hi, :k]
        slots = models.slots(before[lo + 1 : hi + 1, :k], before[lo:hi, :k])
        chance, hit, row = np.empty(x.shape, np.int32), np.empty(x.shape, bool), np.empty(x.shape, np.int64)
        for t in range(hi - lo):
            row[t] = models.row[:k]
            guess, chance[t] = models.look(k, slots[t])
            np.equal(x[t], guess, out=hit[t])
            hit[t] &= models.said
            models.fit(x[t], hit[t])
        row += x
        out.code_steps(chance, hit, head.start.take(row), head.flat.take(row))
    return head.bytes(), [(int(s), tokens.crc32(ids[i * block : i * block + s]), c) for i, (s, c) in enumerate(zip(sizes, out.finish(), strict=True))]


def decode(head_bytes: bytes, blocks: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """The ids of blocks with one head; raises ValueError if a checksum doesn't hold."""
    return decode_all([(head_bytes, blocks)])[0]


def decode_all(segments: list[tuple[bytes, list[tuple[int, int, np.ndarray]]]]) -> list[np.ndarray]:
    """The ids of each segment (head, blocks), all worked out side by side; raises ValueError if a checksum doesn't hold."""
    blocks = [b for _, given in segments for b in given]
    if not blocks:
        return [np.zeros(0, np.uint32) for _ in segments]
    filled = [(h, given) for h, given in segments if given]
    head = _Joined([Head.of_bytes(h) for h, _ in filled])
    part = np.repeat(np.arange(len(filled)), [len(given) for _, given in filled])
    sizes = np.array([b[0] for b in blocks])
    order = np.argsort(-sizes, kind="stable")
    models, source = _Models(len(blocks), head, part[order]), _Reader([blocks[i][2] for i in order])
    down = sizes[order]
    result = np.zeros((int(down[0]), len(blocks)), np.int32)
    origin, table = head.origin[part[order]], head.table_first[part[order]]
    left = np.searchsorted(-down, -np.arange(int(down[0])), "left").tolist()  # blocks that have so many ids
    for t, k in enumerate(left):
        x, chance = models.look(k)
        hit = source.decide(k, chance)
        at = np.flatnonzero(~hit)
        if len(at):
            where, step = source.place(at)
            place = head.find((table.take(at) << BITS) + where)
            source.take(at, step, head.start.take(place), head.flat.take(place))
            x[at] = place - models.row.take(at)
        result[t, :k] = x
        models.fit(x, hit)
        head.table_of.take(x + origin[:k], out=table[:k], mode="clip")
    result = np.ascontiguousarray(result.T)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for i, b in enumerate(order):
        out[b] = head.ids.take(result[i, : sizes[b]] + origin[i])
    for got, (_, crc, _) in zip(out, blocks, strict=True):
        if tokens.crc32(got) != crc:
            raise ValueError("a block of ids doesn't match its checksum")
    ends = np.cumsum([0, *[len(given) for _, given in segments]])
    return [np.concatenate(out[a:b]) if a < b else np.zeros(0, np.uint32) for a, b in itertools.pairwise(ends)]


def pack_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    head, blocks = encode(ids)
    parts = [MAGIC, struct.pack("<III", len(doc_ids), len(blocks), len(head))]
    parts.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    parts.append(np.array([d is not None for d in doc_ids], np.uint8).tobytes())
    parts.append(np.asarray(lengths, "<u4").tobytes())
    parts += [struct.pack("<III", n, len(c), crc) for n, crc, c in blocks]
    parts.append(head)
    parts += [c.astype("<u2").tobytes() for _, _, c in blocks]
    return b"".join(parts)


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of token ids, and all token ids."""
    return unpack_segments([data])[0]


def unpack_segments(data: list[bytes]) -> list[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """As ``unpack_segment``, for segments that are worked out side by side."""
    parts = [_parts(d) for d in data]
    return [(docs, lengths, ids) for (docs, lengths, _), ids in zip(parts, decode_all([p[2] for p in parts]), strict=True)]


def _parts(data: bytes) -> tuple[list[int | None], np.ndarray, tuple[bytes, list[tuple[int, int, np.ndarray]]]]:
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, count, length = struct.unpack_from("<III", data, 4)
    at = 16
    ids = np.frombuffer(data, "<i8", docs, at)
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    heads = [struct.unpack_from("<III", data, at + 12 * i) for i in range(count)]
    at += 12 * count
    head = data[at : at + length]
    at += length
    blocks = []
    for n, words, crc in heads:
        blocks.append((n, crc, np.frombuffer(data, "<u2", words, at)))
        at += 2 * words
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], lengths, (head, blocks)


def full_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as they come, put together up to SEGMENT_BYTES of text: the more blocks advance together, the less a step costs each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in tokens.small_batches(batches, "text", SEGMENT_BYTES):
        more = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + more > SEGMENT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Write the segments of all documents in ascending id order."""
    vocabulary = tokenizer or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in full_batches(batches):
            ids, bounds = tokens.with_end(*tokens.encoder(vocabulary).encode(batch.column("text")), end_id)
            data = pack_segment(batch.column("doc_id").to_pylist(), np.diff(bounds), ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["part", "number", "n_ids", "segment"]
            )
            number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first()]
    # Fewer ranges than partitions, as long as all cores have one: their segments are fuller.
    n, cores = storage.partitions(docs.sparkSession), docs.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartitionByRange(max(min(n, cores), n // 2), *order).sortWithinPartitions(*order, "text")
    rows.mapInArrow(run, "part int, number int, n_ids long, segment binary").write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, in file order: doc_id, start, n_tokens, ids."""
    return _read(spark, path, with_ids=True)


def side_by_side(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[list[int | None], np.ndarray, np.ndarray]]]:
    """The base and the parts of each segment. As many as hold TOGETHER ids are worked out side by side, or one."""
    n = batch.column("n_ids").to_pylist()
    lo = 0
    while lo < len(n):
        hi = lo + 1
        while hi < len(n) and sum(n[lo : hi + 1]) <= TOGETHER:
            hi += 1
        yield from zip(batch.column("base")[lo:hi].to_pylist(), unpack_segments(batch.column("segment")[lo:hi].to_pylist()), strict=True)
        lo = hi


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, (docs, lengths, ids) in side_by_side(batch):
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                value = pa.array(parts, pa.list_(pa.uint32())).cast(pa.list_(pa.int64())) if with_ids else pa.array([tokens.crc32(p) for p in parts], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + ends - lengths), pa.array(lengths), value], names=["doc_id", "start", "n_tokens", "value"])

    files = spark.read.parquet(path)
    bases = prefix.running(files.select("part", "number", "n_ids").withColumn("_all", F.lit(0)), ["_all"], ["part"], ["number"], {"base": F.col("n_ids")}).select("part", "number", "base")
    kind, name = ("array<bigint>", "ids") if with_ids else ("long", "ids_crc32")
    placed = files.select("part", "number", "n_ids", "segment").join(bases, ["part", "number"])
    return placed.select("base", "n_ids", "segment").mapInArrow(run, f"doc_id long, start long, n_tokens long, value {kind}").withColumnRenamed("value", name)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return _read(spark, path, with_ids=False)
