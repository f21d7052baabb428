"""Token ids of whole texts, word by word.

The tokenizer drops white space and never joins what it separates, so the ids of a text are
those of its words, one after the other. Words repeat, so each is encoded once per worker and
kept in a bounded store. A word that ends in ASCII punctuation is split before it, where the
tokenizer splits it, too.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept per worker; of a full store only the words at hand stay.
KEPT_WORDS = 300_000
#: Bytes of text that are worked on at once; a longer text is a batch of its own.
BATCH_BYTES = 4_000_000

_TAIL = r"^(?P<core>\p{L}+)(?P<tail>[!-/:-@\[-`{-~]+)$"

#: Letters up to U+00FF that no step before the tokenizer's merges changes.
_SMALL = re.compile(r"[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes columns of text. ``path``: a tokenizer file whose words don't cross white space."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        given = json.loads(self.tokenizer.to_str())
        split = (given["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        suffix = given["model"].get("end_of_word_suffix")
        #: Whether an id ends a word; none, if the tokenizer's ids don't tell.
        self.ends = None
        #: The tokenizer without the steps that leave small letters up to U+00FF as they are.
        self.letters = self.tokenizer
        if suffix and split[-1].get("type") == "ByteLevel":
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            plain = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, split[-1]]}
            self.letters = Tokenizer.from_str(json.dumps(given | {"normalizer": None, "pre_tokenizer": plain, "added_tokens": []}))
        self._clear()

    def _clear(self) -> None:
        self.kept = pa.array([], pa.large_string())
        #: Words learned since ``kept`` was put together.
        self.new: list[pa.Array] = []
        #: Where the kept words' ids begin, in parts; the last of a part is where the next begins.
        self.starts: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0

    def _append(self, ids: np.ndarray, lengths: np.ndarray, words: list[str] | pa.Array) -> None:
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : need] = ids
        self.new.append(pa.array(words, pa.large_string()))
        self.starts.append(self.used + np.cumsum(lengths))
        self.used = need

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone are encoded together, a text of some hundreds at a time: the ids tell where its words end."""
        small = [w for w in words if _SMALL.fullmatch(w)]
        rest = [w for w in words if not _SMALL.fullmatch(w)] if len(small) < len(words) else []
        other, odd = [w for w in rest if w.isalpha()], [w for w in rest if not w.isalpha()]
        for tokenizer, plain in ((self.letters, small), (self.tokenizer, other)):
            texts = [plain[k : k + 500] for k in range(0, len(plain), 500)]
            joined = [" ".join(t) for t in texts]
            encode = tokenizer.encode_batch if self.ends is None else tokenizer.encode_batch_fast
            for part, got in zip(texts, encode(joined, add_special_tokens=False), strict=True):
                ids = np.array(got.ids, np.uint32)
                if self.ends is None:
                    lengths = np.bincount(np.array(got.word_ids, np.int64))
                else:
                    lengths = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
                if len(lengths) == len(part) and lengths.all() and lengths.sum() == len(ids):
                    self._append(ids, lengths, part)
                else:
                    odd += part
        ids = [got.ids for got in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        if odd:
            self._append(np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids]), odd)

    def _keep(self, numbers: np.ndarray) -> None:
        """Drop all other words."""
        words, starts = self.kept.take(pa.array(numbers)), self.starts[0]
        lengths = starts[numbers + 1] - starts[numbers]
        ids = _gather(self.flat, starts[numbers], lengths)
        self._clear()
        self._append(ids, lengths, words)
        self._put_together()

    def _put_together(self) -> None:
        self.kept, self.new, self.starts = pa.concat_arrays([self.kept, *self.new]), [], [np.concatenate(self.starts)]

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Places of different words in the store, which learns those that it doesn't have."""
        found = pc.index_in(words, value_set=self.kept)
        unknown = found.is_null()
        missing = words.filter(unknown)
        unknown, numbers = unknown.to_numpy(zero_copy_only=False), found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(missing):
            return numbers
        if len(self.kept) + len(missing) > KEPT_WORDS and len(self.kept):
            self._keep(numbers[~unknown])
            numbers[~unknown] = np.arange(len(words) - len(missing))
        for k in range(0, len(missing), 20_000):
            # Words hold no blank, so one text gives them all.
            part = missing.slice(k, 20_000).cast(pa.string())
            self._learn(pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), " ")[0].as_py().split(" "))
        numbers[unknown] = len(self.kept) + pc.index_in(missing, value_set=pa.concat_arrays(self.new)).to_numpy()
        self._put_together()
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's ids (one more than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        words = lists.values.dictionary_encode()
        bounds = lists.offsets.to_numpy()
        unique, index = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        if not len(unique):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        # Up to U+00FF a letter has one lower-case form, which the tokenizer would choose, too.
        plain = pc.match_substring_regex(unique, r"^[\x00-\x{FF}]*$")
        # Added tokens are found in the text as it is written.
        plain = pc.and_not(plain, pc.match_substring(unique, "<|"))
        low = pc.if_else(plain, pc.utf8_lower(unique), unique)
        split = pc.extract_regex(pc.if_else(plain, low, pa.scalar(None, low.type)), pattern=_TAIL)
        core = pc.coalesce(pc.struct_field(split, 0), low)
        tail = pc.coalesce(pc.struct_field(split, 1), pa.scalar("", pa.large_string()))
        # One list, so that words are dropped before both or neither. Tails are few.
        tails = tail.dictionary_encode()
        both = pa.concat_arrays([core, tails.dictionary]).dictionary_encode()
        numbers = self._numbers(both.dictionary)[both.indices.to_numpy()]
        starts = self.starts[0]
        a, b = numbers[: len(unique)], numbers[len(unique) :][tails.indices.to_numpy()]
        na, nb = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
        # Each distinct word's ids, then each word's.
        u_ids = _gather(self.flat, np.stack([starts[a], starts[b]], 1).ravel(), np.stack([na, nb], 1).ravel())
        u_len = na + nb
        u_start = np.concatenate([[0], np.cumsum(u_len)])
        ids = _gather(u_ids, u_start[index], u_len[index])
        ends = np.concatenate([[0], np.cumsum(u_len[index])])
        return ids, ends[bounds - bounds[0]]


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + lengths[i]], one after the other."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return flat.take(at)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``most`` bytes of text, or one row.

    After the last one Arrow gives back what it keeps for later, since a worker lives on idle beside other steps.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def add_columns(docs: DataFrame, columns: Sequence[str], names: Sequence[str], kinds: Sequence[str], model: object, of: Callable) -> DataFrame:
    """The given columns of ``docs`` and those that ``of(texts, model)`` gives for the column text.

    Columns go through Python by place, so names that occur twice do no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = [f"_{k}" for k in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            got = of(batch.column("_text"), shared.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in given], *got], names=[*given, *[f"_new{k}" for k in range(len(names))]])

    rows = docs.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(columns, given, strict=True)], F.col("text").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"_new{k} {t}" for k, t in enumerate(kinds)])
    return rows.mapInArrow(run, schema).toDF(*columns, *names)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the end id after each document."""
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(n + 1)


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
