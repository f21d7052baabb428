"""Words of whole texts as numbers, a batch at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_column(texts: pa.Array) -> pa.Array:
    """Large strings; null is empty."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in order, and each text's bounds in it.

    Words are runs of characters other than space and U+0009 to U+000D.
    """
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy()
    values = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    words = values.dictionary_encode()
    unique, codes = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(unique, pa.scalar("", unique.type)).as_py() if len(unique) else -1
    if empty >= 0:
        keep = codes != empty
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    return unique, codes, bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def mean_by(owner: np.ndarray, value: np.ndarray, n: int, count: np.ndarray) -> np.ndarray:
    return np.bincount(owner, value, n) / np.maximum(count, 1)


def unused(columns: Sequence[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
