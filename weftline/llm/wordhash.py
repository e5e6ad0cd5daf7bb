"""Words of Arrow text columns as positions and 64-bit hashes, for whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weftline.llm.shared import SPACE_CHARS

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE_CHARS]] = True
#: The lower-case byte of each byte, for A-Z only.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, so that near values get far hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_bytes(batch: pa.RecordBatch, most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose texts hold about `most` bytes, or one longer text; each run is a copy."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    edges = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield batch.take(pa.array(range(a, b), pa.int64()))


@dataclass
class Words:
    """data holds the bytes of all texts; word i is data[start[i]:end[i]]; text t has the words first[t] to first[t + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes, equal for equal words."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        powers = np.cumprod(np.full(int(length.max()) + 1, _BASE))
        value = (self.data[np.repeat(self.start, length) + place].astype(np.uint64) + np.uint64(1)) * powers[place]
        return mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text; a null text has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"") if texts.null_count else texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    word = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)  # where a text begins
    edge[bounds[:-1]] = True
    before = np.zeros(len(raw), bool)
    before[1:] = word[:-1]
    begins = word & (~before | edge[:-1])
    after = np.zeros(len(raw), bool)
    after[:-1] = word[1:]
    edge[-1] = True
    ends = word & (~after | edge[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(_LOWER[raw] if lower else raw, start, end, np.searchsorted(start, bounds))


def occurrence(*keys: np.ndarray) -> np.ndarray:
    """How many earlier rows have the same keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    n = np.empty(len(order), np.int64)
    n[order] = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
    return n
