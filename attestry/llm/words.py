"""Words of whole texts as arrays: where they start and end, and a 64-bit name for each.

Everything here works on the bytes of an Arrow string column, so a task handles millions of words
in a handful of numpy calls and never builds a Python string per word. A word is a run of bytes
outside 0x20 and 0x09-0x0D; those bytes never occur inside a longer UTF-8 sequence, so splitting
bytes equals splitting code points. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# every ASCII byte but letters and digits: for matching words whatever the punctuation around them
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of a well known hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Tables of powers that grow to the longest slice seen by this Python worker."""

    up = down = powers(_BASE, 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 1)
            cls.up, cls.down = powers(_BASE, size), powers(_BASE_INVERSE, size)
        return cls.up, cls.down


@dataclass
class Words:
    """The words of some texts, in order. `data` are the texts' bytes, one after the other."""

    data: np.ndarray
    start: np.ndarray  # first byte of each word in data
    end: np.ndarray  # the byte after each word
    first: np.ndarray  # per text, and one more: the number of words before it
    name: np.ndarray  # 64-bit name of each word

    def text_of(self) -> np.ndarray:
        """Per word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and the offsets of its texts in them."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def words_of(column: pa.Array, lower: bool = False, apart: np.ndarray = _SPACE) -> Words:
    """Split the texts of a column at the bytes `apart` marks; `lower` turns A-Z into a-z first."""
    data, at = text_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64), np.zeros(0, np.uint64))
    inside = ~apart[data]
    begins, ends = np.empty(n, bool), np.empty(n, bool)
    begins[0] = ends[-1] = True
    begins[1:], ends[:-1] = ~inside[:-1], ~inside[1:]
    begins[at[:-1][at[:-1] < n]] = True
    ends[at[1:][at[1:] > 0] - 1] = True
    start, end = np.flatnonzero(inside & begins), np.flatnonzero(inside & ends) + 1
    up, down = _Powers.upto(n)
    value = data.astype(np.uint64) + np.uint64(1)
    value *= up[:n]
    value[~inside] = 0
    name = mix(np.add.reduceat(value, start) * down[start]) if len(start) else np.zeros(0, np.uint64)
    return Words(data, start, end, np.searchsorted(start, at), name)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has at most `limit` bytes of text, or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        before = end[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(end, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of n words, and per text (and one more) the number of runs before it.

    A text with fewer than n words, but at least one, counts as one run of all its words."""
    count = np.diff(words.first)
    total = len(words.name)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    if not total:
        return np.zeros(0, np.uint64), first
    factor = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    padded = np.concatenate([words.name, np.zeros(n, np.uint64)])
    whole = np.zeros(total, np.uint64)
    for i in range(n):
        whole += padded[i:i + total] * factor[i]
    for t in np.flatnonzero((count > 0) & (count < n)):  # short texts: only their own words
        own = words.name[words.first[t]:words.first[t + 1]]
        whole[words.first[t]] = (own * factor[:len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    at = np.arange(int(first[-1])) - np.repeat(first[:-1], runs) + np.repeat(words.first[:-1], runs)
    return mix(whole[at]), first
