"""Hashes of the words of many texts at once, on the bytes of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes hashed in one go; longer words are hashed by themselves.
STRETCH = 1 << 15
LONG = 1 << 12

def finish(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.ones(STRETCH + 1, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


_STEP = 0x9E3779B97F4A7C15
_UP, _DOWN = _powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, nulls as empty texts, and where each text begins, with the end of the last."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts data[at[i]:at[i+1]], and the number of words of each text.

    Words are runs of bytes other than ASCII white space; A-Z count as a-z. A word's hash is a polynomial of its bytes with
    odd coefficients, taken as a difference of running sums and divided by the power at which the word begins.
    """
    lo, hi = int(at[0]), int(at[-1])
    data, at = data[lo:hi], at - lo
    inside = (data != 32) & ((data - np.uint8(9)) > 4)
    low = data + ((data - np.uint8(65)) < 26) * np.uint8(32)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < len(data))]  # a text's end ends a word too
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + STRETCH, "right")))
            if ends[j - 1] - base <= STRETCH:
                sums = np.zeros(ends[j - 1] - base + 1, np.uint64)
                span = slice(base, ends[j - 1])
                np.multiply(low[span], _UP[: len(sums) - 1], out=sums[1:])
                sums[1:] += _UP[: len(sums) - 1]
                sums[1:] *= inside[span]
                np.cumsum(sums, out=sums)
                s, e = starts[i:j] - base, ends[i:j] - base
                out[i:j] = (sums[e] - sums[s]) * _DOWN[s]
            i = j
        for k in np.flatnonzero(ends - starts > LONG):
            out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes().lower())
        out = finish(out)
    return out, np.diff(np.searchsorted(starts, at))


PART_BYTES = 1 << 20


def hashed_parts(column: pa.Array):
    """(first row, end row, hashes, words of each row) of a string column, in parts of whole texts of about PART_BYTES."""
    data, at = text_bytes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART_BYTES, "right")) - 1)
        yield i, j, *word_hashes(data, at[i : j + 1])
        i = j
