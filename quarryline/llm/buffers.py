"""Vectorised helpers over the UTF-8 bytes of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: An odd multiplier and its inverse modulo 2**64, for hashes of spans; random values for the 256 bytes.
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more than texts). No nulls."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, … modulo 2**64, at least n of them."""
    key = str(base)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        step = _U(base)
        while len(have) < n:  # doubles: the next half is this half times base**len
            have = np.concatenate((have, have * step))
            step = step * step
        _POWERS[key] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans, eight to a number, and where each span's numbers begin (one more than spans)."""
    count = (ends - starts + 7) >> 3
    first = np.concatenate(([0], np.cumsum(count))).astype(np.int64)
    place = np.repeat(starts - 8 * first[:-1], count) + 8 * np.arange(first[-1])
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = np.repeat(ends, count) - place
    return eight[place] & _MASKS[np.minimum(left, 8)], first


def hash_lanes(values: np.ndarray, first: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span from its ``lanes``: every eight bytes are mixed with their place before they are added, so no rule by which bytes
    repeat or change places makes two spans' sums equal."""
    with np.errstate(over="ignore"):
        nth = (np.arange(len(values)) - np.repeat(first[:-1], np.diff(first)) + 1).astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(mix64(values + _U(seed)) ^ (nth * _U(_BASE))))))
        return mix64(sums[first[1:]] - sums[first[:-1]] + lengths.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; it depends on the span's bytes and length alone."""
    return hash_lanes(*lanes(data, starts, ends), ends - starts)


def tokens(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, A to Z in lower case; where each maximal run of bytes that are ``inside`` begins and ends; and each text's first run (one
    more than texts). No nulls."""
    data, offsets = as_bytes(texts)
    data = _LOWER[data]
    own = np.zeros(len(data) + 2, bool)
    own[1:-1] = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(own[1:-1] & (~own[:-2] | edge[:-1]))
    ends = np.flatnonzero(own[1:-1] & (~own[2:] | edge[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def same_spans(values: np.ndarray, at: np.ndarray, i: np.ndarray, others: np.ndarray, other_at: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether span ``i`` and span ``j`` of other ``lanes`` have equal lanes, pair by pair."""
    count = at[i + 1] - at[i]
    same = count == other_at[j + 1] - other_at[j]
    k = np.flatnonzero(same)
    count = count[k]
    step = np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    differ = values[np.repeat(at[i[k]], count) + step] != others[np.repeat(other_at[j[k]], count) + step]
    same[k[np.repeat(np.arange(len(k)), count)[differ]]] = False
    return same


def batches_of(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows again, cut where a column's texts come to about ``most`` bytes, so that rows of any length need like memory; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = as_bytes(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
