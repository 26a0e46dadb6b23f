"""Vectorised words of Arrow text columns.

A word is a maximal run of a-z and 0-9 after lower-casing.  All words of a batch are cut and
hashed with a handful of numpy passes over its bytes, without one Python object per word.  Words are
known by a 64-bit hash from here on; two words of one corpus of a billion different words share a hash
with a probability of about 0.03, and only such a pair could change a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 22

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse, modulo 2 ** 64."""
    return _power(_INVERSE, n, "down") if inverse else _power(_BASE, n, "up")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the lower-cased texts, and the n + 1 offsets; a null text has none."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    if data.max() >= 128:  # only characters beyond ASCII need the full case mapping
        texts = [x.lower().encode() for x in column.to_pylist()]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    return data, offsets - offsets[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the column in order, and the n + 1 offsets of its rows' words."""
    data, offsets = _bytes(column)
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    first = 0
    while first < len(counts):  # rows in chunks of bounded size; a longer row is a chunk of its own
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
        begin, end = offsets[first], offsets[last]
        letters = np.zeros(end - begin + (last - first), np.uint8)
        # one separator after each row keeps words of neighbouring rows apart
        starts = offsets[first : last + 1] - begin + np.arange(last - first + 1)
        if last - first == 1:
            letters[:-1] = _CLASS[data[begin:end]]
        else:
            keep = np.ones(len(letters), bool)
            keep[starts[1:] - 1] = False
            letters[keep] = _CLASS[data[begin:end]]
        inside = letters != 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        s, e = edge[0::2], edge[1::2]
        if len(s):
            total = np.zeros(len(letters) + 1, np.uint64)
            np.cumsum(letters.astype(np.uint64) * powers(len(letters)), out=total[1:])
            h = (total[e] - total[s]) * powers(len(letters), inverse=True)[s]
            hashes.append(mix(h + (e - s).astype(np.uint64)))
            counts[first:last] = np.diff(np.searchsorted(s, starts))
        first = last
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def elements(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each row's words as a set: the k-th occurrence of a word in its row becomes an element of its own."""
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    bits = np.uint64(max(1, int(len(offsets)).bit_length()))
    key = (rows << (np.uint64(64) - bits)) | (hashes >> bits)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
    out = np.empty_like(hashes)
    out[order] = np.where(nth == 0, hashes[order], mix(hashes[order] + nth.astype(np.uint64) * _INVERSE))
    return out
