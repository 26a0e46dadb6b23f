"""Encoding with a public byte-level BPE through a sentencepiece model made from its vocabulary (problem 8).

The model is written directly, field by field: every vocabulary entry is a piece in the byte alphabet (each
byte one printable character), its score the negative rank, so sentencepiece merges in the order of ranks;
normalisation is the identity.  Texts are cut into pre-tokens by the tokenizer's pattern, the different
pre-tokens of a batch are encoded once, and piece numbers lead back to ids by the inverse mapping.
"""

from __future__ import annotations

import base64
from itertools import chain
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import mix, powers

_SHIFT = 1  # piece 0 is the unknown piece that every model needs
_CACHE_BITS = 19
_CACHE = 1 << _CACHE_BITS
_loaded: dict[str, Codec] = {}


def byte_alphabet() -> list[str]:
    """For each byte a printable character of its own: itself where it prints, the next free one from 256 on else."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def default_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model proto of type BPE with one piece for each rank; ranks must be 0 to n - 1."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks are not 0 to n - 1")
    letters = byte_alphabet()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + np.float32(score).tobytes() + _field(3, kind))

    normal, unknown = 1, 2
    out = [piece("<unk>", 0.0, unknown)]
    for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(piece("".join(letters[b] for b in word), -float(rank), normal))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(ranks) + _SHIFT) + _field(40, 0)
    minus_one = (1 << 64) - 1
    trainer += _field(41, minus_one) + _field(42, minus_one) + _field(43, minus_one)  # no sentence marks, no padding
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, blanks stay
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


_LETTER, _DIGIT, _OTHER, _BLANK, _END = 1, 2, 3, 4, 5
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[*range(9, 14), 32]] = _BLANK
_KIND[255] = _END


def cut_ascii(data: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in ASCII texts that each end with a byte 255; those bytes count as beginnings.

    The same cuts as the public pattern makes: an apostrophe with s, t, re, ve, m, ll or d; runs of letters, of
    digits or of other characters, each with one blank before it; and the blanks left over, of which a run
    leaves its last one to what follows.
    """
    n = len(data)
    kind = _KIND[data]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    before = np.zeros(n, np.uint8)
    before[1:] = data[:-1]
    after_end = np.ones(n, bool)
    after_end[1:] = kind[:-1] == _END
    solid = (kind != _BLANK) & (kind != _END)
    start &= ~(solid & (before == 32))  # that blank begins the token instead
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == _BLANK) & solid[1:]
    start |= last
    ends = kind == _END
    start |= ends | after_end
    quote = np.flatnonzero((data[:-3] == 39) & (before[:-3] != 32) & (kind[1:-2] == _LETTER)) if n > 3 else np.zeros(0, np.int64)
    quote = quote[start[quote]]
    tail = np.flatnonzero((data[max(0, n - 3) : n - 1] == 39)) + max(0, n - 3) if n > 1 else np.zeros(0, np.int64)
    quote = np.union1d(quote, tail[start[tail]])
    x, y = data[np.minimum(quote + 1, n - 1)], data[np.minimum(quote + 2, n - 1)]
    two = np.isin(x, [115, 116, 109, 100])
    three = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
    for hit, size in ((two, 2), (three, 3)):
        q = quote[hit]
        start[q + 1] = False
        start[np.minimum(q + size, n - 1)] = True
    return np.flatnonzero(start)


class Codec:
    """Encoder and decoder of one vocabulary file of ranks (``.tiktoken``)."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.words = {rank: word for word, rank in self.ranks.items()}
        self.letters = {b: c for b, c in enumerate(byte_alphabet())}
        self.pattern = regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.hash = np.zeros(_CACHE, np.uint64)  # of the pre-token known in each slot
        self.begin = np.zeros(_CACHE, np.int64)
        self.size = np.zeros(_CACHE, np.int64)
        self.flat = np.zeros(1 << 16, np.int32)  # ids of all known pre-tokens one after another
        self.used = 0

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode([x.decode("latin-1").translate(self.letters) for x in new], out_type=int, num_threads=1)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        end = self.used + int(size.sum())
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(end, np.int32)])
        self.flat[self.used : end] = np.fromiter(chain.from_iterable(ids), np.int32, end - self.used) - _SHIFT
        begin = self.used + np.cumsum(size) - size
        self.used = end
        return begin, size

    def _cut(self, texts: list[bytes], ascii_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes, each followed by a byte 255, and where pre-tokens begin."""
        data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
        if ascii_only:
            return data, cut_ascii(data)
        begins, at = [], 0
        for x in texts:
            sizes = [len(w.encode("utf-8", "replace")) for w in self.pattern.findall(x.decode())]
            begins.append(at + np.cumsum([0, *sizes]))
            at += len(x) + 1
        return data, np.unique(np.concatenate(begins)) if begins else np.zeros(0, np.int64)

    def _encode(self, texts: list[bytes], ascii_only: bool) -> tuple[np.ndarray, np.ndarray]:
        data, begin = self._cut(texts, ascii_only)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        end = np.append(begin[1:], len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=total[1:])
        h = mix((total[end] - total[begin]) * powers(len(data), inverse=True)[begin] + (end - begin).astype(np.uint64))
        mark = data[begin] == 255
        h = h[~mark]
        row = (np.cumsum(mark) - mark)[~mark]
        begin, end = begin[~mark], end[~mark]
        if self.used > _CACHE * 8:
            self._forget()
        slot = (h >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        at, size = self.begin[slot], self.size[slot]
        miss = np.flatnonzero(self.hash[slot] != h)
        if len(miss):
            different, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            raw = data.tobytes()
            new_at, new_size = self._learn([raw[begin[k] : end[k]] for k in miss[first]])
            at[miss], size[miss] = new_at[inverse], new_size[inverse]
            place = slot[miss[first]]
            self.hash[place], self.begin[place], self.size[place] = different, new_at, new_size
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(row, size, len(texts)))]).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n + 1 offsets."""
        plain = np.array([x.isascii() for x in texts], bool)
        sizes = np.zeros(len(texts), np.int64)
        got = []
        for ascii_only in (True, False):
            rows = np.flatnonzero(plain == ascii_only)
            ids, offsets = self._encode([texts[k].encode("utf-8", "replace") for k in rows], ascii_only)
            sizes[rows] = np.diff(offsets)
            got.append((rows, ids, offsets))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(ends[-1], np.int32)
        for rows, ids, offsets in got:
            if len(ids):
                out[np.repeat(ends[rows] - offsets[:-1], np.diff(offsets)) + np.arange(len(ids))] = ids
        return out, ends

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.words[int(k)] for k in ids).decode("utf-8", "replace")


def codec(path: str, pattern: str | None = None) -> Codec:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    key = f"{path}\0{pattern}"
    if key not in _loaded:
        _loaded[key] = Codec(path, pattern)
    return _loaded[key]


_ROWS = 256


def token_ids(text: Column, path: str | None = None) -> Column:
    """Ids of a text without special tokens, as array<int>; null and empty texts have the empty list.

    Strings of special tokens in a text are ordinary text.  path: a vocabulary file of ranks.
    """
    from pyspark.sql.functions import arrow_udf

    path = path or default_path("byte_bpe_50k.tiktoken")

    @arrow_udf("array<int>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for part in parts:
            out = []
            for k in range(0, len(part), _ROWS):
                ids, offsets = c.encode([x or "" for x in part.slice(k, _ROWS).to_pylist()])
                out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return encode(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of ids of a text; 0 for null and empty texts."""
    from pyspark.sql.functions import arrow_udf

    path = path or default_path("byte_bpe_50k.tiktoken")

    @arrow_udf("int")
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for part in parts:
            out = [np.zeros(0, np.int64)]
            for k in range(0, len(part), _ROWS):
                out.append(np.diff(c.encode([x or "" for x in part.slice(k, _ROWS).to_pylist()])[1]))
            yield pa.array(np.concatenate(out).astype(np.int32))

    return F.coalesce(count(text), F.lit(0))
