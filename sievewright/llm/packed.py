"""Set-similarity candidates from popcount embeddings, exchanged as packed columns.

Every text becomes the set of its elements (word, nth occurrence).  For two texts of m and n words with c
elements in common, similarity 2c / (m + n) >= t means that at most (1 - t)(m + n) elements differ.

Embedding.  Elements are hashed to segments; the per-segment counts of a text are its embedding.  One
element more or less moves one count by one, so the Manhattan distance of two embeddings never exceeds the
number of differing elements: a distance beyond (1 - t)(m + n) refutes the pair, whatever the segments are.
Counts are kept modulo two, whose differences are again no more than those of the counts; frequent elements
have segments of their own, so a text has 256 bits, 128 of them of its frequent elements, and the distance of
two texts is the popcount of their exclusive or.

Grid.  The embedding by fine segments (64-bit ranges, so that one holds hardly more than one word) is cut into
unary grid cells (segment, level), i.e. elements; elements in one order fixed for the corpus, rare ones first,
make a text a string, in which elements that differ are insertions and deletions.

* An element of at most ``hot`` occurrences in the corpus is a cell of its own.  A pair within the radius that shares one
  has its first common element among the first m - c + 1 of one text and the first n - c + 1 of the other, so a text
  enters only these.
* Elements more frequent than ``hot`` stand at the end of every string.  A pair that shares none of the others has
  its c common elements there; at most (1 - t)(m + n) differing elements part them, less the rare ones, so at
  least (1.5 t - 1)(m + n) - 1 neighbours among them are neighbours in both strings.  Two neighbours are one cell, and a
  text enters the first of them, as many as can be before the first common one.  A text thus enters fewer cells than
  it has words, whatever is hot, and nothing is lost or capped.  Texts too short for this bound, of under
  six words at t = 0.8, and those that can pair with them, enter single frequent elements as well.

In a cell the join ranges over the interval of lengths that the Manhattan radius allows, then over positions: a shared
element at i of m and j of n leaves |i - j| elements before and |(m - i) - (n - j)| behind that differ; then over the
distance of the coarse embeddings.  A pair has to stand only in the first cell that it shares: of single elements, none before it
is common; of neighbours, no rare element is.  So the rare elements before, of both texts, have used up that much of what may
differ, and the embeddings of the frequent elements may differ by the rest only.  This is looked at first.

Exchange.  Cell entries travel as packed arrays, one row for each batch and bucket, so the JVM moves a few
large binaries and a text's embedding goes once to a bucket however many of its cells fall there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import elements, mix, words

#: Segments of the corpus-wide count sketch; its size, 2 MB, is that of what is broadcast, at any input.
SKETCH_BITS = 18
SKETCH_BLOCK = 1 << 12
#: Segments of a text's coarse embedding, a bit each, of its frequent elements and as many of the others.
SEGMENTS = 128
#: Texts handled at once; their row number needs 14 bits.
CHUNK = 1 << 12
#: Share of all words that are in the rare half of the embedding; somewhat fewer may differ.
RARE = 0.3
#: Pairs handed on at once, and looked at at once.
PAIRS = 1 << 20
STEP = 1 << 16
#: Bit of a key that tells a cell of two neighbours from one of a single element.
PAIR = np.uint64(1 << 24)


def segment_counts(e: np.ndarray) -> np.ndarray:
    return np.bincount((e >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)


def bag_ids(e: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's element set, independent of order."""
    n = np.diff(offsets).astype(np.uint64)

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    return mix(total(mix(e)) + n), mix(total(mix(e ^ np.uint64(0xA5A5A5A5A5A5A5A5))) ^ n)


def embed(e: np.ndarray, rows: np.ndarray, n: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """n rows of 64-bit words: SEGMENTS counts modulo two of frequent elements, then those of the others."""
    at = ((e >> np.uint64(8)) % np.uint64(SEGMENTS)).astype(np.int64)
    if frequent is None or not len(frequent):
        at += SEGMENTS
    else:
        at += np.where(frequent, 0, SEGMENTS)
    counts = np.bincount(rows * (2 * SEGMENTS) + at, minlength=n * 2 * SEGMENTS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, 2 * SEGMENTS), axis=1, bitorder="little").view(np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the packed embeddings, row by row."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int32)


def classes(counts: np.ndarray) -> np.ndarray:
    """Frequency class of each segment; cells are ordered by it, then by hash."""
    return np.minimum(255, np.floor(8 * np.log2(1.0 + counts))).astype(np.uint8)


def is_frequent(e: np.ndarray, klass: np.ndarray, least: int) -> np.ndarray:
    """Elements from a class on, so that they are the last ones in the corpus-wide order."""
    return klass[(e >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] >= least


def halves(counts: np.ndarray, klass: np.ndarray, hot: int) -> int:
    """The class from which on elements are in the frequent half of the embedding: RARE of all words are below, none of the hot ones."""
    mass = np.cumsum(np.bincount(klass, counts, 256))
    return min(int(classes(np.array([hot + 1]))[0]), int(np.searchsorted(mass, RARE * mass[-1], "right")))


def ordered(e: np.ndarray, offsets: np.ndarray, klass: np.ndarray) -> np.ndarray:
    """Index that puts each row's elements in the corpus-wide order, rows of a chunk one after another."""
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    seg = (e >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    key = (rows << np.uint64(50)) | (klass[seg].astype(np.uint64) << np.uint64(42)) | (mix(e) >> np.uint64(22))
    return np.argsort(key)


def short(t: float) -> int:
    """The length from which on texts are sure to share neighbours among c common elements with every partner."""
    gain = 1.5 * t - 1
    return 1 << 40 if gain < 0.01 else int(np.ceil(2 / (gain * (1 + t / (2 - t))) - 1e-9))


def cells(e: np.ndarray, offsets: np.ndarray, counts: np.ndarray, klass: np.ndarray, t: float, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells a chunk's texts enter: key, row, and the place of the cell's (first) element in the text's order.

    A text of m elements enters at most m - c + 1 single elements and m neighbours.
    """
    order = ordered(e, offsets, klass)
    e = e[order]
    m = np.diff(offsets)
    rows = np.repeat(np.arange(len(m)), m)
    size = m[rows]
    pos = np.arange(len(e)) - offsets[:-1][rows]
    least = np.ceil(t / (2 - t) * m - 1e-9).astype(np.int64)  # elements shared with the smallest partner
    seg = (e >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    is_hot = is_frequent(e, klass, classes(np.array([hot + 1]))[0])
    near = (size - pos >= least[rows]) & (counts[seg] > 1)
    enough = short(t)
    one = np.flatnonzero(near & (~is_hot | (size * t <= enough * (2 - t))))
    gain = 1.5 * t - 1
    rare = np.bincount(rows[~is_hot], minlength=len(m))
    common = np.maximum(1, np.ceil(gain * (m + least) - 1 + rare - 1e-9)).astype(np.int64)  # neighbours shared at least
    two = np.flatnonzero(is_hot & (size >= enough) & (pos <= (m - 1 - common)[rows]))
    keys = np.concatenate([mix(e[one]) & ~PAIR, mix(mix(e[two]) + e[np.minimum(two + 1, len(e) - 1)]) | PAIR])
    at = np.concatenate([one, two])
    return keys, rows[at], pos[at]


BLOB = pa.schema([("bucket", pa.int32()), ("texts", pa.binary()), ("cells", pa.binary())])
BLOB_DDL = "bucket int, texts binary, cells binary"
TEXT = np.dtype([("id", "<u8"), ("m", "<u4"), ("role", "u1"), ("rare", "<u2"), ("v", "<u8", (SEGMENTS // 32,))])
CELL = np.dtype([("low", "<u4"), ("high", "u1"), ("row", "<u2"), ("at", "<u4")])
CELL_NARROW = np.dtype([("low", "<u4"), ("high", "u1"), ("row", "<u2"), ("at", "<u2")])


def pack(keys: np.ndarray, rows: np.ndarray, places: np.ndarray, texts: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort((bucket << 40) | rows, kind="stable")
    bucket, keys, rows, places = bucket[order], keys[order], rows[order], places[order]
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    out: list[list] = [[], [], []]
    for a, b in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
        used, local = np.unique(rows[a:b], return_inverse=True)
        kind = CELL_NARROW if places[a:b].max() < 1 << 16 else CELL
        c = np.empty(b - a, kind)
        key = keys[a:b] >> np.uint64(24)
        c["low"], c["high"] = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.uint8)
        c["row"], c["at"] = local, places[a:b]
        for x, y in zip(out, (int(bucket[a]), texts[used].tobytes(), bytes([kind is CELL]) + c.tobytes()), strict=True):
            x.append(y)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, BLOB, strict=True)], schema=BLOB)


def unpack(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of the bucket, each once; and its cells, each text once in a cell: key, text, place."""
    texts, low, high, row, at, base = [], [], [], [], [], 0
    for batch in batches:
        for t, c in zip(batch.column(1), batch.column(2), strict=True):
            t = np.frombuffer(t.as_buffer(), TEXT)
            raw = c.as_buffer()
            c = np.frombuffer(raw, CELL if raw[0] else CELL_NARROW, offset=1)
            texts.append(t)
            low.append(c["low"])
            high.append(c["high"])
            row.append(c["row"].astype(np.int64) + base)
            at.append(c["at"].astype(np.int64))
            base += len(t)
    if not texts:
        return np.zeros(0, TEXT), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.concatenate(texts)
    _, first, inverse = np.unique(both["id"], return_index=True, return_inverse=True)
    out = both[first].copy()
    role = np.zeros(len(out), np.uint8)
    np.bitwise_or.at(role, inverse, both["role"])
    out["role"] = role
    key = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
    text, place = inverse[np.concatenate(row)], np.concatenate(at)
    order = np.argsort((key << np.uint64(24)) | text.astype(np.uint64))
    key, text, place = key[order], text[order], place[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return out, key[keep], text[keep], place[keep]


#: How far, in multiples of its own length, the partners of a smaller text may reach: the classes of the grid.
REACH = (1.06, 1.14, 1.26, np.inf)


def pairs(texts: np.ndarray, key: np.ndarray, text: np.ndarray, place: np.ndarray, t: float, crossing: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Range join inside the cells: pairs the lengths, the positions and the embeddings leave standing.

    An entry of m elements that meets at place i can share m - i elements, or as many neighbours less one, and reaches
    partners up to the length 2 (m - i) / t - m, or (m - i) / (1.5 t - 1) - m; where neighbours are the first to be shared, its r rare elements
    aren't, and the length is 2 (m - r) / t - m at most.  A pair stands if each reaches the other, the smaller one therefore beyond its own length; these
    are laid out by cell, class of reach and length, and every entry looks through one interval of each class.  Of the
    (1 - t)(m + n) elements that may differ each entry brings its share, less the rare ones before the place, which do.
    """
    m, rare = texts["m"].astype(np.int64), texts["rare"].astype(np.int64)
    role, v = np.ascontiguousarray(texts["role"]), np.ascontiguousarray(texts["v"])
    most = (1 << 22) - 1  # beyond four million words one interval holds all lengths
    length, before = m[text], np.minimum(place, rare[text])
    two = (key & np.uint64(1)) == 1  # bit PAIR of the whole key
    shared = np.where(two, np.minimum((length - place) / max(1.5 * t - 1, 1e-9), (length - before) / (t / 2)), (length - place) / (t / 2))
    reach = np.floor(np.minimum(shared, length * 2 / t) - length + 1e-9).astype(np.int64)
    left = ((1 - t) * (1 + 1e-6) * length + 0.01 - before).astype(np.float32)  # rounded up
    first = v[:, 0][text]
    small = np.flatnonzero(reach >= length)
    kind = np.searchsorted(REACH, reach[small] / length[small], "right").astype(np.uint64)
    code = (key[small] << np.uint64(24)) | (kind << np.uint64(22)) | np.minimum(length[small], most).astype(np.uint64)
    order = np.argsort(code)
    code, small = code[order], small[order]
    first_small, left_small = first[small], left[small]
    high = np.minimum(length, reach)
    for k, bound in enumerate(REACH):
        low = np.ceil(length * np.maximum(t / (2 - t), 1 / bound) - 1e-9).astype(np.int64)
        large = np.flatnonzero(high >= low)
        base = (key[large] << np.uint64(24)) | np.uint64(k << 22)
        begin = np.searchsorted(code, base | np.minimum(low[large], most).astype(np.uint64))
        end = np.searchsorted(code, base | np.minimum(high[large], most).astype(np.uint64), "right")
        some = end > begin
        large, begin, times = large[some], begin[some], (end - begin)[some]
        total = np.cumsum(times)
        first_large, left_large = first[large], left[large]
        done = 0
        while done < len(times):
            gone = total[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(total, gone + STEP, "right")))
            count = times[done:stop]
            at = np.arange(total[stop - 1] - gone) + np.repeat(begin[done:stop] - total[done:stop] + count + gone, count)
            far = np.bitwise_count(np.repeat(first_large[done:stop], count) ^ first_small[at])
            ok = np.flatnonzero(far <= np.repeat(left_large[done:stop], count) + left_small[at])
            a, b = large[done + np.searchsorted(total[done:stop] - gone, ok, "right")], small[at[ok]]
            done = stop
            i, j, p, q = place[a], place[b], length[a], length[b]
            ok = (reach[b] >= p) & (np.abs(i - j) + np.abs((p - i) - (q - j)) <= (1 - t) * (p + q) + 1e-9)
            x, y = text[a], text[b]
            ok &= x != y
            if crossing:
                ok &= (role[x] | role[y]) == 3
            x, y, least = x[ok], y[ok], left[a[ok]] + left[b[ok]]
            if len(x):
                apart = np.bitwise_count(v[x] ^ v[y])
                near = (apart[:, : SEGMENTS // 64].sum(1, dtype=np.int32) <= least) & (apart.sum(1, dtype=np.int32) <= (1 - t) * (m[x] + m[y]) + 1e-9)
                if near.any():
                    yield x[near], y[near]


def bucket_count(texts: int, parallelism: int) -> int:
    """Buckets for so many texts, their number and their sizes growing with the square root at first; a bucket never has more
    than 2^18 times the entries of a text, of about 2 KB."""
    return max(4 * parallelism, int(np.sqrt(max(1, texts)) / 20), texts >> 18)


class Bloom:
    """Fixed-size set of hashes, grown with the count it is made for up to a bound; false hits only cost work."""

    def __init__(self, n: int, most_bits: int = 1 << 27):
        self.bits = 1 << max(13, min(most_bits.bit_length() - 1, (max(1, n) * 10).bit_length()))
        self.data = np.zeros(self.bits // 8, np.uint8)

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.bits - 1)
        return [((h >> np.uint64(k)) & mask) for k in (0, 17, 34)]

    def add(self, h: np.ndarray) -> None:
        for p in self._places(h):
            np.bitwise_or.at(self.data, (p >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))

    def has(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for p in self._places(h):
            ok &= (self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def id_hashes(column: pa.Array) -> np.ndarray:
    """A hash of each id, a string of whatever characters or a number."""
    import pandas as pd

    if pa.types.is_integer(column.type):
        return mix(np.asarray(column).view(np.uint64) + np.uint64(9))
    return mix(pd.util.hash_array(np.asarray(column.to_pylist(), dtype=object), categorize=False))


#: Bytes of one block in which Bloom filters are merged.
BLOOM_BLOCK = 1 << 16


def merged_bloom(rows: DataFrame, n: int, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> Bloom:
    """Bloom filter over the hashes of a relation's batches, for about n of them.

    Tasks write the blocks they touched, blocks are merged apart from each other, and the merged filter, of bounded
    size, is put together on the driver.
    """
    out = Bloom(n)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(n)
        for b in batches:
            own.add(hashes(b))
        for k in range(0, len(own.data), BLOOM_BLOCK):
            part = own.data[k : k + BLOOM_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // BLOOM_BLOCK], pa.int32()), "bits": pa.array([part.tobytes()], pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")])
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    for row in rows.mapInArrow(build, "block int, bits binary").groupBy("block").applyInArrow(merge, "block int, bits binary").collect():
        part = np.frombuffer(row["bits"], np.uint8)
        out.data[row["block"] * BLOOM_BLOCK :][: len(part)] |= part
    return out


def bloom_of(ids: DataFrame, column: str, n: int) -> Bloom:
    """Bloom filter of a column's values; nulls are left out."""
    return merged_bloom(ids.select(column), n, lambda b: id_hashes(b.column(0).drop_null()))


def sum_blocks(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of the dense count vectors that tasks wrote in blocks (block int, counts binary)."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts")], axis=0, dtype=np.int64)
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(width, np.int64)
    for row in parts.select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        x = np.frombuffer(row["counts"], np.int64)
        out[row["block"] * len(x) : (row["block"] + 1) * len(x)] = x
    return out


def blocks(counts: np.ndarray) -> pa.RecordBatch:
    n = len(counts) // SKETCH_BLOCK
    used = [k for k in range(n) if counts[k * SKETCH_BLOCK : (k + 1) * SKETCH_BLOCK].any()]
    return pa.RecordBatch.from_pydict({"block": pa.array(used, pa.int32()), "counts": pa.array([counts[k * SKETCH_BLOCK : (k + 1) * SKETCH_BLOCK].astype(np.int64).tobytes() for k in used], pa.binary())})
