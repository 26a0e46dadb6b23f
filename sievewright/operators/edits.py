"""Candidates for near-equal texts under edits of single characters, without comparing every text with every other.

A sequence-matching ratio of at least t between texts of a and b characters leaves a common subsequence of at least t (a + b) / 2
characters, so at most (1 - t)(a + b) insertions and deletions.  A deletion touches q grams of q characters, an insertion q - 1 of them,
so two such texts have all but 2 q (1 - t) / (2 - t) a of the a - q + 1 grams of either in common, repeated grams counted
as often as they occur in both.

With the grams of every text in one order, rare ones first, the first common gram stands among as many first grams as edits can touch,
and one more; a text enters only the cells of these.  Rarity comes from a sketch of fixed size.  In a cell lengths are joined by range, then
places: a common gram leaves as many grams before and behind it unshared as its places differ, and the histograms of
characters may differ by no more than the edits.  Texts so short that edits can touch all their grams are all in one cell, whose
range join by length remains.  Nothing is capped: every pair that reaches the ratio is a candidate.

Where texts share most of their grams, as texts of few templates do, such cells hold more pairs than there are.  So the pairs of
both ways are estimated from the sketch and the numbers of texts by length; if the cells of grams don't have fewer, texts enter
cells of neighbouring length bands, divided into tiles of bounded size.  Either way gives the same pairs of the ratio.  In a tile the
histograms are laid out by cell of characters, and a text passes over all that its length allows: first the few cells that differ most,
then all for what these leave.

What the characters leave standing is refuted by pairs of neighbouring characters: an edit changes at most three of their counts, which
are kept modulo 16 in PAIR_CELLS cells and compared around that circle.

Cell entries travel packed by bucket, a text's histograms once to a bucket; candidates are pairs of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Characters of a gram, cells of the sketch of gram counts (a power of two), and of the character histogram.
GRAM = 3
SKETCH = 1 << 18
BLOCK = 1 << 12
HISTOGRAM = 64
#: Cells of the counts of neighbouring characters, half a byte each.
PAIR_CELLS = 512
#: Cells of characters that are compared first, and texts of a tile laid out at once, which with them stay in a core's cache.
FIRST = 24
WIDE = 4096
#: Length bands that are counted for each of KINDS groups of kinds, and texts of a tile.
BANDS, KINDS = 512, 8
TILE = 1 << 15
#: Texts, and pairs, handled at once.
CHUNK = 1 << 10
PAIRS = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
TEXT = np.dtype([("id", "<i8"), ("side", "u1"), ("n", "<u4"), ("h", "u1", (HISTOGRAM,)), ("g", "u1", (PAIR_CELLS // 2,))])
CELL = np.dtype([("low", "<u4"), ("high", "u1"), ("row", "<u2"), ("at", "<u4")])


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(texts: list[str], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the hashes of its grams, a repeated one told apart by its number; their offsets; characters and their offsets."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    n = np.array([len(r) for r in raw], np.int64)
    chars = np.concatenate([*raw, np.zeros(GRAM, np.uint32)]).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(n)])
    h = np.zeros(len(chars) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h = h * _ODD + chars[k : len(chars) - GRAM + 1 + k]
    count = np.maximum(0, n - GRAM + 1)
    row = np.repeat(np.arange(len(texts)), count)
    offsets = np.concatenate([[0], np.cumsum(count)])
    # 54 bits, so that text and gram sort as one number
    h = _spread(h[np.arange(offsets[-1]) - offsets[row] + starts[row]] ^ salt[row]) >> np.uint64(10)
    code = (row.astype(np.uint64) << np.uint64(54)) | h
    order = np.argsort(code)
    sorted_, code = h[order], code[order]
    new = np.ones(len(h), bool)
    new[1:] = code[1:] != code[:-1]
    first = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    out = np.empty_like(h)
    out[order] = _spread((sorted_ + nth.astype(np.uint64)) * _ODD)
    return out, offsets, chars[: starts[-1]], starts


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the texts and their offsets."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    return np.concatenate([*raw, np.zeros(0, np.uint32)]).astype(np.uint64), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])


def histograms(chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the counts of its characters, cut off at 255, and those of its neighbouring characters modulo 16, two a byte."""
    n = np.diff(starts)
    owner = np.repeat(np.arange(len(n)), n)
    h = np.bincount(owner * HISTOGRAM + ((chars * _ODD) >> np.uint64(58)).astype(np.int64), minlength=len(n) * HISTOGRAM)
    two = np.flatnonzero(owner[1:] == owner[:-1])
    cell = (_spread(chars[two] * _ODD + chars[two + 1]) * _ODD) >> np.uint64(55)
    g = np.bincount(owner[two] * PAIR_CELLS + cell.astype(np.int64), minlength=len(n) * PAIR_CELLS).astype(np.uint8).reshape(len(n), -1, 2) & np.uint8(15)
    return np.minimum(255, h).astype(np.uint8).reshape(len(n), HISTOGRAM), g[:, :, 0] | (g[:, :, 1] << np.uint8(4))


def pairs_differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row the distance of counts of neighbouring characters, never more than that of the counts before they are taken modulo 16."""
    total = np.zeros(len(p), np.int64)
    for shift in (0, 4):
        d = ((p >> np.uint8(shift)) - (q >> np.uint8(shift))) & np.uint8(15)
        total += np.minimum(d, np.uint8(16) - d).sum(1, dtype=np.int64)
    return total


def common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row the sum of the smaller ones of the counts of characters, eight to a word."""
    x = np.minimum(p, q).view(np.uint64)
    mask = np.uint64(0x00FF00FF00FF00FF)
    x = ((x & mask) + ((x >> np.uint64(8)) & mask)).sum(1)
    return ((x * np.uint64(0x0001000100010001)) >> np.uint64(48)).astype(np.int64)


def _salts(kinds: pa.Array) -> np.ndarray:
    d = kinds.dictionary_encode()
    salt = np.array([int.from_bytes(x.encode()[:7], "little") + 1 for x in d.dictionary.to_pylist()] or [0], np.uint64)
    return _spread(salt * _ODD)[np.asarray(d.indices)]


def band(n: np.ndarray, t: float) -> np.ndarray:
    """Length band: of two texts within the ratio the longer one is in the band of the shorter or in the next."""
    return np.minimum(BANDS - 2, np.floor(np.log(np.maximum(1, n)) / np.log(max(1.05, 2 / t - 1)) + 1e-9)).astype(np.int64)


def _sketch(values: DataFrame, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all grams by cell of the sketch, and of texts by side, group of kinds and band, summed by blocks in the executors; their
    size is the same at any input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH + 2 * BLOCK, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                b = batch.slice(k, CHUNK)
                salt = _salts(b.column(0))
                h, _, _, starts = grams(b.column(1).to_pylist(), salt)
                total[:SKETCH] += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                group = np.asarray(b.column(2)).astype(np.int64) * KINDS + (salt % np.uint64(KINDS)).astype(np.int64)
                total[SKETCH:] += np.bincount(group * BANDS + band(np.diff(starts), t), minlength=2 * BLOCK)
        some = [k for k in range(0, len(total), BLOCK) if total[k : k + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[k : k + BLOCK].tobytes() for k in some], pa.binary())], ["block", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts")], axis=0, dtype=np.int64)
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(SKETCH + 2 * BLOCK, np.int64)
    for r in values.select("kind", "text", "side").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["counts"], np.int64)
    return out[:SKETCH], out[SKETCH:].reshape(2, KINDS, BANDS)


def estimates(counts: np.ndarray, texts: np.ndarray, t: float, symmetric: bool = True) -> tuple[float, float]:
    """Pairs that meet in cells of grams, which take the rarest part of all grams, and in those of length bands; of two sides only those
    across, which are the same part of both."""
    rare = np.sort(counts[counts > 0]).astype(float)
    taken = rare[np.cumsum(rare) <= min(1.0, 2 * GRAM * (1 - t) / (2 - t)) * rare.sum()]
    both = texts.astype(float) + np.roll(texts, -1, -1)
    by_grams, by_bands = float((taken * (taken - 1)).sum() / 2), float((both.sum(0) ** 2).sum() / 2)
    if not symmetric and by_bands:
        across = float((both[0] * both[1]).sum())
        by_grams, by_bands = by_grams * across / by_bands, across
    return by_grams, by_bands


def length_entries(n: np.ndarray, ids: np.ndarray, salt: np.ndarray, texts: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells by length: key, row, and place: twice 0 in a cell of one tile, else the text's own tile plus one, plus 1 in the band before its own.

    A text enters its band and the one before, there with every tile of the band; two texts meet in the cell of their two tiles
    and of the band of the shorter one.
    """
    tiles = np.maximum(1, -(-(texts + np.roll(texts, -1, 1)) // TILE))
    own = band(n, t)
    group = (salt % np.uint64(KINDS)).astype(np.int64)
    keys, rows, places = [], [], []
    for step in (0, 1):
        some = np.flatnonzero(own >= step)
        at = own[some] - step
        count = tiles[group[some], at]
        mine = (_spread(ids[some].view(np.uint64)) % count.astype(np.uint64)).astype(np.int64)
        row = np.repeat(some, count)
        other = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        tile, where = np.repeat(mine, count), np.repeat(at, count)
        low, high = np.minimum(tile, other), np.maximum(tile, other)
        keys.append(_spread(_spread(salt[row] + where.astype(np.uint64)) + (low * (1 << 20) + high).astype(np.uint64) * _ODD))
        rows.append(row)
        places.append(2 * np.where(low == high, 0, tile + 1) + step)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(places)


def touched(n: np.ndarray, t: float) -> np.ndarray:
    """The most grams of a text of n characters that are not in common with a text within the ratio."""
    return np.floor(2 * GRAM * (1 - t) / (2 - t) * n + 1e-9).astype(np.int64)


def entries(hashes: np.ndarray, offsets: np.ndarray, n: np.ndarray, counts: np.ndarray, t: float, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells the texts enter: key, row, place of the gram among the text's grams, rare ones first."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    df = counts[(hashes & np.uint64(SKETCH - 1)).astype(np.int64)]
    rank = np.minimum(255, np.floor(8 * np.log2(1.0 + df))).astype(np.uint64)
    order = np.lexsort((hashes, rank, row))
    place = np.arange(len(hashes)) - offsets[:-1][row]
    short = touched(n, t) >= size
    use = (place <= touched(n, t)[row]) & ~short[row]
    key, at = hashes[order][use], place[use]
    # what is short, or could pair with it, is in the cell of its kind
    limit = np.flatnonzero(short | (touched(np.floor(n * t / (2 - t)).astype(np.int64), t) >= np.floor(n * t / (2 - t)) - GRAM + 1))
    return np.concatenate([key, _spread(salt[limit] + np.uint64(77))]), np.concatenate([row[use], limit]), np.concatenate([at, np.zeros(len(limit), np.int64)])


def _pack(key: np.ndarray, row: np.ndarray, at: np.ndarray, texts: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((row, bucket))
    bucket, key, row, at = bucket[order], key[order] >> np.uint64(24), row[order], at[order]
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    out: list[list] = [[], [], []]
    for a, b in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
        used, local = np.unique(row[a:b], return_inverse=True)
        c = np.empty(b - a, CELL)
        c["low"], c["high"] = (key[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key[a:b] >> np.uint64(32)).astype(np.uint8)
        c["row"], c["at"] = local, at[a:b]
        for x, y in zip(out, (int(bucket[a]), texts[used].tobytes(), c.tobytes()), strict=True):
            x.append(y)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["bucket", "texts", "cells"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of a bucket; its entries by cell and length: key, text, place."""
    texts, cells, base = [np.zeros(0, TEXT)], [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for batch in batches:
        for x, c in zip(batch.column("texts"), batch.column("cells"), strict=True):
            x, c = np.frombuffer(x.as_buffer(), TEXT), np.frombuffer(c.as_buffer(), CELL)
            texts.append(x)
            cells.append((c["low"].astype(np.uint64) | (c["high"].astype(np.uint64) << np.uint64(32)), c["row"].astype(np.int64) + base, c["at"].astype(np.int64)))
            base += len(x)
    both = np.concatenate(texts)
    key, row, at = (np.concatenate(c) for c in zip(*cells, strict=True))
    order = np.lexsort((both["n"][row], key))
    return both, key[order], row[order], at[order]


def _like(both: np.ndarray, x: np.ndarray, y: np.ndarray, t: float, symmetric: bool) -> np.ndarray:
    """Of the pairs of texts x, y those whose histograms fit, as ids."""
    n = both["n"].astype(np.int64)
    edits = np.floor((1 - t) * (n[x] + n[y]) + 1e-9)
    p, q = both["h"][x], both["h"][y]
    ok = common(p, p) + common(q, q) - 2 * common(p, q) <= edits
    x, y, edits = x[ok], y[ok], edits[ok]
    ok = pairs_differ(both["g"][x], both["g"][y]) <= 3 * edits
    x, y = x[ok], y[ok]
    a, b = both["id"][x], both["id"][y]
    turned = a > b if symmetric else both["side"][x] == 1
    return np.unique(np.stack([np.where(turned, b, a), np.where(turned, a, b)], 1), axis=0)


def _windows(both: np.ndarray, rows: np.ndarray, columns: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different texts, one of rows and one of columns, both in the order of length, that FIRST cells of characters leave; the one
    of columns is no longer than the other."""
    n = both["n"].astype(np.int64)
    lengths = n[columns]
    begin, end = np.searchsorted(lengths, np.floor(n[rows] * t / (2 - t))), np.searchsorted(lengths, n[rows], "right")
    if not len(rows) or not len(columns):
        return
    h = both["h"][columns]
    first = np.argsort(-h.var(0), kind="stable")[:FIRST]
    # a distance is the sum of both less twice what is common, so at least so much is; that of columns is one more cell
    least = [np.maximum(-12000, np.floor((x[:, first].sum(1, dtype=np.int64) - (1 - t) * n[k] - 1e-9) / 2)).astype(np.int16) for x, k in ((both["h"][rows], rows), (h, columns))]
    mine = np.concatenate([both["h"][rows][:, first].astype(np.int16), np.full((len(rows), 1), 32767, np.int16)], 1)[:, :, None]
    reach = least[0] + np.int16(12000)
    space, sums = np.empty((FIRST + 1) * WIDE, np.int16), np.empty(WIDE, np.int16)
    held: list[np.ndarray] = []
    owners: list[tuple[int, int]] = []
    size = 0

    def pairs() -> tuple[np.ndarray, np.ndarray]:
        r, times = np.array(owners).T
        return rows[np.repeat(r, times)], columns[np.concatenate(held)]

    for c in range(0, len(columns), WIDE):
        laid = np.concatenate([h[c : c + WIDE, first].astype(np.int16).T, [np.int16(12000) - least[1][c : c + WIDE]]])
        width = laid.shape[1]
        for r in range(int(np.searchsorted(end, c, "right")), int(np.searchsorted(begin, c + width))):
            a, b = max(0, int(begin[r]) - c), min(width, int(end[r]) - c)
            if a >= b:
                continue
            small = np.minimum(laid[:, a:b], mine[r], out=space[: len(laid) * (b - a)].reshape(len(laid), b - a))
            found = (np.add.reduce(small, axis=0, out=sums[: b - a]) >= reach[r]).nonzero()[0]
            if len(found):
                held.append(found + (c + a))
                owners.append((r, len(found)))
                size += len(found)
                if size >= PAIRS:
                    yield pairs()
                    held, owners, size = [], [], 0
    if held:
        yield pairs()


def _meet_by_length(both: np.ndarray, key: np.ndarray, row: np.ndarray, at: np.ndarray, symmetric: bool, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts in cells of length bands.  Of two texts from the next band none is the shorter one; in a cell of two tiles only
    those of different ones meet."""
    edge = np.flatnonzero(np.append(np.diff(key.astype(np.int64), prepend=-1) != 0, True)) if len(key) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        some, own, tile = row[a:b], at[a:b] % 2 == 0, at[a:b] // 2
        part = 2 * tile + (0 if symmetric else both["side"][some])
        for p in np.unique(part):
            for q in np.unique(part):
                if (p // 2 != q // 2 or p // 2 == 0) and (symmetric or p % 2 != q % 2):
                    yield from _windows(both, some[part == p], some[(part == q) & own], t)


def _meet_by_grams(both: np.ndarray, key: np.ndarray, row: np.ndarray, at: np.ndarray, symmetric: bool, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts in cells of grams that lengths and places leave standing."""
    n = both["n"].astype(np.int64)
    length = n[row]
    code = (key << np.uint64(24)) | np.minimum(length, (1 << 24) - 1).astype(np.uint64)
    low = (key << np.uint64(24)) | np.minimum(np.floor(length * t / (2 - t)), (1 << 24) - 1).astype(np.uint64)
    begin, end = np.searchsorted(code, low), np.arange(len(code))  # partners that stand before, no longer than the text itself
    times = np.maximum(0, end - begin)
    total = np.cumsum(times)
    done = 0
    while done < len(times):
        before = total[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        count = times[done:stop]
        a = np.repeat(np.arange(done, stop), count)
        b = np.arange(total[stop - 1] - before) - np.repeat(total[done:stop] - count - before, count) + np.repeat(begin[done:stop], count)
        x, y = row[a], row[b]
        edits = np.floor((1 - t) * (n[x] + n[y]) + 1e-9)
        grams_x, grams_y = np.maximum(0, n[x] - GRAM + 1), np.maximum(0, n[y] - GRAM + 1)
        apart = np.abs(at[a] - at[b]) + np.abs((grams_x - at[a]) - (grams_y - at[b]))
        ok = (n[x] - n[y] <= edits) & (apart <= (2 * GRAM - 1) * edits)
        if not symmetric:
            ok &= both["side"][x] != both["side"][y]
        yield x[ok], y[ok]
        done = stop


def _meet(batches: Iterator[pa.RecordBatch], t: float, symmetric: bool, by_length: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids that a bucket's cells leave standing; of two sides, or each unordered pair of one."""
    both, key, row, at = _unpack(batches)
    seen: list[np.ndarray] = []
    for x, y in (_meet_by_length if by_length else _meet_by_grams)(both, key, row, at, symmetric, t):
        for k in range(0, len(x), PAIRS):
            one, other = x[k : k + PAIRS], y[k : k + PAIRS]
            ok = both["id"][one] != both["id"][other]
            seen.append(_like(both, one[ok], other[ok], t, symmetric))
        if len(seen) > 32:
            seen = [np.unique(np.concatenate(seen), axis=0)]
    if seen:
        pairs = np.unique(np.concatenate(seen), axis=0)
        yield pairs[:, 0], pairs[:, 1]


def candidates(left: DataFrame, right: DataFrame | None, t: float, by_length: bool | None = None) -> DataFrame:
    """id_l, id_r of texts of one kind that may reach the ratio t; with right None pairs of left, each once, smaller id left.

    left, right: id long (unique), kind, text.  Null and empty texts are no candidates.  by_length: the cells that texts enter; None lets
    the estimates choose.
    """
    if not 0 < t <= 1:
        raise ValueError("the ratio must be in (0, 1]")
    sides = [df.where("text is not null and text <> ''").select("kind", "text", "id", F.lit(k).cast("byte").alias("side")) for k, df in enumerate([left] + ([] if right is None else [right]))]
    symmetric = right is None
    values = sides[0] if symmetric else sides[0].unionByName(sides[1])
    spark = values.sparkSession
    counts, lengths = _sketch(values, t)
    if by_length is None:
        by_grams, by_bands = estimates(counts, lengths, t, symmetric)
        by_length = by_bands <= by_grams
    lengths = lengths.sum(0)
    shared = spark.sparkContext.broadcast(counts)  # 2 MB at any input
    texts = int(lengths.sum())
    # cells of length bands are few, large and unequal
    buckets = max((16 if by_length else 4) * spark.sparkContext.defaultParallelism, int(np.sqrt(max(1, texts)) / 20), texts >> 17)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                b = batch.slice(k, CHUNK)
                salt = _salts(b.column(0))
                chars, starts = characters(b.column(1).to_pylist())
                n = np.diff(starts)
                x = np.zeros(len(n), TEXT)
                x["id"], x["side"], x["n"] = np.asarray(b.column(2)), np.asarray(b.column(3)), n
                x["h"], x["g"] = histograms(chars, starts)
                if by_length:
                    key, row, at = length_entries(n, x["id"], salt, lengths, t)
                else:
                    h, offsets, _, _ = grams(b.column(1).to_pylist(), salt)
                    key, row, at = entries(h, offsets, n, counts, t, salt)
                if len(key):
                    yield _pack(key, row, at, x, buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _meet(batches, t, symmetric, by_length):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["id_l", "id_r"])

    packed = values.mapInArrow(enter, "bucket int, texts binary, cells binary").repartitionById(buckets, "bucket")
    return cut(packed.mapInArrow(meet, "id_l long, id_r long").distinct())
