"""Evaluation passages inside training documents, by spaced-seed hashing (problem 7).

Items (benchmark entries, records of validation and test) and documents are strings of words.  A seed is a
fixed mask over ``SPAN`` consecutive words that ignores some positions, so it also matches passages in which
the words at those positions were substituted.  Both sides hash their text under every mask and keep, of each
``window`` neighbouring seeds of a mask, the one of the smallest hash: texts that share ``run`` =
SPAN + window - 1 consecutive words keep at least one seed of every mask in common, so no such pair is missed
while about 2 / (window + 1) of the seeds travel.  If all seeds are kept, the masks find every passage of 20 words
with one substitution, 92 percent of those with two, and all of 30 words with up to three.

Seeds travel alone, with the id of their text and their place; only for places that met are words fetched, once from
each text.  Around each hit they are compared outwards: exactly, for the longest run of equal words, and with up to
``tolerance`` substitutions between matching words, many hits at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .packed import Bloom, bloom_of, id_hashes, merged_bloom
from .words import mix, words

#: Words a seed covers, and the masks: 1 takes the word part in the hash, 0 ignores it.  Whichever word of 20 differs, some place has
#: a mask that ignores it, and so for 175 of the 190 ways in which two do.
SPAN = 12
MASKS = ("111101110111", "110111011111")
#: Consecutive words that make a leak.
RUN = 20
#: Substituted words an extended overlap may bridge, one at a time.
TOLERANCE = 2
_CHUNK = 2048


def seeds(h: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of the kept seeds of all masks.

    A text with at least SPAN but fewer than SPAN + window - 1 words keeps the smallest seed it has.
    """
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:n] == row[SPAN - 1 :]
    all_hashes, all_places = [], []
    for number, mask in enumerate(MASKS):
        x = np.full(n, number + 1, np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        x = mix(x)
        rank = np.where(inside, x, np.uint64(0xFFFFFFFFFFFFFFFF))
        # the minimum of each window, by doubling; windows that cross a text's end are those of its last seeds
        least, width = rank, 1
        while width < window:
            step = min(width, window - width)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            width += step
        keep = np.zeros(n, bool)
        if len(least):
            # a seed is kept if it is the minimum of some window that lies wholly inside its text
            whole = row[: len(least)] == row[SPAN + window - 2 :][: len(least)]
            wanted = np.where(whole, least, np.uint64(0xFFFFFFFFFFFFFFFF))
            top = np.concatenate([wanted, np.full(n - len(wanted), 0xFFFFFFFFFFFFFFFF, np.uint64)])
            for k in range(window):
                at = np.zeros(n, bool)
                at[k:] = (rank[k:] == top[: n - k]) & (top[: n - k] != np.uint64(0xFFFFFFFFFFFFFFFF))
                keep |= at
        length = np.diff(offsets)
        short = np.flatnonzero((length >= SPAN) & (length < SPAN + window - 1))
        for r in short:
            a = offsets[r]
            keep[a + int(np.argmin(rank[a : a + length[r] - SPAN + 1]))] = True
        place = np.flatnonzero(keep & inside)
        all_hashes.append(x[place])
        all_places.append(place)
    return np.concatenate(all_hashes), np.concatenate(all_places)


def item_texts(benchmark: DataFrame, samples: DataFrame, splits: DataFrame) -> DataFrame:
    """item_id, text of benchmark entries and of the records in validation or test; null texts give no row."""
    entries = benchmark.select(F.col("benchmark_id").alias("item_id"), F.explode(F.array("task_text", "patch_text")).alias("text"))
    held = splits.where("split in ('validation', 'test')").select("sample_id")
    records = samples.join(held, "sample_id", "left_semi").select(
        F.col("sample_id").alias("item_id"), F.explode(F.concat(F.array("task_text"), F.coalesce("patch_texts", F.array().cast("array<string>")))).alias("text")
    )
    return entries.union(records).where("item_id is not null and text is not null")


_SEED_DDL = "seed long, key long, at int"


def _places(seed: np.ndarray) -> np.ndarray:
    return id_hashes(pa.array(seed.view(np.int64)))


def _seed_rows(window: int, bloom):
    """Rows of the kept seeds that the Bloom filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(k, _CHUNK)
                h, offsets = words(part.column(1))
                seed, place = seeds(h, offsets, window)
                hit = bloom.value.has(_places(seed))
                seed, place = seed[hit], place[hit]
                if len(seed):
                    row = np.searchsorted(offsets, place, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), part.column(0).take(pa.array(row)), pa.array((place - offsets[row]).astype(np.int32))], ["seed", "key", "at"])

    return run


def _seed_bloom(items: DataFrame, window: int, n: int) -> Bloom:
    """Bloom filter of the items' seeds."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        found = [seeds(*words(batch.slice(k, _CHUNK).column(1)), window)[0] for k in range(0, batch.num_rows, _CHUNK)]
        return _places(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    return merged_bloom(items, n, hashes)


def _windows(texts: DataFrame, places: DataFrame, reach: int, outside: int) -> DataFrame:
    """key, at, near: the words up to reach before and behind each wanted place, 32 bits each; outside, under 2, where the text ends.

    texts: key, text.  places: key, at.  A text is read once for all its places, whose number its length bounds.
    """
    wanted = places.groupBy("key").agg(F.collect_set("at").alias("places"))
    some = texts.sparkSession.sparkContext.broadcast(bloom_of(wanted, "key", wanted.count()))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(some.value.has(id_hashes(b.column(0)))))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                h, offsets = words(part.column(1))
                x = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(2)
                at = part.column(2)
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(at.offsets)))
                flat = np.asarray(at.flatten()).astype(np.int64)
                for m in range(0, len(flat), 1 << 14):
                    r, f = row[m : m + (1 << 14)], flat[m : m + (1 << 14)]
                    where = (offsets[r] + f)[:, None] + np.arange(-reach, SPAN + reach)
                    inside = (where >= offsets[r][:, None]) & (where < offsets[r + 1][:, None])
                    near = np.where(inside, x[np.clip(where, 0, max(0, len(x) - 1))] if len(x) else np.uint32(0), np.uint32(outside)).astype(np.uint32)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(f.astype(np.int32)), pa.array([n.tobytes() for n in near], pa.binary())], ["key", "at", "near"])

    few = texts.select("key", "text").mapInArrow(only, "key long, text string").dropDuplicates(["key"])
    return few.join(wanted, "key").select("key", "text", "places").mapInArrow(fetch, "key long, at int, near binary")


def _extend(same: np.ndarray, reach: int, tolerance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of equal-word marks around a seed, which starts at column reach: the longest exact run that touches the seed,
    and length and equal words of the overlap with substitutions."""
    n, width = same.shape
    column = np.arange(width)
    before = np.maximum.accumulate(np.where(same, -1, column), 1)
    behind = np.minimum.accumulate(np.where(same, width, column)[:, ::-1], 1)[:, ::-1]
    run = np.where(same, behind - before - 1, 0)
    exact = run[:, reach : reach + SPAN].max(1, initial=0)
    sides = []
    for part in (same[:, reach:], same[:, :reach][:, ::-1]):
        good = part & (np.cumsum(~part, 1) <= tolerance)  # ends on an equal word
        length = np.where(good.any(1), part.shape[1] - np.argmax(good[:, ::-1], 1), 0)
        sides.append((length, (part & (np.arange(part.shape[1]) < length[:, None])).sum(1)))
    return exact, sides[0][0] + sides[1][0], sides[0][1] + sides[1][1]


_AT_DDL = "seed long, key long, at int, near binary"


def _seed_places(bloom, reach: int, beyond: int):
    """Rows of all seeds that the Bloom filter lets through, with a byte of each word up to reach words around; beyond, under
    2, stands for what is outside of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(k, _CHUNK)
                h, offsets = words(part.column(1))
                seed, place = seeds(h, offsets, 1)
                if len(seed):
                    hit = bloom.value.has(_places(seed))
                    seed, place = seed[hit], place[hit]
                if len(seed):
                    row = np.searchsorted(offsets, place, "right") - 1
                    at = place[:, None] + np.arange(-reach, SPAN + reach)
                    byte = (h >> np.uint64(40)).astype(np.uint8) | np.uint8(2)
                    near = np.where((at >= offsets[row][:, None]) & (at < offsets[row + 1][:, None]), byte[np.clip(at, 0, len(h) - 1)], np.uint8(beyond)).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(seed.view(np.int64)), part.column(0).take(pa.array(row)), pa.array((place - offsets[row]).astype(np.int32)), pa.array([x.tobytes() for x in near], pa.binary()),
                    ], ["seed", "key", "at", "near"])

    return run


def _diagonal(d: np.ndarray, q: np.ndarray, shift: int, places: np.ndarray, tolerance: int) -> tuple[int, int, int]:
    """As _extend, over all seeds of one diagonal (document place - item place = shift) and without a limit of reach."""
    exact = overlap = equal = 0
    first = max(0, shift)
    a, b = d[first:], q[max(0, -shift) :]
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    hit = np.zeros(n + 1, bool)
    hit[places - first] = True
    edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
    met = np.concatenate([[0], np.cumsum(hit)])
    starts, stops = edges[0::2], edges[1::2]
    meets = met[stops] > met[np.maximum(0, starts - SPAN + 1)]
    exact = int((stops - starts)[meets].max()) if meets.any() else 0
    wrong = np.flatnonzero(~same)
    # a seed whose word before is equal and starts a seed too extends as that one does
    for p in np.flatnonzero(hit[:n] & ~np.concatenate([[False], hit[: n - 1] & same[: n - 1]])):
        k = int(np.searchsorted(wrong, p))
        lo = int(wrong[k - tolerance - 1]) + 1 if k > tolerance else 0
        hi = int(wrong[k + tolerance]) if k + tolerance < len(wrong) else n
        good = lo + np.flatnonzero(same[lo:hi])
        if len(good) and int(good[-1]) + 1 - int(good[0]) > 0:
            overlap, equal = max(overlap, int(good[-1]) + 1 - int(good[0])), max(equal, len(good))
    return exact, overlap, equal


def all_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, tolerance: int = TOLERANCE) -> DataFrame:
    """As leaks, from all seeds and with true lengths: a pair is found if any seed of any mask is common to a passage.

    Seeds travel with a byte of each word around, which refutes most hits and no leak; those of one diagonal that are left
    are one hit, and the texts of a pair meet once to be compared.
    """
    broadcast = documents.sparkSession.sparkContext.broadcast
    reach = run + tolerance  # as far as it takes to tell whether run words overlap
    kind = dict(documents.dtypes)["doc_id"]
    docs = documents.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), "text")
    wanted = cut(items.where("item_id is not null and text is not null").select("item_id", F.xxhash64("text").alias("key"), "text").distinct())
    n = wanted.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    only = wanted.select("key", "text").dropDuplicates(["key"])

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        found = [seeds(*words(batch.slice(k, _CHUNK).column(1)), 1)[0] for k in range(0, batch.num_rows, _CHUNK)]
        return _places(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    d = cut(docs.select("key", "text").mapInArrow(_seed_places(broadcast(merged_bloom(only, n // 3 + 1, hashes)), reach, 0), _AT_DDL).distinct()).toDF("seed", "doc", "doc_at", "doc_near")
    q = only.mapInArrow(_seed_places(broadcast(bloom_of(d, "seed", d.count())), reach, 1), _AT_DDL).toDF("seed", "item", "item_at", "item_near")

    def refute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("doc_near", "item_near"))
            length = np.zeros(b.num_rows, np.int64)
            same = x == y
            for part in (same[:, reach:], same[:, :reach][:, ::-1]):
                good = part & (np.cumsum(~part, 1) <= tolerance)
                length += np.where(good.any(1), part.shape[1] - np.argmax(good[:, ::-1], 1), 0)
            yield b.select(["doc", "item", "doc_at", "item_at"]).filter(pa.array(length >= run))

    near = d.join(q, "seed").select("doc", "item", "doc_at", "item_at", "doc_near", "item_near").mapInArrow(refute, "doc long, item long, doc_at int, item_at int")
    hits = near.groupBy("doc", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.collect_set("doc_at").alias("places"))
    pairs = hits.groupBy("doc", "item").agg(F.collect_list(F.struct("shift", "places")).alias("diagonals"))
    texts = docs.select("key", "text").dropDuplicates(["key"])
    both = pairs.join(texts.toDF("doc", "doc_text"), "doc").join(only.toDF("item", "item_text"), "item").select("doc", "item", "diagonals", "doc_text", "item_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                (dw, do), (qw, qo) = words(b.column(3)), words(b.column(4))
                got = []
                for r, diagonals in enumerate(b.column(2).to_pylist()):
                    x, y = dw[do[r] : do[r + 1]], qw[qo[r] : qo[r + 1]]
                    each = [_diagonal(x, y, g["shift"], np.array(g["places"], np.int64), tolerance) for g in diagonals]
                    kept = [e for e in each if e[1] >= run]
                    got.append(tuple(max(e) for e in zip(*kept, strict=True)) if kept else (0, 0, 0))
                e, o, s = (np.array(x, np.int32) for x in zip(*got, strict=True))
                out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(e), pa.array(o), pa.array(s)], ["doc", "item", "exact_words", "overlap_words", "equal_words"])
                yield out.filter(pa.array(o >= run))

    found = both.mapInArrow(verify, "doc long, item long, exact_words int, overlap_words int, equal_words int")
    named = found.join(docs.select("doc_id", F.col("key").alias("doc")), "doc").join(wanted.select("item_id", F.col("key").alias("item")), "item")
    return named.groupBy(F.col("doc_id").cast(kind).alias("doc_id"), "item_id").agg(*[F.max(c).alias(c) for c in ("exact_words", "overlap_words", "equal_words")])


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, tolerance: int = TOLERANCE) -> DataFrame:
    """doc_id, item_id, exact_words, overlap_words, equal_words of the documents and items that share a passage.

    documents: doc_id, text; items: item_id, text.  exact_words is the longest run of consecutive words seen
    around a common seed, at least min(run, its true length); overlap_words is the longest passage around one when
    up to ``tolerance`` words on either side may be substituted, equal_words its equal words; both are measured up to
    2 * run words from the seed.  Pairs whose overlap_words stay below run are no leak and left out.

    Pairs with run equal consecutive words are complete.  Null and wordless texts match nothing, repeated items
    and documents count once, empty tables give an empty result.
    """
    if run <= SPAN:
        raise ValueError(f"run must be more than {SPAN} words")
    spark = documents.sparkSession
    window = run - SPAN + 1
    reach = 2 * run
    broadcast = spark.sparkContext.broadcast
    key = lambda name: F.xxhash64(F.col(name), F.col("text")).alias("key")
    docs = documents.where("text is not null and doc_id is not null").select("doc_id", key("doc_id"), "text")
    wanted = cut(items.where("item_id is not null and text is not null").select("item_id", key("item_id"), "text").distinct())
    n = wanted.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    # each side only sends the seeds that the other side may hold; filters of bounded size, beyond which more seeds, of 20 bytes, travel
    bloom = broadcast(_seed_bloom(wanted.select("key", "text"), window, n // 12 + 1))
    d = cut(docs.select("key", "text").mapInArrow(_seed_rows(window, bloom), _SEED_DDL)).toDF("seed", "doc", "doc_at")
    q = wanted.select("key", "text").mapInArrow(_seed_rows(window, broadcast(bloom_of(d, "seed", d.count()))), _SEED_DDL).toDF("seed", "item", "item_at")
    hits = cut(d.join(q, "seed").select("doc", "doc_at", "item", "item_at").distinct())
    left = _windows(docs, hits.select(F.col("doc").alias("key"), F.col("doc_at").alias("at")), reach, 0).toDF("doc", "doc_at", "doc_near")
    right = _windows(wanted, hits.select(F.col("item").alias("key"), F.col("item_at").alias("at")), reach, 1).toDF("item", "item_at", "item_near")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("doc_near", "item_near"))
                e, o, s = (v.astype(np.int32) for v in _extend(x == y, reach, tolerance))
                out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(e), pa.array(o), pa.array(s)], ["doc", "item", "exact_words", "overlap_words", "equal_words"])
                yield out.filter(pa.array(o >= run))

    met = hits.join(left, ["doc", "doc_at"]).join(right, ["item", "item_at"]).select("doc", "item", "doc_near", "item_near")
    measures = ("exact_words", "overlap_words", "equal_words")
    found = met.mapInArrow(verify, "doc long, item long, exact_words int, overlap_words int, equal_words int").groupBy("doc", "item").agg(*[F.max(c).alias(c) for c in measures])
    named = found.join(docs.select("doc_id", F.col("key").alias("doc")), "doc").join(wanted.select("item_id", F.col("key").alias("item")), "item")
    return named.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in measures])
