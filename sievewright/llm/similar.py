"""Pairs of texts whose word bags are alike, over collections too large to compare pairwise (problems 1 and 5).

The similarity of two texts is 2c / (m + n): m and n are their numbers of words, c the number of words in
common, repeated words counted as often as they occur in both.  A text without words is similar to none.

Stages, each a distributed pass whose state is bounded:

1. one scan hashes every text to its bag identity and sums the segment counts of the corpus into a sketch of
   fixed size, which only decides the order of cells;
2. a second scan enters each different bag into its cells (``packed``); copies of a bag seen by a task are
   entered once, so a bag that a third of all rows share travels a few times only;
3. each bucket joins its cells and refutes pairs by the Manhattan distance of the embeddings;
4. the bags of what is left, found again by a Bloom filter, are joined to the pairs and compared exactly.

Different bags are linked as classes; copies are members of their class and are only multiplied into record
pairs where a result asks for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from . import packed
from .banded import indel_distances
from .words import elements, mix, words

#: Bits of a text's role in a search between splits.
TRAIN, EVALUATION = 1, 2
#: Evaluation ids up to which their filter, of ten bits an id, is broadcast: 16 MB.
ROLE_IDS = (1 << 27) // 10
_RECENT = 1 << 18


@dataclass
class Found:
    """members: kind, id, lo, hi, m - one row for each different (kind, id, bag).  links: lo_a < lo_b of similar different bags."""

    members: DataFrame
    links: DataFrame


def sample_texts(samples: DataFrame) -> DataFrame:
    """kind, id, text of every task text and every patch; null ids, null and blank texts give no row."""
    one = F.array(F.struct(F.lit("task").alias("kind"), F.col("task_text").alias("text")))
    many = F.transform(F.coalesce(F.col("patch_texts"), F.array().cast("array<string>")), lambda p: F.struct(F.lit("patch").alias("kind"), p.alias("text")))
    return (
        samples.select(F.col("sample_id").alias("id"), F.explode(F.concat(one, many)).alias("x"))
        .select("x.kind", "id", "x.text")
        .where(F.col("id").isNotNull() & F.col("text").isNotNull())
    )


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, elements and offsets; the kind (column 0) keeps elements of different kinds apart."""
    for k in range(0, batch.num_rows, packed.CHUNK):
        part = batch.slice(k, packed.CHUNK)
        h, offsets = words(part.column(2))
        e = elements(h, offsets)
        kinds = part.column(0).dictionary_encode()
        salt = np.array([int.from_bytes(x.encode()[:8], "little") for x in kinds.dictionary.to_pylist()] or [0], np.uint64)
        e ^= mix(salt[np.asarray(kinds.indices)])[np.repeat(np.arange(part.num_rows), np.diff(offsets))]
        yield part, e, offsets


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << packed.SKETCH_BITS, np.int64)
    for batch in batches:
        for part, e, offsets in _chunks(batch):
            counts += packed.segment_counts(e)
            lo, hi = packed.bag_ids(e, offsets)
            m = np.diff(offsets)
            some = pa.array(m > 0)
            out = pa.RecordBatch.from_pydict({"kind": part.column(0), "id": part.column(1), "lo": pa.array(lo.view(np.int64)), "hi": pa.array(hi.view(np.int64)), "m": pa.array(m.astype(np.int64)), "block": pa.nulls(part.num_rows, pa.int32()), "counts": pa.nulls(part.num_rows, pa.binary())})
            yield out.filter(some)
    b = packed.blocks(counts)
    none = {k: pa.nulls(b.num_rows, t) for k, t in (("kind", pa.string()), ("id", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("m", pa.int64()))}
    yield pa.RecordBatch.from_pydict(none | {"block": b.column(0), "counts": b.column(1)})


def find(texts: DataFrame, threshold: float = 0.8, evaluation_ids: DataFrame | None = None, hot: int = 16384, role_ids: int = ROLE_IDS) -> Found:
    """Similar pairs among the rows (kind, id, text).

    evaluation_ids: a one-column table; if given, only pairs of one text of these ids and one of the others are
    searched, by segment join: of the element string of an evaluation text, in the corpus-wide order, segments of one
    element, or two where elements are frequent, are taken, so many that edits within the budget can't destroy all;
    equal substrings of training strings are looked up for them, at the positions that the budget allows; and the rest is
    verified by banded dynamic programming.  Up to ROLE_IDS ids their role travels in a filter sized for them, beyond
    in a join with the texts; either way pairs of the wrong roles are dropped by exact ids before they are verified.

    Null or wordless texts match nothing; equal rows count once; an empty table gives empty results.
    hot: corpus frequency above which an element is a cell with its neighbour only; no value changes the result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = texts.sparkSession
    t, crossing = threshold, evaluation_ids is not None
    profile = cut(texts.mapInArrow(_profile, "kind string, id string, lo long, hi long, m long, block int, counts binary"))
    members = cut(profile.where("block is null").select("kind", "id", "lo", "hi", "m").distinct())
    counts = packed.sum_blocks(profile.where("block is not null"), 1 << packed.SKETCH_BITS)
    size = profile.where("block is null").count()
    buckets = packed.bucket_count(size, spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(counts.astype(np.int64))
    roles, ids, entering = None, None, texts
    if crossing:
        ids = evaluation_ids.toDF("id").where("id is not null").distinct()
        n = ids.count()
        if n <= role_ids:
            roles = spark.sparkContext.broadcast(packed.bloom_of(ids, "id", n))
        else:
            known = F.when(F.col("held"), EVALUATION).otherwise(TRAIN).cast("byte").alias("role")
            entering = texts.join(ids.withColumn("held", F.lit(True)), "id", "left").select("kind", "id", "text", known)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        klass = packed.classes(counts)
        least = packed.halves(counts, klass, hot)
        recent = np.zeros((3, _RECENT), np.uint64)  # last bag of each slot, by role
        for batch in batches:
            for part, e, offsets in _chunks(batch):
                lo, hi = packed.bag_ids(e, offsets)
                role = np.full(part.num_rows, TRAIN if roles else TRAIN | EVALUATION, np.uint8)
                if part.num_columns > 3:
                    role = np.asarray(part.column(3)).astype(np.uint8)
                elif roles:
                    role[roles.value.has(packed.id_hashes(part.column(1)))] = TRAIN | EVALUATION  # a hit may be false
                slot = (lo >> np.uint64(40)).astype(np.int64) % _RECENT
                new = (recent[role % 3, slot] != lo) & (np.diff(offsets) > 0)
                recent[role[new] % 3, slot[new]] = lo[new]
                _, first = np.unique(np.where(new, lo ^ role.astype(np.uint64), np.uint64(0)), return_index=True)
                new &= np.isin(np.arange(part.num_rows), first)
                if not new.any():
                    continue
                keep = np.repeat(new, np.diff(offsets))
                m = np.diff(offsets)[new]
                e, offsets = e[keep], np.concatenate([[0], np.cumsum(m)])
                rows = np.repeat(np.arange(len(m)), m)
                key, at, place = packed.cells(e, offsets, counts, klass, t, hot)
                if len(key):
                    x = np.zeros(len(m), packed.TEXT)
                    frequent = packed.is_frequent(e, klass, least)
                    x["id"], x["m"], x["role"], x["v"] = lo[new], m, role[new], packed.embed(e, rows, len(m), frequent)
                    x["rare"] = np.minimum(np.bincount(rows[~frequent], minlength=len(m)), (1 << 16) - 1)
                    yield packed.pack(key, at, place, x, buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, key, text, place = packed.unpack(batches)
        held: list[np.ndarray] = []
        for a, b in packed.pairs(x, key, text, place, t, crossing):
            held.append(np.unique((np.minimum(a, b) << 32) | np.maximum(a, b)))
            if len(held) > 64:
                held = [np.unique(np.concatenate(held))]
        got = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        for k in range(0, len(got), packed.PAIRS):
            p = got[k : k + packed.PAIRS]
            a, b = x["id"][p >> 32].view(np.int64), x["id"][p & 0xFFFFFFFF].view(np.int64)
            yield pa.RecordBatch.from_pydict({"lo_a": pa.array(np.minimum(a, b)), "lo_b": pa.array(np.maximum(a, b))})

    met = entering.mapInArrow(enter, packed.BLOB_DDL).repartitionById(buckets, "bucket").mapInArrow(meet, "lo_a long, lo_b long").distinct()
    if crossing:
        met = cut(met)
        used = met.select(F.explode(F.array("lo_a", "lo_b")).alias("lo")).distinct()
        held = members.join(used, "lo", "left_semi").join(ids.withColumn("held", F.lit(True)), "id", "left")
        sides = held.groupBy("lo").agg(F.bool_or(F.col("held").isNotNull()).alias("e"), F.bool_or(F.col("held").isNull()).alias("n"))
        met = met.join(sides.toDF("lo_a", "e_a", "n_a"), "lo_a").join(sides.toDF("lo_b", "e_b", "n_b"), "lo_b").where("(e_a and n_b) or (n_a and e_b)").select("lo_a", "lo_b")
    met = cut(met)
    return Found(members, _verified(texts, members, met, t, crossing))


def _verified(texts: DataFrame, members: DataFrame, met: DataFrame, t: float, crossing: bool) -> DataFrame:
    """Of the met pairs those whose bags are alike: lo_a, lo_b."""
    spark = texts.sparkSession
    wanted = met.select(F.explode(F.array("lo_a", "lo_b")).alias("lo")).distinct()
    stand_in = cut(members.join(wanted, "lo").groupBy("lo").agg(F.min(F.struct("id", "kind")).alias("x")).select("lo", "x.id", "x.kind"))
    n = stand_in.count()
    bloom = spark.sparkContext.broadcast(packed.bloom_of(stand_in, "id", n))
    bag_bloom = spark.sparkContext.broadcast(packed.bloom_of(stand_in, "lo", n))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom.value.has(packed.id_hashes(batch.column(1)))))
            for part, e, offsets in _chunks(batch):
                lo, _ = packed.bag_ids(e, offsets)
                wanted = bag_bloom.value.has(packed.id_hashes(pa.array(lo.view(np.int64))))
                e, lo, part = e[np.repeat(wanted, np.diff(offsets))], lo[wanted], part.filter(pa.array(wanted))
                offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[wanted])])
                rows = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                e = e[np.lexsort((e, rows))]
                data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int64).tobytes()), pa.py_buffer(e.tobytes())])
                yield pa.RecordBatch.from_pydict({"kind": part.column(0), "id": part.column(1), "lo": pa.array(lo.view(np.int64)), "bag": data.cast(pa.binary())})

    bag = (
        texts.mapInArrow(bags, "kind string, id string, lo long, bag binary")
        .join(stand_in.toDF("lo", "x", "y"), "lo")
        .where("id = x and kind = y")
        .select("lo", "bag")
        .dropDuplicates(["lo"])
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(c)] for c in ("bag_a", "bag_b"))
                total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
                budget = np.floor((1 - t) * total + 1e-9).astype(np.int64)
                if crossing:
                    differ = indel_distances(a, b, budget)
                else:
                    differ = np.array([len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
                yield part.select(["lo_a", "lo_b"]).filter(pa.array(differ <= budget))

    left = bag.select(F.col("lo").alias("lo_a"), F.col("bag").alias("bag_a"))
    right = bag.select(F.col("lo").alias("lo_b"), F.col("bag").alias("bag_b"))
    return cut(met.join(left, "lo_a").join(right, "lo_b").select("lo_a", "lo_b", "bag_a", "bag_b").mapInArrow(compare, "lo_a long, lo_b long"))


def record_pairs(found: Found) -> DataFrame:
    """kind, a, b with a < b: every pair of different records of similar or equal bags, each once for a kind."""
    m = found.members
    many = m.groupBy("kind", "lo", "hi").count().where("count > 1").select(F.col("lo").alias("lo_a"), F.col("lo").alias("lo_b"))
    both = found.links.unionByName(many)
    left = m.select("kind", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("id").alias("x"))
    right = m.select(F.col("kind").alias("kind_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("id").alias("y"))
    same = (F.col("lo_a") != F.col("lo_b")) | ((F.col("hi_a") == F.col("hi_b")) & (F.col("x") < F.col("y")))
    return (
        both.join(left, "lo_a")
        .join(right, "lo_b")
        .where(same & (F.col("x") != F.col("y")) & (F.col("kind") == F.col("kind_b")))
        .select("kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
