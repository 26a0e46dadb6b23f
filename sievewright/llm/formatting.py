"""Copies that differ in formatting only (problem 4).

Records get a canonical key: all characters but a-z and 0-9 dropped after lower-casing, patches sorted.
The keys are range-partitioned by their hash and sorted by hash and key (Spark sorts externally), adjacent rows
are compared by their full keys, and each run gives its smallest id and its length.  The ranges are over
(hash, id), so a run that holds a third of all rows spreads over as many partitions as it needs, and the sample
from which Spark takes the ranges holds no texts; runs that may cross partitions are merged by their full keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def canonical_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def canonical_records(samples: DataFrame) -> DataFrame:
    """sample_id, key of each record with a letter or digit in its task text and in a patch; one row for an id.

    Patches that are null, blank or without letters and digits don't count, nor does a null id; an id
    delivered repeatedly is one record.
    """
    patches = F.array_sort(F.filter(F.transform("patch_texts", lambda p: canonical_text(F.coalesce(p, F.lit("")))), lambda p: p != ""))
    return (
        samples.select("sample_id", canonical_text(F.col("task_text")).alias("task"), patches.alias("patches"))
        .where("sample_id is not null and task <> '' and size(patches) > 0")
        .select("sample_id", F.concat_ws("\n", "task", F.array_join("patches", "\n")).alias("key"))
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The run of each row: its number in the partition and its first id; and, as edge, the full key of runs near the partition's ends.

    Only a run whose hash is that of the partition's first or last row can go on elsewhere; one row of it, in each
    batch it is met in, has the key.  The last hash of every batch is taken for a last one, which does no harm.
    """
    run, last, first_hash, first_id = -1, None, None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h, key, ids = np.asarray(batch.column(0)), batch.column(1), batch.column(2)
        if first_hash is None:
            first_hash = h[0]
        new = np.ones(n, bool)
        new[0] = last is None or key[0].as_py() != last
        new[1:] = np.asarray(pc.not_equal(key.slice(1), key.slice(0, n - 1)))
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        firsts = ids.take(pa.array(np.maximum(start, 0)))
        if start[0] < 0:
            firsts = pc.if_else(pa.array(start < 0), pa.scalar(first_id, pa.string()), firsts)
        numbers = run + np.cumsum(new)
        mark = new.copy()
        mark[0] = True
        mark &= (h == first_hash) | (h == h[-1])
        yield pa.RecordBatch.from_pydict({"part": batch.column(3), "run": pa.array(numbers), "first_id": firsts, "sample_id": ids, "edge": pc.if_else(pa.array(mark), key, pa.scalar(None, pa.string()))})
        run, last, first_id = int(numbers[-1]), key[n - 1].as_py(), firsts[n - 1].as_py()


def members(samples: DataFrame) -> DataFrame:
    """first_id, sample_id of every record that takes part, first_id being its set's smallest id.

    Canonical records are made once and kept, so choosing the ranges doesn't make them again.
    """
    spark = samples.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = cut(canonical_records(samples).withColumn("h", F.xxhash64("key")))
    sorted_ = records.repartitionByRange(n, "h", "sample_id").sortWithinPartitions("h", "key", "sample_id")
    rows = sorted_.select("h", "key", "sample_id", F.spark_partition_id().alias("part"))
    marked = cut(rows.mapInArrow(_runs, "part int, run long, first_id string, sample_id string, edge string"))
    # a run that may go on in another partition has a row or a few with its full key, by which it is matched
    ends = marked.where("edge is not null").groupBy("part", "run", "edge").agg(F.min("first_id").alias("first_id"))
    joined = ends.groupBy("edge").agg(F.min("first_id").alias("whole_first")).join(ends, "edge").select("part", "run", "whole_first")
    return marked.join(joined, ["part", "run"], "left").select(F.coalesce("whole_first", "first_id").alias("first_id"), "sample_id").distinct()


def sets(samples: DataFrame) -> DataFrame:
    """first_id, n_copies of every set of copies, those of one record too; counted by partial sums, so a giant set is a row a task."""
    return members(samples).groupBy("first_id").agg(F.count(F.lit(1)).alias("n_copies"))


def copies(samples: DataFrame) -> DataFrame:
    """first_id, sample_id of the records that are another's copy.

    Repeated rows of an id count once; columns beside sample_id, task_text and patch_texts are ignored; an empty table gives an
    empty result.
    """
    return members(samples).where("sample_id <> first_id")
