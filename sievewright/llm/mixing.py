"""Mixing sources to target shares of the size in tokens, by pivotal dependent rounding (problem 9).

The largest total that every source can serve within its repeats fixes the expected number of copies of a
source's documents.  Its whole part every document has; its fraction is rounded so that the source's size in
tokens is kept: two documents with fractional probabilities pass mass, measured in tokens, to each other in a
random direction until one of them is integral.  Blocks of bounded size round their documents in parallel and
leave one fractional document each at most; these residuals are rounded again in a tree of fixed fan-in.
Every document keeps its expected number of copies, and a source misses its size by less than one document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .tokenizing import token_count

#: Documents of one block on average, and residuals combined by one node of the tree.
BLOCK = 1 << 16
FAN_IN = 256


def pivotal(probability: list[float], size: list[int], seed: int, last: bool) -> list[float]:
    """Probabilities after pairwise transfers: 0 or 1 but for one at most; with last that one is rounded too.

    sum(probability * size) is kept by every transfer, and each probability in expectation.
    """
    import random

    rng = random.Random(seed)
    p = list(probability)
    held = -1
    for k in range(len(p)):
        if not 1e-12 < p[k] < 1 - 1e-12:
            p[k] = float(round(p[k]))
            continue
        if held < 0:
            held = k
            continue
        a, b = size[held], size[k]
        up = min((1 - p[held]) * a, p[k] * b)
        down = min(p[held] * a, (1 - p[k]) * b)
        if rng.random() * (up + down) < down:
            p[held], p[k] = p[held] + up / a, p[k] - up / b
        else:
            p[held], p[k] = p[held] - down / a, p[k] + down / b
        for x in (held, k):
            if p[x] < 1e-9 or p[x] > 1 - 1e-9:
                p[x] = float(round(p[x]))
        fractional = [x for x in (held, k) if 0 < p[x] < 1]
        held = fractional[0] if fractional else -1
    if held >= 0 and last:
        p[held] = float(rng.random() < p[held])
    return p


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, tokens of every document; 0 tokens for null and empty texts."""
    return documents.select("doc_id", "source", token_count(F.col("text"), path).cast("long").alias("tokens"))


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, wanted_share, max_repeats, tokens, documents, expected: expected copies of a document.

    wanted_share is the target share among the sources that have tokens; a source without any can't be mixed in.
    Repeated targets of a source count once (largest share and repeats), null, zero or negative ones not at all.
    """
    t = (
        targets.where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    have = sizes.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    joined = t.join(have, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "documents": F.coalesce("documents", F.lit(0))})
    served = joined.where("tokens > 0")
    total = served.agg(F.sum("target_share").alias("shares"), F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("per_share")).first()
    shares, per_share = total["shares"] or 1.0, total["per_share"] or 0.0
    usable = F.col("tokens") > 0
    expected = F.least(F.col("target_share") * F.lit(per_share) / F.col("tokens"), F.col("max_repeats").cast("double"))
    return joined.withColumns({
        "wanted_share": F.when(usable, F.col("target_share") / F.lit(shares)).otherwise(0.0),
        "expected": F.when(usable, expected).otherwise(0.0),
    })


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, source, tokens, copies of the documents that are used, each at least once and at most max_repeats times.

    Documents without tokens, without a source or of sources without a target are not used.  sizes is read more than
    once: pass a table or a checkpoint.  Equal doc_ids are separate documents; empty tables give an empty result.
    """
    shares = plan(sizes, targets).where("expected > 0").select("source", "expected", "documents")
    blocks = F.ceil(F.col("documents") / F.lit(BLOCK))
    rows = sizes.where("tokens > 0").join(F.broadcast(shares.limit(10_000)) if shares.count() <= 10_000 else shares, "source").select(
        "doc_id", "source", "tokens", F.floor("expected").cast("long").alias("whole"),
        (F.col("expected") - F.floor("expected")).alias("p"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), blocks).alias("node"),
        blocks.alias("nodes"),
    )
    deepest = shares.agg(F.max(blocks)).first()[0] or 0
    done, level = None, 0
    while True:
        last = deepest <= 1

        def round_block(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")  # what stays over is small
            import zlib

            number = zlib.crc32(repr((seed, level, str(key[0]), int(key[1]))).encode())
            part["p"] = pivotal(part["p"].tolist(), part["tokens"].tolist(), number, last)
            return part

        out = rows.groupBy("source", "node").applyInPandas(round_block, rows.schema)
        if last:
            return (
                (out if done is None else done.unionByName(out))
                .select("doc_id", "source", "tokens", (F.col("whole") + F.col("p").cast("long")).cast("int").alias("copies"))
                .where("copies > 0")
            )
        out = cut(out)
        settled = out.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        rows = out.where("p > 0 and p < 1").withColumn("node", F.floor(F.col("node") / F.lit(FAN_IN)))
        deepest = -(-deepest // FAN_IN)
        level += 1


def reached(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, wanted_share, available_tokens, mixed_tokens, actual_share, documents_used, most_copies of each target."""
    p = plan(sizes, targets)
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents_used"), F.max("copies").alias("most_copies"))
    total = used.agg(F.sum("mixed_tokens")).first()[0] or 1
    zero = F.lit(0)
    return p.join(used, "source", "left").select(
        "source", "target_share", "wanted_share", F.col("tokens").alias("available_tokens"),
        F.coalesce("mixed_tokens", zero).alias("mixed_tokens"), (F.coalesce("mixed_tokens", zero) / F.lit(total)).alias("actual_share"),
        F.coalesce("documents_used", zero).alias("documents_used"), F.coalesce("most_copies", zero).alias("most_copies"), "max_repeats",
    )
