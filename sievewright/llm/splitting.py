"""Splits that keep whole components together, by component swap search (problem 6).

A component is all records of one entity.  Components start in the split their hash falls into; then rounds
of parallel annealing move components between splits, and exchange them, to reduce the deviation of sizes and
of label counts from the targets.  A round deals the components anew into blocks of bounded size, one task
each.  A block is given its part of the whole deviation to remove and anneals its own components with several
chains.  A component that isn't small beside a block can't be moved there, since it changes more than the block is to
remove; these, at most FINE for a block and measure, are placed before the rounds so that no split overflows, and
annealed against the whole deviation after each.  After a round the whole deviation (one number for each split and
label) is summed; the best assignment of all rounds is kept.  Only these sums and the large components reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .samples import with_entity

#: Components of one block at most, on average.
BLOCK = 2048
ROUNDS = 4
CHAINS = 4
STEPS = 12000
#: A component of more than this part of a block's fair share, in size or a label, is placed globally.
FINE = 16


def anneal(weights: np.ndarray, start: np.ndarray, goal: np.ndarray, seed: int, steps: int, importance: np.ndarray, warmth: float = 1.0) -> np.ndarray:
    """Assignment of components to splits whose sums come nearest to goal.

    weights: components x measures; goal: splits x measures; start: a split for each component.  Energy is the sum of
    absolute differences times importance, warmth scales the first temperature.  Moves put one component elsewhere, swaps exchange two; the best
    assignment seen is returned, which is start itself if nothing improves it.
    """
    rng = np.random.default_rng(seed)
    n, k = len(weights), len(goal)
    now = start.copy()
    if n == 0 or k < 2:
        return now
    gap = goal.astype(float).copy()
    np.subtract.at(gap, now, weights)
    energy = float((np.abs(gap) * importance).sum())
    best, best_energy = now.copy(), energy
    heat = max(warmth * energy / max(4, n), 1e-9)
    who, other, to, chance, swap = rng.integers(0, n, steps), rng.integers(0, n, steps), rng.integers(0, k, steps), rng.random(steps), rng.random(steps) < 0.4
    for s in range(steps):
        i = who[s]
        a = now[i]
        if swap[s]:
            j = other[s]
            b = now[j]
            delta = weights[i] - weights[j]
        else:
            j = -1
            b = to[s]
            delta = weights[i]
        if a == b:
            continue
        before = ((np.abs(gap[a]) + np.abs(gap[b])) * importance).sum()
        after = ((np.abs(gap[a] + delta) + np.abs(gap[b] - delta)) * importance).sum()
        change = after - before
        if change <= 0 or chance[s] < np.exp(-change / heat):
            gap[a] += delta
            gap[b] -= delta
            now[i] = b
            if j >= 0:
                now[j] = a
            energy += change
            if energy < best_energy - 1e-12:
                best, best_energy = now.copy(), energy
        heat *= 1 - 8.0 / steps
    return best


def place_large(weights: np.ndarray, start: np.ndarray, goal: np.ndarray, importance: np.ndarray) -> np.ndarray:
    """Splits of the large components, largest first: the one of start if goal isn't exceeded there, else where it is least
    exceeded, and of several such splits the emptiest."""
    at, left = start.copy(), goal.astype(float).copy()
    for i in np.argsort(-(weights * importance).sum(1), kind="stable"):
        over = (np.maximum(0, weights[i] - np.maximum(0, left)) * importance).sum(1)
        if over[at[i]] > 1e-12:
            room = (left * importance).sum(1)
            at[i] = max(range(len(goal)), key=lambda k: (-round(over[k], 12), room[k]))
        left[at[i]] -= weights[i]
    return at


def assign_components(stats: DataFrame, targets: DataFrame, seed: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """component, split for stats (component, n, l0, l1, ...): sizes and label counts of each component.

    targets: split, share; null or non-positive shares are left out and the rest normalised.  A null component is
    left out, an empty table gives an empty result, and no positive share is an error.
    """
    spark = stats.sparkSession
    wanted = sorted((r["split"], float(r["share"])) for r in targets.where("split is not null and share > 0").groupBy("split").agg(F.max("share").alias("share")).collect())
    if not wanted:
        raise ValueError("targets hold no positive share")
    names = [w[0] for w in wanted]
    share = np.array([w[1] for w in wanted])
    share /= share.sum()
    labels = [c for c in stats.columns if c != "component"]
    stats = stats.where("component is not null")
    whole = stats.agg(F.count(F.lit(1)).alias("components"), *[F.sum(c).alias(c) for c in labels]).first()
    count = whole["components"]
    if not count:
        return stats.select("component", F.lit(None).cast("string").alias("split"))
    total = np.array([whole[c] or 0 for c in labels], float)
    goal = share[:, None] * total[None, :]
    importance = np.where(total > 0, 1.0 / np.maximum(total, 1), 0.0) * np.array([1.0] + [0.25] * (len(labels) - 1))
    blocks = -(-count // BLOCK)
    unit = F.pmod(F.xxhash64(F.col("component").cast("string"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    edge = np.cumsum(share)
    pick = F.lit(len(names) - 1)
    for k in reversed(range(len(names) - 1)):
        pick = F.when(unit < float(edge[k]), F.lit(k)).otherwise(pick)
    state = cut(stats.withColumn("at", pick.cast("int")))

    def sums(df: DataFrame) -> np.ndarray:
        out = np.zeros_like(goal)
        for r in df.groupBy("at").agg(*[F.sum(c).alias(c) for c in labels]).collect():
            out[r["at"]] = [r[c] or 0 for c in labels]
        return out

    fixed, fixed_at, keys = np.zeros((0, len(labels))), np.zeros(0, np.int64), []
    if blocks > 1:
        is_large = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) * float(blocks * FINE) > float(max(total[k], 1)) for k, c in enumerate(labels)])
        large = state.where(is_large).orderBy("component").toPandas()
        keys, fixed = list(large["component"]), large[labels].fillna(0).to_numpy(float)
        fixed_at = place_large(fixed, large["at"].to_numpy(np.int64), goal, importance)
        if keys:
            state = cut(state.where(~is_large))

    def held() -> np.ndarray:
        out = np.zeros_like(goal)
        np.add.at(out, fixed_at, fixed)
        return out

    rest = sums(state)
    have = rest + held()
    best, best_at, best_energy = state, fixed_at, float((np.abs(goal - have) * importance).sum())
    for number in range(rounds if blocks > 1 else 1):
        if best_energy < 1e-6:
            break
        gap = (goal - have) / blocks  # run is serialised at once, with this round's values

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held_rows = [p for p in parts if len(p)]  # one block, of BLOCK components on average
            if not held_rows:
                return
            rows = pd.concat(held_rows).sort_values("component", kind="stable")
            key = int(rows["block"].iloc[0])
            weights = rows[labels].fillna(0).to_numpy(float)
            start = rows["at"].to_numpy(np.int64)
            own = gap.copy()
            np.add.at(own, start, weights)  # what this block should hold of each split
            tries = [anneal(weights, start, own, seed * 1000 + number * 100 + key * 7 + c, STEPS, importance, 8.0**c) for c in range(CHAINS)]

            def energy(a: np.ndarray) -> float:
                g = own.copy()
                np.subtract.at(g, a, weights)
                return float((np.abs(g) * importance).sum())

            rows["at"] = min(tries, key=energy).astype(np.int32)
            yield rows[["component", *labels, "at"]]

        block = F.pmod(F.xxhash64(F.col("component").cast("string"), F.lit(seed + 1 + number)), F.lit(blocks)).cast("int")
        # a task a block: an exchange by hash would be merged into a few tasks, since it is small, and anneal one block after another
        state = cut(state.withColumn("block", block).repartitionById(blocks, "block").mapInPandas(run, state.schema))
        rest = sums(state)
        if keys:
            tries = [anneal(fixed, fixed_at, goal - rest, seed * 1000 + number * 100 + c, STEPS, importance, 8.0**c) for c in range(CHAINS)]

            def off(a: np.ndarray) -> float:
                g = goal - rest
                np.subtract.at(g, a, fixed)
                return float((np.abs(g) * importance).sum())

            fixed_at = min([fixed_at, *tries], key=off)
        have = rest + held()
        energy = float((np.abs(goal - have) * importance).sum())
        if energy < best_energy:
            best, best_at, best_energy = state, fixed_at, energy
        else:
            state, fixed_at = best, best_at
            have = sums(state) + held()
    named = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("at") + 1)
    found = best.select("component", "at")
    if keys:
        placed = spark.createDataFrame(list(zip(keys, map(int, best_at), strict=True)), found.select("component", F.col("at").cast("int")).schema)
        found = found.unionByName(placed)
    return found.select("component", named.alias("split"))


def split_records(samples: DataFrame, aliases: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """sample_id, name, entity, resolved, split of every record; one row for an id.

    name is the repository in canonical form, entity what its aliases lead to; records of one entity share a
    split.  A record whose repository names nothing is a component of its own.  Labels that the splits balance
    are the numbers of resolved and unresolved records.  Repeated rows of an id are one record (the smallest
    repository spelling and label count), null ids are left out.
    """
    one = (
        samples.where("sample_id is not null")
        .groupBy("sample_id")
        .agg(F.min("repository").alias("repository"), F.max("resolved").alias("resolved"))
    )
    records = cut(
        with_entity(one, aliases).select("sample_id", "name", "entity", "resolved", F.coalesce("entity", F.concat(F.lit("record:"), "sample_id")).alias("component"))
    )
    stats = records.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("resolved") == 1).alias("solved"), F.count_if(F.col("resolved") == 0).alias("unsolved")
    )
    placed = assign_components(stats, targets, seed)
    return records.join(placed, "component").select("sample_id", "name", "entity", "resolved", "split")
