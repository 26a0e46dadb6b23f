"""Decontamination: content values, exact and near duplicates, benchmark overlap, components, hash split."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_text, unit_bucket
from ..sources.tables import cut
from . import edits


def _values(samples: DataFrame) -> DataFrame:
    """As content, with a row for each time that a sample holds a value."""
    none = F.array().cast("array<string>")
    pair = lambda k: lambda p: F.struct(F.lit(k).alias("kind"), p.alias("text"))
    values = F.concat(F.transform(F.array("task_text"), pair("task")), F.transform(F.coalesce("patch_texts", none), pair("patch")))
    rows = samples.select("sample_id", "repository", F.inline(values)).where("text is not null")
    rows = rows.withColumn("text", normalized_text(F.col("text"))).where("text <> ''")
    return rows.select("kind", F.sha2("text", 256).alias("fingerprint"), "text", F.length("text").alias("n_chars"), "sample_id", "repository")


def content(samples: DataFrame) -> DataFrame:
    """kind, fingerprint, text, n_chars, sample_id, repository of every task text and patch that isn't blank.

    samples: sample_id, repository, task_text, patch_texts.  A value that a sample holds twice gives one row.
    """
    return _values(samples).dropDuplicates(["kind", "fingerprint", "sample_id"])


def exact_groups(values: DataFrame) -> DataFrame:
    """kind, fingerprint, n_repositories, n_samples, first_repository of the values that several repositories carry."""
    per = values.groupBy("kind", "fingerprint", "repository").agg(F.count(F.lit(1)).alias("n"))
    return (
        per.groupBy("kind", "fingerprint")
        .agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n").alias("n_samples"), F.min("repository").alias("first_repository"))
        .where("n_repositories > 1")
    )


def exact_edges(values: DataFrame) -> DataFrame:
    """a, b: a star from the smallest repository of each shared value to its other repositories."""
    groups = exact_groups(values).select("kind", "fingerprint", "first_repository")
    return values.join(groups, ["kind", "fingerprint"]).where("repository <> first_repository").select(F.col("first_repository").alias("a"), F.col("repository").alias("b")).distinct()


def benchmark_values(benchmark: DataFrame) -> DataFrame:
    """kind, fingerprint, text, n_chars, benchmark_id of the benchmark's texts that aren't blank."""
    pairs = F.array(F.struct(F.lit("task").alias("kind"), F.col("task_text").alias("text")), F.struct(F.lit("patch").alias("kind"), F.col("patch_text").alias("text")))
    rows = benchmark.select("benchmark_id", F.inline(pairs)).where("text is not null").withColumn("text", normalized_text(F.col("text"))).where("text <> ''")
    return rows.select("kind", F.sha2("text", 256).alias("fingerprint"), "text", F.length("text").alias("n_chars"), "benchmark_id")


def exact_overlap(values: DataFrame, benchmark: DataFrame) -> DataFrame:
    """sample_id, benchmark_id, kind of equal values."""
    return values.join(benchmark.select("kind", "fingerprint", "benchmark_id"), ["kind", "fingerprint"]).select("sample_id", "benchmark_id", "kind").distinct()


def near_values(df: DataFrame) -> DataFrame:
    """kind, fingerprint, text, n_chars, id of the different values, computed once."""
    return cut(df.select("kind", "fingerprint", "text", "n_chars").dropDuplicates(["kind", "fingerprint"]).withColumn("id", F.xxhash64("kind", "fingerprint")))


def near_candidates(left: DataFrame, right: DataFrame, t: float, symmetric: bool) -> DataFrame:
    """kind, fp_l, fp_r, text_l, text_r of the pairs of one kind and different fingerprints that may reach a ratio of t; no pair that does
    is missing.

    Candidates are found as pairs of ids (``edits``); texts are fetched for what is left.  left and right are values or already what
    near_values makes of them.  symmetric: left and right are one relation, each pair once, smaller fingerprint left.
    """
    a = left if "id" in left.columns else near_values(left)
    b = a if symmetric else right if "id" in right.columns else near_values(right)
    ids = edits.candidates(a, None if symmetric else b, t)

    def used(df: DataFrame, side: str) -> DataFrame:
        some = df.join(ids.select(F.col(f"id_{side}").alias("id")).distinct(), "id", "left_semi")
        return some.select(F.col("id").alias(f"id_{side}"), F.col("kind").alias(f"kind_{side}"), F.col("fingerprint").alias(f"fp_{side}"), F.col("text").alias(f"text_{side}"))

    j = ids.join(used(a, "l"), "id_l").join(used(b, "r"), "id_r").where("kind_l = kind_r and fp_l <> fp_r")
    swap = (F.col("fp_l") > F.col("fp_r")) if symmetric else F.lit(False)
    names = ["fp", "text"]
    return j.select(
        F.col("kind_l").alias("kind"), *[F.when(swap, F.col(f"{n}_r")).otherwise(F.col(f"{n}_l")).alias(f"{n}_l") for n in names], *[F.when(swap, F.col(f"{n}_l")).otherwise(F.col(f"{n}_r")).alias(f"{n}_r") for n in names]
    )


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one integer."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << k)
    whole = row = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


#: Characters of the shortest common run that is looked up for a whole pair.
_RUN = 8


def common_runs(a: str, b: str) -> list[tuple[int, int, int]]:
    """Start in a, start in b, and length of the common substrings of _RUN characters or more that can't be made longer."""
    places: dict[str, list[int]] = {}
    for j in range(len(b) - _RUN + 1):
        places.setdefault(b[j : j + _RUN], []).append(j)
    runs, past = [], {}  # past: by diagonal the end of its last run
    for i in range(len(a) - _RUN + 1):
        for j in places.get(a[i : i + _RUN], ()):
            if past.get(j - i, 0) > i:
                continue
            n, step, most = _RUN, _RUN, min(len(a) - i, len(b) - j)
            while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
                n, step = min(most, n + step), 2 * step
            while step and n < most:  # the first difference is within the next step characters
                step //= 2
                if step and n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
                    n += step
            past[j - i] = i + n
            runs.append((i, j, n))
    return runs


def matched(a: str, b: str, runs: list[tuple[int, int, int]]) -> int:
    """Characters that sequence matching matches, as SequenceMatcher without junk counts them: the longest common substring, of equal ones
    the first in a, then in b, and so on before and behind it.  runs: those of a and b."""
    from difflib import SequenceMatcher

    total = 0
    parts = [(0, len(a), 0, len(b), runs)]
    while parts:
        a0, a1, b0, b1, near = parts.pop()
        best = (0, 0, 0)
        inside = []
        for run in near:
            i, j, n = run
            back = max(a0 - i, b0 - j, 0)
            n = min(a1 - i, b1 - j, n) - back
            if n >= _RUN:
                inside.append(run)
                best = max(best, (n, -i - back, -j - back))
        size, i, j = best[0], -best[1], -best[2]
        if size:
            total += size
            parts += [(a0, i, b0, j, inside), (i + size, a1, j + size, b1, inside)]
        elif a0 < a1 and b0 < b1:
            total += sum(m.size for m in SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).get_matching_blocks())
    return total


def near_pairs(candidates: DataFrame, t: float) -> DataFrame:
    """kind, fp_l, fp_r, similarity of the candidates whose sequence-matching ratio, the larger of both directions, is at least t.

    What sequence matching matches is a common subsequence, so candidates whose longest one is too short are refuted before any sequence
    is matched, and where one direction matches all of it the other is no larger.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("text_l").to_pylist(), batch.column("text_r").to_pylist(), strict=True):
                total, best = len(a) + len(b), 0
                most = common_subsequence(a, b)
                if 2 * most >= t * total - 1e-9:
                    runs = common_runs(a, b)
                    best = matched(a, b, runs)
                    if best < most:
                        best = max(best, matched(b, a, [(j, i, n) for i, j, n in runs]))
                out.append(2.0 * best / total)
            kept = pa.array([s >= t for s in out])
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("fp_l"), batch.column("fp_r"), pa.array(out, pa.float64())], ["kind", "fp_l", "fp_r", "similarity"]).filter(kept)

    n = candidates.sparkSession.sparkContext.defaultParallelism * 4
    return candidates.repartition(n).mapInArrow(match, "kind string, fp_l string, fp_r string, similarity double")


@dataclass
class Near:
    """values: of the samples, without texts.  For samples and benchmark each: numbers of candidates; matches as in near_pairs."""

    values: DataFrame
    candidates: dict[str, DataFrame]
    matches: dict[str, DataFrame]


def near_content(samples: DataFrame, benchmark: DataFrame, t: float) -> Near:
    """What is near among the samples and with the benchmark, found once."""
    # one shuffle by value for both: the first sample of a value keeps its text
    first = Window.partitionBy("fingerprint", "kind").orderBy("sample_id")
    rows = _values(samples).repartition("fingerprint").dropDuplicates(["kind", "fingerprint", "sample_id"]).withColumn("first", F.row_number().over(first) == 1)
    rows = cut(rows.withColumn("text", F.when(F.col("first"), F.col("text"))))
    texts = rows.where("first").select("kind", "fingerprint", "text", "n_chars", F.xxhash64("kind", "fingerprint").alias("id"))
    out = Near(rows.select("kind", "fingerprint", "sample_id", "repository"), {}, {})
    for what, left, symmetric in (("samples", texts, True), ("benchmark", near_values(benchmark_values(benchmark)), False)):
        found = near_candidates(left, texts, t, symmetric)
        out.candidates[what] = found.agg(F.count(F.lit(1)).alias("n"))
        out.matches[what] = cut(near_pairs(found, t))
    return out


def near_edges(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b between the smallest repositories of near values, and stars inside each value of a pair."""
    used = pairs.select("kind", F.explode(F.array("fp_l", "fp_r")).alias("fingerprint")).distinct()
    carriers = values.join(used, ["kind", "fingerprint"]).select("kind", "fingerprint", "repository").distinct()
    first = carriers.groupBy("kind", "fingerprint").agg(F.min("repository").alias("first"))
    across = pairs.join(first.toDF("kind", "fp_l", "a"), ["kind", "fp_l"]).join(first.toDF("kind", "fp_r", "b"), ["kind", "fp_r"]).select("a", "b")
    inside = carriers.join(first, ["kind", "fingerprint"]).select(F.col("first").alias("a"), F.col("repository").alias("b"))
    return across.union(inside).where("a <> b").distinct()


def smallest_in_component(vertices: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """vertex, root for every vertex (one column): the smallest vertex linked to it directly or indirectly.

    Labels fall to the smallest of the neighbours' labels, then jump to their label's label, so chains shorten by
    half each round; only minima are aggregated, and each round is cut off by a checkpoint.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v").where("u is not null and v is not null").distinct())
    label = cut(vertices.toDF("vertex").where("vertex is not null").distinct().select("vertex", F.col("vertex").alias("root")))
    for _ in range(most_rounds):
        near = both.join(label.toDF("v", "r"), "v").groupBy("u").agg(F.min("r").alias("r"))
        lower = label.join(near.toDF("vertex", "r"), "vertex", "left").select("vertex", F.least("root", F.coalesce("r", "root")).alias("next"), "root")
        jump = lower.select(F.col("vertex").alias("next"), F.col("next").alias("further"))
        moved = cut(lower.join(jump, "next", "left").select("vertex", F.least("next", F.coalesce("further", "next")).alias("root"), F.col("root").alias("old")))
        label = moved.select("vertex", "root")
        if not moved.where("root <> old").limit(1).count():
            return label
    raise ValueError("components did not settle")


def split_repositories(samples: DataFrame, benchmark: DataFrame, seed: int, evaluation_fraction: float, near: float | Near | None = None) -> DataFrame:
    """sample_id, repository, contamination_group, split: excluded, evaluation or train, equal for a whole component.

    Repositories that share a value (or, with near, have values at least so similar) form a component; a component
    with a benchmark overlap is excluded, any other is split by the hash of its smallest repository.  near: the similarity, or what
    near_content has found for it.
    """
    if isinstance(near, float):
        near = near_content(samples, benchmark, near)
    values = near.values if near else cut(content(samples))
    edges = exact_edges(values)
    overlap = exact_overlap(values, benchmark_values(benchmark)).select("sample_id")
    if near:
        edges = edges.unionByName(near_edges(values, near.matches["samples"]))
        close = near.matches["benchmark"].select("kind", F.col("fp_r").alias("fingerprint"))
        overlap = overlap.unionByName(values.join(close.distinct(), ["kind", "fingerprint"], "left_semi").select("sample_id"))
    one = samples.select("sample_id", "repository").where("sample_id is not null and repository is not null").distinct()
    root = smallest_in_component(one.select("repository"), edges).toDF("repository", "contamination_group")
    placed = one.join(root, "repository")
    excluded = placed.join(overlap.distinct(), "sample_id", "left_semi").select("contamination_group").distinct().withColumn("out", F.lit(True))
    split = F.when(F.col("out"), "excluded").when(unit_bucket(F.col("contamination_group"), seed) < evaluation_fraction, "evaluation").otherwise("train")
    return placed.join(excluded, "contamination_group", "left").select("sample_id", "repository", "contamination_group", split.alias("split"))


def evidence(samples: DataFrame, benchmark: DataFrame, assigned: DataFrame, near: Near | None = None) -> DataFrame:
    """name, n: counts of values, groups, overlaps and of samples and repositories in each split; with near also of the near
    candidates and matches among samples and with the benchmark."""
    values = near.values if near else content(samples)
    groups = exact_groups(values).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("exact_groups_"), "kind").alias("name"), "n")
    distinct = values.select("kind", "fingerprint").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("values_"), "kind").alias("name"), "n")
    hits = exact_overlap(values, benchmark_values(benchmark)).agg(F.count_distinct("sample_id").alias("n")).select(F.lit("overlap_samples").alias("name"), "n")
    per = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("s"), F.count_distinct("repository").alias("r"))
    splits = per.select(F.inline(F.array(F.struct(F.concat(F.lit("samples_"), "split").alias("name"), F.col("s").alias("n")), F.struct(F.concat(F.lit("repositories_"), "split").alias("name"), F.col("r").alias("n")))))
    out = groups.unionByName(distinct).unionByName(hits).unionByName(splits)
    for what in near.matches if near else ():
        for name, n in (("candidates", near.candidates[what]), ("matches", near.matches[what].agg(F.count(F.lit(1)).alias("n")))):
            out = out.unionByName(n.select(F.lit(f"near_{name}_{what}").alias("name"), "n"))
    return out
