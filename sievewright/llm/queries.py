"""Queries of the training-data operators, with SQL for the ones SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut, table
from . import components, formatting, leaks, mixing, samples, similar, splitting, tokenizing, toxicity
from .sql import SQL


def _pairs(found: similar.Found) -> DataFrame:
    return similar.record_pairs(found).select("kind", F.col("a").alias("sample_id_a"), F.col("b").alias("sample_id_b"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(similar.find(similar.sample_texts(table(spark, folder, "samples"))))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every record and kind with the groups of similar texts it is in, each named by its smallest record, and the most links that a
    text of it there has to different texts."""
    found = similar.find(similar.sample_texts(table(spark, folder, "samples")))
    group = components.components(found.links.select("lo_a", "lo_b")).toDF("lo", "group")
    links = found.links.select(F.explode(F.array("lo_a", "lo_b")).alias("lo")).groupBy("lo").agg(F.count(F.lit(1)).alias("links"))
    rows = found.members.join(group, "lo", "left").join(links, "lo", "left").select("kind", F.col("id").alias("sample_id"), F.coalesce("group", "lo").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = cut(rows)
    names = rows.groupBy("kind", "group").agg(F.min("sample_id").alias("group_id"))
    return rows.join(names, ["kind", "group"]).groupBy("kind", "sample_id", "group_id").agg(F.max("links").alias("links"))


def sample_groups(spark: SparkSession, folder: str) -> DataFrame:
    """sample_id, group_id of every record linked by entity or by matched pairs."""
    s = table(spark, folder, "samples")
    one = s.where("sample_id is not null").groupBy("sample_id").agg(F.min("repository").alias("repository"))
    records = cut(
        samples.with_entity(one, table(spark, folder, "repository_aliases")).select("sample_id", F.coalesce("entity", F.concat(F.lit("record:"), "sample_id")).alias("entity"))
    )
    m = table(spark, folder, "sample_matches").where("matched").select(samples.sample_id(F.col("left_sample_id")).alias("l"), samples.sample_id(F.col("right_sample_id")).alias("r"))
    m = m.where("l is not null and r is not null and l <> r").distinct()
    edges = (
        m.join(records.toDF("l", "a"), "l")
        .join(records.toDF("r", "b"), "r")
        .where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    group = components.components(edges).toDF("entity", "group_id")
    return records.join(group, "entity", "left").select("sample_id", F.coalesce("group_id", "entity").alias("group_id"))


def p4_copies(spark: SparkSession, folder: str) -> DataFrame:
    return formatting.sets(table(spark, folder, "samples"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return formatting.copies(table(spark, folder, "samples")).select("first_id", F.col("sample_id").alias("copy_id"))


def _crossing(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """kind, a, b of similar pairs between train and the other splits, and the splits."""
    split = cut(samples.splits(table(spark, folder, "split_assignments")))
    evaluation = split.where("split <> 'train'").select("sample_id")
    found = similar.find(similar.sample_texts(table(spark, folder, "samples")), evaluation_ids=evaluation)
    a, b = split.toDF("a", "split_a"), split.toDF("b", "split_b")
    pairs = similar.record_pairs(found).join(a, "a").join(b, "b").where("(split_a = 'train') <> (split_b = 'train')")
    return pairs, split


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, _ = _crossing(spark, folder)
    return pairs.select("kind", F.col("a").alias("sample_id_a"), F.col("b").alias("sample_id_b"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps with train of each evaluation split and source: pairs, and records of the split that have one."""
    pairs, _ = _crossing(spark, folder)
    held_a = F.col("split_b") == "train"
    x = pairs.select("kind", F.when(held_a, F.col("a")).otherwise(F.col("b")).alias("sample_id"), F.when(held_a, F.col("split_a")).otherwise(F.col("split_b")).alias("split"))
    source = table(spark, folder, "samples").groupBy("sample_id").agg(F.min("source_dataset").alias("source_dataset"))
    return x.join(source, "sample_id").groupBy("split", "source_dataset", "kind").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("sample_id").alias("records"))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_records(table(spark, folder, "samples"), table(spark, folder, "repository_aliases"), table(spark, folder, "split_targets"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).where("name <> entity").select("sample_id", "entity")


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).select("sample_id", "entity", "split")


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Of each split the target share, the share of records reached, and the shares of resolved and unresolved records that it holds."""
    got = cut(_split(spark, folder))
    whole = got.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("resolved") == 1).alias("y"), F.count_if(F.col("resolved") == 0).alias("z"))
    per = got.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("resolved") == 1).alias("yes"), F.count_if(F.col("resolved") == 0).alias("no"))
    targets = table(spark, folder, "split_targets").groupBy("split").agg(F.max("share").alias("target_share"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    joined = targets.join(per, "split", "left").crossJoin(F.broadcast(whole))  # one row
    return joined.select("split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), share("records", "n").alias("share"), share("yes", "y").alias("resolved_share"), share("no", "z").alias("unresolved_share"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What a split must keep, one row a rule with the number of cases that break it: no record twice or without a split, no
    entity in two splits, no split that misses its target by over 0.02 in records or in either label."""
    got = cut(_split(spark, folder))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(name).alias("rule"), "broken")
    missing = table(spark, folder, "samples").where("sample_id is not null").select("sample_id").distinct().join(got.where("split is not null"), "sample_id", "left_anti")
    parted = got.where("entity is not null").groupBy("entity").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    far = p6_shares(spark, folder).where("abs(share - target_share) > 0.02 or abs(resolved_share - target_share) > 0.02 or abs(unresolved_share - target_share) > 0.02")
    return n(got.groupBy("sample_id").count().where("count > 1"), "record_twice").unionByName(n(missing, "record_without_split")).unionByName(n(parted, "entity_in_two_splits")).unionByName(n(far, "split_off_target"))


def _leaks(spark: SparkSession, folder: str, find: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    items = leaks.item_texts(table(spark, folder, "benchmark_entries"), table(spark, folder, "samples"), samples.splits(table(spark, folder, "split_assignments")))
    return find(table(spark, folder, "documents"), items)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder, leaks.leaks).where(F.col("exact_words") >= leaks.RUN).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder, leaks.all_leaks)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tokenizing.token_ids(F.col("text")).alias("ids"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = cut(mixing.sized(table(spark, folder, "documents")))
    targets = table(spark, folder, "mix_targets")
    return mixing.mix(sizes, targets), sizes, targets


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    mixed, sizes, targets = _mixed(spark, folder)
    return mixing.reached(cut(mixed), sizes, targets)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, folder, "doc_labels")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).where("toxic").select("doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("doc_id", "score", "toxic")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("toxic").alias("toxic_documents"), F.avg(F.col("toxic").cast("double")).alias("rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_groups": p1_groups, "p2_found": sample_groups, "p4_found": p4_found, "p4_copies": p4_copies,
        "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_splits": p6_splits, "p6_shares": p6_shares, "p6_checks": p6_checks, "p7_found": p7_found,
        "p7_leaks": p7_leaks, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found,
        "p10_scores": p10_scores, "p10_rates": p10_rates,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
