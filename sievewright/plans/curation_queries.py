"""Queries of the profiling, decision, normalization, decontamination, recovery and selection operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.repository import canonical_repository
from ..operators import aliases, contamination, decisions, evidence, normalization, profile, selection
from ..sources.tables import table
from .curation_sql import SQL as SQL

SEED, FRACTION, NEAR = 11, 0.5, 0.95


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tasks")


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: repository by its canonical form."""
    return table(spark, folder, "samples").where("sample_id is not null").dropDuplicates(["sample_id"]).withColumn("repository", canonical_repository(F.col("repository")))


def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    return profile.audit(_tasks(spark, folder), "instance_id", "repository", "license")


def audit_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_counts(_tasks(spark, folder), {"language": F.col("language"), "license": X.license_disposition(F.col("license")), "spdx": X.spdx(F.col("license"))})


def duplicate_instances(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicate_ids(_tasks(spark, folder), "instance_id")


def first_duplicate_instances(spark: SparkSession, folder: str) -> DataFrame:
    return profile.first_duplicates(_tasks(spark, folder), "instance_id", 20)


def license_rejections(spark: SparkSession, folder: str) -> DataFrame:
    return profile.license_rejections(_tasks(spark, folder), ["row_index", "instance_id", "repository"], "license")


def patch_size_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distribution(_tasks(spark, folder), F.col("row_index"), F.octet_length("patch"))


def small_sample_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distribution(table(spark, folder, "lineitem"), F.concat_ws("-", "l_orderkey", "l_linenumber"), F.col("l_partkey"), 1000)


def observed_fields(spark: SparkSession, folder: str) -> DataFrame:
    return profile.observed_fields(table(spark, folder, "events"), "props")


def canonical_repositories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "samples").select("repository", canonical_repository(F.col("repository")).alias("canonical")).distinct()


def text_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "tasks").where("problem_statement is not null")
    return t.select("row_index", X.fingerprint(F.col("problem_statement")).alias("fingerprint"), F.length(X.normalized_text(F.col("problem_statement"))).alias("n_chars"))


def diff_statistics(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("patch")
    return _tasks(spark, folder).where("patch is not null").select("row_index", X.diff_lines(c, "+").alias("added"), X.diff_lines(c, "-").alias("removed"), F.octet_length(c).alias("n_bytes"), F.size(X.changed_paths(c)).alias("n_paths"))


def hash_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return _tasks(spark, folder).where("repository is not null").select("repository").distinct().select("repository", F.round(X.unit_bucket(F.col("repository"), SEED), 9).alias("bucket"))


def task_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.task_decisions(_tasks(spark, folder)).select("row_index", "instance_id", "decision", "reason_code")


def task_reasons(spark: SparkSession, folder: str) -> DataFrame:
    d = decisions.task_decisions(_tasks(spark, folder))
    return d.groupBy(F.coalesce("reason_code", F.lit("admitted")).alias("reason_code"), F.coalesce("cause_code", F.lit("none")).alias("cause_code")).agg(F.count(F.lit(1)).alias("n_rows"))


def rollout_decisions(spark: SparkSession, folder: str) -> DataFrame:
    ok = X.license_disposition(F.col("license")) == "ALLOW"
    rows = _tasks(spark, folder).select("row_index", F.col("instance_id").alias("rollout"), F.sha2(F.concat_ws("|", F.coalesce("problem_statement", F.lit("")), F.coalesce("patch", F.lit(""))), 256).alias("raw"), ok.alias("valid"), F.when(~ok, F.lit("license")).alias("why"))
    return decisions.rollout_decisions(rows, "rollout", "raw", "valid", "why", "row_index").select("row_index", "rollout", "decision", "reason_code", "cause_code")


def row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.row_numbers(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_index")


def claimed_once(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "documents").where("text is not null").select(F.sha2("text", 256).alias("h"), "doc_id")
    return decisions.claim_once(raw, raw.select("h").distinct(), "h", "doc_id").select("h", "doc_id")


def normalized_traces(spark: SparkSession, folder: str) -> DataFrame:
    t = _tasks(spark, folder)
    traces = t.select("row_index", "instance_id", "repository", "base_commit", "license", "language", F.pmod("row_index", F.lit(4)).cast("int").alias("m"), "patch").withColumn("resolved", F.col("m") - 1)
    return normalization.normalize(traces, decisions.admitted_tasks(t)).select("row_index", "repository", "license", "language", "added_lines", "removed_lines", F.coalesce("reason_code", F.lit("accepted")).alias("reason_code"))


def exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.exact_groups(contamination.content(_samples(spark, folder)))


def exact_benchmark_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.exact_overlap(contamination.content(_samples(spark, folder)), contamination.benchmark_values(table(spark, folder, "benchmark_entries")))


def near_task_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Near pairs of task texts and of patches, each kind with itself."""
    v = contamination.content(_samples(spark, folder))
    return contamination.near_pairs(contamination.near_candidates(v, v, NEAR, True), NEAR).select("kind", "fp_l", "fp_r", F.round("similarity", 6).alias("similarity"))


def near_benchmark_overlap(spark: SparkSession, folder: str) -> DataFrame:
    v = contamination.content(_samples(spark, folder))
    b = contamination.benchmark_values(table(spark, folder, "benchmark_entries"))
    return contamination.near_pairs(contamination.near_candidates(b, v, 0.95, False), 0.95).select("kind", "fp_l", "fp_r", F.round("similarity", 6).alias("similarity"))


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    """As _samples, with the repository that aliases lead to."""
    return aliases.resolve(table(spark, folder, "samples").where("sample_id is not null").dropDuplicates(["sample_id"]), table(spark, folder, "repository_aliases"))


def whole_decontaminated_split(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: repositories under their resolved names, linked by equal and near content, excluded by equal and near
    benchmark overlap, split by hash."""
    s, b = _resolved(spark, folder), table(spark, folder, "benchmark_entries")
    return contamination.split_repositories(s, b, SEED, FRACTION, contamination.near_content(s, b, NEAR))


def whole_decontamination_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """As decontamination_evidence, of the whole split, with the near candidates and matches of samples and benchmark."""
    s, b = _resolved(spark, folder), table(spark, folder, "benchmark_entries")
    near = contamination.near_content(s, b, NEAR)
    return contamination.evidence(s, b, contamination.split_repositories(s, b, SEED, FRACTION, near), near)


def decontaminated_split(spark: SparkSession, folder: str) -> DataFrame:
    """The exact form of whole_decontaminated_split, which SQL can express: repositories linked by shared content, excluded by benchmark overlap, split by hash."""
    return contamination.split_repositories(_samples(spark, folder), table(spark, folder, "benchmark_entries"), SEED, FRACTION)


def decontamination_evidence(spark: SparkSession, folder: str) -> DataFrame:
    s, b = _samples(spark, folder), table(spark, folder, "benchmark_entries")
    return contamination.evidence(s, b, contamination.split_repositories(s, b, SEED, FRACTION))


def pilot_selection(spark: SparkSession, folder: str) -> DataFrame:
    t = _tasks(spark, folder)
    n = F.octet_length("patch")
    rules = [
        ("repository", canonical_repository(F.col("repository")).isNull()), ("license", X.spdx(F.col("license")).isNull()),
        ("language", ~F.coalesce(X.language(F.col("language")).isin("TypeScript", "JavaScript"), F.lit(False))), ("empty_patch", F.col("patch").isNull() | (n == 0)), ("patch_size", n > 1600),
    ]
    judged = selection.decide(t, rules, ["repository", "instance_id"], "row_index").where("reason is null")
    rank = selection.rank_in(X.language(F.col("language")), ["TypeScript", "JavaScript"])
    return selection.top(judged.withColumn("rank", rank), [F.col("rank"), F.col("repository"), F.col("instance_id"), F.col("row_index")], 100).select("row_index", "rank", "repository", "instance_id")


def pilot_reasons(spark: SparkSession, folder: str) -> DataFrame:
    n = F.octet_length("patch")
    rules = [("license", X.spdx(F.col("license")).isNull()), ("empty_patch", F.col("patch").isNull() | (n == 0)), ("patch_size", n > 1600)]
    j = selection.decide(_tasks(spark, folder), rules, ["repository", "instance_id"], "row_index")
    return evidence.reason_counts(j, "reason")


def stratified_cover(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    f = F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("s"), F.col("c_mktsegment")))
    return selection.cover(c.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey", f, 40, 100)


def language_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.languages_of(_tasks(spark, folder), "language")


def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories that have records in train and in another split."""
    a = table(spark, folder, "split_assignments").select(F.lower(F.trim("split")).alias("split"), canonical_repository(F.col("repository")).alias("repository"))
    train, rest = a.where("split = 'train'").select("repository").distinct(), a.where("split <> 'train'").select("repository").distinct()
    return train.intersect(rest).where("repository is not null")


def unassigned_samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "samples").select("sample_id").distinct().join(table(spark, folder, "split_assignments").select("sample_id"), "sample_id", "left_anti")


def accounting_violations(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return evidence.violations(o, {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O"), "date": F.col("o_orderdate") >= F.lit("1992-06-01").cast("timestamp")})


def snapshot_differences(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    changed = s.where("s_suppkey % 3 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return evidence.differences(s, changed, "s_suppkey")


QUERIES = {
    f.__name__: f
    for f in (
        whole_decontaminated_split, whole_decontamination_evidence, decontaminated_split, audit_summary, audit_value_counts, duplicate_instances, first_duplicate_instances, license_rejections,
        patch_size_distribution, small_sample_distribution, observed_fields, canonical_repositories, text_fingerprints, diff_statistics,
        hash_buckets, task_decisions, task_reasons, rollout_decisions, row_numbers, claimed_once, normalized_traces, exact_groups,
        exact_benchmark_overlap, near_benchmark_overlap, near_task_pairs, decontamination_evidence,
        pilot_selection, pilot_reasons, stratified_cover, language_counts, split_overlap, unassigned_samples, accounting_violations,
        snapshot_differences,
    )
}
