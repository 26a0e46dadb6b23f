"""Queries of raw traces: records, isolation, audits, pilot subsets, label recovery and run outcomes, with their SQL.

The test tables hold no nested traces, so one nested row is made of each row of ``tasks`` by fixed rules of its row_index, which
the SQL states again; labels of the recovery are those of ``samples``, whose sources are the partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.repository import canonical_repository
from ..functions.text import language, unit_bucket
from ..operators import aliases, contamination, decisions, evidence, isolation, manifests, outcomes, profile, recovery, selection, traces
from ..sources import snapshot
from ..sources.tables import cut, table
from ..streaming import arrivals
from . import curation_queries
from .trace_sql import SQL as SQL

LANGUAGES = ["TypeScript", "JavaScript"]
LABELLED = ["task-forge-v2", "swe-traces-open"]
FIXED = {"source_dataset": "traces", "source_dataset_revision": "0" * 40, "harness": "tables", "generating_model": "none", "source_repository_id": "tables/tasks"}
EVIDENCE = ["materialization:tables", "trace-partition:tasks", "upstream-source:tasks", "task-provenance:tasks@1", "task-provenance-artifact:tasks"]


def raw_traces(spark: SparkSession, folder: str) -> DataFrame:
    """A nested trace row of every task row: labels, patches in various places, steps, tools."""
    t = table(spark, folder, "tasks")
    k = F.col("row_index")
    case = lambda n, r, c: F.when(k % n == r, c)
    step = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    patch = F.col("patch")
    shown = F.when(k % 13 == 0, F.concat_ws("\n", "problem_statement", patch)).otherwise(F.col("problem_statement"))
    steps = F.array(step("system", F.lit("Solve the task.")), step("user", shown), step("assistant", patch), step("tool", F.col("test_patch")))
    tools = F.array(F.when(k % 11 == 0, '{"name":"look","gold_patch":{}}').when(k % 19 == 0, "{broken").otherwise('{"name":"shell"}'))
    return t.select(
        "row_index", "instance_id", F.col("repository").alias("repo"), "license", "language", "base_commit", F.concat(F.lit("r"), (k / 2).cast("long").cast("string")).alias("trajectory_id"),
        case(7, 0, F.lit(-1)).when(k % 7 == 1, F.lit(None)).when(k % 7 < 4, F.lit(0)).otherwise(1).alias("resolved"),
        case(4, 0, patch).alias("model_patch"), case(4, 1, patch).alias("pred_patch"),
        F.struct(F.struct(case(4, 2, patch).alias("patch")).alias("model_patch"), F.when(patch.isNotNull() & (k % 17 != 0), F.struct(patch.alias("patch"))).alias("reference_patch")).alias("metadata"),
        F.when(k % 23 == 0, F.slice(steps, 1, 0)).otherwise(steps).alias("trajectory"), tools.alias("tools"),
    )


def _inspected(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_traces(spark, folder)
    fields = [c for c in raw.columns if c != "row_index"]
    return isolation.inspected(raw.select("row_index", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("row")), "row").select("row_index", "inspection", F.lit(None).cast("string").alias("sample_id"), F.lit(True).alias("agrees"))


def isolation_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Every reason that every raw trace gives."""
    return isolation.findings(_inspected(spark, folder), 0, 0, 0, 0).select("row_index", "reason_code")


def isolation_summary(spark: SparkSession, folder: str) -> DataFrame:
    scanned = cut(_inspected(spark, folder))
    return isolation.summary(scanned, isolation.findings(scanned, 0, 0, 0, 0), table(spark, folder, "tasks").count())


def task_bindings(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each raw trace agrees with the admitted task of its instance in repository, commit and language."""
    raw = raw_traces(spark, folder)
    rows = raw.select("row_index", traces.identifier_field(raw, traces.ISSUE).alias("instance_id"), canonical_repository(F.col("repo")).alias("repository"), decisions.commit(F.col("base_commit")).alias("base_commit"))
    known = decisions.admitted_tasks(table(spark, folder, "tasks")).select("instance_id", F.col("repository").alias("task_repository"), F.col("base_commit").alias("task_commit"))
    return rows.join(known, "instance_id").select("row_index", isolation.binding_agrees({"repository": "task_repository", "base_commit": "task_commit"}).alias("agrees"))


def model_patches(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_traces(spark, folder)
    found = raw.select("row_index", traces.model_patch(raw).alias("p"))
    return found.select("row_index", F.col("p.source_field").alias("source_field"), *traces.patch_facts(F.col("p.patch")))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return traces.normalized(raw_traces(spark, folder), FIXED, EVIDENCE)


def normalized_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every raw trace with the reason that keeps it out, or its record; the lineage without the row's own digest."""
    r = _records(spark, folder)
    m = F.col("patch_metadata")
    return r.select(
        "row_index", F.coalesce("reason", F.lit("accepted")).alias("reason"), "repository", "repository_license", "base_commit", "issue_or_pr_id", "language", "rollout_id", "resolved", "n_steps",
        m.sha256.alias("patch_sha256"), m.bytes.alias("patch_bytes"), m.source_field.alias("source_field"), F.array_join(F.filter("provenance_lineage", lambda x: ~x.startswith("raw-row:")), "|").alias("lineage"),
    )


def record_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted records that break a rule of their own form, by rule; all counts must be 0."""
    r = _records(spark, folder).where("reason is null")
    return evidence.violations(r, {
        "sample_id": F.col("sample_id").rlike("^[0-9a-f]{64}$"), "raw_row": F.col("raw_sha256").rlike("^[0-9a-f]{64}$"),
        "lineage": traces.exact_lineage(F.col("provenance_lineage"), f"tables/tasks@{'0' * 40}", F.col("issue_or_pr_id"), EVIDENCE), "commit": F.col("base_commit").rlike("^[0-9a-f]{40}$"),
        "patch_counts": (F.col("patch_metadata.bytes") >= 0) & (F.col("patch_metadata.added_lines") >= 0), "resolved": F.col("resolved").isNotNull(),
    })


def record_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Collisions of rollout keys over the raw traces, a sample's content standing for its id; counts by rule."""
    r = raw_traces(spark, folder)
    ok = F.col("license").isin("MIT", "Apache-2.0") & F.col("patch").isNotNull()
    t = table(spark, folder, "tasks").select("row_index", F.when(ok, F.sha2("patch", 256)).alias("sample_id"), F.sha2(F.coalesce("repository", F.lit("")), 256).alias("raw_sha256"))
    return traces.collisions(r.select("row_index", F.col("instance_id").alias("rollout_key")).join(t, "row_index"))


def audit_report(spark: SparkSession, folder: str) -> DataFrame:
    return profile.report(raw_traces(spark, folder), declared_rows=4000)


def _pilot_rows(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_traces(spark, folder)
    return raw.select(
        F.col("row_index").alias("ordinal"), F.col("repo").alias("repository"), F.col("license").alias("repository_license"), language(F.col("language")).alias("language"),
        traces.label(raw).known.alias("resolved"), traces.steps(raw).alias("n_steps"), F.octet_length(traces.model_patch(raw).patch).alias("patch_bytes"), F.col("instance_id").alias("issue"), F.col("trajectory_id").alias("rollout"),
    )


def _pilot(spark: SparkSession, folder: str) -> tuple[DataFrame, selection.PilotPolicy, DataFrame, DataFrame]:
    names = table(spark, folder, "tasks").select("repository").where("repository is not null").distinct()
    place = unit_bucket(F.col("repository"), 11)
    return _pilot_rows(spark, folder), selection.PilotPolicy(100, most_steps=20, most_patch_bytes=1600), names.where(place < 0.2), names.where(place >= 0.3)


def pilot_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The whole cascade over every trace, with excluded repositories and a frozen split."""
    judged = selection.pilot_reasons(*_pilot(spark, folder))
    return judged.select(F.col("ordinal").alias("row_index"), F.coalesce("reason", F.lit("accepted")).alias("reason"))


def pilot_subset(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred samples of the pilot, a top-k by its feature."""
    return selection.pilot(*_pilot(spark, folder)).select(F.col("ordinal").alias("row_index"), "rank", "canonical", "issue", "rollout")


def _labels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Labelled and target rows: a row a sample and patch, its source the partition, its label that of the sample."""
    s = table(spark, folder, "samples").where("sample_id is not null").dropDuplicates(["sample_id"])
    p = s.select(F.coalesce("source_dataset", F.lit("none")).alias("partition"), F.col("sample_id").alias("rollout_id"), "resolved", F.explode("patch_texts").alias("patch")).where("patch is not null and trim(patch) <> ''")
    path = F.regexp_extract("patch", r"^diff --git a/(\S+) ", 1)
    ending = F.regexp_extract(path, r"\.([a-z]+)$", 1)
    lang = F.when(ending.isin("ts", "tsx"), "ts").when(ending.isin("js", "jsx", "mjs"), "js").otherwise(ending)
    key = F.regexp_replace(F.lower("patch"), "[^a-z0-9]+", "")
    rows = p.select("partition", "rollout_id", F.sha2("patch", 256).alias("row_hash"), F.sha2(key, 256).alias("key"), path.alias("instance_id"), lang.alias("lang"), "resolved")
    return rows.where(F.col("partition").isin(*LABELLED)), rows.where(~F.col("partition").isin(*LABELLED))


def label_recovery(spark: SparkSession, folder: str) -> DataFrame:
    return recovery.recover(*_labels(spark, folder), LANGUAGES).select("partition", "rollout_id", "row_hash", "key", "outcome", "label", "n_labels")


def label_requests(spark: SparkSession, folder: str) -> DataFrame:
    return recovery.requests(recovery.recover(*_labels(spark, folder), LANGUAGES))


def label_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return recovery.conflicts(*_labels(spark, folder), LANGUAGES)


def label_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The observations behind every candidate, in order."""
    labelled, targets = _labels(spark, folder)
    keys = recovery.recover(labelled, targets, LANGUAGES).where("outcome = 'candidate'")
    return recovery.evidence_of(keys, recovery.observations(labelled, targets, LANGUAGES)).select("key", "label", "partition", "rollout_id", "row_hash", "place")


def label_accounting(spark: SparkSession, folder: str) -> DataFrame:
    labelled, targets = _labels(spark, folder)
    return recovery.accounting(labelled.unionByName(targets), LANGUAGES)


def label_counters(spark: SparkSession, folder: str) -> DataFrame:
    return recovery.counters(*_labels(spark, folder), LANGUAGES)


def run_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Test runs made of orders: a line is a test, its flags the statuses before and after, the order's status the exit."""
    failed = F.col("l_returnflag") == "R"
    tests = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(failed).alias("before"), F.bool_or(failed & (F.col("l_quantity") > 45)).alias("after"))
    status = lambda c: F.when(F.col(c), "failed").otherwise("passed").alias(c)
    one = F.struct(F.concat(F.lit("t"), F.col("l_linenumber").cast("string"), F.lit(" (3 ms)")).alias("name"), status("before"), status("after"))
    lines = tests.groupBy("l_orderkey").agg(F.collect_list(one).alias("x"))  # an order has at most seven line numbers
    to_map = lambda f: outcomes.normalized_statuses(F.map_from_entries(F.transform("x", lambda t: F.struct(t["name"], t[f]))))
    name = lambda x: F.transform(x, lambda t: F.regexp_replace(t["name"], " .*", ""))
    o = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    runs = o.select(
        "o_orderkey", to_map("before").alias("baseline"), to_map("after").alias("candidate"), (F.col("o_custkey") % 10 != 0).alias("baseline_ran"), (F.col("o_custkey") % 10 != 1).alias("candidate_ran"),
        (F.col("o_custkey") % 10 != 2).alias("candidate_succeeded"), (F.col("o_custkey") % 10 == 3).alias("truncated"), name(F.filter("x", lambda t: t["before"] == "failed")).alias("fail_to_pass"),
        F.concat(name(F.filter("x", lambda t: t["before"] == "passed")), F.when(F.col("o_custkey") % 10 == 4, F.array(F.lit("t9"))).otherwise(F.array().cast("array<string>"))).alias("pass_to_pass"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("expected_label"),
    )
    return outcomes.evaluate(runs).select("o_orderkey", F.coalesce("reason", F.lit("valid")).alias("reason"), "resolved", "label_agrees")


def resolved_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """Names that aliases lead elsewhere, and where."""
    return aliases.entities(table(spark, folder, "repository_aliases")).select("name", "entity")


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return manifests.run_summary(run_outcomes(spark, folder))


def hashed_split(spark: SparkSession, folder: str) -> DataFrame:
    """The split of all repositories of samples by hash, under their resolved names."""
    s = aliases.resolve(table(spark, folder, "samples").select("repository"), table(spark, folder, "repository_aliases"))
    return manifests.hashed_split(s, 11, 0.5)


def excluded_repositories(spark: SparkSession, folder: str) -> DataFrame:
    return manifests.excluded(hashed_split(spark, folder))


def overlapping_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories, in canonical form, that are in several of tasks, samples and documents."""
    name = lambda t: table(spark, folder, t).select(canonical_repository(F.col("repository")).alias("repository"))
    return manifests.overlapping({t: name(t) for t in ("documents", "samples", "tasks")}, "repository")


def unequal_records(spark: SparkSession, folder: str) -> DataFrame:
    """Customers whose nation, balance or segment isn't that of a second copy with every seventh balance and eleventh row changed."""
    c = table(spark, folder, "customer")
    k = F.col("c_custkey")
    other = c.where(k % 11 != 0).withColumn("c_acctbal", F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return manifests.unequal(c, other, ["c_custkey"], ["c_nationkey", "c_acctbal", "c_mktsegment"])


def replayed_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The target rows of all candidates of the recovery, found again by their references."""
    labelled, targets = _labels(spark, folder)
    chosen = recovery.recover(labelled, targets, LANGUAGES).where("outcome = 'candidate'").select(*recovery.REFERENCE, "key")
    return manifests.replayed(chosen, targets.select(*recovery.REFERENCE, "key", "instance_id"), recovery.REFERENCE, ["key"])


def private_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Every admitted task with the one set of its private texts' digests; ids with several are left to the decisions that refuse them."""
    t = table(spark, folder, "tasks")
    admitted = decisions.admitted_tasks(t).select("instance_id")
    private = t.select("instance_id", F.sha2(F.concat_ws("|", F.coalesce("problem_statement", F.lit("-")), F.coalesce("test_patch", F.lit("-"))), 256).alias("private_sha256")).distinct()
    single = private.groupBy("instance_id").count().where("count = 1").select("instance_id")
    return manifests.with_unique(admitted.join(single, "instance_id", "left_semi"), private, "instance_id")


def snapshot_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and least and greatest row_index of two tables read as one snapshot."""
    rows = snapshot.scan(spark, folder, None, ("part.parquet", "supplier.parquet"))
    n = snapshot.numbered(rows.select("source_file", "file_ordinal", "row_place"), ["file_ordinal", "row_place"])
    return n.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_index").alias("first"), F.max("row_index").alias("last"))


def planted_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark, and an entry of every sample whose id starts with 00: its task text, and its first patch with another line."""
    b = table(spark, folder, "benchmark_entries").select("benchmark_id", "task_text", "patch_text")
    s = table(spark, folder, "samples").where("sample_id like '00%'").dropDuplicates(["sample_id"])
    return b.unionByName(s.select(F.concat(F.lit("planted-"), "sample_id").alias("benchmark_id"), "task_text", F.concat(F.try_element_at("patch_texts", F.lit(1)), F.lit("\n+one line more")).alias("patch_text")))


def planted_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.exact_overlap(contamination.content(curation_queries._samples(spark, folder)), contamination.benchmark_values(planted_benchmark(spark, folder)))


def planted_split(spark: SparkSession, folder: str) -> DataFrame:
    """The exact split with the planted benchmark, which excludes whole components."""
    return contamination.split_repositories(curation_queries._samples(spark, folder), planted_benchmark(spark, folder), curation_queries.SEED, curation_queries.FRACTION)


def planted_near_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Near overlaps with the planted benchmark: entries and the values that are at least 0.95 similar but not equal."""
    v, b = contamination.content(curation_queries._samples(spark, folder)), contamination.benchmark_values(planted_benchmark(spark, folder))
    return contamination.near_pairs(contamination.near_candidates(b, v, curation_queries.NEAR, False), curation_queries.NEAR).select("kind", "fp_l", "fp_r", F.round("similarity", 6).alias("similarity"))


def oracle_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Private task rows made of tasks, lists and single names alike, with the reason that keeps one out."""
    t = table(spark, folder, "tasks")
    k = F.col("row_index")
    config = F.struct(F.when(k % 29 != 0, "parse_js").alias("log_parser"), F.when(k % 31 != 0, " npm test ").alias("test_cmd"))
    names = F.when(k % 5 == 0, F.array(F.lit("a"), F.lit("a "))).when(k % 37 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("a"), F.lit("b")))
    rows = t.select("instance_id", F.col("repository").alias("repo"), "base_commit", "language", F.when(k % 41 != 0, "img:1").otherwise("img 1").alias("image_name"), F.coalesce("test_patch", "patch").alias("test_patch"), names.alias("FAIL_TO_PASS"), F.when(k % 3 == 0, "b").otherwise("c").alias("PASS_TO_PASS"), config.alias("install_config"))
    found = outcomes.private_tasks(rows)
    return found.groupBy(F.coalesce("reason", F.lit("usable")).alias("reason"), "language").agg(F.count(F.lit(1)).alias("n_rows"))


def training_text_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of the training text of every record that is accepted and has steps."""
    r = _records(spark, folder).where("reason is null and n_steps > 0")
    return outcomes.training_texts(r.select(F.col("row_index").cast("string").alias("sample_id"), *outcomes.VISIBLE)).select("sample_id", F.length("text").alias("n_chars"))


def evaluation_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests rebuilt from the target rows that recovery queued."""
    labelled, targets = _labels(spark, folder)
    queued = recovery.recover(labelled, targets, LANGUAGES).where("outcome = 'request'").select(*recovery.REFERENCE)
    rows = targets.join(queued.distinct(), recovery.REFERENCE, "left_semi").withColumn("patch", F.col("row_hash"))
    return recovery.evaluation_requests(rows, LANGUAGES).select(*recovery.REFERENCE, "key", "instance_id", "lang")


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type and hour, read as arriving files."""
    schema = table(spark, folder, "events").schema
    stream = arrivals.arriving(spark, f"{folder}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return arrivals.drained(arrivals.windowed_counts(stream, "ts", "1 hour", "1 day", ["event_type"])).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n_rows")


QUERIES = {
    f.__name__: f
    for f in (
        isolation_findings, isolation_summary, task_bindings, model_patches, normalized_records, record_checks, record_collisions, audit_report, pilot_decisions, pilot_subset,
        label_recovery, label_requests, label_conflicts, label_evidence, label_accounting, label_counters, run_outcomes, resolved_repositories,
        run_summary, hashed_split, excluded_repositories, overlapping_sources, unequal_records, replayed_targets, private_tasks, snapshot_rows, planted_overlap, planted_split, planted_near_overlap, oracle_tasks, training_text_sizes, evaluation_requests, event_windows,
    )
}
