"""Trace rows joined to task metadata, filled, checked and classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repository import canonical_repository
from ..functions.text import diff_lines, language, license_disposition, resolved, resolved_is_valid, spdx, stripped, usable


#: Fields that a trace and its task share, and the form in which they are compared.
SHARED = {"repository": canonical_repository, "base_commit": lambda c: F.lower(stripped(c)), "license": spdx, "language": language}


def agrees(name: str) -> Column:
    """A value that the trace doesn't give is filled from the task; another must be equal in canonical form."""
    return ~F.col(f"{name}.given") | F.coalesce(F.col(f"{name}.value") == F.col(f"task_{name}"), F.lit(False))


def filled(name: str) -> Column:
    return F.when(F.col(f"{name}.given"), F.col(f"{name}.value")).otherwise(F.col(f"task_{name}"))


def trace_reason() -> Column:
    """First failing check of a joined trace row; null if it passes.

    Order: id, resolution (invalid before unknown), task, repository, commit, license, language, license gate, patch.
    Task columns carry the prefix ``task_``; shared fields are structs of given and value.
    """
    return (
        F.when(F.col("instance_id").isNull(), "missing_instance_id")
        .when(~resolved_is_valid(F.col("resolved")), "invalid_resolution")
        .when(resolved(F.col("resolved")).isNull(), "unknown_resolution")
        .when(F.col("task_id").isNull(), "missing_task")
        .when(~agrees("repository"), "repository_mismatch")
        .when(~agrees("base_commit"), "base_commit_mismatch")
        .when(~agrees("license"), "license_mismatch")
        .when(~agrees("language"), "language_mismatch")
        .when(license_disposition(F.col("task_license")) != "ALLOW", "license_gate")
        .when(F.col("patch").isNull(), "missing_patch")
    )


def normalize(traces: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every trace row with its task's metadata filled in, valid, reason_code and the patch's counts.

    traces: row_index, instance_id, repository, base_commit, license, language, resolved, patch.  tasks: instance_id (unique),
    repository, base_commit, license, language in canonical form.  Traces without a task are kept with their reason.
    Canonical forms are worked out once, before the join; Spark picks the join by measured sizes, and a hot instance_id on the trace
    side is split by the adaptive skew join.
    """
    shared = [F.struct(usable(F.col(n)).isNotNull().alias("given"), form(F.col(n)).alias("value")).alias(n) for n, form in SHARED.items()]
    patch = F.col("patch")
    own = traces.select(
        "row_index", usable(F.col("instance_id")).alias("instance_id"), "resolved", *shared, F.when(patch.isNotNull(), F.lit(True)).alias("patch"), F.sha2(patch, 256).alias("patch_sha256"),
        F.octet_length(patch).alias("patch_bytes"), diff_lines(patch, "+").alias("added_lines"), diff_lines(patch, "-").alias("removed_lines"),
    )
    known = tasks.select(usable(F.col("instance_id")).alias("task_id"), *[F.col(n).alias(f"task_{n}") for n in SHARED])
    j = own.join(known, F.col("instance_id") == F.col("task_id"), "left")
    return j.select(
        "row_index", "instance_id", *[filled(n).alias(n) for n in SHARED], resolved(F.col("resolved")).alias("resolved"), "patch_sha256", "patch_bytes", "added_lines", "removed_lines", trace_reason().alias("reason_code")
    )


def lineage(row: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Adds provenance_lineage, an array of ``namespace:value`` in the order of parts."""
    return row.withColumn("provenance_lineage", F.array(*[F.concat(F.lit(f"{k}:"), c) for k, c in parts.items()]))


def has_lineage(entries: Column, namespace: str, value: Column) -> Column:
    """Whether exactly one entry of the namespace is there, with this value."""
    return F.filter(entries, lambda x: x.startswith(f"{namespace}:")) == F.array(F.concat(F.lit(f"{namespace}:"), value))


def cohort(members: dict[str, DataFrame], identity: str) -> tuple[DataFrame, DataFrame]:
    """The union of the members with their name as ``partition``, and the identities that occur more than once in it."""
    if len(members) < 2:
        raise ValueError("a cohort needs two members")
    whole = None
    for name in sorted(members):
        part = members[name].withColumn("partition", F.lit(name))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole, whole.groupBy(identity).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def incompatible(members: dict[str, DataFrame], shared: list[str]) -> DataFrame:
    """field, n_values of the fields that should be the same in all members but aren't."""
    whole, _ = cohort(members, shared[0])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in shared])
    return whole.select(F.inline(pairs)).distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")
