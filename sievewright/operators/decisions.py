"""Row decisions: projections with reasons, duplicates, conflicts, keep-first and claim-once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.repository import canonical_repository
from ..functions.text import language, license_disposition, spdx, stripped, usable


def commit(c: Column) -> Column:
    """A full commit of 40 hexadecimal digits in lower case, blanks around it aside; else null."""
    x = stripped(c)
    return F.when(x.rlike(r"\A[0-9a-fA-F]{40}\z"), F.lower(x))


def canonical_tasks(tasks: DataFrame) -> DataFrame:
    """row_index, id, some_repository, repository, base_commit, license_disposition, license, language of the table tasks, each in canonical
    form and worked out once; null where it can't be."""
    return tasks.select(
        "row_index", usable(F.col("instance_id")).alias("id"), usable(F.col("repository")).alias("some_repository"), canonical_repository(F.col("repository")).alias("repository"),
        commit(F.col("base_commit")).alias("base_commit"), license_disposition(F.col("license")).alias("license_disposition"), spdx(F.col("license")).alias("license"), language(F.col("language")).alias("language"),
    )


def task_reason(source_verified: Column | None = None) -> Column:
    """First failing check of a row of canonical_tasks, in fixed order; null if it passes."""
    d = F.col("license_disposition")
    verified = F.lit(True) if source_verified is None else source_verified
    return (
        F.when(~verified, "unverified_source")
        .when(d == "UNKNOWN", "license_unknown")
        .when(d == "REJECT", "license_reject")
        .when(F.col("id").isNull(), "missing_instance_id")
        .when(F.col("some_repository").isNull(), "missing_repository")
        .when(F.col("repository").isNull(), "invalid_repository")
        .when(F.col("base_commit").isNull(), "invalid_base_commit")
        .when(F.col("language").isNull(), "missing_language")
    )


KEPT = ["repository", "base_commit", "license", "language"]


def task_decisions(tasks: DataFrame, source_verified: Column | None = None) -> DataFrame:
    """row_index, instance_id, decision, reason_code, cause_code of every task row."""
    return decided_tasks(tasks, source_verified).drop(*KEPT)


def decided_tasks(tasks: DataFrame, source_verified: Column | None = None) -> DataFrame:
    """As task_decisions, with what the projection keeps of each row in canonical form.

    Rows without a usable id keep their reason.  Per id: if no row is valid each keeps its reason; if all are valid and
    equal in what the projection keeps, the first is admitted and the others are duplicate_task_provenance; otherwise
    the whole id is conflicting_task_provenance.  Then an invalid row's cause is its own reason, and a valid row's is
    duplicate_task_provenance if it repeats the first valid row before the conflict showed.  row_index must be unique.
    Counts of an id come from one aggregate, joined back, so an id with many rows needs no window over them.
    """
    rows = canonical_tasks(tasks).withColumns({"reason": task_reason(source_verified), "payload": F.sha2(F.concat_ws("\x1f", *KEPT), 256)}).withColumn("ok", F.col("reason").isNull())
    ids = rows.where("id is not null").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"),
        F.min(F.when(F.col("ok"), F.struct("row_index", "payload"))).alias("first"),
        F.min(F.when(F.col("ok"), F.col("payload"))).alias("low"), F.max(F.when(F.col("ok"), F.col("payload"))).alias("high"),
        F.min(F.when(~F.col("ok"), F.col("row_index"))).alias("first_bad"),
    )
    # the row at which a conflict shows: the first that makes valid and invalid, or two payloads, stand side by side
    other = rows.join(ids.where("low <> high").select("id", F.col("first.payload").alias("p"), F.lit(1).alias("x")), "id").where("ok and payload <> p").groupBy("id").agg(F.min("row_index").alias("first_other"))
    ids = ids.join(other, "id", "left")
    mixed = F.greatest(F.col("first_bad"), F.col("first.row_index"))
    shows = F.least(F.when(F.col("first_bad").isNotNull() & F.col("first").isNotNull(), mixed), F.col("first_other"))
    j = rows.join(ids.withColumn("shows", shows), "id", "left")
    conflict = F.col("id").isNotNull() & (F.col("n_ok") > 0) & ((F.col("n_ok") < F.col("n")) | (F.col("low") != F.col("high")))
    is_first = F.col("row_index") == F.col("first.row_index")
    repeats = F.col("ok") & ~is_first & (F.col("payload") == F.col("first.payload")) & (F.col("row_index") < F.col("shows"))
    code = (
        F.when(F.col("id").isNull(), F.col("reason"))
        .when(conflict, "conflicting_task_provenance")
        .when(~F.col("ok"), F.col("reason"))
        .when(~is_first, "duplicate_task_provenance")
    )
    cause = F.when(conflict & ~F.col("ok"), F.col("reason")).when(conflict & repeats, "duplicate_task_provenance")
    return j.select(
        "row_index", F.col("id").alias("instance_id"), F.when(code.isNull(), "admit").otherwise("reject").alias("decision"),
        code.alias("reason_code"), cause.alias("cause_code"), *KEPT,
    )


def admitted_tasks(tasks: DataFrame, source_verified: Column | None = None) -> DataFrame:
    """instance_id, repository, base_commit, license, language of the admitted tasks, in canonical form, each id once."""
    return decided_tasks(tasks, source_verified).where("decision = 'admit'").select("instance_id", *KEPT)


def rollout_decisions(rows: DataFrame, key: str, raw: str, valid: str, reason: str, order: str) -> DataFrame:
    """All columns and decision, reason_code, cause_code, by the rows of one rollout key.

    No key: rejected with the row's reason.  Different raw rows under a key, or valid beside invalid ones: all are
    conflicting_rollout_identity, their own reason the cause.  All invalid: each keeps its reason.  Else the first by
    ``order`` is admitted and the others are duplicate_trace_row.
    """
    per = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(valid)).alias("_ok"), F.min(raw).alias("_low"), F.max(raw).alias("_high"), F.min(order).alias("_first"),
    )
    j = rows.join(per, key, "left")
    conflict = (F.col("_low") != F.col("_high")) | ((F.col("_ok") > 0) & (F.col("_ok") < F.col("_n")))
    code = (
        F.when(F.col(key).isNull(), F.coalesce(F.col(reason), F.lit("missing_rollout_key")))
        .when(conflict, "conflicting_rollout_identity")
        .when(F.col("_ok") == 0, F.coalesce(F.col(reason), F.lit("normalization_error")))
        .when(F.col(order) != F.col("_first"), "duplicate_trace_row")
    )
    cause = F.when(F.col(key).isNotNull() & conflict, F.col(reason))
    return j.withColumns({"decision": F.when(code.isNull(), "admit").otherwise("reject"), "reason_code": code, "cause_code": cause}).drop("_n", "_ok", "_low", "_high", "_first")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows with equal keys, nulls being equal, the one that comes first in a unique order; an aggregate, so equal rows never meet in one task."""
    return df.join(df.groupBy(*keys).agg(F.min(order).alias(order)).select(order), order, "left_semi")


def claim_once(raw: DataFrame, claims: DataFrame, key: str, order: str) -> DataFrame:
    """claims with the first raw row of their key; later raw rows of a key are claimed by nobody."""
    first = raw.groupBy(key).agg(F.min(order).alias(order))
    return claims.join(first, key)


def row_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds row_index, from 0, in the order of the columns, which must make rows unique.

    The rows are range-partitioned and numbered inside their partitions; each partition starts behind the ones before.
    """
    from ..sources.tables import cut

    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    starts = sorted_.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sorted_.join(starts.withColumn("_before", before), "_p").withColumn("row_index", F.col("_before") + F.col("_m") - F.col("_from")).drop("_p", "_m", "_n", "_from", "_before")
