"""Raw trace rows of open schema: aliased fields, patches wherever they stand, labels, identities, normalized records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.repository import canonical_repository
from ..functions.text import diff_lines, language, license_disposition, spdx, stripped
from .decisions import commit
from .isolation import canonical_sha256
from .selection import cascade

# Names under which a field may stand, first come first taken.
REPOSITORY, LICENSE, ROLLOUT = ("repo", "repository"), ("license", "repository_license"), ("trajectory_id", "rollout_id")
ISSUE = ("instance_id", "issue_or_pr_id", "pull_number", "issue_id")
MODEL_PATCH, NESTED_MODEL_PATCH = ("model_patch", "pred_patch", "generated_patch"), "metadata.model_patch.patch"
SIZED_PATCH, NESTED_SIZED_PATCH = ("model_patch", "patch", "pred_patch", "diff"), ("metadata.model_patch", "metadata.patch")
ABSENT = "absent"


def type_at(schema: T.DataType, path: str) -> T.DataType | None:
    """Type of a dotted path, None where the schema doesn't have it."""
    for name in path.split("."):
        if not isinstance(schema, T.StructType) or name not in schema.fieldNames():
            return None
        schema = schema[name].dataType
    return schema


def text_field(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the string columns that holds more than white space, stripped; columns of other types and missing ones don't count."""
    have = [F.nullif(stripped(F.col(n)), F.lit("")) for n in names if isinstance(type_at(df.schema, n), T.StringType)]
    return F.coalesce(*have, F.lit(None).cast("string"))


def identifier_field(df: DataFrame, names: tuple[str, ...]) -> Column:
    """As text_field, integers counting as their digits, 0 too; booleans and fractions don't count."""
    have = []
    for n in names:
        kind = type_at(df.schema, n)
        if isinstance(kind, T.StringType):
            have.append(F.nullif(stripped(F.col(n)), F.lit("")))
        elif isinstance(kind, T.IntegralType):
            have.append(F.col(n).cast("string"))
    return F.coalesce(*have, F.lit(None).cast("string"))


def patch_text(df: DataFrame, path: str) -> Column | None:
    """Text of a patch given as a string or as an object with a string ``patch``; None where it can't be either."""
    kind = type_at(df.schema, path)
    if isinstance(kind, T.StringType):
        return F.col(path)
    return F.col(f"{path}.patch") if isinstance(type_at(df.schema, f"{path}.patch"), T.StringType) else None


def model_patch(df: DataFrame) -> Column:
    """Struct of patch and source_field: the first model patch that is a string, empty and ``absent`` where there is none."""
    places = [n for n in (*MODEL_PATCH, NESTED_MODEL_PATCH) if isinstance(type_at(df.schema, n), T.StringType)]
    have = [F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("patch"), F.lit(n).alias("source_field"))) for n in places]
    return F.coalesce(*have, F.struct(F.lit("").alias("patch"), F.lit(ABSENT).alias("source_field")))


def patch_bytes(df: DataFrame) -> Column:
    """Bytes of the first patch, strings and objects alike; null without one."""
    have = [patch_text(df, n) for n in (*SIZED_PATCH, *NESTED_SIZED_PATCH)]
    return F.octet_length(F.coalesce(*[c for c in have if c is not None], F.lit(None).cast("string")))


def label(df: DataFrame, name: str = "resolved") -> Column:
    """Struct of known (boolean or null) and valid: booleans, 0 and 1 are labels, -1 and null unknown, all else invalid."""
    kind, c = type_at(df.schema, name), F.col(name)
    none = F.lit(None).cast("boolean")
    if kind is None or isinstance(kind, T.NullType):
        known, valid = none, F.lit(True)
    elif isinstance(kind, T.BooleanType):
        known, valid = c, F.lit(True)
    elif isinstance(kind, T.IntegralType):
        known, valid = F.when(c == 1, True).when(c == 0, False), c.isNull() | c.isin(-1, 0, 1)
    else:
        known, valid = none, c.isNull()
    return F.struct(known.alias("known"), valid.alias("valid"))


def steps(df: DataFrame, name: str = "trajectory") -> Column:
    """Number of steps; 0 where there is no list."""
    return F.coalesce(F.size(F.col(name)), F.lit(0)) if isinstance(type_at(df.schema, name), T.ArrayType) else F.lit(0)


def patch_facts(c: Column) -> list[Column]:
    """sha256, bytes, added_lines, removed_lines of a patch."""
    return [F.sha2(c, 256).alias("sha256"), F.octet_length(c).alias("bytes"), diff_lines(c, "+").alias("added_lines"), diff_lines(c, "-").alias("removed_lines")]


def row_identity(df: DataFrame) -> Column:
    """SHA-256 of a row's canonical JSON, fields without a value included."""
    return canonical_sha256(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))


def normalized(raw: DataFrame, fixed: dict[str, str], evidence: list[str], reference_paths: Column | None = None) -> DataFrame:
    """The record of every raw row, and reason, the first rule it breaks or null; sample_id only where it breaks none.

    fixed: source_dataset, source_dataset_revision, harness, generating_model, source_repository_id.  evidence: lineage entries
    that all rows share, ``namespace:value`` each.  reference_paths: array of forbidden fields of the row's trajectory.
    sample_id is the SHA-256 of the record's canonical JSON, so equal content has one id.  All checks are expressions; Python
    only makes canonical JSON.
    """
    found = model_patch(raw)
    row = raw.select(
        F.col("row_index"), row_identity(raw.drop("row_index")).alias("raw_sha256"), identifier_field(raw, ISSUE).alias("issue_or_pr_id"), text_field(raw, REPOSITORY).alias("_repository"),
        text_field(raw, LICENSE).alias("_license"), text_field(raw, ("base_commit",)).alias("_commit"), text_field(raw, ("language",)).alias("_language"),
        text_field(raw, ROLLOUT).alias("rollout_id"), label(raw).alias("_label"), F.col("trajectory"), steps(raw).alias("n_steps"), found.alias("_patch"),
        (F.lit(False) if reference_paths is None else F.coalesce(F.size(reference_paths) > 0, F.lit(False))).alias("_gold"),
    )
    reason = cascade([
        ("missing_license", F.col("_license").isNull()), ("license_gate", license_disposition(F.col("_license")) != "ALLOW"),
        ("missing_repository", F.col("_repository").isNull()), ("invalid_repository", canonical_repository(F.col("_repository")).isNull()),
        ("invalid_base_commit", commit(F.col("_commit")).isNull()), ("missing_issue", F.col("issue_or_pr_id").isNull()), ("missing_language", F.col("_language").isNull()),
        ("missing_rollout", F.col("rollout_id").isNull()), ("invalid_resolution", ~F.col("_label.valid")), ("unknown_resolution", F.col("_label.known").isNull()),
        ("reference_patch_in_trajectory", F.col("_gold")),
    ])
    instance = F.col("issue_or_pr_id")
    lineage = [
        F.concat(F.lit(f"hf-dataset:{fixed['source_repository_id']}@{fixed['source_dataset_revision']}")), F.concat(F.lit("instance:"), instance),
        F.concat(F.lit("raw-row:"), F.col("raw_sha256")), F.concat(F.lit("task-metadata:"), instance), *[F.lit(x) for x in evidence],
    ]
    record = {k: F.lit(fixed[k]) for k in ("source_dataset", "source_dataset_revision", "harness", "generating_model")} | {
        "repository": canonical_repository(F.col("_repository")), "repository_license": spdx(F.col("_license")), "base_commit": commit(F.col("_commit")), "issue_or_pr_id": instance,
        "language": language(F.col("_language")), "rollout_id": F.col("rollout_id"), "resolved": F.col("_label.known"), "trajectory": F.col("trajectory"),
        "generated_patch": F.nullif(F.col("_patch.patch"), F.lit("")), "patch_metadata": F.struct(*patch_facts(F.col("_patch.patch")), F.col("_patch.source_field")), "provenance_lineage": F.array(*lineage),
    }
    out = row.select("row_index", "raw_sha256", "n_steps", reason.alias("reason"), *[c.alias(k) for k, c in record.items()])
    whole = canonical_sha256(F.when(F.col("reason").isNull(), F.to_json(F.struct(*record), {"ignoreNullFields": "false"})))
    return out.withColumn("sample_id", whole)


def exact_lineage(entries: Column, source: str, instance: Column, evidence: list[str]) -> Column:
    """Whether the lineage is complete, in order, and names this source, instance and evidence and some raw row."""
    ends = F.array(F.concat(F.lit("task-metadata:"), instance), *[F.lit(x) for x in evidence])
    return (
        (F.size(entries) == 4 + len(evidence)) & (entries[0] == F.lit(f"hf-dataset:{source}")) & (entries[1] == F.concat(F.lit("instance:"), instance))
        & entries[2].rlike(r"\Araw-row:[0-9a-f]{64}\z") & (F.slice(entries, 4, 1 + len(evidence)) == ends)
    )


def collisions(rows: DataFrame) -> DataFrame:
    """rule, value of what may not be: a normalized row without a rollout key, a sample id under several rollout keys, and a key of
    equal raw rows with several sample ids.

    rows: row_index, rollout_key, raw_sha256, sample_id.  Keys are counted by minimum and maximum, so a hot one is a row a task.
    """
    known = rows.where("sample_id is not null")
    keyless = known.where("rollout_key is null").select(F.lit("sample_without_rollout_key").alias("rule"), F.col("row_index").cast("string").alias("value"))
    per = known.groupBy("sample_id").agg(F.min("rollout_key").alias("a"), F.max("rollout_key").alias("b")).where("a <> b")
    keys = rows.where("rollout_key is not null").groupBy("rollout_key").agg(
        F.count(F.lit(1)).alias("n"), F.count("sample_id").alias("n_ok"), F.min("raw_sha256").alias("a"), F.max("raw_sha256").alias("b"), F.min("sample_id").alias("c"), F.max("sample_id").alias("d")
    )
    several = keys.where("n = n_ok and a = b and c <> d")
    return (
        keyless.unionByName(per.select(F.lit("sample_of_several_rollouts").alias("rule"), F.col("sample_id").alias("value")))
        .unionByName(several.select(F.lit("rollout_of_several_samples").alias("rule"), F.col("rollout_key").alias("value")))
    )
