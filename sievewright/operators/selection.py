"""Bounded, reproducible selections: predicate cascades, keep-first, top-k, covers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repository import canonical_repository
from ..functions.text import license_disposition, spdx


def cascade(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, else null."""
    out = None
    for name, broken in rules:
        out = F.when(F.coalesce(broken, F.lit(False)), name) if out is None else out.when(F.coalesce(broken, F.lit(False)), name)
    return out if out is not None else F.lit(None).cast("string")


def first_of_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds is_first: whether the row is the first of its key, nulls being equal.  order must be unique."""
    best = df.groupBy(*key).agg(F.min(order).alias(order)).select(order).withColumn("_first", F.lit(True))
    return df.join(best, order, "left").withColumn("is_first", F.coalesce("_first", F.lit(False))).drop("_first")


def decide(df: DataFrame, rules: list[tuple[str, Column]], key: list[str], order: str) -> DataFrame:
    """Adds reason: the first broken rule, or duplicate for passing rows that come after the first of their key."""
    judged = df.withColumn("reason", cascade(rules))
    passing = first_of_key(judged.where("reason is null"), key, order)
    dup = passing.withColumn("reason", F.when(~F.col("is_first"), F.lit("duplicate"))).drop("is_first")
    return judged.where("reason is not null").unionByName(dup)


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows; Spark keeps k rows a partition only."""
    return df.orderBy(*order).limit(k)


def rank_in(c: Column, values: list[str]) -> Column:
    """Place of a value in a list of preference, ignoring case; null if it isn't there."""
    return F.nullif(F.array_position(F.array(*[F.lit(v.lower()) for v in values]), F.lower(c)), F.lit(0))


def cover(df: DataFrame, identity: str, features: Column, minimum: int, maximum: int) -> DataFrame:
    """Rows of a bounded cover: the smallest identity of every feature, filled with the smallest others up to minimum.

    features: an array column expression.  Null and repeated identities, a cover of more than maximum rows, and fewer rows
    than minimum are errors.
    """
    if not 0 < minimum <= maximum:
        raise ValueError("0 < minimum <= maximum must hold")
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count(identity).alias("some")).first()
    if seen["some"] < seen["n"] or df.groupBy(identity).count().where("count > 1").limit(1).count():
        raise ValueError(f"{identity} must be known and unique")
    if seen["n"] < minimum:
        raise ValueError(f"{seen['n']} rows can't make a cover of {minimum}")
    firsts = df.select(identity, F.explode(features).alias("f")).groupBy("f").agg(F.min(identity).alias(identity)).select(identity).distinct()
    chosen = df.join(firsts, identity, "left_semi")
    n = firsts.count()
    if n > maximum:
        raise ValueError(f"a cover takes {n} rows, more than {maximum}")
    if n < minimum:
        rest = df.join(firsts, identity, "left_anti").orderBy(identity).limit(minimum - n)
        chosen = chosen.unionByName(rest)
    return chosen


@dataclass(frozen=True)
class PilotPolicy:
    """What a pilot subset admits; limits that are None don't apply."""

    most_samples: int = 10_000
    languages: tuple[str, ...] = ("TypeScript", "JavaScript")
    licenses: tuple[str, ...] = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause")
    require_resolved: bool = True
    require_steps: bool = True
    most_steps: int | None = None
    most_patch_bytes: int | None = None

    def check(self, spark) -> None:
        """Raises ValueError for limits that aren't positive, no language, and licenses that the gate doesn't allow."""
        limits = [x for x in (self.most_samples, self.most_steps, self.most_patch_bytes) if x is not None]
        if min(limits) <= 0:
            raise ValueError("limits must be positive")
        if not self.languages or not self.licenses:
            raise ValueError("a policy names languages and licenses")
        given = spark.createDataFrame([(x,) for x in self.licenses], "l string")
        if bad := [r.l for r in given.where(license_disposition(F.col("l")) != "ALLOW").collect()]:
            raise ValueError(f"licenses that the gate doesn't allow: {bad}")


def pilot_reasons(samples: DataFrame, policy: PilotPolicy, excluded: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """samples with rank (of the language) and reason: the first broken rule, duplicate, or null for what may be chosen.

    samples: ordinal (unique), repository, repository_license, language, resolved, n_steps, patch_bytes, issue, rollout.  excluded and,
    if the split is frozen, training: one column of repositories in any spelling, joined in; the rules go from repository over
    evaluation_repository, not_in_frozen_split, license, language, unresolved, empty_trajectory, trajectory_length and patch_size to duplicate.
    """
    policy.check(samples.sparkSession)

    def names(df: DataFrame, flag: str) -> DataFrame:
        return df.select(canonical_repository(F.col(df.columns[0])).alias("_name")).where("_name is not null").distinct().withColumn(flag, F.lit(True))

    rows = samples.withColumn("_name", canonical_repository(F.col("repository"))).join(names(excluded, "_out"), "_name", "left")
    rows = rows.join(names(training, "_in"), "_name", "left") if training is not None else rows.withColumn("_in", F.lit(True))
    rows = rows.withColumn("rank", rank_in(F.col("language"), list(policy.languages)))
    license_ = spdx(F.col("repository_license"))
    rules = [
        ("repository", F.col("_name").isNull()), ("evaluation_repository", F.col("_out")), ("not_in_frozen_split", F.col("_in").isNull()),
        ("license", license_.isNull() | ~license_.isin(*[_spdx(x) for x in policy.licenses])), ("language", F.col("rank").isNull()),
        ("unresolved", F.lit(policy.require_resolved) & ~F.coalesce("resolved", F.lit(False))), ("empty_trajectory", F.lit(policy.require_steps) & (F.coalesce("n_steps", F.lit(0)) == 0)),
        ("trajectory_length", F.col("n_steps") > F.lit(policy.most_steps)), ("patch_size", F.col("patch_bytes") > F.lit(policy.most_patch_bytes)),
    ]
    return decide(rows, rules, ["_name", "issue", "rollout"], "ordinal").drop("_out", "_in")


def _spdx(name: str) -> str:
    from ..functions.text import ALLOWED_LICENSES

    return ALLOWED_LICENSES[name.strip().lower()]


def pilot(samples: DataFrame, policy: PilotPolicy, excluded: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """The first most_samples admitted samples by rank of language, canonical repository, issue, rollout and ordinal."""
    judged = pilot_reasons(samples, policy, excluded, training).where("reason is null")
    return top(judged, [F.col(c) for c in ("rank", "_name", "issue", "rollout", "ordinal")], policy.most_samples).withColumnRenamed("_name", "canonical")
