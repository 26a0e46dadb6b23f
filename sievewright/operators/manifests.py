"""Relations of sources, artifacts and selections: registries, trust lists, equality, replays and exact joins.

Each function gives the rows that break a rule, or raises where a result without the rule would be wrong; tables of configuration are small,
those of rows may be of any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repository import canonical_repository
from ..functions.text import unit_bucket


def registry(sources: DataFrame, required: list[str], key: str = "name") -> DataFrame:
    """sources, checked: there is one, keys are unique, and required columns hold something; else ValueError."""
    bad = sources.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(c) for c in required]).first()
    if not bad["n"]:
        raise ValueError("a registry needs a source")
    if empty := [c for c in required if bad[c]]:
        raise ValueError(f"sources without {empty}")
    if twice := [r[key] for r in sources.groupBy(key).count().where("count > 1").orderBy(key).limit(10).collect()]:
        raise ValueError(f"sources named twice: {twice}")
    return sources


def pinned_differences(registered: DataFrame, observed: DataFrame, fields: list[str], key: str = "name") -> DataFrame:
    """key, field, registered, observed of pinned fields that an observation doesn't confirm; letter case of revisions aside."""
    j = registered.select(key, *[F.col(f).alias(f"r_{f}") for f in fields]).join(observed.select(key, *[F.col(f).alias(f"o_{f}") for f in fields]), key, "left")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"r_{f}").cast("string").alias("registered"), F.col(f"o_{f}").cast("string").alias("observed")) for f in fields])
    return j.select(key, F.inline(pairs)).where(~F.lower("registered").eqNullSafe(F.lower("observed")))


def untrusted(rows: DataFrame, allowed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose digests, under their name, aren't on the list; a name that the list doesn't have is not trusted."""
    return rows.join(allowed.select(*columns).distinct(), columns, "left_anti")


def unequal(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key, field of fields that differ between two relations of one row a key; a row that only one side has differs in all."""
    h = left.select(*key, F.struct(*fields).alias("l")).join(right.select(*key, F.struct(*fields).alias("r")), key, "full_outer")
    pairs = F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")) | F.col("l").isNull() | F.col("r").isNull(), F.lit(f)) for f in fields])
    return h.select(*key, F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("field"))


def overlapping(parts: dict[str, DataFrame], column: str) -> DataFrame:
    """value, parts of the values that are in several parts, names in order; parts must be pairwise disjoint where this is empty."""
    rows = reduce(DataFrame.unionByName, [df.select(F.col(column).alias("value"), F.lit(n).alias("part")) for n, df in parts.items()]).where("value is not null").distinct()
    return rows.groupBy("value").agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def replayed(selection: DataFrame, rows: DataFrame, reference: list[str], identity: list[str]) -> DataFrame:
    """selection with the columns of the one row that each reference names.

    A reference without a row or with several different ones, and a row whose identity isn't the selected one, are errors.
    """
    found = rows.dropDuplicates().select(*[F.col(c).alias(f"_{c}") for c in rows.columns], F.lit(True).alias("_here"))
    j = selection.join(found, reduce(lambda a, b: a & b, [selection[c].eqNullSafe(found[f"_{c}"]) for c in reference]), "left")
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity])
    per = j.groupBy(*reference).agg(F.count("_here").alias("n"), F.count_if(changed).alias("changed"))
    bad = per.agg(F.count_if(F.col("n") == 0).alias("missing"), F.count_if(F.col("n") > 1).alias("several"), F.count_if((F.col("n") == 1) & (F.col("changed") > 0)).alias("changed")).first()
    if bad["missing"] or bad["several"] or bad["changed"]:
        raise ValueError(f"references without a row: {bad['missing']}, with several: {bad['several']}, with another identity: {bad['changed']}")
    return j.select(*selection.columns, *[F.col(f"_{c}").alias(c) for c in rows.columns if c not in selection.columns])


def with_unique(selection: DataFrame, private: DataFrame, key: str) -> DataFrame:
    """selection joined to the one different private row of its key; several different ones, or none, are an error."""
    used = private.join(selection.select(key).distinct(), key, "left_semi").distinct()
    if n := used.groupBy(key).count().where("count > 1").count():
        raise ValueError(f"{n} keys have conflicting private rows")
    if n := selection.join(used, key, "left_anti").count():
        raise ValueError(f"{n} selected rows have no private row")
    return selection.join(used, key)


def exactly(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in order; fewer are an error."""
    out = df.orderBy(*order).limit(n)
    if (have := out.count()) < n:
        raise ValueError(f"{have} rows where {n} are needed")
    return out


def excluded(manifest: DataFrame) -> DataFrame:
    """repository of those that training may not hold: the excluded and the evaluation ones, each once. manifest: repository, split."""
    return manifest.where(F.col("split").isin("excluded", "evaluation")).select("repository").distinct()


def hashed_split(repositories: DataFrame, seed: int, evaluation_fraction: float) -> DataFrame:
    """repository, split of every canonical repository by its hash alone, without a look at contents."""
    if not 0 < evaluation_fraction < 1:
        raise ValueError("the fraction must be between 0 and 1")
    names = repositories.select(canonical_repository(F.col(repositories.columns[0])).alias("repository")).where("repository is not null").distinct()
    return names.select("repository", F.when(unit_bucket(F.col("repository"), seed) < evaluation_fraction, "evaluation").otherwise("train").alias("split"))


def run_summary(results: DataFrame) -> DataFrame:
    """reason, n_runs, n_resolved, n_agree, n_disagree of evaluated runs."""
    return results.groupBy("reason").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("resolved").alias("n_resolved"), F.count_if("label_agrees").alias("n_agree"), F.count_if(~F.col("label_agrees")).alias("n_disagree"))
