"""Records of samples: entities, splits and ids in the one form the operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repository import repository_key
from ..operators.aliases import entities


def sample_id(c: Column) -> Column:
    """An id as samples writes it: lower case, without blanks and the prefix ``sha256:``."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^sha256:\s*", "")


def split_name(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin("val", "dev"), "validation").otherwise(x)


def with_entity(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds name (canonical repository) and entity; a repository without a name has neither."""
    known = entities(aliases)
    named = records.withColumn("name", repository_key(F.col("repository")))
    return named.join(known, "name", "left").withColumn("entity", F.coalesce("entity", "name"))


def splits(assignments: DataFrame) -> DataFrame:
    """sample_id, split of every record assigned to train, validation or test, each once."""
    return (
        assignments.select("sample_id", split_name(F.col("split")).alias("split"))
        .where(F.col("sample_id").isNotNull() & F.col("split").isin("train", "validation", "test"))
        .groupBy("sample_id")
        .agg(F.min("split").alias("split"))
    )
