"""Names that repositories had and the ones they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repository import canonical_repository, repository_key
from ..sources.tables import cut


def entities(aliases: DataFrame, strict: bool = False) -> DataFrame:
    """name, entity: for each alias the name where no further alias applies.

    Spellings are made canonical, repeated and null rows dropped; of several targets of one alias the smallest
    counts or, if strict, they are an error; a name that is its own alias applies no further.  Chains are halved by joining the mapping with
    itself until nothing moves, so no step holds the table on the driver; a cycle is an error.
    """
    step = (
        aliases.select(repository_key(F.col("alias")).alias("name"), repository_key(F.col("target")).alias("entity"))
        .where("name is not null and entity is not null and name <> entity")
        .groupBy("name")
        .agg(F.min("entity").alias("entity"), F.max("entity").alias("other"))
    )
    now = cut(step)
    if strict and (twice := now.where("entity <> other").count()):
        raise ValueError(f"{twice} aliases have several targets")
    now = now.select("name", "entity")
    for _ in range(64):
        on = now.select(F.col("name").alias("entity"), F.col("entity").alias("further"))
        moved = cut(now.join(on, "entity", "left").select("name", F.coalesce("further", "entity").alias("entity"), F.col("further").isNotNull().alias("moved")))
        if moved.where("name = entity").limit(1).count():
            raise ValueError("repository aliases form a cycle")
        if not moved.where("moved").limit(1).count():
            return moved.select("name", "entity")
        now = moved.select("name", "entity")
    raise ValueError("repository aliases form a cycle")


def resolve(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """records with repository as the lower-case canonical name that its aliases lead to; null where it names nothing. An alias of
    several targets is an error."""

    def canonical(name: str) -> Column:
        return F.coalesce(canonical_repository(F.col(name)), F.col(name)).alias(name)

    known = entities(aliases.select(canonical("alias"), canonical("target")), strict=True)
    named = records.withColumn("name", repository_key(canonical_repository(F.col("repository"))))
    return named.join(known, "name", "left").withColumn("repository", F.coalesce("entity", "name")).drop("name", "entity")
