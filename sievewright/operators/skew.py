"""Per-key results where a few keys hold most records (problem 3).

Algebraic aggregates are combined on the map side: every task keeps bounded hash tables of key states, spills
them when full, and only compact partial states are shuffled.  Distinct counts are made algebraic first, by
grouping on (key, value), so no task ever holds the values of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """key_kind, key_value, n_rows of every value of every key column; null is not a key. Key columns are read as strings."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key_kind"), F.col(k).cast("string").alias("key_value")) for k in keys])
    return df.select(F.inline(pairs)).where("key_value is not null").groupBy("key_kind", "key_value").agg(F.count(F.lit(1)).alias("n_rows"))


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """key_kind, key_value, n_rows of the values that at least ``share`` of all rows have, rows with a null key included. None in an empty table."""
    return key_counts(df, keys).where(F.col("n_rows") >= F.lit(share) * F.lit(df.count()))


def key_profile(df: DataFrame, key: str, distinct: list[str], measures: dict[str, Column]) -> DataFrame:
    """For each non-null key: n_rows, n_<column> different non-null values of each column in distinct, and the measures.

    measures are algebraic aggregates (sum, count, min, max).  Each distinct column costs one grouping on
    (key, value) with partial counts, and its result is one row a key.
    """
    some = df.where(F.col(key).isNotNull())
    out = some.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *[m.alias(n) for n, m in measures.items()])
    for c in distinct:
        per = some.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.lit(1).alias("one")).groupBy(key).agg(F.sum("one").alias(f"n_{c}"))
        out = out.join(per, key, "left").withColumn(f"n_{c}", F.coalesce(f"n_{c}", F.lit(0)))
    return out
