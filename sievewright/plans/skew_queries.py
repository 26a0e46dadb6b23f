"""Queries of the skewed-key aggregates (problem 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, key_profile
from ..sources.tables import table

SHARE = 0.02


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(table(spark, folder, "tasks"), ["repository", "instance_id"], SHARE).select("key_kind", "key_value")


def p3_repositories(spark: SparkSession, folder: str) -> DataFrame:
    return key_profile(table(spark, folder, "tasks"), "repository", ["instance_id", "license"], {"last_created": F.max("created_at")})


def p3_instances(spark: SparkSession, folder: str) -> DataFrame:
    return key_profile(table(spark, folder, "tasks"), "instance_id", ["repository", "license"], {"first_row": F.min("row_index")})


QUERIES = {"p3_found": p3_found, "p3_repositories": p3_repositories, "p3_instances": p3_instances}

SQL = {
    "p3_found": """
        with k as (
          select 'repository' as key_kind, repository as key_value from tasks where repository is not null
          union all select 'instance_id', instance_id from tasks where instance_id is not null)
        select key_kind, key_value from k group by 1, 2 having count(*) >= 0.02 * (select count(*) from tasks)""",
    "p3_repositories": """
        select repository, count(*) as n_rows, count(distinct instance_id) as n_instance_id, count(distinct license) as n_license,
               max(created_at) as last_created
        from tasks where repository is not null group by repository""",
    "p3_instances": """
        select instance_id, count(*) as n_rows, count(distinct repository) as n_repository, count(distinct license) as n_license,
               min(row_index) as first_row
        from tasks where instance_id is not null group by instance_id""",
}
