"""Profiles of raw rows: counts, duplicates, distributions, observed fields, digests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repository import canonical_repository
from ..functions.text import language, license_disposition, license_reason


def value_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """kind, value, n_rows of every value of every column, as strings; null counts as UNKNOWN.

    All columns are counted in one pass with partial aggregation.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(c.cast("string"), F.lit("UNKNOWN")).alias("value")) for k, c in columns.items()])
    return df.select(F.inline(pairs)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def audit(df: DataFrame, identity: str, repository: str, license: str) -> DataFrame:
    """One row: n_rows, n_repositories, n_duplicate_ids, n_allow, n_reject, n_unknown, n_rejected.

    A repository that has no canonical form counts under its trimmed lower-case spelling.  An empty table gives zeros.
    """
    repo = F.coalesce(canonical_repository(F.col(repository)), F.lower(F.trim(repository)))
    d = license_disposition(F.col(license))
    whole = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(d == "ALLOW").alias("n_allow"), F.count_if(d == "REJECT").alias("n_reject"),
        F.count_if(d == "UNKNOWN").alias("n_unknown"), F.count_if(d != "ALLOW").alias("n_rejected"),
    )
    repositories = df.select(repo.alias("r")).where("r is not null").distinct().agg(F.count(F.lit(1)).alias("n_repositories"))
    duplicates = duplicate_ids(df, identity).agg(F.count(F.lit(1)).alias("n_duplicate_ids"))
    one = F.lit(1)
    return whole.withColumn("k", one).join(repositories.withColumn("k", one), "k").join(duplicates.withColumn("k", one), "k").drop("k")


def duplicate_ids(df: DataFrame, identity: str) -> DataFrame:
    """identity, n_rows of the ids that occur more than once; null is no id."""
    return df.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def first_duplicates(df: DataFrame, identity: str, cap: int) -> DataFrame:
    """The ``cap`` smallest ids that occur more than once."""
    return duplicate_ids(df, identity).orderBy(identity).limit(cap)


def license_rejections(df: DataFrame, keys: list[str], license: str) -> DataFrame:
    """keys, raw_license, disposition, reason of the rows whose license isn't allowed."""
    c = F.col(license)
    return df.where(license_disposition(c) != "ALLOW").select(*keys, c.alias("raw_license"), license_disposition(c).alias("disposition"), license_reason(c).alias("reason"))


def distribution(df: DataFrame, identity: Column, value: Column, cap: int = 100_000) -> DataFrame:
    """One row: n, minimum, p50, p95, maximum, approximate.

    n and the extremes are exact.  The percentiles are nearest-rank over at most ``cap`` rows, those with the smallest
    SHA-256 of ``identity:value``, which is the feature of this bounded summary; approximate says whether rows were left out.
    Null values are left out; an empty table gives n = 0 and nulls.
    """
    rows = df.select(identity.cast("string").alias("i"), value.alias("v")).where("v is not null")
    score = F.sha2(F.concat(F.coalesce("i", F.lit("")), F.lit(":"), F.col("v").cast("string")), 256)
    sample = rows.orderBy(score).limit(cap).agg(F.expr("percentile_disc(0.5) within group (order by v)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by v)").alias("p95"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))
    return whole.withColumn("k", F.lit(1)).join(sample.withColumn("k", F.lit(1)), "k").select("n", "minimum", "p50", "p95", "maximum", (F.col("n") > cap).alias("approximate"))


def observed_fields(df: DataFrame, json: str) -> DataFrame:
    """field, type, n_rows of the top-level fields of JSON objects; the type is one of the JSON types.

    Rows that are null, malformed or no objects show no field.
    """
    v = F.try_parse_json(F.col(json))
    kind = F.regexp_extract(F.schema_of_variant(F.col("x.value")), "^[A-Z]+", 0)
    names = {"BIGINT": "integer", "DOUBLE": "number", "DECIMAL": "number", "FLOAT": "number", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object", "VOID": "null"}
    named = F.create_map(*[F.lit(y) for kv in names.items() for y in kv])
    rows = df.select(v.alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    fields = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.struct("key", "value").alias("x"))) if hasattr(rows, "lateralJoin") else rows
    return fields.select(F.col("x.key").alias("field"), F.try_element_at(named, kind).alias("type")).groupBy("field", "type").agg(F.count(F.lit(1)).alias("n_rows"))


def ordered_digest(df: DataFrame, order: str, value: str) -> str:
    """SHA-256 over the rows' values, a line each, in the order of a unique column.

    Sorted by Spark and streamed through the driver a partition at a time; this fold can't be parallel.
    """
    import hashlib

    h = hashlib.sha256()
    rows: Iterator = df.select(order, value).orderBy(order).toLocalIterator(prefetchPartitions=True)
    for r in rows:
        h.update((r[1] or "").encode())
        h.update(b"\n")
    return h.hexdigest()


def partition_digests(df: DataFrame, partition: list[str], value: Column) -> DataFrame:
    """partition columns, n_rows, digest: an order-independent digest of each partition, summed from row hashes.

    The sum of 64-bit hashes in a wide decimal is algebraic, so partitions of any size need partial sums only.
    """
    h = F.xxhash64(value).cast("decimal(38,0)")
    return df.groupBy(*partition).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("digest"))


def languages_of(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(language(F.col(column)).alias("language")).agg(F.count(F.lit(1)).alias("n_rows"))


def report(df: DataFrame, declared_rows: int | None = None, caps: tuple[int, int, int] = (100, 100_000, 100), source_passes: bool = True) -> DataFrame:
    """field, key, value (strings) of a whole audit of raw rows: one row a fact, key '' where a field has one value.

    df: row_index and fields of an open schema.  Fields: row_count, declared_row_count, matches_declared_row_count, schema_field_types
    (key: field and type; null where some value is), language, resolved and license (key: value), unique_repositories, duplicate_instance_id_count,
    duplicate_instance_id (key: the caps[2] smallest), duplicate_instance_ids_truncated, trajectory_length and patch_size (key: count, min,
    p50, p95, max), percentiles_approximate, rejected_row_count, rejected_rows_truncated (beyond caps[0]), issue, status.
    A row without instance_id and id counts under its row_index.  Percentiles are nearest-rank over at most caps[1] values, those of
    smallest hash; all else covers every row.  An invalid label fails the query.
    """
    from . import traces

    spark = df.sparkSession
    kind = traces.type_at
    identity = F.coalesce(*[F.col(c).cast("string") for c in ("instance_id", "id") if c in df.columns], F.col("row_index").cast("string"))
    label = traces.label(df)
    known = F.when(label.valid, label.known).otherwise(F.raise_error(F.lit("a label must be true, false or unknown")).cast("boolean"))
    nonempty = [F.when(F.col(c) != "", F.col(c)) for c in traces.REPOSITORY if c in df.columns]
    repo = F.coalesce(*nonempty, F.lit(None).cast("string"))
    lang = F.when(F.col("language") != "", F.col("language")) if "language" in df.columns else F.lit(None)
    disposition = license_disposition(F.col("license") if "license" in df.columns else F.lit(None).cast("string"))
    rows = df.select(
        "row_index", identity.alias("i"), F.coalesce(canonical_repository(repo), F.lower(F.trim(repo))).alias("repo"), F.coalesce(lang, F.lit("UNKNOWN")).alias("lang"),
        F.when(known, "resolved").when(~known, "unresolved").otherwise("unknown").alias("label"), disposition.alias("d"), traces.steps(df).alias("steps"), traces.patch_bytes(df).alias("size"),
    )
    out = []

    def fact(name: str, part: DataFrame, key, value) -> None:
        out.append(part.select(F.lit(name).alias("field"), key.cast("string").alias("key"), value.cast("string").alias("value")))

    blank = F.lit("")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") != "ALLOW").alias("rejected"), F.count("repo").alias("named"))
    fact("row_count", whole, blank, F.col("n"))
    fact("declared_row_count", whole, blank, F.lit(declared_rows))
    fact("matches_declared_row_count", whole, blank, (F.col("n") == F.lit(declared_rows)) if declared_rows is not None else F.lit(None))
    fact("rejected_row_count", whole, blank, F.col("rejected"))
    fact("rejected_rows_truncated", whole, blank, F.col("rejected") > caps[0])
    for name, column in (("language", "lang"), ("resolved", "label"), ("license", "d")):
        fact(name, rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), F.col(column), F.col("n"))
    fact("unique_repositories", rows.where("repo is not null").select("repo").distinct().agg(F.count(F.lit(1)).alias("n")), blank, F.col("n"))
    repeated = duplicate_ids(rows, "i")
    fact("duplicate_instance_id_count", repeated.agg(F.count(F.lit(1)).alias("n")), blank, F.col("n"))
    fact("duplicate_instance_ids_truncated", repeated.agg(F.count(F.lit(1)).alias("n")), blank, F.col("n") > caps[2])
    fact("duplicate_instance_id", repeated.orderBy("i").limit(caps[2]), F.col("i"), F.col("n_rows"))
    approximate = []
    for name, column in (("trajectory_length", "steps"), ("patch_size", "size")):
        d = distribution(rows, F.col("row_index"), F.col(column), caps[1])
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("long").cast("string").alias("v")) for k, c in (("count", "n"), ("min", "minimum"), ("p50", "p50"), ("p95", "p95"), ("max", "maximum"))])
        fact(name, d.select(F.inline(pairs)), F.col("k"), F.col("v"))
        approximate.append(d.select("approximate"))
    fact("percentiles_approximate", approximate[0].unionByName(approximate[1]).agg(F.bool_or("approximate").alias("a")), blank, F.col("a"))
    # types of the schema are known; whether nulls occur takes one pass
    names = {"StringType": "string", "BooleanType": "boolean", "ArrayType": "array", "StructType": "object", "MapType": "object", "DoubleType": "number", "FloatType": "number", "DecimalType": "number"}
    fields = [c for c in df.columns if c != "row_index"]
    seen = df.agg(*[F.struct(F.count_if(F.col(f"`{c}`").isNotNull()).alias("some"), F.count_if(F.col(f"`{c}`").isNull()).alias("none")).alias(c) for c in fields]) if fields else None
    if seen is not None:
        kinds = {c: names.get(type(kind(df.schema, c)).__name__, "integer") for c in fields}
        pairs = F.array(*[x for c in fields for x in (F.struct(F.lit(f"{c}:{kinds[c]}").alias("k"), F.col(f"`{c}`.some").alias("n")), F.struct(F.lit(f"{c}:null").alias("k"), F.col(f"`{c}`.none").alias("n")))])
        fact("schema_field_types", seen.select(F.inline(pairs)).where("n > 0"), F.col("k"), F.lit(None))
    drift = F.lit(False) if declared_rows is None else F.col("n") != F.lit(declared_rows)
    nameless = (F.col("n") > 0) & (F.col("named") == 0)
    issues = whole.select(F.explode(F.array(F.when(drift, "row_count_drift"), F.when(nameless, "no_repository_identity"))).alias("x")).where("x is not null")
    fact("issue", issues, F.col("x"), F.lit(None))
    fact("status", whole, blank, F.when(drift | nameless, "FAIL").otherwise("PASS" if source_passes else "UNVERIFIED"))
    total = out[0]
    for part in out[1:]:
        total = total.unionByName(part)
    return total
