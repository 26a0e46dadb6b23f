"""Snapshots of JSONL and parquet files: discovery, scans, identities, partitions, immutable sinks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = (".jsonl", ".parquet")


def discover(root: str | Path, patterns: tuple[str, ...] = ()) -> list[Path]:
    """Sorted different .jsonl and .parquet files of a folder, or the one file given; none is an error.

    Patterns must be relative and may not climb; a link that leads out of the folder is an error.
    """
    root = Path(root)
    for p in patterns:
        if PurePosixPath(p).is_absolute() or ".." in PurePosixPath(p).parts:
            raise ValueError(f"pattern {p!r} must stay below the snapshot")
    if root.is_file():
        found = [root] if root.suffix.lower() in SUFFIXES else []
    else:
        chosen = (q for p in patterns for q in root.glob(p)) if patterns else root.rglob("*")
        found = sorted({q for q in chosen if q.is_file() and q.suffix.lower() in SUFFIXES})
        inside = root.resolve()
        for q in found:
            if not q.resolve().is_relative_to(inside):
                raise ValueError(f"{q} leads out of the snapshot")
    if not found:
        raise ValueError(f"no {' or '.join(SUFFIXES)} file in {root}")
    return found


def unique_object(text: str) -> dict:
    """A JSON object; a key that occurs twice in an object at any depth is an error, as is anything but an object."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("duplicate key")
        return out

    value = json.loads(text, object_pairs_hook=once)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return value


def canonical_json(value: object) -> str:
    """JSON with sorted keys, no blanks and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def read_jsonl(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None, strict: bool = False, file: bool = False) -> DataFrame:
    """Rows of JSONL files; blank lines are skipped, a malformed line or one that is no object fails the query.

    strict: also a key that occurs twice.  Without a schema one is inferred from all lines.  Column pruning reaches the parser.
    file: adds source_file, the path of each row's file, and row_place, which orders the rows of a file.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("position"))
    lines = spark.read.text(paths).select("value", *([F.col("_metadata.file_path").alias("source_file"), place.alias("row_place")] if file else [])).where(F.trim("value") != "")
    if strict:

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for line in b.column(0).to_pylist():
                    unique_object(line)
                yield b

        lines = lines.mapInArrow(check, lines.schema)
    lines = lines.withColumn("value", F.when(F.trim("value").startswith("{"), F.col("value")).otherwise(F.raise_error(F.lit("a line is no JSON object"))))
    if schema is None:
        schema = inferred_schema(lines)
        if schema is None:
            return spark.createDataFrame([], "source_file string").drop("source_file")
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("r"), *[F.col(c) for c in lines.columns if c != "value"]).select("r.*", *[c for c in lines.columns if c != "value"])


def inferred_schema(lines: DataFrame) -> str | None:
    """Schema of JSON lines (column value), merged by a JVM aggregate over all of them; None for no line. Malformed ones fail."""
    merged = lines.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0]
    if merged is None or not merged.startswith("OBJECT"):
        return None
    # names of variant types that the parser of schemas doesn't know
    return re.sub(r"\bVOID\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", merged))


def scan(spark: SparkSession, root: str | Path, columns: list[str] | None = None, patterns: tuple[str, ...] = (), schema: T.StructType | None = None, nested: bool = False) -> DataFrame:
    """All rows of a snapshot, with source_file (relative), file_ordinal and row_place; parquet and JSONL files by their columns' names, missing ones null.

    columns: dotted paths; only these leaves are read from parquet, as flat columns or, with nested, as objects again.  Files are
    in the order of their paths and row_place is ordered as the rows of a file, so numbered() by both is the order of the snapshot.
    """
    files = discover(root, patterns)
    base = Path(root).resolve() if Path(root).is_dir() else Path(root).resolve().parent
    names = [str(f.resolve().relative_to(base)) for f in files]
    order = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)])
    parts = []
    for suffix in SUFFIXES:
        paths = [str(f) for f in files if f.suffix.lower() == suffix]
        if not paths:
            continue
        if suffix == ".parquet":
            df = spark.read.option("mergeSchema", "true").parquet(*paths)
            place = F.struct(F.lit(0).cast("long").alias("block"), F.col("_metadata.row_index").alias("position"))
            df = df.select("*", F.col("_metadata.file_path").alias("source_file"), place.alias("row_place"))
        else:
            df = read_jsonl(spark, paths, schema, file=True)
        df = df.withColumn("source_file", F.substring_index(F.url_decode(F.replace("source_file", F.lit("+"), F.lit("%2B"))), f"{base}/", -1)).withColumn("file_ordinal", order[F.col("source_file")])
        if columns is not None:
            taken = projected(columns) if nested else [F.col(c).alias(c.replace(".", "_")) for c in columns]
            df = df.select(*taken, "source_file", "file_ordinal", "row_place")
        parts.append(df)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def projected(paths: list[str]) -> list:
    """Columns that hold the leaves of dotted paths in objects as before; a path inside of another, or twice, is an error."""
    if len(set(paths)) != len(paths) or any(p != q and (q + ".").startswith(p + ".") for p in paths for q in paths):
        raise ValueError("projected paths overlap")
    tree: dict = {}
    for p in paths:
        node = tree
        *above, leaf = p.split(".")
        for a in above:
            node = node.setdefault(a, {})
        node[leaf] = p

    def build(node) -> list:
        return [(F.col(v) if isinstance(v, str) else F.struct(*build(v))).alias(k) for k, v in node.items()]

    return build(tree)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds row_index, from 0 in the order of the columns, which must make rows unique."""
    from ..operators.decisions import row_numbers

    return row_numbers(rows, order)


def identities(spark: SparkSession, root: str | Path, patterns: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), sha256, n_bytes of every file of the snapshot, hashed in the executors."""
    root = Path(root)
    base = str(root.resolve() if root.is_dir() else root.resolve().parent) + "/"
    files = spark.read.format("binaryFile").load([str(f) for f in discover(root, patterns)])
    path = F.substring_index(F.col("path"), base, -1)
    return files.select(path.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob; ``*`` stays inside a folder, ``**`` doesn't."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif c == "*":
            deep = pattern.startswith("**", k)
            out, k = out + (".*" if deep else "[^/]*"), k + (2 if deep else 1)
        elif c == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(c), k + 1
    return f"^{out}$"


def partitioned(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds partition: the name of the one pattern that a path matches.

    patterns is a contract of bounded size, so it is part of the expression.  A path of none or of several partitions, and a
    partition without a path, are errors.
    """
    names = sorted(patterns)
    hits = F.filter(F.array(*[F.when(F.col("path").rlike(glob_regex(patterns[n])), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    out = files.withColumn("_hits", hits)
    counts = {r["p"]: r["n"] for r in out.groupBy(F.when(F.size("_hits") == 1, F.col("_hits")[0]).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if None in counts:
        raise ValueError(f"{counts[None]} files match none or several partitions")
    if empty := [n for n in names if n not in counts]:
        raise ValueError(f"partitions without files: {empty}")
    return out.withColumn("partition", F.col("_hits")[0]).drop("_hits")


class Collision(Exception):
    """Something else is already published under the name."""


def publish_json(path: str | Path, value: object) -> str:
    """Writes canonical JSON once: equal bytes already there are fine, other bytes a Collision. Returns the SHA-256."""
    import hashlib
    import tempfile

    path = Path(path)
    data = canonical_json(value).encode() + b"\n"
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=path.parent, delete=False) as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(f.name, path)
    except FileExistsError:
        if path.read_bytes() != data:
            raise Collision(str(path)) from None
    finally:
        os.unlink(f.name)
    return hashlib.sha256(data).hexdigest()


def relation_digest(df: DataFrame) -> dict:
    """rows, digest and columns of a relation; the digest doesn't depend on the order of rows."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first() if df.columns else None
    return {"rows": got["n"] if got else 0, "digest": str(got["h"]) if got else None, "columns": df.columns}


def publish(df: DataFrame, path: str, manifest: dict | None = None, nonempty: bool = False) -> dict:
    """Writes a relation as parquet where nothing is, then, last, a manifest of its rows beside it; gives the manifest.

    The folder is complete only with its manifest.  The same rows published there before are left as they are; other rows are a
    Collision, and so is a folder without a manifest, which a lost writer left.  nonempty: no rows are an error.
    """
    if nonempty and not df.limit(1).count():
        raise ValueError(f"no rows for {path}")
    beside = Path(f"{path.rstrip('/')}.manifest.json")
    if beside.exists():
        have = json.loads(beside.read_text())
        if relation_digest(df) | (manifest or {}) != {k: v for k, v in have.items() if k != "sha256"}:
            raise Collision(path)
        return have | {"sha256": publish_json(beside, have)}
    if Path(path).exists():
        raise Collision(f"{path} has no manifest")
    df.write.mode("errorifexists").parquet(path)
    out = relation_digest(df.sparkSession.read.parquet(path)) | (manifest or {})
    return out | {"sha256": publish_json(beside, out)}


def materialize(df: DataFrame, order: list[str], path: str, most_rows: int | None = None, manifest: dict | None = None) -> dict:
    """Publishes rows, the first most_rows in order if given, with their row_index; a manifest's status is FAIL for no rows."""
    rows = numbered(df if most_rows is None else first_rows(df, order, most_rows), order)
    return publish(rows, path, (manifest or {}) | {"status": "PASS" if rows.limit(1).count() else "FAIL"})


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order; for materialising a bounded leaf."""
    return df.orderBy(*order).limit(n)


def snapshot_digest(files: DataFrame) -> dict:
    """sha256 and n_bytes of a snapshot: the digest of the canonical list of its files (path, sha256, n_bytes) in the order of paths.

    Paths are sorted by Spark and streamed through the driver a partition at a time; the fold is sequential by definition.
    """
    import hashlib

    h, total = hashlib.sha256(b"["), 0
    for k, r in enumerate(files.select("path", "sha256", "n_bytes").orderBy("path").toLocalIterator(prefetchPartitions=True)):
        h.update(("," if k else "").encode() + canonical_json({"bytes": r["n_bytes"], "path": r["path"], "sha256": r["sha256"]}).encode())
        total += r["n_bytes"]
    h.update(b"]")
    return {"sha256": h.hexdigest(), "n_bytes": total}


def population_digest(members: dict[str, str | Path]) -> str:
    """SHA-256 of the exact bytes of the members' files one behind another, in the order of their names; read in blocks."""
    import hashlib

    h = hashlib.sha256()
    for name in sorted(members):
        with open(members[name], "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
    return h.hexdigest()


def artifact_name(prefix: str, inputs: object, suffix: str = ".json") -> str:
    """A name that depends on the inputs alone: prefix, 16 digits of their canonical digest, suffix."""
    import hashlib

    return f"{prefix}-{hashlib.sha256(canonical_json(inputs).encode()).hexdigest()[:16]}{suffix}"
