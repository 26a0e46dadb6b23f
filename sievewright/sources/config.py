"""Small configuration files, parsed from exactly the bytes whose digest is given."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .snapshot import unique_object

#: Bytes of a configuration file at most.
MOST_BYTES = 1 << 20


def read_mapping(path: str | Path, most_bytes: int = MOST_BYTES) -> tuple[dict, str, int]:
    """The mapping in a JSON or YAML file, its SHA-256 and size.

    Keys that occur twice in JSON, anything but a mapping, larger files and other endings are errors.  YAML needs its library.
    """
    path = Path(path)
    data = path.read_bytes()
    if len(data) > most_bytes:
        raise ValueError(f"{path} has more than {most_bytes} bytes")
    if path.suffix.lower() == ".json":
        value = unique_object(data.decode())
    elif path.suffix.lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no library reads YAML here") from e
        value = yaml.safe_load(data)
    else:
        raise ValueError(f"{path} is neither JSON nor YAML")
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value, hashlib.sha256(data).hexdigest(), len(data)


def records(spark: SparkSession, entries: list[dict], schema: str) -> DataFrame:
    """Entries of a configuration as a relation; fields that the schema doesn't have are an error, missing ones null."""
    out = spark.createDataFrame([], schema)
    known = set(out.columns)
    if extra := sorted({k for e in entries for k in e} - known):
        raise ValueError(f"fields that aren't known: {extra}")
    return spark.createDataFrame([tuple(e.get(c) for c in out.columns) for e in entries], schema)


def aliases(spark: SparkSession, path: str | Path) -> DataFrame:
    """alias, target of a file with just the mapping ``aliases`` of names to names and a schema_version."""
    value, _, _ = read_mapping(path)
    names = value.get("aliases")
    if set(value) != {"schema_version", "aliases"} or not isinstance(names, dict) or not all(isinstance(x, str) for kv in names.items() for x in kv):
        raise ValueError("an alias file has a schema_version and names")
    return spark.createDataFrame(list(names.items()), "alias string, target string")
