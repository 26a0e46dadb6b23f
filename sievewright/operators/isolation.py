"""Whether what a model saw was free of the reference solution: inspection of recorded contexts, bindings, summaries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import forbidden_paths, gate, key_kind

# Reason codes in the order in which a row's findings are given, and the one place where a reference patch may stand.
REASONS = [
    "invalid_recorded_model_context",
    "gold_field_in_recorded_model_context",
    "reference_patch_in_initial_prompt",
    "unsupported_reference_patch_location",
    "raw_normalized_binding_mismatch",
    "population_binding_mismatch",
]
ALLOWED_PLACE = ("metadata", "reference_patch")

INSPECTION = "reference_patch boolean, reasons array<string>"


def canonical_json(c: Column) -> Column:
    """A JSON column in canonical form: sorted keys, no blanks, characters as they are; null for null and malformed JSON."""

    @F.arrow_udf("string")
    def dump(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = []
            for text in part.to_pylist():
                try:
                    out.append(None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":")))
                except ValueError:
                    out.append(None)
            yield pa.array(out, pa.string())

    return dump(c)


def canonical_sha256(c: Column) -> Column:
    """SHA-256 of a JSON column in canonical form."""
    return F.sha2(canonical_json(c), 256)


def leaves(value: object) -> Iterator[str]:
    """All strings at any depth, keys aside."""
    stack = [value]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            yield node
        elif isinstance(node, dict):
            stack += node.values()
        elif isinstance(node, list):
            stack += node


def _lf(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _tool_definitions(tools: object) -> list | None:
    """Tool definitions, serialised ones parsed; None if they aren't a list of objects or JSON texts."""
    if tools is None:
        return []
    if not isinstance(tools, list):
        return None
    out = []
    for tool in tools:
        try:
            out.append(json.loads(tool) if isinstance(tool, str) else tool)
        except ValueError:
            return None
        if not isinstance(tool, (str, dict)):
            return None
    return out


def _misplaced(row: dict) -> bool:
    """Whether a field outside of trajectory and tools names a reference patch anywhere but in the allowed place."""
    stack: list[tuple[object, tuple[str, ...]]] = [({k: v for k, v in row.items() if k not in ("trajectory", "tools")}, ())]
    while stack:
        node, path = stack.pop()
        if isinstance(node, list):
            stack += [(x, path) for x in node]
        elif isinstance(node, dict):
            here = [(v, (*path, k)) for k, v in node.items()]
            if any(all(key_kind(p[-1])) and p != ALLOWED_PLACE for _, p in here):
                return True
            stack += here
    return False


def inspect(row: dict) -> tuple[bool, list[str]]:
    """Whether a structured reference patch is there, and the row's reasons in their order.

    Steps of the role assistant are output; every other step, of whatever role, and the tool definitions are input that the
    model could see.  Input may neither hold fields that name a reference patch nor the reference patch itself, line ends made
    equal and stripped; the patch must stand in metadata.reference_patch.patch and nowhere else.
    """
    reasons = set()
    steps, tools = row.get("trajectory"), _tool_definitions(row.get("tools"))
    whole = isinstance(steps, list) and all(isinstance(s, dict) for s in steps)
    shown = [s for s in steps if s.get("role") != "assistant"] if whole else []
    if any(forbidden_paths(s) for s in shown) or (whole and tools is not None and forbidden_paths(tools)):
        reasons.add(REASONS[1])
    elif not whole or tools is None:
        reasons.add(REASONS[0])
    metadata = row.get("metadata")
    held = metadata.get("reference_patch") if isinstance(metadata, dict) else None
    patch = held.get("patch") if isinstance(held, dict) else None
    known = isinstance(patch, str) and patch != ""
    if not known or _misplaced(row):
        reasons.add(REASONS[3])
    wanted = _lf(patch).strip() if known else ""
    if wanted and isinstance(steps, list):
        before = next((k for k, s in enumerate(steps) if not isinstance(s, dict)), len(steps))
        seen = [s for s in steps[:before] if s.get("role") != "assistant"] + ((tools or []) if whole else [])
        if any(wanted in _lf(text) for text in leaves(seen)):
            reasons.add(REASONS[2])
    return known, [r for r in REASONS if r in reasons]


def inspected(rows: DataFrame, json_column: str) -> DataFrame:
    """Adds inspection, a struct of reference_patch and reasons, of a row's JSON; null and malformed JSON count as an empty object.

    The recursion over nested keys is what expressions can't do; it runs over Arrow batches and keeps no text.
    """

    @F.arrow_udf(f"struct<{INSPECTION.replace(' boolean', ': boolean').replace('reasons ', 'reasons: ')}>")
    def look(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            known, reasons = [], []
            for text in part.to_pylist():
                try:
                    row = json.loads(text) if text is not None else {}
                except ValueError:
                    row = {}
                k, r = inspect(row if isinstance(row, dict) else {})
                known.append(k)
                reasons.append(r)
            yield pa.StructArray.from_arrays([pa.array(known, pa.bool_()), pa.array(reasons, pa.list_(pa.string()))], ["reference_patch", "reasons"])

    return rows.withColumn("inspection", look(F.col(json_column)))


def binding_agrees(pairs: dict[str, str]) -> Column:
    """Whether all pairs of columns hold equal values, nulls being equal to each other only."""
    out = F.lit(True)
    for left, right in pairs.items():
        out = out & F.col(left).eqNullSafe(F.col(right))
    return out


def claimed(raw: DataFrame, samples: DataFrame, digest: str, order: str) -> DataFrame:
    """Raw rows that samples claim by their digest, each digest by its first row only, with the sample's columns."""
    first = raw.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(order).alias(order))
    return raw.join(first.select(order), order, "left_semi").join(samples, digest)


def findings(scanned: DataFrame, n_raw: int, n_expected_raw: int, n_covered: int, n_expected: int) -> DataFrame:
    """row_index, sample_id, reason_code: a row for each reason of each claimed row, and one for the whole population if its
    counts aren't the expected ones (row_index is then the number of raw rows).

    scanned: row_index, sample_id, inspection, agrees.
    """
    codes = F.concat(F.col("inspection.reasons"), F.when(F.col("agrees"), F.array().cast("array<string>")).otherwise(F.array(F.lit(REASONS[4]))))
    rows = scanned.select(F.col("row_index").cast("long").alias("row_index"), "sample_id", F.explode(codes).alias("reason_code"))
    if n_raw == n_expected_raw and n_covered == n_expected:
        return rows
    one = scanned.sparkSession.range(1).select(F.lit(n_raw).cast("long").alias("row_index"), F.lit(None).cast("string").alias("sample_id"), F.lit(REASONS[5]).alias("reason_code"))
    return rows.unionByName(one)


def summary(scanned: DataFrame, found: DataFrame, n_expected: int) -> DataFrame:
    """One row: n_seen, n_reference_patches, n_findings and status (FAIL with findings, BLOCKED if not all were seen, else PASS)."""
    one = F.lit(1).alias("k")
    a = scanned.agg(F.count(F.lit(1)).alias("n_seen"), F.count_if("inspection.reference_patch").alias("n_reference_patches"), one)
    b = found.agg(F.count(F.lit(1)).alias("n_findings"), one)
    return a.join(b, "k").drop("k").withColumn("status", gate(F.col("n_findings"), F.col("n_seen"), F.lit(n_expected)))
