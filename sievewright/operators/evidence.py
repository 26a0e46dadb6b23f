"""Scans of nested records for reference material, and accounting checks on their results."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import KEY_WORD, PATCH_WORDS, REFERENCE_WORDS, names_patch, names_reference


@functools.lru_cache(1 << 16)
def key_kind(key: str) -> tuple[bool, bool]:
    """Whether the words of a field name speak of reference material, and of a patch."""
    words = {w.lower() for w in re.findall(KEY_WORD, key)}
    return bool(words & set(REFERENCE_WORDS)) or {"ground", "truth"} <= words, bool(words & set(PATCH_WORDS))


def forbidden_paths(document: object) -> list[str]:
    """Paths of the keys that name a patch while they or a key above them name reference material."""
    found: list[str] = []
    stack: list[tuple[object, bool, str]] = [(document, False, "$")]
    while stack:
        node, below, path = stack.pop()
        if isinstance(node, dict):
            for k, v in node.items():
                reference, patch = key_kind(str(k))
                if (below or reference) and patch:
                    found.append(f"{path}.{k}")
                stack.append((v, below or reference, f"{path}.{k}"))
        elif isinstance(node, list):
            stack += [(v, below, f"{path}[]") for v in node]
    return sorted(found)


def reference_findings(c: Column) -> Column:
    """Forbidden paths of a JSON column, recursion that expressions can't do; null for malformed JSON, which is no finding."""

    @F.pandas_udf("array<string>")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for text in part:
                try:
                    out.append(forbidden_paths(json.loads(text)) if text is not None else None)
                except ValueError:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return scan(c)


def flat_findings(keys: Column) -> Column:
    """Of an array of top-level keys those that name reference material and a patch at once; stays in the JVM."""
    return F.filter(keys, lambda k: names_reference(k) & names_patch(k))


def prompt_contains(text: Column, patch: Column) -> Column:
    """Whether the patch, line ends made equal and stripped, is part of the text; a blank patch never is."""
    flat = lambda c: F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    p = F.trim(flat(patch))
    return F.coalesce((p != "") & flat(text).contains(p), F.lit(False))


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n_rows"))


def gate(n_findings: Column, n_seen: Column, n_expected: Column) -> Column:
    """FAIL with findings, BLOCKED where not all were seen or none was expected, else PASS."""
    return F.when(n_findings > 0, "FAIL").when((n_seen != n_expected) | (n_expected == 0), "BLOCKED").otherwise("PASS")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n_rows: in how many rows each rule (true, false or null) doesn't hold; one scan for all rules."""
    counted = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows")) for n in rules])))


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side of the rows of one relation that the other doesn't hold in equal form: left_only, right_only or changed."""
    h = lambda df: df.select(F.col(key), F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).alias("h"))
    a, b = h(left).alias("a"), h(right).alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    side = F.when(F.col(f"b.{key}").isNull(), "left_only").when(F.col(f"a.{key}").isNull(), "right_only").when(F.col("a.h") != F.col("b.h"), "changed")
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), side.alias("side")).where("side is not null")
