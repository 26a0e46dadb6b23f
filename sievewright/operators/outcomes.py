"""Outcomes of test runs, training texts and task projections, as expressions on nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.repository import canonical_repository
from ..functions.text import language, stripped, test_name
from .decisions import commit
from .evidence import reference_findings
from .isolation import canonical_json
from .selection import cascade
from .traces import text_field, type_at


def normalized_statuses(statuses: Column) -> Column:
    """A map of test statuses under names without timings, in upper case; of names that fall together a failure wins, else the smallest status."""
    entries = F.transform(F.map_entries(statuses), lambda e: F.struct(test_name(e.key).alias("k"), F.upper(e.value).alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e.k))
    def best(k: Column) -> Column:
        mine = F.transform(F.filter(entries, lambda e: e.k == k), lambda e: e.v)
        return F.when(F.array_contains(mine, "FAILED"), "FAILED").otherwise(F.array_min(mine))

    return F.map_from_arrays(names, F.transform(names, best))


# Marks with which reporters of JavaScript tests list failures, and words of their summaries.
CROSS, DETAIL, AVA_FAIL, AVA_REASON = "✕", "●", "✘ [fail]:", "Rejected promise returned by test"
SUITE_SEPARATOR = " › "


def failed_names(log: Column) -> Column:
    """Names of the failed tests that a log of a JavaScript runner reports.

    A numbered line (``1) name``) counts alone.  A crossed line counts if a detail line names the test, itself or behind its
    suite, and a ``Tests:`` summary speaks of failures.  A rejection line counts if the name is repeated on a line indented by
    two blanks and a summary tells how many tests failed.  Lines are split once; all else works on arrays inside the JVM.
    """
    lines = F.split(F.regexp_replace(log, "\r\n?", "\n"), "\n")
    behind = lambda x, mark: test_name(F.substring(F.trim(x), len(mark) + 1, 1 << 30))
    marked = lambda mark: F.filter(lines, lambda x: F.ltrim(x).startswith(mark))
    numbered = F.filter(lines, lambda x: F.ltrim(x).rlike("\\A[0-9]+\\)\\s"))
    number_names = F.transform(numbered, lambda x: test_name(F.regexp_replace(F.rtrim(F.regexp_replace(F.ltrim(x), "\\A[0-9]+\\)\\s+", "")), ":\\z", "")))
    details = F.transform(marked(DETAIL), lambda x: behind(x, DETAIL))
    details = F.concat(details, F.transform(details, lambda x: F.element_at(F.split(x, SUITE_SEPARATOR), -1)))
    jest = F.exists(lines, lambda x: x.startswith("Tests:") & x.rlike("\\b0*[1-9][0-9]*\\s+failed\\b"))
    crossed = F.filter(F.transform(marked(CROSS), lambda x: behind(x, CROSS)), lambda n: jest & F.array_contains(details, n))
    indented = F.transform(F.filter(lines, lambda x: x.rlike("\\A  \\S")), test_name)
    ava = F.exists(lines, lambda x: F.trim(x).rlike("\\A[1-9][0-9]*\\s+tests?\\s+failed\\z"))
    rejected = F.filter(marked(AVA_FAIL), lambda x: F.rtrim(x).endswith(AVA_REASON))
    rejected = F.transform(rejected, lambda x: test_name(F.regexp_replace(F.substring(F.trim(x), len(AVA_FAIL) + 1, 1 << 30), f"\\s+{AVA_REASON}\\z", "")))
    rejected = F.filter(rejected, lambda n: ava & F.array_contains(indented, n))
    return F.array_distinct(F.concat(number_names, crossed, rejected))


def with_recovered(statuses: Column, log: Column, expected: Column) -> Column:
    """Statuses, and FAILED for expected tests that only the log names; known ones are never overwritten."""
    missing = F.filter(failed_names(log), lambda n: F.array_contains(expected, n) & ~F.map_contains_key(statuses, n))
    return F.map_concat(statuses, F.map_from_arrays(missing, F.transform(missing, lambda _: F.lit("FAILED"))))


def all_have(statuses: Column, names: Column, status: str) -> Column:
    return F.forall(names, lambda n: F.coalesce(F.try_element_at(statuses, n) == status, F.lit(False)))


def complete(statuses: Column, names: Column) -> Column:
    return F.forall(names, lambda n: F.map_contains_key(statuses, n))


def evaluate(runs: DataFrame) -> DataFrame:
    """Adds reason (null for a usable run), resolved and label_agrees.

    runs: baseline, candidate (maps of statuses), baseline_ran, candidate_ran, candidate_succeeded, truncated (booleans), fail_to_pass,
    pass_to_pass (arrays), expected_label (boolean or null).  The first of: baseline_failed_to_run, candidate_failed_to_run, truncated,
    incomplete_tests, baseline_not_reproduced, exit_contradicts_tests, label_disagreement; only with the last one is resolved known too.
    """
    both = F.concat("fail_to_pass", "pass_to_pass")
    passed = all_have(F.col("candidate"), both, "PASSED")
    reproduced = all_have(F.col("baseline"), F.col("fail_to_pass"), "FAILED") & all_have(F.col("baseline"), F.col("pass_to_pass"), "PASSED")
    agrees = F.when(F.col("expected_label").isNotNull(), F.col("expected_label") == passed)
    reason = cascade([
        ("baseline_failed_to_run", ~F.col("baseline_ran")), ("candidate_failed_to_run", ~F.col("candidate_ran")), ("truncated", F.col("truncated")),
        ("incomplete_tests", ~complete(F.col("baseline"), both) | ~complete(F.col("candidate"), both)), ("baseline_not_reproduced", ~reproduced),
        ("exit_contradicts_tests", passed & ~F.col("candidate_succeeded")), ("label_disagreement", ~agrees),
    ])
    known = reason.isNull() | (reason == "label_disagreement")
    return runs.withColumns({"reason": reason, "resolved": F.when(known, passed), "label_agrees": F.when(known, agrees)})


def listed(c: Column) -> Column:
    """Test names given as a JSON array or as one name, without blanks; null gives none."""
    parsed = F.from_json(c, "array<string>")
    return F.filter(F.when(c.startswith("["), parsed).otherwise(F.array(c)), lambda x: x.isNotNull() & (F.trim(x) != ""))


def training_text(columns: list[str]) -> Column:
    """JSON of the columns with sorted names; nulls are kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def strings_of(df: DataFrame, name: str) -> Column:
    """Test names or commands given as an array or as one string, stripped; null where one of them is blank or there is no such column."""
    kind = type_at(df.schema, name)
    if isinstance(kind, T.StringType):
        values = F.when(F.col(name).isNotNull(), F.array(F.col(name)))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        values = F.col(name)
    else:
        return F.lit(None).cast("array<string>")
    clean = F.transform(values, stripped)
    return F.when(F.forall(clean, lambda x: F.coalesce(x != "", F.lit(False))), clean)


def private_tasks(rows: DataFrame, languages: tuple[str, ...] = ("TypeScript", "JavaScript")) -> DataFrame:
    """What an evaluation needs of each task row, without its solution, and reason, the first rule that a row breaks or null.

    rows: instance_id, repo, base_commit, language, image_name, test_patch, FAIL_TO_PASS, PASS_TO_PASS (strings or arrays; the latter may
    be absent) and install_config with log_parser and test_cmd.  Lists may not repeat a name, nor have one in common.
    """
    text = lambda n: text_field(rows, (n,)) if "." not in n else (F.nullif(stripped(F.col(n)), F.lit("")) if isinstance(type_at(rows.schema, n), T.StringType) else F.lit(None).cast("string"))
    absent = F.array().cast("array<string>")
    passing = strings_of(rows, "PASS_TO_PASS") if "PASS_TO_PASS" in rows.columns else absent
    out = rows.select(
        text("instance_id").alias("instance_id"), canonical_repository(text("repo")).alias("repository"), commit(text("base_commit")).alias("base_commit"), language(text("language")).alias("language"),
        text("image_name").alias("image_name"), F.when(F.col("test_patch") != "", F.col("test_patch")).alias("test_patch"), strings_of(rows, "FAIL_TO_PASS").alias("fail_to_pass"), passing.alias("pass_to_pass"),
        strings_of(rows, "install_config.test_cmd").alias("test_commands"), text("install_config.log_parser").alias("log_parser"),
    )
    repeats = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    empty = lambda c: F.coalesce(F.size(c) < 1, F.lit(True))
    reason = cascade([
        ("unsupported_language", ~F.coalesce(F.col("language").isin(*languages), F.lit(False))), ("missing_log_parser", F.col("log_parser").isNull()), ("missing_instance_id", F.col("instance_id").isNull()),
        ("invalid_repository", F.col("repository").isNull()), ("invalid_base_commit", F.col("base_commit").isNull()), ("invalid_image", F.col("image_name").isNull() | F.col("image_name").rlike("[\\s\\x00]")),
        ("missing_test_patch", F.col("test_patch").isNull()), ("invalid_fail_to_pass", empty("fail_to_pass")), ("invalid_pass_to_pass", F.col("pass_to_pass").isNull()), ("invalid_test_commands", empty("test_commands")),
        ("repeated_names", repeats("fail_to_pass") | repeats("pass_to_pass") | repeats("test_commands")), ("names_in_both_lists", F.arrays_overlap("fail_to_pass", "pass_to_pass")),
    ])
    return out.withColumn("reason", reason)


#: Fields of a sample that training may see.
VISIBLE = ["repository", "base_commit", "issue_or_pr_id", "trajectory", "generated_patch"]


def training_texts(samples: DataFrame) -> DataFrame:
    """sample_id, text: the canonical JSON of what training may see of each sample; a sample without steps, or whose steps name reference
    patches, fails the query."""
    steps = F.to_json("trajectory")
    bad = (F.coalesce(F.size("trajectory"), F.lit(0)) < 1) | (F.size(reference_findings(steps)) > 0)
    text = canonical_json(F.to_json(F.struct(*VISIBLE), {"ignoreNullFields": "false"}))
    return samples.select("sample_id", F.when(bad, F.raise_error(F.concat(F.lit("sample without steps or with reference patches: "), "sample_id")).cast("string")).otherwise(text).alias("text"))
