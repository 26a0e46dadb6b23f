import hashlib

import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.functions.repository import canonical_repository, repository_key


def one(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Acme/Widget", "github.com/acme/widget"), ("https://github.com/acme/widget.git", "github.com/acme/widget"),
        ("git@github.com:Acme/Widget.git", "github.com/acme/widget"), ("https://u:p@Host.example:8443/a/b?q=1#x", "host.example/a/b"),
        ("https://github.com/acme/widget.git/", "github.com/acme/widget.git"), ("a/b.GIT", "github.com/a/b.git"), ("widget", None),
        ("https://github.com/acme", None), ("  ", None), (None, None), ("github.com/acme/widget", "github.com/acme/widget"),
        ("https://github.com//owner/repo", "github.com/owner/repo"), ("owner//repo", "github.com/owner/repo"), ("git@h:a//b", "h/a/b"), ("git@h:a", None), ("file:///a/b/c", None), ("a//", None),
    ],
)
def test_canonical_repository(spark, raw, want):
    assert one(spark, canonical_repository, raw) == [want]


def test_repository_key(spark):
    raw = ["  https://Forge.Example/A/B", "ssh://git@git.example:2222/a/b.git ", "git@git.example:A/B.git", "git.example/a/b/", None, " / "]
    assert one(spark, repository_key, *raw) == ["forge.example/a/b", "git.example/a/b", "git.example/a/b", "git.example/a/b", None, None]


# Spellings of licenses and what becomes of them.
def test_license_table(spark):
    raw = [" MIT", "MIT License", "Apache License 2.0", "BSD 2-Clause", None, "", "unknown", "GPL-3.0", "AGPL-3.0", "MIT OR GPL-3.0"]
    assert one(spark, X.license_disposition, *raw) == ["ALLOW"] * 4 + ["UNKNOWN"] * 3 + ["REJECT"] * 3
    assert one(spark, X.spdx, *raw[:4]) == ["MIT", "MIT", "Apache-2.0", "BSD-2-Clause"]


def test_language(spark):
    assert one(spark, X.language, "js", " TypeScript", "ts", "Python", " ", None) == ["JavaScript", "TypeScript", "TypeScript", "python", None, None]


def test_normalized_text(spark):
    assert one(spark, X.normalized_text, "one  \r\ntwo\r\n", "one\ntwo\n", "\t a \x1f\n\n b ", "", None) == ["one\ntwo", "one\ntwo", "a\n\n b", "", None]
    assert one(spark, X.fingerprint, "one  \r\ntwo\r\n") == [hashlib.sha256(b"one\ntwo").hexdigest()]


def test_unit_bucket(spark):
    key = "github.com/acme/widget"
    want = int(hashlib.sha256(f"11:{key}".encode()).hexdigest()[:16], 16) / (2**64 - 1)
    assert one(spark, lambda c: X.unit_bucket(c, 11), key)[0] == pytest.approx(want, abs=1e-15)


def test_diffs(spark):
    d = "diff --git a/x.py b/x.py\r\n--- a/x.py\r\n+++ b/x.py\r\n+a\r\n-b\r\n+c"
    assert one(spark, lambda c: X.diff_lines(c, "+"), d, "", None) == [2, 0, None]
    assert one(spark, lambda c: X.diff_lines(c, "-"), d) == [1]
    assert one(spark, X.changed_paths, d) == [["x.py"]]
    assert one(spark, X.is_text_diff, d, "x", None, d + "\nrename from a") == [True, False, False, False]
    more = [d + x for x in ("\nnew file mode 100644", "\r\ndeleted file mode 100644", "\nliteral 12", "\ndelta 3", "\nGIT binary patch", "\n+GIT binary patch", "\nGIT binary patches", "\0", "\n" + "x" * 1_000_000)]
    assert one(spark, X.is_text_diff, *more) == [False] * 5 + [True, True, False, False]


def test_capped_text(spark):
    assert one(spark, lambda c: X.capped(c, 4), "abcdef", "aéé", "ééé", "ab", "", None) == ["abcd", "aé", "éé", "ab", "", None]


def test_field_names(spark):
    assert one(spark, X.key_words, "goldPatch_v2", "ground-truth.Diff") == [["gold", "patch", "v2"], ["ground", "truth", "diff"]]
    assert one(spark, X.key_words, "aB2C", "GOLDPatch", "goldPATCH", "", None) == [["a", "b2", "c"], ["goldpatch"], ["gold", "patch"], [], None]
    assert one(spark, X.names_reference, "goldPatch", "ground_truth", "groundwork", "refs") == [True, True, False, False]


def test_test_output(spark):
    assert one(spark, X.test_name, "a b [12 ms]", "a in 3 sec", "a (0.5s) ") == ["a b", "a", "a"]
    assert one(spark, X.test_name, "a in 3 msec b", "x [1.5 S]", "in 3", "a (3) ", None) == ["a b", "x", "in 3", "a (3)", None]
    assert one(spark, X.test_count, "# tests 3\nx\nℹ tests 14", "none", None) == [14, None, None]


def test_redaction(spark):
    got = one(spark, X.redacted, "API_KEY=abc123 rest", 'password: "x y"', "Authorization: Bearer abc.def", "nothing", None)
    assert got == ["API_KEY=[REDACTED] rest", 'password: "[REDACTED]"', "Authorization: Bearer [REDACTED]", "nothing", None]
