"""Scalar expressions on text, ids, licenses and patches.  Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that counts, licenses that are allowed, language names, reference words, words of patch fields,
# line starts that a text diff may not have and its most bytes, characters of bearer tokens, marks of a test count.
WHITE = "\\u0009-\\u000d\\u001c-\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ALLOWED_LICENSES = {
    "mit": "MIT",
    "mit license": "MIT",
    "apache-2.0": "Apache-2.0",
    "apache 2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "bsd-2-clause": "BSD-2-Clause",
    "bsd 2-clause": "BSD-2-Clause",
    "bsd-3-clause": "BSD-3-Clause",
    "bsd 3-clause": "BSD-3-Clause",
}
LANGUAGES = {"js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript"}
REFERENCE_WORDS = ["gold", "golden", "reference", "ref", "oracle", "groundtruth"]
PATCH_WORDS = ["patch", "diff"]
NOT_TEXT_DIFF = ["Binary files ", "literal ", "delta ", "new file mode ", "deleted file mode ", "old mode ", "new mode ", "rename from ", "rename to ", "copy from ", "copy to "]
DIFF_BYTES = 1_000_000
TOKEN_CHARACTERS = "A-Za-z0-9._~+/=-"
COUNT_MARKS = ["#", "ℹ"]

#: A word of a field name: capitals part from what is before them, and run on into what is behind.
KEY_WORD = "[A-Z]*[a-z0-9]+|[A-Z]+"


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def usable(*columns: Column) -> Column:
    """The first of the columns that holds more than white space, stripped; else null."""
    return F.coalesce(*[F.nullif(stripped(c.cast("string")), F.lit("")) for c in columns])


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed map, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def normalized_text(c: Column) -> Column:
    """Line ends made LF, white space stripped from the end of every line and from both ends of the whole."""
    lines = F.regexp_replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), f"[{WHITE}&&[^\\n]]+(?=\\n|$)", "")
    return stripped(lines)


def fingerprint(c: Column) -> Column:
    """SHA-256 of the normalized text."""
    return F.sha2(normalized_text(c), 256)


def digest(domain: str, *parts: Column) -> Column:
    """SHA-256 of the parts under a domain name; a part's length goes before it, so parts can't run together."""
    joined = F.concat(F.lit(domain), F.lit("\0"), *[x for p in parts for x in (F.coalesce(F.octet_length(p), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p, F.lit("")))])
    return F.sha2(joined, 256)


def language(c: Column) -> Column:
    """Canonical language name: JavaScript and TypeScript under their short names too, others in lower case; blank is null."""
    x = F.lower(usable(c))
    return F.coalesce(lookup(x, LANGUAGES), x)


def spdx(c: Column) -> Column:
    """Identifier of an allowed license, else null."""
    return lookup(F.lower(stripped(c)), ALLOWED_LICENSES)


def license_disposition(c: Column) -> Column:
    """ALLOW, REJECT or UNKNOWN; blank and unrecognised licenses are UNKNOWN, anything with gpl in it is REJECT."""
    return F.when(spdx(c).isNotNull(), "ALLOW").when(F.lower(c).contains("gpl"), "REJECT").otherwise("UNKNOWN")


def license_reason(c: Column) -> Column:
    return (
        F.when(usable(c).isNull(), "missing")
        .when(spdx(c).isNotNull(), "allowed")
        .when(F.lower(c).contains("gpl"), "copyleft")
        .otherwise("not recognised")
    )


def resolved(c: Column) -> Column:
    """1 is true, 0 false; -1 and null are unknown (null).  Use resolved_is_valid for anything else."""
    return F.when(c == 1, True).when(c == 0, False)


def resolved_is_valid(c: Column) -> Column:
    return c.isNull() | c.isin(-1, 0, 1)


def unit_bucket(key: Column, seed: int) -> Column:
    """A number from 0 to 1 from the first 64 bits of the SHA-256 of ``seed:key``."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551615.0)


def diff_lines(patch: Column, sign: str) -> Column:
    """Lines a unified diff adds (sign ``+``) or removes (``-``), without the file headers."""
    lines = F.split(F.replace(F.replace(patch, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    return F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))


def changed_paths(patch: Column) -> Column:
    """Sorted different paths that the headers of a git diff name."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/(\S+) b/\S+"), F.lit(1))))


def is_text_diff(patch: Column, most_bytes: int = DIFF_BYTES) -> Column:
    """Whether a patch is a bounded git diff of text: no NUL, no binary, new or deleted file, mode, rename or copy lines. Null isn't."""
    starts = "|".join(NOT_TEXT_DIFF)
    forbidden = rf"(?:^|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])(?:{starts}|GIT binary patch(?=$|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]))"
    return F.coalesce(patch.startswith("diff --git ") & (F.octet_length(patch) <= most_bytes) & ~patch.contains("\0") & ~patch.rlike(forbidden), F.lit(False))


def key_words(c: Column) -> Column:
    """Lower-case words of a field name."""
    return F.transform(F.regexp_extract_all(c, F.lit(KEY_WORD), F.lit(0)), F.lower)


def names_reference(c: Column) -> Column:
    w = key_words(c)
    return F.arrays_overlap(w, F.array(*[F.lit(x) for x in REFERENCE_WORDS])) | (F.array_contains(w, "ground") & F.array_contains(w, "truth"))


def names_patch(c: Column) -> Column:
    return F.arrays_overlap(key_words(c), F.array(*[F.lit(x) for x in PATCH_WORDS]))


def test_name(c: Column) -> Column:
    """A test's name without the time it took: ``[12 ms]`` or ``(1.5s)`` at its end, ``in 3 msec`` inside."""
    number, blanks = "[0-9]+(?:[.][0-9]+)?", "[\\s]*"

    def enclosed(x: Column, left: str, right: str) -> Column:
        return F.regexp_replace(x, blanks.join(["(?i)", f"\\{left}", number, "m?s", f"\\{right}", "\\z"]), "")

    x = enclosed(c, "[", "]")
    x = F.regexp_replace(x, f"(?i)[\\s]+in[\\s]+{number}[\\s]+m?sec\\b", "")
    return stripped(enclosed(x, "(", ")"))


def test_count(output: Column) -> Column:
    """The last count of tests that a run's output reports on a line of its own, as in ``# tests 12``, or null."""
    words = F.transform(F.split(output, "\n"), lambda x: F.split(F.rtrim(F.regexp_replace(x, "\\s+", " ")), " "))
    is_count = lambda w: (F.size(w) == 3) & w[0].isin(*COUNT_MARKS) & (w[1] == "tests") & w[2].rlike("\\A[0-9]+\\z")
    return F.try_element_at(F.filter(words, is_count), F.lit(-1))[2].cast("long")


def capped(c: Column, most_bytes: int) -> Column:
    """The first bytes of a text, at most so many, cut between characters."""
    head = F.substring(F.encode(c, "UTF-8"), 1, most_bytes)
    whole = F.regexp_replace(F.make_valid_utf8(head.cast("string")), "\ufffd+\\z", "")
    return F.when(F.octet_length(c) <= most_bytes, c).otherwise(whole)


def redacted(c: Column) -> Column:
    """Text whose values of secret-like settings and bearer tokens are blacked out."""
    name = r"(?i)(\b[a-z0-9_.-]*(?:api[_-]?key|auth|credential|password|private[_-]?key|secret|token)[a-z0-9_.-]*\s*[=:]\s*)"
    x = F.regexp_replace(c, rf"(?i)\bbearer\s+[{TOKEN_CHARACTERS}]+", "Bearer [REDACTED]")
    x = F.regexp_replace(x, name + "([\"'])[^\"'\n]*\\2", "$1$2[REDACTED]$2")
    return F.regexp_replace(x, name + "(?![\"'\\[])(?!Bearer \\[)[^\\s\"',;]+", "$1[REDACTED]")
