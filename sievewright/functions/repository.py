"""Repository names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def repository_key(name: Column) -> Column:
    """``host/owner/name`` in lower case without scheme, user, port, blanks, outer slashes or ``.git``.

    Null, blank, or nothing but slashes gives null.
    """
    x = F.lower(F.regexp_replace(name, _BLANKS, ""))
    x = F.regexp_replace(x, r"^[a-z][a-z0-9+.\-]*://", "")
    x = F.regexp_replace(x, r"^[^/@]*@", "")
    x = F.regexp_replace(x, r"^([^/:]+):[0-9]+(?=/|$)", "$1")
    x = F.regexp_replace(x, r"^([^/:]+):", "$1/")
    x = F.regexp_replace(x, r"^[/\s]+|[/\s]+$", "")
    x = F.regexp_replace(x, r"\.git$", "")
    return F.nullif(F.regexp_replace(x, r"^[/\s]+|[/\s]+$", ""), F.lit(""))


def canonical_repository(name: Column, default_host: str = "github.com") -> Column:
    """Canonical repository of a ``git@host:path``, URL, ``host/owner/name`` or bare ``owner/name``.

    A URL keeps host and path only and needs a host; one lower-case ``.git`` at the very end goes before outer slashes do, and
    parts without a character are left out.  Fewer than two parts, or than three behind an explicit host, give null, as null does.
    """
    x = F.regexp_replace(name, _BLANKS, "")
    scp, url = x.rlike(r"\Agit@[^:]+:.+\z"), x.contains("://")
    rest = F.regexp_replace(x, r"^[^:]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    whole = F.when(scp, F.regexp_replace(x, r"^git@([^:]+):", "$1/")).when(url, F.when(host != "", F.concat(host, path))).otherwise(x)
    parts = F.filter(F.split(F.lower(F.regexp_replace(whole, r"\.git$", "")), "/"), lambda p: p != "")
    n = F.size(parts)
    return (
        F.when((n == 2) & ~scp & ~url, F.concat(F.lit(default_host + "/"), F.array_join(parts, "/")))
        .when(n >= 3, F.array_join(parts, "/"))
        .otherwise(F.lit(None).cast("string"))
    )
