"""Canonical spellings of paths and digests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """`/` as the only separator, none doubled, no leading `./`. Null stays null."""
    slashes = F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")
    return F.regexp_replace(slashes, r"^(?:\./)+", "")


def canonical_hash(digest: Column) -> Column:
    """The digest without case, prefix `sha256:` and outer blanks; blank or null gives null."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(digest)), "^sha256:", ""))
    return F.when(bare != "", bare)


def resolve_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments and doubled separators; `..` above the root is dropped."""
    parts = F.aggregate(
        F.split(F.translate(path, "\\", "/"), "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(parts, "/")


def directory(path: Column) -> Column:
    """The part before the last `/`, empty if there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)
