"""Column functions over paths and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def defaulted(c: Column, default: str) -> Column:
    """The trimmed text, or the default where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def resolved(path: Column, folder: Column) -> Column:
    """An absolute path as it is, another below the manifest's folder."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))


def under(path: Column, prefix: str) -> Column:
    """Whether the path is the prefix or lies below it; /a/b is not a prefix of /a/bc."""
    p = prefix.rstrip("/")
    return (path == p) | path.startswith(p + "/")


def rewritten(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The path with its prefix replaced by the first rule (from, to) that matches at a slash."""
    out = path
    for old, new in reversed(rules):
        old, new = old.rstrip("/"), new.rstrip("/")
        out = F.when(under(path, old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(out)
    return out


def longest_rewritten(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """As rewritten, by the longest rule that matches."""
    return rewritten(path, sorted(rules, key=lambda r: -len(r[0].rstrip("/"))))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def name_of(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def parent(path: Column) -> Column:
    """Everything before the last slash."""
    return F.regexp_replace(path, r"/[^/]*$", "")


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(name_of(path), r"(.)\.[^.]*$", "$1")


def in_frames(path: Column) -> Column:
    return F.lower(name_of(parent(path))) == "frames"


def session(path: Column, how: str = "auto") -> Column:
    """The session of a file: auto is the folder above `frames` or else the file, parent the folder, file the file."""
    if how == "parent":
        return parent(path)
    if how == "file":
        return path
    return F.when(in_frames(path), parent(parent(path))).otherwise(path)


def mining_group(path: Column) -> Column:
    """The folder, or the one above it when it is called `frames`."""
    return F.when(in_frames(path), parent(parent(path))).otherwise(parent(path))


def session_key(key: Column) -> Column:
    """merchant/session of an object key; null with fewer than two parts."""
    p = F.filter(F.split(key, "/"), lambda x: x != "")
    return F.when(F.size(p) >= 2, F.concat_ws("/", F.element_at(p, 1), F.element_at(p, 2)))


def either_path(path: Column, folder: Column, name: Column) -> Column:
    """The path, or folder/name where it is blank."""
    return F.coalesce(F.nullif(F.trim(path), F.lit("")), F.concat_ws("/", folder, name))


def tail(path: Column, k: int) -> Column:
    """The last k components."""
    p = parts(path)
    return F.when(F.size(p) > k, F.array_join(F.slice(p, -k, k), "/")).otherwise(path)


def short_run(name: Column) -> Column:
    """What follows the last dash."""
    return F.substring_index(name, "-", -1)
