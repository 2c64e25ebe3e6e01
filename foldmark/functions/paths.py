"""Path expressions. All run inside the JVM; nothing here touches a file system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_segments(path: Column) -> Column:
    """Segments of a path after dropping empty and ``.`` ones and letting ``..`` remove its parent; above the root ``..`` does nothing."""
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc)
        .when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(x)))
    )
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def resolved_path(path: Column) -> Column:
    """The place an absolute path leads to, in one spelling.

    ``/mnt/x/...`` and the Windows spelling of drive x with either slash become
    ``/mnt/x/...`` with a small drive letter. Doubled separators, ``.`` and
    ``..`` are resolved, a trailing separator is dropped, letter case otherwise
    counts. Null and blank paths give null.
    """
    starts = lambda k, n=1: F.substring(path, k, n)
    windows = (starts(2) == ":") & F.lower(starts(1)).between("a", "z") & starts(3).isin("", "/", "\\")
    # most paths are tidy; folding runs only where one of these spellings occurs
    untidy = F.lit(False)
    for part in ("//", "/./", "/../"):
        untidy = untidy | F.contains(path, F.lit(part))
    for end in ("/", "/.", "/.."):
        untidy = untidy | F.endswith(path, F.lit(end))
    for start in ("./", "../"):
        untidy = untidy | F.startswith(path, F.lit(start))
    body = F.when(windows, F.concat(F.lit("/"), F.translate(F.substr(path, F.lit(3)), "\\", "/"))).otherwise(path)
    folded = F.concat(F.when(body.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(_fold_segments(body), "/"))
    placed = F.when(windows, F.concat(F.lit("/mnt/"), F.lower(starts(1)), F.when(folded == "/", F.lit("")).otherwise(folded))).otherwise(_small_mount(folded))
    return F.when(F.trim(path) == "", F.lit(None)).when(windows | untidy, placed).otherwise(_small_mount(path))


def _small_mount(path: Column) -> Column:
    letter = F.substring(path, 6, 1)
    mounted = path.startswith("/mnt/") & letter.between("A", "Z") & F.substring(path, 7, 1).isin("", "/")
    return F.when(mounted, F.concat(F.lit("/mnt/"), F.lower(letter), F.substr(path, F.lit(7)))).otherwise(path)


def drive_of(path: Column) -> Column:
    """Drive of a resolved path: x for ``/mnt/x/...``, else the first segment; ``root`` for ``/``."""
    first = F.split_part(path, F.lit("/"), F.lit(2))
    second = F.split_part(path, F.lit("/"), F.lit(3))
    return F.when((first == "mnt") & (second != ""), F.lower(second)).when(first == "", F.lit("root")).otherwise(first)


def depth_of(path: Column) -> Column:
    """Number of segments of an absolute path; 0 for ``/``."""
    return F.when(path == "/", F.lit(0)).otherwise(F.size(F.split(path, "/")) - 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """Parent path; ``/`` for a top-level entry and the empty string for the root itself."""
    cut = F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)
    return F.when(path == "/", F.lit("")).when(cut == "", F.lit("/")).otherwise(cut)


def relative_to(path: Column, root: Column) -> Column:
    """Path below root; null when it does not lie below it."""
    return F.when(root == "/", F.substr(path, F.lit(2))).when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2))


def ancestors_of(path: Column) -> Column:
    """All proper ancestors of an absolute path below the root, shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def suffix_of(name: Column) -> Column:
    """Lower-case suffix after the last dot; empty for names that start with their only dot or end in one."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def splitext_suffix(name: Column) -> Column:
    """Suffix that keeps a bare trailing dot and ignores all leading dots of the name."""
    return F.regexp_extract(F.regexp_replace(base_name(name), r"^\.+", ""), r"(?s)^.+(\.[^.]*)$", 1)


def mount_letter(path: Column) -> Column:
    last = F.lower(base_name(F.regexp_replace(path, r"/+$", "")))
    return F.when(last == "", F.lit("root")).otherwise(last)


def last_segments(path: Column, count: int) -> Column:
    return F.substring_index(path, "/", -count)
