"""Reading progress and errors off log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of fatal lines, and of lines that never are: fixed values.
FATAL = r"Traceback \(most recent|^\s*File \".*\", line \d|^(?:ERROR|FATAL|CRITICAL)|SystemExit|subprocess.*[Ee]rror|FAILED|[Kk]illed by signal|command not found"
HARMLESS = r"(?i)database is locked|NotADirectoryError|integer expression|WARNING|Hashing|file/s|cached=|\d+%"
PROGRESS = r"(\d+)file \[.*?,\s*([\d.]+)file/s"


def is_error(line: Column) -> Column:
    bare = F.trim(line)
    return (bare != "") & ~bare.rlike(HARMLESS) & bare.rlike(FATAL)


def progress_count(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, PROGRESS, 1), F.lit("")).cast("long")


def progress_rate(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, PROGRESS, 2), F.lit("")).cast("double")


def stage_of(done: Column, active: Column, waiting: Column) -> Column:
    """done before active before waiting before starting."""
    return F.when(done, "done").when(active, "active").when(waiting, "waiting").otherwise("starting")
