"""References whose target does not exist, not yet exists or no longer exists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.operators.skew import split_join

MATCHES = ("simple", "partial", "full")


def lifetimes(targets: DataFrame, removals: DataFrame, key: str = "key", arrived: str = "arrived", removed: str = "removed") -> DataFrame:
    """One row per target key: ``key``, ``valid_from`` (null: always) and ``valid_until`` (null: still there).

    A removal before the known arrival of its target is void, since the target
    came back; of the others the earliest counts. Removals without a time are
    ignored. Repeated target rows count as one that arrived with the earliest.
    """
    t = targets.select(F.col(key).alias("key"), F.col(arrived).alias("at")).where("key is not null")
    t = t.groupBy("key").agg(F.min("at").alias("valid_from"))
    r = removals.select(F.col(key).alias("gone_key"), F.col(removed).alias("gone")).where("gone_key is not null and gone is not null")
    # both sides hold a key a few times at most, so this shuffle has no hot key
    met = t.join(r, (F.col("key") == F.col("gone_key")) & (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("gone"))), "left")
    return met.groupBy("key", "valid_from").agg(F.min("gone").alias("valid_until"))


def orphan_references(refs: DataFrame, targets: DataFrame, columns: Sequence[str], match: str = "simple", time: str | None = None) -> DataFrame:
    """Rows of ``refs`` whose composite reference ``columns`` has no target with those columns.

    References are grouped by null mask: which of the columns, and the
    reference time if there is one, are null. Each mask is anti-joined on its
    non-null columns alone. What a mask means is declared by ``match``, as in
    SQL: ``simple`` checks only references without null, ``partial`` checks the
    non-null columns, ``full`` takes a mix of null and non-null as an orphan
    without looking. A reference whose columns are all null is never an orphan.

    With ``time``, targets hold ``valid_from`` and ``valid_until`` (both may be
    null for no limit) and must be valid at that time; where the time is null
    they must never have ended. Extra columns of refs are kept, those of targets
    ignored. No targets make every checked reference an orphan; repeated refs
    are each judged.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    columns = list(columns)
    masked = columns + ([time] if time else [])
    wanted = targets.select(*[F.col(c).alias(f"_t_{c}") for c in columns], *([F.col("valid_from").alias("_from"), F.col("valid_until").alias("_until")] if time else []))
    bits = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") * (1 << k) for k, c in enumerate(masked)])
    parts = []
    for flags in product((False, True), repeat=len(masked)):
        present = [c for c, there in zip(columns, flags) if there]
        if not present or (match == "simple" and len(present) < len(columns)):
            continue
        mine = refs.where(bits == sum(1 << k for k, there in enumerate(flags) if there))
        if match == "full" and len(present) < len(columns):
            parts.append(mine)
            continue
        parts.append(_missing(mine, wanted, present, len(present) == len(columns), time, bool(time) and flags[-1]))
    return reduce(DataFrame.unionByName, parts)


def _missing(refs: DataFrame, wanted: DataFrame, present: list[str], whole: bool, time: str | None, timed: bool) -> DataFrame:
    keys = [F.col(f"_t_{c}").alias(c) for c in present]
    if not time:
        return split_join(refs, wanted.select(*keys).dropna().distinct(), present, "left_anti")
    if not timed:
        return split_join(refs, wanted.where("_until is null").select(*keys).dropna().distinct(), present, "left_anti")
    at = F.col(time)
    valid = (F.col("_from").isNull() | (F.col("_from") <= at)) & (F.col("_until").isNull() | (at < F.col("_until")))
    spans = wanted.select(*keys, "_from", "_until").dropna(subset=present)
    if whole:
        return split_join(refs, spans, present, "left_anti", valid)
    # a partial key may have many spans, so their number has no bound: shuffle, and let adaptive execution split hot keys
    spans = spans.distinct().select(*[F.col(c).alias(f"_t_{c}") for c in present], "_from", "_until")
    met = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_t_{c}") for c in present]) & valid
    return refs.join(spans, met, "left_anti")


def month_of(epoch: str):
    """UTC month ``yyyy-MM`` of epoch seconds, ``none`` where unknown."""
    return F.coalesce(F.date_format(F.timestamp_seconds(F.floor(F.col(epoch))), "yyyy-MM"), F.lit("none"))
