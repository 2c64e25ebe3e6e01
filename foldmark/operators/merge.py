"""Upserts and replacements over immutable tables. Each returns the new content; writing it is the caller's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_one(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``. Null keys form one group. One aggregation with a running minimum, so a key with most rows is no hot group."""
    others = [c for c in rows.columns if c not in keys]
    ranks = F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)])
    if not others:
        return rows.distinct()
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), ranks).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Old rows with the ``update`` columns (all but the keys by default) taken from the new row of the same key, and the new rows of other keys.

    Columns that the new side lacks, and columns not updated, keep the old value;
    for inserted rows what is missing is null. Both sides hold a key
    once; new rows with a null key are inserted.
    """
    update = [c for c in old.columns if c not in keys and c in new.columns] if update is None else list(update)
    left, right = old.withColumn("_old", F.lit(True)), new.withColumn("_new", F.lit(True))
    a, b = left.alias("a"), right.alias("b")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
        if c not in new.columns:
            return F.col(f"a.{c}")
        use_new = F.col("b._new").isNotNull() if c in update else F.col("a._old").isNull()
        return F.when(use_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return met.select(*[pick(c).alias(c) for c in old.columns])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Old rows and those new rows whose key is not there yet; of several new rows of a key the first in ``order``."""
    return old.unionByName(keep_one(new, keys, order).join(old.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Old rows of groups that new does not hold, and all new rows."""
    return old.join(new.select(group).distinct(), group, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def prefer_first(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union in which a key's row comes from the first part that holds the key."""
    ranked = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    rows = ranked[0]
    for p in ranked[1:]:
        rows = rows.unionByName(p)
    return keep_one(rows, keys, [F.col("_part")]).drop("_part")


def mark_rows(rows: DataFrame, ids: DataFrame, row_id: str, column: str, value: Column) -> DataFrame:
    """Set a column in the rows whose id is listed."""
    listed = ids.select(F.col(ids.columns[0]).alias(row_id)).distinct().withColumn("_listed", F.lit(True))
    met = rows.join(listed, row_id, "left")
    return met.select(*[F.when(F.col("_listed"), value).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])


def unchanged(found: DataFrame, known: DataFrame, path: str, mtime: str, tolerance: float = 0.01) -> DataFrame:
    """Found rows whose path is known with the same mtime within the tolerance."""
    before = known.select(F.col(path).alias("_path"), F.col(mtime).alias("_mtime"))
    return found.join(before, (F.col(path) == F.col("_path")) & (F.abs(F.col(mtime) - F.col("_mtime")) < tolerance), "left_semi")


def to_process(found: DataFrame, known: DataFrame, path: str, mtime: str, tolerance: float = 0.01) -> DataFrame:
    """Found rows that are new or changed; the complement of unchanged."""
    before = known.select(F.col(path).alias("_path"), F.col(mtime).alias("_mtime"))
    return found.join(before, (F.col(path) == F.col("_path")) & (F.abs(F.col(mtime) - F.col("_mtime")) < tolerance), "left_anti")


def stable_ids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``row_key``, an id from the natural key alone: the same in every run."""
    return rows.withColumn("row_key", F.xxhash64(*keys))


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, slices: int = 64) -> DataFrame:
    """The first n rows of each key in ``order``. Each key is cut into slices by a hash of its rows, of which the first n are kept before they meet, so a key with most rows is no hot window."""
    if n == 1:
        return keep_one(rows, keys, order)
    first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    cut = rows.withColumn("_cut", F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(slices)))
    return first(first(cut, *keys, "_cut").drop("_cut"), *keys)
