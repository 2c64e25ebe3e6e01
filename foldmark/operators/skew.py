"""Joins and aggregates that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of the rows on, so there are at most 1 / HEAVY_SHARE heavy keys whatever the input.
HEAVY_SHARE = 1 / 1000
#: Counters of the frequent-items sketch; its count error is below 5 / TRACKED of the rows.
TRACKED = 16_384
#: Up to so many rows and bytes a lookup table is broadcast; beyond, the join shuffles and splits heavy keys.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def heavy_values(df: DataFrame, key: Column, share: float = HEAVY_SHARE) -> tuple[list, int]:
    """Values of ``key`` that hold at least about ``share`` of its non-null rows, and the number of those rows.

    One pass with a mergeable frequent-items sketch. The result is bounded by
    2 / share values; what it misses or adds changes only the balance of a
    later plan, never its rows. An empty table gives ``([], 0)``.
    """
    keyed = df.select(key.alias("k")).where("k is not null")
    row = keyed.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(k, {int(1 / share)}, {TRACKED})").alias("top")).first()
    floor = max(2, row["n"] * share)
    return [x["item"] for x in row["top"] or [] if x["count"] >= floor], row["n"]


def split_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", residual: Column | None = None, share: float = HEAVY_SHARE, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a right side that holds each key once, whatever the skew of the left.

    A right side of at most ``most`` rows and BROADCAST_BYTES is broadcast.
    Otherwise the heavy left keys are found by sketch; their right rows, at most one per
    heavy key, are broadcast to them, all other rows meet in an ordinary
    shuffle join, and the two results are united. ``how`` is inner, left,
    left_semi or left_anti. Null keys match nothing. ``residual`` may refer to
    columns of both sides, whose names must differ apart from ``on``.
    """
    on = list(on)
    keys = [f"_right_{k}" for k in on]
    right = right.select(*[F.col(k).alias(n) for k, n in zip(on, keys)], *[c for c in right.columns if c not in on])
    condition = F.lit(True) if residual is None else residual
    for k, n in zip(on, keys):
        condition = (F.col(k) == F.col(n)) & condition
    join = lambda a, b: a.join(b, condition, how).drop(*keys)
    if fits(right, most):
        return join(left, F.broadcast(right))
    mark = lambda names: F.xxhash64(*names)
    known = left.where(F.expr(" and ".join(f"`{k}` is not null" for k in on)))
    heavy, _ = heavy_values(known, mark(on), share)
    if not heavy:
        return join(left, right)
    light = join(left.where(~mark(on).isin(heavy)), right.where(~mark(keys).isin(heavy)))
    return light.unionByName(join(left.where(mark(on).isin(heavy)), F.broadcast(right.where(mark(keys).isin(heavy)))))


def fits(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows and BROADCAST_BYTES, by the values of its first ``most`` rows."""

    def wide(f) -> Column:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            return F.octet_length(f.name)
        if kind.startswith("array<") and kind[6:-1] in ("bigint", "int", "double"):
            return F.size(f.name) * 8
        return F.octet_length(F.to_json(F.struct(f.name))) if kind.startswith(("array", "struct", "map")) else F.lit(8)

    size = sum((F.coalesce(wide(f), F.lit(8)) for f in df.schema.fields), F.lit(16))
    n, held = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return n <= most and held <= BROADCAST_BYTES


def profile_keys(df: DataFrame, key: str, size: str, holder: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Rows, total size and number of distinct holders of each key, without a task that follows a hot key.

    Heavy keys come from a sketch and are broadcast. Rows of heavy keys are
    combined by (key, holder) before any shuffle and spread by that pair; all
    other rows move once, by key. Result: the key column, ``n_rows``,
    ``total_size``, ``n_holders``.

    Rows with a null key are left out. A null size counts as 0, a null holder
    as none. Repeated rows all count. An empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("k"), F.col(size).cast("long").alias("s"), F.col(holder).alias("h")).where("k is not null")
    heavy, _ = heavy_values(rows, F.col("k"), share)
    return _united(rows, heavy).withColumnRenamed("k", key)


def _united(rows: DataFrame, heavy: list) -> DataFrame:
    spark = rows.sparkSession
    hot_keys = F.broadcast(spark.createDataFrame([(x,) for x in heavy], rows.select("k").schema))
    by_holder = lambda part: part.groupBy("k", "h").agg(F.count("*").alias("c"), F.sum("s").alias("s"))
    total = [F.sum("c").alias("n_rows"), F.coalesce(F.sum("s"), F.lit(0)).alias("total_size"), F.count("h").alias("n_holders")]
    light = by_holder(rows.join(hot_keys, "k", "left_anti").repartition("k")).groupBy("k").agg(*total)
    if not heavy:
        return light
    return light.unionByName(by_holder(rows.join(hot_keys, "k")).groupBy("k").agg(*total))


def keys_above(df: DataFrame, key: str, size: str, holder: str, least_share: float) -> DataFrame:
    """The profile of each key that holds at least ``least_share`` of the rows with a key (at most 1 / least_share keys)."""
    rows = df.select(F.col(key).alias("k"), F.col(size).cast("long").alias("s"), F.col(holder).alias("h")).where("k is not null")
    heavy, n = heavy_values(rows, F.col("k"))
    return _united(rows, heavy).where(F.col("n_rows") >= F.lit(n) * F.lit(least_share)).withColumnRenamed("k", key)
