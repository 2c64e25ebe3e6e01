"""Steps that similarity joins of sets are made of. Sets are rows (s, x): a set and one of its tokens, an integer."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldmark.operators.skew import BROADCAST_ROWS, split_join
from foldmark.session import Scratch

#: Expected tokens of a verification chunk, and sets from twice this size on are ranked in slices.
CHUNK = 4096
#: Bytes of chunks that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Entries of one key that are met in one piece; longer lists are cut into slices of about so many.
LIST_SLICE = 2000


def shared_least(n: Column, threshold: float) -> Column:
    """Least overlap of a set of n tokens with any set of that similarity; the small term absorbs rounding of the product."""
    return F.ceil(F.lit(threshold) * n - 1e-9).cast("int")


def with_counts(kept: DataFrame, counts: DataFrame) -> DataFrame:
    """Every row of kept with the frequency df of its token. Tokens above a frequency that only so many can have are broadcast, the rest shuffle."""
    total = kept.count()
    hot = max(1000, math.ceil(total / BROADCAST_ROWS))
    frequent = F.broadcast(counts.where(F.col("df") >= hot))
    return kept.join(frequent, "x").unionByName(kept.join(frequent, "x", "left_anti").join(counts.where(F.col("df") < hot), "x"))


def ranked(rows: DataFrame, last: Column, scratch: Scratch, name: str = "prefixes") -> DataFrame:
    """s, n, x, df, pos: the tokens of each set up to position ``last``, rarest first, from 1.

    ``rows`` has s, n, x, df. Sets of ordinary size are ranked by a window. A set of 2 CHUNK tokens or
    more is cut into slices of about CHUNK in token order, each ranked by
    itself, and offset by the slices before it, so that no task sees it whole.
    """
    small = rows.where(F.col("n") < 2 * CHUNK).withColumn("pos", F.row_number().over(Window.partitionBy("s").orderBy("df", "x")))
    parts = [small]
    big = rows.where(F.col("n") >= 2 * CHUNK)
    if not big.isEmpty():
        # slices: by frequency, and for equal frequency by ranges of the hash
        cut = F.floor((F.col("x").cast("double") / 2.0**64 + 0.5) * F.ceil(F.col("n") / CHUNK))
        big = big.withColumn("cut", cut)
        slices = big.groupBy("s", "df", "cut").agg(F.count("*").alias("c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("s").orderBy("df", "cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = scratch.write(slices.select("s", "df", "cut", before.alias("before")), f"{name}-offsets")
        within = F.row_number().over(Window.partitionBy("s", "df", "cut").orderBy("x"))
        parts.append(big.withColumn("at", within).join(offsets, ["s", "df", "cut"]).withColumn("pos", (F.col("at") + F.col("before")).cast("int")))
    columns = ["s", "n", "x", "df", "pos"]
    whole = reduce(DataFrame.unionByName, [p.where(F.col("pos") <= F.least(F.col("n"), last)).select(*columns) for p in parts])
    return scratch.write(whole, name)


def meet(left: DataFrame, right: DataFrame, on: list[str], where: Column) -> DataFrame:
    """Inner join of two tables that both may hold a key often.

    Where lists of a key are longer than LIST_SLICE they are cut by a hash of the other columns, and every
    slice of one side meets every slice of the other in a task of its own.
    Both sides are read more than once, so what is dear should be stored before.
    """
    counts = [side.groupBy(*on).agg(F.count("*").alias(name)) for side, name in ((left, "_l"), (right, "_r"))]
    # a key is long if its lists make more pairs than two of LIST_SLICE do; there are at most as many as slices of the input
    cuts = lambda c: F.ceil(F.col(c) / LIST_SLICE).cast("int").alias(f"{c}cuts")
    long_ = counts[0].join(counts[1], on).where(F.col("_l") * F.col("_r") > LIST_SLICE * LIST_SLICE).select(*on, cuts("_l"), cuts("_r"))
    long_ = Scratch(left.sparkSession, "meet").write(long_, "long")
    if long_.isEmpty():
        return left.join(right, on).where(where)

    def sliced(side: DataFrame, own: str, other: str) -> DataFrame:
        rest = F.xxhash64(*[c for c in side.columns if c not in on])
        cut = split_join(side, long_, on, "left").withColumn(own, F.pmod(rest, F.coalesce(f"{own}cuts", F.lit(1))).cast("int"))
        return cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}cuts", F.lit(1)) - 1))).drop("_lcuts", "_rcuts")

    return sliced(left, "_l", "_r").join(sliced(right, "_r", "_l"), [*on, "_l", "_r"]).where(where).drop("_l", "_r")


def _cuts(n: str) -> Column:
    return F.when(F.col(n) <= CHUNK, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(F.col(n) / CHUNK))).cast("int"))


def chunks(rows: DataFrame, scratch: Scratch, name: str = "chunks") -> DataFrame:
    """s, cut, t: rows (s, n, x) cut by hash into a power of two of arrays of about CHUNK tokens per set."""
    cut = rows.withColumn("cut", F.pmod("x", _cuts("n")).cast("int")).groupBy("s", "cut").agg(F.collect_list("x").alias("t"))
    return scratch.write(cut, name)


def overlap_counts(candidates: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The candidates (a, b, na, nb) with ``k``, their number of common tokens, from the chunks of both sides. Chunk i of the finer cut meets chunk i modulo the coarser one."""
    most = BROADCAST_BYTES // (16 * CHUNK)
    pairs = candidates.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(_cuts("na"), _cuts("nb")) - 1)))
    pairs = pairs.withColumns({"ca": F.pmod("i", _cuts("na")), "cb": F.pmod("i", _cuts("nb"))})
    for side, chunk in (("a", left), ("b", right)):
        pairs = split_join(pairs, chunk.select(F.col("s").alias(side), F.col("cut").alias(f"c{side}"), F.col("t").alias(f"t{side}")), [side, f"c{side}"], "left", most=most)
    common = F.coalesce(F.size(F.array_intersect("ta", "tb")), F.lit(0))
    return pairs.groupBy("a", "b", "na", "nb").agg(F.sum(F.when(F.col("ta").isNull() | F.col("tb").isNull(), 0).otherwise(common)).alias("k"))
