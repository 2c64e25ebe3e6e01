"""All pairs of similar sets by an extended-prefix join."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.operators.sets import chunks, meet, overlap_counts, ranked, shared_least, with_counts
from foldmark.operators.skew import split_join
from foldmark.session import Scratch

#: Frequencies at which prefixes may begin to ask for more shared tokens.
LADDER = tuple(4**k for k in range(2, 16))
#: A frequency that no token reaches.
NEVER = 2**62


@dataclass(frozen=True)
class SimilarSets:
    """``pairs``: one row per pair of different representatives (set1 < set2, shared, size1, size2, jaccard); ``members``: every set with its class, the smallest set of the same content."""

    pairs: DataFrame
    members: DataFrame


def similar_sets(members: DataFrame, set_id: str, token: str, threshold: float = 0.8, least_size: int = 1, label: str = "sets") -> SimilarSets:
    """Find all pairs of sets with |A and B| / |A or B| >= threshold, without loss.

    ``members`` has one row per set and token; repeated rows count once, rows
    with a null are left out, sets below ``least_size`` too. Tokens are compared
    by a 64-bit hash of their value. Sets of equal content are collapsed to one
    class first and come out as membership, not as pairs.

    Tokens are ordered by the number of sets that hold them, rarest first. If
    two sets are similar they share at least one token in their prefixes of
    n - ceil(t n) + 1 tokens, at least two in prefixes one token longer, and so
    on. How many must be shared is chosen by the first shared token: rare
    ones are joined alone; for a frequent one, all later shared tokens are as
    frequent or more, so the sets share two, or three, such tokens of the longer
    prefix and are joined on the combination. The two frequencies at which this
    begins minimise the estimated number of join rows over all tokens. Sizes and
    positions prune the joined rows; overlaps of the remaining candidates
    are then counted exactly.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    scratch = Scratch(members.sparkSession, label)
    rows = members.select(F.col(set_id).alias("s"), F.xxhash64(token).alias("x"), F.col(token).isNotNull().alias("ok")).where("ok and s is not null").select("s", "x")
    rows = scratch.write(rows.distinct(), "rows")
    # order-free 128-bit fingerprint of a set's content; tokens are distinct, so none cancels out
    mix = lambda salt: F.bit_xor(F.xxhash64("x", F.lit(salt)))
    prints = rows.groupBy("s").agg(F.count("*").cast("int").alias("n"), mix(1).alias("m1"), mix(2).alias("m2")).where(F.col("n") >= least_size)
    prints = scratch.write(prints, "prints")
    classes = prints.groupBy("n", "m1", "m2").agg(F.min("s").alias("class"))
    member = scratch.write(split_join(prints, classes, ["n", "m1", "m2"]).select("s", "class", "n"), "members")
    sizes = member.where("s = class").select("s", "n")

    kept = split_join(rows, sizes, ["s"])
    kept = scratch.write(kept, "kept")
    counts = scratch.write(kept.groupBy("x").agg(F.count("*").alias("df")), "counts")
    prefixes = ranked(with_counts(kept, counts), F.col("n") - shared_least(F.col("n"), threshold) + 3, scratch)
    two, three = _levels(prefixes, threshold)
    entries = scratch.write(_entries(prefixes, threshold, two, three), "entries")
    candidates = scratch.write(_candidates(entries, threshold), "candidates")
    pairs = _verified(candidates, kept, threshold, scratch)
    return SimilarSets(pairs, member.select(F.col("s").alias("set"), F.col("class"), F.col("n").alias("size")))


def _levels(prefixes: DataFrame, threshold: float) -> tuple[int, int]:
    """Frequencies from which two and three shared tokens are asked for, by least estimated work.

    A token joined alone costs its posting list squared over two; tokens
    joined in combinations cost the combinations of each set's prefix.
    """
    one = F.col("n") - shared_least(F.col("n"), threshold) + 1
    single = prefixes.where(F.col("pos") <= one).groupBy("x").agg(F.max("df").alias("df"), F.count("*").alias("p")).agg(*[F.sum(F.when(F.col("df") < d, F.col("p") * F.col("p") / 2)).alias(f"a{k}") for k, d in enumerate(LADDER)], F.sum(F.col("p") * F.col("p") / 2).alias("all")).first()
    above = prefixes.groupBy("s").agg(*[F.sum(F.when(F.col("df") >= d, 1).otherwise(0)).cast("double").alias(f"k{k}") for k, d in enumerate(LADDER)])
    k = [F.col(f"k{i}") for i in range(len(LADDER))]
    combined = above.agg(*[F.sum(c * (c - 1) / 2).alias(f"b{i}") for i, c in enumerate(k)], *[F.sum(c * (c - 1) * (c - 2) / 6).alias(f"c{i}") for i, c in enumerate(k)]).first()
    costs = {(NEVER, NEVER): single["all"] or 0.0}
    for i, d in enumerate(LADDER):
        alone, pairs = single[f"a{i}"] or 0.0, combined[f"b{i}"] or 0.0
        costs[d, NEVER] = alone + pairs
        for j in range(i + 1, len(LADDER)):
            costs[d, LADDER[j]] = alone + pairs - (combined[f"b{j}"] or 0.0) + (combined[f"c{j}"] or 0.0)
    # of equal costs the later beginnings
    return min(costs, key=lambda at: (costs[at], -at[0], -at[1]))


def _entries(prefixes: DataFrame, threshold: float, two: int, three: int) -> DataFrame:
    """key, head (tokens that a pair meeting here shares at least), s, n, pos (of the last of them).

    Sets that may be similar to another with one or two shared tokens in all
    are also joined by so few.
    """
    least = shared_least(F.col("n"), threshold)
    upto = lambda k: F.col("pos") <= F.col("n") - least + k
    parts = [prefixes.where(upto(1) & ((F.col("df") < two) | (least <= 1))).select(F.col("x").alias("key"), F.lit(1).alias("head"), "s", "n", "pos")]
    frequent = prefixes.where(F.col("df") >= two)
    later = lambda k, rows: rows.where(upto(k)).select("s", F.col("x").alias(f"x{k}"), F.col("pos").alias(f"pos{k}"))
    if two < NEVER:
        firsts = frequent.where(upto(1) & ((F.col("df") < three) | (least <= 2)))
        pairs = firsts.join(later(2, frequent), "s").where("pos2 > pos")
        parts.append(pairs.select(F.xxhash64("x", "x2").alias("key"), F.lit(2).alias("head"), "s", "n", F.col("pos2").alias("pos")))
    if three < NEVER:
        most = prefixes.where(F.col("df") >= three)
        triples = most.where(upto(1)).join(later(2, most), "s").where("pos2 > pos").join(later(3, most), "s").where("pos3 > pos2")
        parts.append(triples.select(F.xxhash64("x", "x2", "x3").alias("key"), F.lit(3).alias("head"), "s", "n", F.col("pos3").alias("pos")))
    return reduce(DataFrame.unionByName, parts)


def _candidates(entries: DataFrame, threshold: float) -> DataFrame:
    """a, b, na, nb: pairs that meet at an entry and whose sizes and positions allow the overlap; a is the smaller set.

    Sizes of similar sets differ by a factor of 1 / threshold at most, so the
    size class is part of the join key, which also divides long posting lists;
    what is still long is met in slices.
    """
    band = F.col("n") if threshold == 1 else F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    side = lambda c: entries.select("key", "head", F.col("s").alias(c), F.col("n").alias(f"n{c}"), F.col("pos").alias(f"p{c}"), band.cast("int").alias("band"))
    small = side("a") if threshold == 1 else side("a").withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    fits = (
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (F.col("na") >= F.lit(threshold) * F.col("nb") - 1e-9)
        & (F.col("head") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= overlap)
    )
    return meet(small, side("b"), ["key", "head", "band"], fits).select("a", "b", "na", "nb").distinct()


def _verified(candidates: DataFrame, kept: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Count the overlap of each candidate pair on chunks of bounded size."""
    parts = chunks(kept, scratch)
    shared = overlap_counts(candidates, parts, parts).withColumnRenamed("k", "shared")
    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    swap = F.col("a") > F.col("b")
    one = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return shared.where(F.col("shared") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9).select(
        one("a", "b").alias("set1"), one("b", "a").alias("set2"), "shared", one("na", "nb").alias("size1"), one("nb", "na").alias("size2"), jaccard.alias("jaccard")
    )
