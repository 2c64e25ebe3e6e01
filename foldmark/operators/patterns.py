"""Similarity join of two kinds of sets that share a few very frequent members: nothing of the size of the result is shuffled or stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldmark.operators.sets import meet
from foldmark.operators.skew import BROADCAST_ROWS, fits, split_join
from foldmark.session import Scratch

#: Bits of a word; a pattern of members is one word, one of cells up to CELL_WORDS.
BITS, CELL_WORDS = 62, 8
#: A member is frequent if it alone makes more pairs than this share of the rows of both sides, as far as there are bits.
SHARE, CELL_SHARE = 1 / 8, 1 / 1000
#: Sets of the left side whose pairs are written by one task.
SETS_PER_TASK = 1000


def _frequent(left: DataFrame, right: DataFrame, words: int, share: float, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """x, word, at: the members of both sides that make most pairs, with the place of their bit; and the number of words, 1 at least."""
    counts = [side.groupBy("x").agg(F.count("*").alias(c)) for side, c in ((left, "l"), (right, "r"))]
    least = share * (left.count() + right.count())
    made = counts[0].join(counts[1], "x").select("x", (F.col("l") * F.col("r")).alias("p")).where(F.col("p") > least)
    # at most words * BITS rows are numbered
    top = made.orderBy(F.desc("p"), "x").limit(words * BITS).withColumn("at", F.row_number().over(Window.orderBy(F.desc("p"), "x")) - 1)
    top = scratch.write(top.select("x", F.expr(f"at div {BITS}").cast("int").alias("word"), (F.col("at") % BITS).alias("at")), name)
    return top, max(1, -(-top.count() // BITS))


def _masks(rows: DataFrame, frequent: DataFrame, words: int, size: str, mask: str) -> DataFrame:
    """s, its size and the words of the bits of its frequent members; 0 without any."""
    tagged = rows.join(F.broadcast(frequent), "x", "left").withColumn("bit", F.expr("shiftleft(1L, at)"))
    bits = [F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("long")).alias(f"{mask}{w}") for w in range(words)]
    return tagged.groupBy("s").agg(F.first("n").alias(size), *bits)


def _common(words: int, one: str, two: str) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(f"{one}{w}").bitwiseAND(F.col(f"{two}{w}"))).cast("long") for w in range(words)])


def matched_pairs(left: DataFrame, right: DataFrame, left_cells: DataFrame, right_cells: DataFrame, threshold: float, extra: DataFrame) -> DataFrame:
    """a, b, k, n1, n2 of all pairs with k / (n1 + n2 - k) >= threshold > 0, ck, c1, c2: common cells and cells of both, and the columns that extra has of every a.

    All four tables come from distinct_members; every set has cells. The few
    members that make most pairs are bits of a pattern, counted by bit
    operations; common members and cells outside the patterns are met and
    counted per pair, and only these pairs are shuffled. A pair that meets in no rare
    member or cell is known by the pattern and size of both sides: sets of the left meet the
    classes of the right, and their members, in one pass. Pairs of the first kind are kept apart by a
    list per left set. The result may be quadratic, what is stored for it is not.
    Nothing of the result reads the four tables.
    """
    scratch = Scratch(left.sparkSession, "patterns")
    top, words = _frequent(left, right, 1, SHARE, scratch, "frequent")
    cell_top, cell_words = _frequent(left_cells, right_cells, CELL_WORDS, CELL_SHARE, scratch, "frequent-cells")
    enough = lambda k: k >= F.lit(threshold) * (F.col("na") + F.col("nb") - k) - 1e-9

    def side(rows: DataFrame, cells: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
        sets, trees = _masks(rows, top, words, f"n{tag}", f"m{tag}"), _masks(cells, cell_top, cell_words, f"c{tag}", f"t{tag}")
        whole = scratch.write(split_join(sets, trees, ["s"]).withColumnRenamed("s", tag), f"sets-{tag}")
        rare = lambda df, part, kind: df.join(F.broadcast(part), "x", "left_anti").select(F.col("s").alias(tag), "x", F.lit(kind).alias("kind"))
        return whole, scratch.write(rare(rows, top, 0).unionByName(rare(cells, cell_top, 1)), f"rare-{tag}")

    (one, rare_one), (two, rare_two) = side(left, left_cells, "a"), side(right, right_cells, "b")
    one, kept = split_join(one, extra, ["a"]), [c for c in extra.columns if c != "a"]
    per_kind = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    light = meet(rare_one, rare_two, ["kind", "x"], F.lit(True)).groupBy("a", "b").agg(per_kind(0).alias("k"), per_kind(1).alias("ck"))
    sized = split_join(split_join(light, one.select("a", "na", "ma0"), ["a"]), two.select("b", "nb", "mb0"), ["b"])
    plain = _common(1, "ma", "mb")
    sized = sized.withColumn("k", F.col("k") + plain).where(enough(F.col("k")))
    met = scratch.write(sized.select("a", "b", "na", "nb", "k", "ck", enough(plain).alias("plain")), "met")
    scratch.drop("rare-a", "rare-b")
    trees = lambda df, tag: df.select(tag, f"c{tag}", *(kept if tag == "a" else []), *[f"t{tag}{w}" for w in range(cell_words)])
    rows = split_join(split_join(met, trees(one, "a"), ["a"]), trees(two, "b"), ["b"])
    common = _common(cell_words, "ta", "tb")
    out = lambda df, k, ck: df.select("a", "b", k.alias("k"), F.col("na").alias("n1"), F.col("nb").alias("n2"), ck.alias("ck"), F.col("ca").alias("c1"), F.col("cb").alias("c2"), *kept)

    known = met.where("plain").groupBy("a").agg(F.collect_list("b").alias("known"))
    mine = split_join(one.where("ma0 <> 0"), known, ["a"], "left")
    mine = mine.repartition(max(left.sparkSession.sparkContext.defaultParallelism, -(-one.count() // SETS_PER_TASK)), "a")
    placed = lambda df, mask: df.withColumn("i", F.explode(F.expr(f"filter(sequence(0, {BITS - 1}), i -> getbit({mask}, i) = 1)")))
    members = two.where("mb0 <> 0").groupBy("mb0", "nb").agg(F.collect_list(F.struct("b", "cb", *[f"tb{w}" for w in range(cell_words)])).alias("members"))
    members = scratch.write(members, "members")
    classes = placed(members.select("mb0", "nb"), "mb0")
    # a class is met at the first bit that both patterns have
    first = F.expr("ma0 & mb0 & (shiftleft(1L, i) - 1) = 0")
    pairs = placed(mine, "ma0").join(F.broadcast(classes), "i") if fits(classes, BROADCAST_ROWS) else meet(placed(mine, "ma0"), classes, ["i"], first & enough(plain))
    pairs = pairs.where(first & enough(plain)).drop("i")
    pairs = split_join(pairs, members, ["mb0", "nb"]).withColumn("m", F.explode("members")).select("*", "m.*").drop("m", "members")
    pairs = pairs.where("known is null or not array_contains(known, b)")
    return out(rows, F.col("k"), F.col("ck") + common).unionByName(out(pairs, plain, common))
