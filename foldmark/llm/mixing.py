"""Records drawn from several sources in target shares, on a curriculum that varies over the training."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldmark.operators.skew import split_join
from foldmark.session import Scratch

#: Records of one prefix sum.
SLICE = 20_000
#: Greatest relative change of a source's weight over the training under the default schedule.
TILT = 0.8

Schedule = Mapping[str, Sequence[tuple[float, float]]]


@dataclass(frozen=True)
class Supply:
    """What a source has and may give: ``tokens`` and ``records`` of one pass, ``share`` asked for, ``repeats`` allowed."""

    share: float
    repeats: int
    tokens: int
    records: int


def demands(supplies: Mapping[str, Supply], total: float | None = None) -> dict[str, float]:
    """Tokens to draw from each source.

    Sources without tokens, share or allowed repeats give nothing, and
    the shares of the others are scaled up to one. Without ``total`` the mixture is the
    largest in which every share is met exactly within the allowed repeats.
    With it, sources that cannot give their share give all they may, and what
    they lack is spread over the others in proportion to their shares.
    """
    able = {k: s for k, s in supplies.items() if s.tokens > 0 and s.share > 0 and s.repeats > 0}
    if not able:
        return {}
    scale = sum(s.share for s in able.values())
    most = {k: float(s.tokens * s.repeats) for k, s in able.items()}
    if total is None:
        total = min(most[k] * scale / s.share for k, s in able.items())
    out: dict[str, float] = {}
    rest, free = float(total), dict(able)
    while free:
        scale = sum(s.share for s in free.values())
        full = [k for k, s in free.items() if rest * s.share / scale > most[k] + 1e-6]
        if not full:
            return out | {k: min(most[k], rest * s.share / scale) for k, s in free.items()}
        out |= {k: most[k] for k in full}
        rest -= sum(most[k] for k in full)
        free = {k: s for k, s in free.items() if k not in full}
    return out


def short_to_long(supplies: Mapping[str, Supply], wanted: Mapping[str, float]) -> Schedule:
    """Default schedule: sources of longer records gain weight over time, those of shorter ones lose it, and the weights sum to the same at any time."""
    order = sorted(wanted, key=lambda k: (supplies[k].tokens / supplies[k].records, k))
    tilt = {k: (2 * i / max(1, len(order) - 1) - 1) for i, k in enumerate(order)}
    total = sum(wanted.values())
    mean = sum(wanted[k] * tilt[k] for k in order) / total
    steepest = max((abs(tilt[k] - mean) for k in order), default=0) or 1.0
    slope = {k: TILT * (tilt[k] - mean) / steepest for k in order}
    return {k: [(0.0, 1 - slope[k]), (1.0, 1 + slope[k])] for k in order}


def _segments(wanted: Mapping[str, float], schedule: Schedule) -> list[tuple]:
    """source, from_tokens, to_tokens, from_time, weight, slope: pieces of the cumulative demand, scaled to the wanted total of each source."""
    out = []
    for source, tokens in wanted.items():
        knots = sorted(schedule.get(source, [(0.0, 1.0), (1.0, 1.0)]))
        if knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
            raise ValueError(f"the schedule of {source} must run from 0 to 1 with weights of 0 or more")
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        if area <= 0:
            raise ValueError(f"the schedule of {source} has no weight")
        done = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            if t1 == t0:
                continue
            a, b = w0 * tokens / area, w1 * tokens / area
            gain = (t1 - t0) * (a + b) / 2
            if gain > 0:
                out.append((source, done, done + gain, t0, a, (b - a) / (t1 - t0)))
                done += gain
        out[-1] = (*out[-1][:2], math.inf, *out[-1][3:])
    return out


def normal_source(source: Column) -> Column:
    return F.lower(F.btrim(source, F.lit(" \t\r\n")))


def mix(records: DataFrame, record_id: str, source: str, size: str, targets: DataFrame, total: float | None = None, schedule: Schedule | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Draws (source, the record id, repeat_no, size, position in [0, 1), sorted by position) and a report of the shares
    reached, beside the target and the share aimed at (the target after sources without tokens have dropped out and capped ones have given all).

    ``targets`` has source, target_share, max_repeats: one row per source, a
    parameter table. Sources are compared without letter case and surrounding
    blanks. Each source passes over its records in a fresh hash order per pass,
    at most max_repeats times. A record's place is the middle of its tokens in
    the source's cumulative draw; it is drawn while that lies below the demand
    of the source, so a source misses it by half a record at most, whatever the
    sizes, and long records are as likely to be drawn as short ones. The place is turned into a training position by inverting the source's integrated weight schedule.

    Records of no listed source, of null source or without size are not drawn;
    targets of the same normal source add up, with the larger repeats. An empty table gives no
    draws and a report of zeros. A source with most of the records is numbered
    in slices of its hash order.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "mixing")
    goals = targets.select(normal_source(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats"))
    goals = goals.dropna(subset=["source"]).groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").cast("long").alias("repeats"))
    rows = records.select(normal_source(F.col(source)).alias("source"), F.col(record_id).alias("_id"), F.col(size).cast("long").alias("_n")).where("_n > 0")
    rows = scratch.write(split_join(rows, goals.select("source"), ["source"], "left_semi"), "rows")
    supply = goals.join(rows.groupBy("source").agg(F.sum("_n").alias("tokens"), F.count("*").alias("records")), "source", "left")
    # one row per row of the targets
    supplies = {r["source"]: Supply(r["share"], r["repeats"], r["tokens"] or 0, r["records"] or 0) for r in supply.collect()}
    wanted = demands(supplies, total)
    schedule = short_to_long(supplies, wanted) if schedule is None and wanted else schedule or {}
    plan = [(k, d, supplies[k].tokens, min(supplies[k].repeats, math.ceil(d / supplies[k].tokens)), -(-supplies[k].records // SLICE)) for k, d in wanted.items()]
    plans = F.broadcast(spark.createDataFrame(plan, "source string, demand double, pass_tokens long, passes int, slices int"))
    drawn = rows.join(plans, "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    drawn = drawn.withColumn("_h", F.xxhash64(F.lit(seed), "repeat_no", "_id"))
    # slices are ranges of the hash order
    part = F.least(F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * F.col("slices")), F.col("slices") - 1)
    drawn = drawn.withColumn("slice", part.cast("int"))
    key = ["source", "repeat_no", "slice"]
    sums = drawn.groupBy(*key).agg(F.sum("_n").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source", "repeat_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*key, before.alias("before"))
    running = F.sum("_n").over(Window.partitionBy(*key).orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = drawn.withColumn("upto", running).join(offsets, key)
    middle = F.col("repeat_no") * F.col("pass_tokens") + F.col("before") + F.col("upto") - F.col("_n") / 2
    placed = placed.withColumn("middle", middle).where("middle < demand").select("source", "_id", "repeat_no", "_n", "middle")
    parts = F.broadcast(spark.createDataFrame(_segments(wanted, schedule), "part_source string, from_tokens double, to_tokens double, from_time double, weight double, slope double"))
    timed = placed.join(parts, (F.col("source") == F.col("part_source")) & (F.col("middle") >= F.col("from_tokens")) & (F.col("middle") < F.col("to_tokens")))
    ahead = F.col("middle") - F.col("from_tokens")
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("weight") * F.col("weight") + 2 * F.col("slope") * ahead))
    position = F.least(F.lit(1.0), F.col("from_time") + F.when(ahead > 0, 2 * ahead / (F.col("weight") + root)).otherwise(0.0))
    draws = scratch.write(timed.select("source", F.col("_id").alias(record_id), "repeat_no", F.col("_n").alias(size), position.alias("position")), "draws")

    reached = draws.groupBy("source").agg(F.sum(size).alias("drawn"), F.count("*").alias("n_draws"), (F.max("repeat_no") + 1).alias("passes"))
    report = spark.createDataFrame([(k, s.share, s.repeats, s.records, s.tokens, wanted.get(k, 0.0), wanted.get(k, 0.0) / (sum(wanted.values()) or 1.0)) for k, s in sorted(supplies.items())], "source string, target_share double, max_repeats long, n_records long, available long, wanted double, aimed_share double")
    all_drawn = draws.agg(F.sum(size)).first()[0] or 1
    report = report.join(reached, "source", "left").select(
        "source", "target_share", "aimed_share", F.coalesce(F.col("drawn") / all_drawn, F.lit(0.0)).alias("actual_share"), F.coalesce("drawn", F.lit(0)).alias("drawn_tokens"), "wanted", F.col("available").alias("available_tokens"), "n_records", F.coalesce("n_draws", F.lit(0)).alias("n_draws"), F.coalesce("passes", F.lit(0)).alias("passes"), "max_repeats"
    )
    return draws.orderBy("position", "source", record_id, "repeat_no"), report
