"""Items of varying size combined into containers of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldmark.operators.skew import BROADCAST_ROWS
from foldmark.session import Scratch

#: Items of one size are numbered in slices of about so many.
SLICE = 50_000
#: Ranks of one join key of the plan.
BLOCK = 4096
#: Containers of one training step.
STEP_CONTAINERS = 16


@dataclass(frozen=True)
class Batch:
    """``count`` containers that look alike: ``room`` left, and parts (size, first rank, items per container, offset)."""

    count: int
    room: int
    parts: tuple[tuple[int, int, int, int], ...]

    def put(self, size: int, rank: int, each: int, capacity: int) -> Batch:
        return replace(self, room=self.room - size * each, parts=(*self.parts, (size, rank, each, capacity - self.room)))

    def split(self, k: int) -> tuple[Batch, Batch]:
        """The first k containers, and the others, whose items have the ranks that follow."""
        return replace(self, count=k), replace(self, count=self.count - k, parts=tuple((s, r + k * e, e, o) for s, r, e, o in self.parts))

    @property
    def cost(self) -> int:
        """Sum of squared sizes: what attention within items costs."""
        return sum(s * s * e for s, _, e, _ in self.parts)


def plan(histogram: Mapping[int, int], capacities: Sequence[int]) -> dict[int, list[Batch]]:
    """Pack ``histogram`` (items per size, sizes up to the largest capacity) into batches of like containers per capacity.

    The capacities are the tiers. Each size is routed to the smallest tier that
    takes it. Tiers are packed from the longest to the shortest: first the
    tier's own sizes, from large to small, each into the smallest gap that
    takes it or into containers of its own; then what room is left in the
    tier's containers is filled from the shorter tiers, again from large to
    small into the smallest gap, without opening containers. What a shorter
    tier has left then goes into its own containers. All items of a size are
    placed together, so the work depends on the number of different sizes,
    never on the number of items.
    """
    tiers = sorted(set(capacities))
    left, rank = dict(histogram), dict.fromkeys(histogram, 0)
    out: dict[int, list[Batch]] = {}
    for capacity in reversed(tiers):
        rooms: list[int] = []  # different rooms with open batches, ascending
        open_: dict[int, list[Batch]] = {}

        def keep(batch: Batch) -> None:
            if batch.room not in open_:  # noqa: B023 - used within the loop only
                insort(rooms, batch.room)  # noqa: B023
                open_[batch.room] = []  # noqa: B023
            open_[batch.room].append(batch)  # noqa: B023

        below = max((t for t in tiers if t < capacity), default=0)
        for size in sorted((s for s in left if s <= capacity), reverse=True):
            own = size > below
            while left[size]:
                at = bisect_left(rooms, size)
                if at < len(rooms):
                    room = rooms[at]
                    batch = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[at]
                    if batch.count > left[size]:
                        batch, rest = batch.split(left[size])
                        keep(rest)
                    each = max(1, min(room // size, left[size] // batch.count))
                elif own:
                    each = min(capacity // size, left[size])
                    batch = Batch(left[size] // each, capacity, ())
                else:
                    break
                keep(batch.put(size, rank[size], each, capacity))
                rank[size] += each * batch.count
                left[size] -= each * batch.count
        left = {s: n for s, n in left.items() if n}
        out[capacity] = [b for room in rooms for b in open_[room]]
    return out


def pack(items: DataFrame, item_id: str, size: str, limits: Mapping[str, int], step_containers: int = STEP_CONTAINERS) -> DataFrame:
    """Assign each item once, to the containers of several capacities: the limits are the tiers of ``plan``.

    Returns limit_name (of the container), container_id, step_id, tier (the
    capacity that the piece was routed to; a smaller one than the container's
    means that it fills a gap), the item id, piece, item_start, piece_size,
    container_offset. An item is split only if it is larger than the largest
    capacity, into full pieces and a remainder. Items of null size or size 0
    take no room and are left out; repeated ids are items of their own.
    Container ids run from 0 per limit. Steps hold equal numbers of tokens in all
    tiers, ``step_containers`` of the largest capacity, and have balanced costs:
    containers are dealt to the steps of their tier back and forth in order of
    their sum of squared sizes.

    Only the number of items per size reaches the driver, at most one number per
    unit of capacity, whatever the number of items. Items are numbered within
    their size in slices, so a size that most items have is no hot group.
    """
    return _packed(items, item_id, size, {"": dict(limits)}, step_containers)


def pack_each(items: DataFrame, item_id: str, size: str, limits: Mapping[str, int], step_containers: int = STEP_CONTAINERS) -> DataFrame:
    """Assign all items to the containers of every limit by itself: as pack, once per limit with that as the only tier."""
    return _packed(items, item_id, size, {name: {name: capacity} for name, capacity in limits.items()}, step_containers)


def _packed(items: DataFrame, item_id: str, size: str, plans: Mapping[str, Mapping[str, int]], step_containers: int) -> DataFrame:
    spark = items.sparkSession
    if not plans or not all(plans.values()):
        raise ValueError("no limits given")
    scratch = Scratch(spark, "packing")
    every_plan = F.array(*[F.struct(F.lit(k).alias("plan"), F.lit(int(max(v.values()))).cast("long").alias("capacity")) for k, v in plans.items()])
    whole = items.select(F.col(item_id).alias("_id"), F.col(size).cast("long").alias("_n")).where("_n > 0")
    cut = whole.select("*", F.inline(every_plan)).withColumn("piece", F.explode(F.expr("sequence(0, cast((_n - 1) div capacity as int))")))
    pieces = cut.select("plan", "_id", "piece", (F.col("piece") * F.col("capacity")).alias("item_start"), F.least(F.col("capacity"), F.col("_n") - F.col("piece") * F.col("capacity")).alias("piece_size"))
    pieces = scratch.write(pieces, "pieces")
    counts: dict[str, dict[int, int]] = {name: {} for name in plans}
    for row in pieces.groupBy("plan", "piece_size").agg(F.count("*").alias("n")).collect():
        counts[row["plan"]][row["piece_size"]] = row["n"]

    segments, steps = [], []
    for name, limits in plans.items():
        of_capacity = {capacity: limit for limit, capacity in sorted(limits.items(), reverse=True)}
        bounds = sorted(of_capacity)
        for capacity, batches in plan(counts[name], bounds).items():
            limit, first = of_capacity[capacity], 0
            for batch in sorted(batches, key=lambda b: (-b.cost, b.parts)):
                for s, rank, each, offset in batch.parts:
                    segments.append((name, s, rank, rank + each * batch.count, first, each, offset, limit, min(t for t in bounds if t >= s)))
                first += batch.count
            steps.append((limit, max(1, -(-first * capacity // (step_containers * bounds[-1])))))
    placed = _place(_ranked(pieces, counts), segments, spark)
    of_steps = F.broadcast(spark.createDataFrame(steps, "limit_name string, n_steps long"))
    lap, at = F.expr("container_id div n_steps"), F.expr("container_id % n_steps")
    return placed.join(of_steps, "limit_name").select(
        "limit_name", "container_id", F.when(lap % 2 == 0, at).otherwise(F.col("n_steps") - 1 - at).alias("step_id"), "tier", F.col("_id").alias(item_id), "piece", "item_start", "piece_size", "container_offset"
    )


def _ranked(pieces: DataFrame, counts: dict[str, dict[int, int]]) -> DataFrame:
    """Number the pieces of each size from 0. Sizes with many pieces are numbered slice by slice."""
    order = Window.partitionBy("plan", "piece_size", "slice").orderBy("_id", "piece")
    many = [(name, s, -(-n // SLICE)) for name, h in counts.items() for s, n in h.items() if n > SLICE]
    if not many:
        return pieces.withColumn("slice", F.lit(0)).withColumn("rank", F.row_number().over(order) - 1)
    slices = F.broadcast(pieces.sparkSession.createDataFrame(many, "plan string, piece_size long, n_slices int"))
    sliced = pieces.join(slices, ["plan", "piece_size"], "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("_id", "piece"), "n_slices"), F.lit(0)).cast("int")).drop("n_slices")
    sizes = sliced.groupBy("plan", "piece_size", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("plan", "piece_size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("plan", "piece_size", "slice", before.alias("before"))
    return sliced.withColumn("at", F.row_number().over(order) - 1).join(offsets, ["plan", "piece_size", "slice"]).withColumn("rank", F.col("at") + F.col("before"))


def _place(ranked: DataFrame, segments: list[tuple], spark) -> DataFrame:
    """Look up each piece's container by its size and rank."""
    schema = "plan string, piece_size long, first long, last long, container long, each long, offset long, limit_name string, tier long"
    blocks = spark.createDataFrame(segments, schema).withColumn("block", F.explode(F.expr(f"sequence(first div {BLOCK}, (last - 1) div {BLOCK})")))
    if sum((s[3] - 1) // BLOCK - s[2] // BLOCK + 1 for s in segments) <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    met = ranked.withColumn("block", F.expr(f"rank div {BLOCK}")).join(blocks, ["plan", "piece_size", "block"]).where("rank >= first and rank < last")
    nth = F.col("rank") - F.col("first")
    return met.withColumns({"container_id": F.col("container") + F.expr("(rank - first) div each"), "container_offset": F.col("offset") + nth % F.col("each") * F.col("piece_size")})


def fill(assigned: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Per limit: containers, tokens, how many of them fill gaps, share of the room used, steps, and the spread of tokens over steps. A limit without containers has no row."""
    caps = F.broadcast(assigned.sparkSession.createDataFrame([(k, int(v)) for k, v in limits.items()], "limit_name string, capacity long"))
    step = assigned.join(caps, "limit_name").groupBy("limit_name", "capacity", "step_id").agg(
        F.sum("piece_size").alias("n"), F.sum(F.when(F.col("tier") < F.col("capacity"), F.col("piece_size")).otherwise(0)).alias("g"), F.sum(F.when(F.col("container_offset") == 0, 1).otherwise(0)).alias("containers")
    )
    total = step.groupBy("limit_name", "capacity").agg(F.sum("containers").alias("n_containers"), F.sum("n").alias("n_tokens"), F.sum("g").alias("n_gap_tokens"), F.count("*").alias("n_steps"), F.min("n").alias("least_step_tokens"), F.max("n").alias("most_step_tokens"))
    return total.withColumn("fill_share", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
