import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldmark.llm import packing
from foldmark.llm.packing import fill, pack, pack_each, plan


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20), st.integers(40, 50), st.sampled_from([(), (8, 20)]))
def test_plan_places_every_item_once(histogram, capacity, shorter):
    placed: dict[int, list[int]] = {}
    for size_of, batches in plan(histogram, [*shorter, capacity]).items():
        containers = filled = 0
        for batch in batches:
            containers += batch.count
            assert batch.count > 0 and batch.room >= 0
            used = 0
            for size, rank, each, offset in batch.parts:
                assert offset == used
                used += size * each
                placed.setdefault(size, []).extend(range(rank, rank + each * batch.count))
            assert used + batch.room == size_of
            # a container of a tier opens for an item that no shorter tier takes
            assert batch.parts[0][0] > max((t for t in shorter if t < size_of), default=0)
            filled += used * batch.count
        # it opens only when no other has the room, so any two together hold more than one's capacity
        assert containers <= 2 * filled / size_of + 1
    assert {s: sorted(r) for s, r in placed.items()} == {s: list(range(n)) for s, n in histogram.items()}


def test_tiers_fill_long_windows_from_shorter_ones():
    histogram = {60: 2, 30: 2, 9: 3, 5: 20}
    tiers = plan(histogram, [10, 40, 64])
    sizes = {c: sorted((s, e * b.count) for b in batches for s, _, e, _ in b.parts) for c, batches in tiers.items()}
    assert sizes[64] == [(60, 2)] and sizes[40] == [(9, 2), (30, 2)]
    assert sum(n for s, n in sizes[10]) == 21 and sum(b.count for b in tiers[10]) == 11
    assert sum(b.count for b in plan(histogram, [64])[64]) == 6  # without tiers everything lies in long windows


def assigned(spark, sizes, limits, how=pack, **options):
    df = spark.createDataFrame([(k, n, "x") for k, n in enumerate(sizes)], "doc long, n long, piece string")
    return how(df, "doc", "n", limits, **options)


@pytest.mark.parametrize("slice_, how", [(50_000, pack), (7, pack), (50_000, pack_each), (7, pack_each)])
def test_containers(spark, monkeypatch, slice_, how):
    monkeypatch.setattr(packing, "SLICE", slice_)
    monkeypatch.setattr(packing, "BLOCK", 16)
    r = random.Random(1)
    sizes = [r.choice([3, 3, 3, r.randint(1, 130), None, 0]) for _ in range(400)] + [1000, 64]
    limits = {"short": 32, "long": 64}
    out = assigned(spark, sizes, limits, how, step_containers=4).collect()
    for group, largest in [(("short", "long"), 64)] if how is pack else [(("short",), 32), (("long",), 64)]:
        pieces: dict = {}
        for x in (x for x in out if x["limit_name"] in group):
            pieces.setdefault(x["doc"], []).append((x["piece"], x["item_start"], x["piece_size"]))
        assert set(pieces) == {k for k, n in enumerate(sizes) if n}
        for k, parts in pieces.items():
            parts.sort()
            assert [p for p, *_ in parts] == list(range(len(parts))) and sum(n for *_, n in parts) == sizes[k]
            assert all(start == p * largest for p, start, _ in parts) and (len(parts) == 1 or sizes[k] > largest)
    for name, capacity in limits.items():
        room, steps = {}, {}
        for x in (x for x in out if x["limit_name"] == name):
            room.setdefault(x["container_id"], []).append((x["container_offset"], x["piece_size"]))
            steps.setdefault(x["container_id"], set()).add(x["step_id"])
            assert x["piece_size"] <= x["tier"] <= capacity
        for parts in room.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
        assert set(room) == set(range(len(room))) and all(len(s) == 1 for s in steps.values())
        assert sum(n for parts in room.values() for _, n in parts) / (len(room) * capacity) > 0.93
        per_step = [sum(1 for s in steps.values() if s == {k}) for k in {next(iter(s)) for s in steps.values()}]
        assert max(per_step) - min(per_step) <= 1


def test_fill_reports_the_assignment(spark):
    limits = {"only": 10}
    row = fill(assigned(spark, [10, 4, 6, 25, 5], limits), limits).first()
    assert (row["n_containers"], row["n_tokens"], row["fill_share"]) == (5, 50, 1.0)


def test_nothing_to_pack(spark):
    assert assigned(spark, [], {"a": 5}).count() == 0
    assert assigned(spark, [None, 0], {"a": 5}).count() == 0
    with pytest.raises(ValueError):
        assigned(spark, [1], {})
