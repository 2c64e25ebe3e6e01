import random

import pytest

from foldmark.llm import mixing
from foldmark.llm.mixing import Supply, demands, mix


def tables(spark, docs, targets):
    return spark.createDataFrame([(*d, 0.5) for d in docs], "doc long, src string, n long, position double"), spark.createDataFrame(targets, "source string, target_share double, max_repeats long")


def test_demands():
    supplies = {"a": Supply(0.5, 2, 100, 10), "b": Supply(0.3, 1, 300, 10), "c": Supply(0.2, 1, 0, 0)}
    want = demands(supplies)
    assert abs(want["a"] - 200) < 1e-9 and abs(want["b"] - 120) < 1e-9 and "c" not in want
    more = demands(supplies, 400)
    assert abs(more["a"] - 200) < 1e-9 and abs(more["b"] - 200) < 1e-9
    assert demands({"c": supplies["c"]}) == {}


def test_capped_sources_pass_on_their_share():
    all_ = {"a": Supply(0.6, 1, 10, 1), "b": Supply(0.2, 1, 20, 1), "c": Supply(0.2, 1, 1000, 1)}
    want = demands(all_, 200)
    assert want == {"a": 10.0, "b": 20.0, "c": 170.0}


@pytest.mark.parametrize("slice_", [20_000, 13])
def test_shares_repeats_and_order(spark, monkeypatch, slice_):
    monkeypatch.setattr(mixing, "SLICE", slice_)
    r = random.Random(2)
    docs = [(k, r.choice(["A", " a ", "b", "B", "c", None, "other"]), r.choice([None, 0, *range(1, 60)])) for k in range(900)]
    size = {k: n for k, _, n in docs}
    d, t = tables(spark, docs, [("a", 0.5, 1), ("B ", 0.4, 3), ("c", 0.1, 2), ("gone", 0.2, 5), (None, 0.3, 1)])
    draws, report = mix(d, "doc", "src", "n", t)
    out = draws.collect()
    assert [x["position"] for x in out] == sorted(x["position"] for x in out) and all(0 <= x["position"] < 1 for x in out)
    assert len({(x["doc"], x["repeat_no"]) for x in out}) == len(out) and all(x["n"] == size[x["doc"]] > 0 for x in out)
    limits = {"a": 1, "b": 3, "c": 2}
    assert all(x["repeat_no"] < limits[x["source"]] for x in out)
    shares = {x["source"]: x for x in report.collect()}
    assert set(shares) == {"a", "b", "c", "gone"} and shares["gone"]["n_draws"] == 0
    total = sum(x["n"] for x in out)
    for source, x in shares.items():
        assert x["drawn_tokens"] == sum(y["n"] for y in out if y["source"] == source)
        assert abs(x["actual_share"] - x["drawn_tokens"] / total) < 1e-12
        assert abs(x["drawn_tokens"] - x["wanted"]) <= 60
    for name, share in (("a", 0.5), ("b", 0.4), ("c", 0.1)):
        assert abs(shares[name]["actual_share"] - share) < 0.02


def test_positions_follow_the_schedule(spark):
    d, t = tables(spark, [(k, "ab"[k % 2], 1) for k in range(2000)], [("a", 0.5, 1), ("b", 0.5, 1)])
    draws, _ = mix(d, "doc", "src", "n", t, schedule={"a": [(0.0, 1.0), (0.5, 0.0), (1.0, 0.0)], "b": [(0.0, 0.0), (0.5, 1.0), (1.0, 1.0)]})
    out = draws.collect()
    a = sorted(x["position"] for x in out if x["source"] == "a")
    b = sorted(x["position"] for x in out if x["source"] == "b")
    # the integral of a falling line is t - t * t, of b's rising one t * t up to the middle
    assert max(a) <= 0.5 and abs(a[len(a) // 2] - (0.5 - 0.5 * 0.5**0.5)) < 0.01
    assert abs(sum(x < 0.5 for x in b) / len(b) - 1 / 3) < 0.01
    with pytest.raises(ValueError):
        mix(d, "doc", "src", "n", t, schedule={"a": [(0.0, 1.0), (0.4, 1.0)]})


def test_a_huge_record_misses_the_demand_by_half_of_it_at_most(spark):
    d, t = tables(spark, [(0, "a", 5000), *[(k, "a", 10) for k in range(1, 500)], *[(k, "b", 10) for k in range(1000, 1400)]], [("a", 0.3, 1), ("b", 0.7, 1)])
    for seed in range(3):
        _, report = mix(d, "doc", "src", "n", t, seed=seed)
        x = {r["source"]: r for r in report.collect()}["a"]
        assert abs(x["drawn_tokens"] - x["wanted"]) <= 2500


def test_long_records_are_drawn_as_often_as_short_ones(spark):
    # a quarter of source a is drawn, whose records differ in length by a factor of 40
    d, t = tables(spark, [*[(k, "a", 40 if k % 10 == 0 else 1) for k in range(4000)], *[(k, "b", 5) for k in range(10_000, 10_982)]], [("a", 0.5, 1), ("b", 0.5, 1)])
    out = [x for x in mix(d, "doc", "src", "n", t)[0].collect() if x["source"] == "a"]
    long_, short = sum(x["n"] == 40 for x in out) / 400, sum(x["n"] == 1 for x in out) / 3600
    assert 0.2 < long_ < 0.31 and 0.2 < short < 0.31


def test_the_report_gives_the_share_aimed_at(spark):
    d, t = tables(spark, [(k, "ab"[k % 2], 1) for k in range(400)], [("a", 0.4, 1), ("b", 0.4, 2), ("none", 0.2, 1)])
    rows = {r["source"]: r for r in mix(d, "doc", "src", "n", t)[1].collect()}
    assert (rows["a"]["target_share"], rows["a"]["aimed_share"], rows["none"]["aimed_share"]) == (0.4, 0.5, 0.0)
    rows = {r["source"]: r for r in mix(d, "doc", "src", "n", t, total=500.0)[1].collect()}
    assert rows["a"]["drawn_tokens"] == 200 and rows["b"]["drawn_tokens"] == 300


def test_nothing_to_mix(spark):
    d, t = tables(spark, [], [("a", 1.0, 1)])
    draws, report = mix(d, "doc", "src", "n", t)
    assert draws.count() == 0 and [tuple(r)[:3] for r in report.collect()] == [("a", 1.0, 0.0)]
    d, t = tables(spark, [(1, "a", 5)], [])
    draws, report = mix(d, "doc", "src", "n", t)
    assert draws.count() == 0 and report.count() == 0
