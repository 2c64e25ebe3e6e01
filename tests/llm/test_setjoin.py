import itertools
import random

import pytest

from foldmark.llm import setjoin
from foldmark.operators import sets
from foldmark.llm.setjoin import similar_sets


def make_sets(seed, n=60):
    """Sets with rare and very frequent tokens, near copies, exact copies and sets of frequent tokens alone."""
    r = random.Random(seed)
    common = [f"c{k}" for k in range(12)]
    sets = {}
    for k in range(n):
        if k and r.random() < 0.5:
            s = set(sets[r.randrange(k)])
            for x in r.sample(sorted(s), min(len(s), r.randint(0, 3))):
                s.discard(x)
            s |= {f"n{r.randint(0, 400)}" for _ in range(r.randint(0, 2))}
        elif r.random() < 0.4:
            s = set(r.sample(common, r.randint(1, 9)))
        else:
            s = set(r.sample(common, r.randint(0, 6))) | {f"n{r.randint(0, 400)}" for _ in range(r.randint(1, 20))}
        sets[k] = s or {"c0"}
    return sets


def frame(spark, sets):
    rows = [(k, x) for k, s in sets.items() for x in s]
    return spark.createDataFrame([*rows, *rows[:10], (None, "c1"), (0, None)], "s long, token string").withColumnRenamed("s", "owner")


def check(spark, sets, threshold, least=1):
    found = similar_sets(frame(spark, sets), "owner", "token", threshold, least)
    kept = {k: s for k, s in sets.items() if len(s) >= least}
    members = {r["set"]: r["class"] for r in found.members.collect()}
    assert members == {k: min(j for j, t in kept.items() if t == s) for k, s in kept.items()}
    classes = {k: kept[k] for k in set(members.values())}
    want = {(a, b, len(classes[a] & classes[b])) for a, b in itertools.combinations(sorted(classes), 2) if len(classes[a] & classes[b]) >= threshold * len(classes[a] | classes[b]) - 1e-9}
    pairs = found.pairs.collect()
    assert {(r["set1"], r["set2"], r["shared"]) for r in pairs} == want and len(pairs) == len(want)
    assert all(abs(r["jaccard"] - r["shared"] / (r["size1"] + r["size2"] - r["shared"])) < 1e-12 and r["size1"] == len(classes[r["set1"]]) for r in pairs)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_equals_brute_force(spark, threshold):
    check(spark, make_sets(1), threshold)


@pytest.mark.parametrize("levels", [(1, 1), (3, 10), (1, setjoin.NEVER), (setjoin.NEVER, setjoin.NEVER)])
def test_any_choice_of_prefixes_is_lossless(spark, monkeypatch, levels):
    monkeypatch.setattr(setjoin, "_levels", lambda *a: levels)
    for threshold in (0.3, 0.6):
        check(spark, make_sets(2, 45), threshold)


def test_sets_larger_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(sets, "CHUNK", 4)
    monkeypatch.setattr(sets, "LIST_SLICE", 3)
    check(spark, make_sets(3, 45), 0.5, 3)


def test_choice_weighs_the_costs(spark):
    ranked = spark.createDataFrame([(s, 4, x, 300, x + 1) for s in range(300) for x in range(4)], "s long, n int, x long, df long, pos int")
    two, three = setjoin._levels(ranked, 0.6)
    assert two <= three <= 300
    rare = ranked.selectExpr("s", "n", "s * 4 + x as x", "1L as df", "pos")
    assert setjoin._levels(rare, 0.6) == (setjoin.NEVER, setjoin.NEVER)


def test_empty_and_useless_inputs(spark):
    none = spark.createDataFrame([], "owner long, token string")
    found = similar_sets(none, "owner", "token", 0.6)
    assert found.pairs.count() == 0 and found.members.count() == 0
    found = similar_sets(spark.createDataFrame([(1, None), (None, "x")], "owner long, token string"), "owner", "token", 0.6)
    assert found.pairs.count() == 0 and found.members.count() == 0
    with pytest.raises(ValueError):
        similar_sets(none, "owner", "token", 0.0)
