import random

import pytest

from foldmark.llm import components
from foldmark.llm.components import connected_groups


def brute(links):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            one, two = sorted((find(a), find(b)))
            top[two] = one
    return {x: find(x) for x in top}


def check(spark, links):
    df = spark.createDataFrame([(*x, "v") for x in links], "one long, two long, vertex string")
    got = [tuple(r) for r in connected_groups(df, "one", "two").collect()]
    assert dict(got) == brute(links) and len(got) == len(dict(got))


def test_chain(spark):
    check(spark, [(k, k + 1) for k in range(60)])


@pytest.mark.parametrize("hub", [10_000, 5])
def test_star_loops_repeats_and_nulls(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB_LINKS", hub)
    monkeypatch.setattr(components, "HUB_SHARE", 0.0)
    check(spark, [(100, k) for k in range(40)] + [(3, 3), (200, 200), (7, 100), (100, 7), (None, 5), (5, None), (301, 300), (300, 301)])


def test_random_graph(spark):
    r = random.Random(3)
    check(spark, [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)])


def test_no_links(spark):
    check(spark, [])
    check(spark, [(1, 1), (None, None)])
