"""Directories against repositories where a few contents are everywhere."""

import random
from difflib import SequenceMatcher
from pathlib import Path

from foldmark.operators import matching, patterns, similarity
from foldmark.plans import overlap
from foldmark.session import Scratch, shared_folder


def test_matched_pairs_equal_brute_force_and_store_no_pairs(spark, monkeypatch):
    rng = random.Random(7)
    stored = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (lambda out: stored.append(out.count()) or out)(write(self, df, name)))

    def some(tag):
        # frequent contents, contents of a few sets, and own ones; cells place contents in one of three paths
        sets = {i: {f"f{k}" for k in range(4) if rng.random() < 0.9} | {f"r{rng.randrange(40)}" for _ in range(rng.randrange(2))} | {f"{tag}{i}.{k}" for k in range(rng.randrange(4))} for i in range(150)}
        sets = {i: v for i, v in sets.items() if v}
        return sets, {i: {f"p{rng.randrange(3)}|{x}" for x in v} for i, v in sets.items()}

    (one, trees1), (two, trees2) = some("a"), some("b")
    members = lambda sets: similarity.distinct_members(spark.createDataFrame([(i, x) for i, v in sets.items() for x in v], "s long, x string"), "s", "x")
    tables = [members(s) for s in (one, two, trees1, trees2)]
    extra = spark.createDataFrame([(i, 10 * i) for i in one], "a long, files long")
    stored.clear()
    got = patterns.matched_pairs(*tables, 0.5, extra)
    kept = sum(stored)
    want = {(i, j, len(u & v), len(u), len(v), len(trees1[i] & trees2[j]), len(trees1[i]), len(trees2[j]), 10 * i) for i, u in one.items() for j, v in two.items() if 2 * len(u & v) >= len(u | v)}
    rows = [tuple(r[c] for c in ("a", "b", "k", "n1", "n2", "ck", "c1", "c2", "files")) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert kept < len(want) / 2


def test_content_matches_leave_only_what_the_result_reads(spark):
    at = Path(shared_folder(spark).removeprefix("file://")) / "foldmark"
    before = set(at.glob("*"))
    found = overlap.content_matches(spark, "/root/testdata/sf0.001")
    left = {p.name for run in set(at.glob("*")) - before for p in run.rglob("*") if p.is_dir()}
    assert left and not left & {"local", "remote", "sized", "rare-a", "rare-b"}
    assert found.count() > 0


def test_names_far_apart_are_dropped_as_they_meet(spark, monkeypatch):
    stored = {}
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: stored.setdefault(name, write(self, df, name)))
    one = [f"{w}-journal-{k}{k}qz" for w in ("amber", "lotus", "umber") for k in range(10)]
    two = [f"{w}_journal-xv{k}{k}" for w in ("amber", "cedar", "fenny") for k in range(10)]
    flat = lambda s: s.lower().replace("-", "_")
    want = {(x, y) for x in one for y in two if SequenceMatcher(None, flat(x), flat(y)).ratio() >= 0.8}
    got = matching.similar_names(*(spark.createDataFrame([(n,) for n in names], "name string") for names in (one, two)))
    assert {(r["local_name"], r["remote_name"]) for r in got.collect()} == want and want
    assert len(want) <= stored["candidates"].count() < len(one) * len(two) / 2
