import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foldmark.operators import containment, matching, merge, rollup, sets, similarity, skew
from foldmark.operators.layout import spread
from foldmark.operators.references import lifetimes, month_of, orphan_references


@pytest.fixture
def no_broadcast(monkeypatch):
    """Make split_join take its way for large tables."""
    monkeypatch.setattr(skew.split_join, "__defaults__", (*skew.split_join.__defaults__[:-1], 0))


def hot_rows(seed=1):
    r = random.Random(seed)
    rows = [("hot", r.randint(0, 9), f"d{r.randint(0, 2)}") for _ in range(300)] + [(f"k{r.randint(0, 40)}", r.randint(0, 9), r.choice(["d0", "d1", None])) for _ in range(200)]
    return [*rows, (None, 5, "d0"), ("k1", None, "d1"), ("k1", 3, None)]


def test_profile_keys_equals_brute_force(spark):
    data = hot_rows()
    want = defaultdict(lambda: [0, 0, set()])
    for k, s, h in data:
        if k is not None:
            want[k][0] += 1
            want[k][1] += s or 0
            want[k][2] |= {h} - {None}
    # the input's own columns may have the names used inside
    df = spark.createDataFrame(data, "key string, s int, h string").withColumn("k", F.lit(1)).withColumn("n_rows", F.lit(2))
    for share in (0.001, 0.3, 0.9):
        got = {r["key"]: (r["n_rows"], r["total_size"], r["n_holders"]) for r in skew.profile_keys(df, "key", "s", "h", share).collect()}
        assert got == {k: (n, s, len(h)) for k, (n, s, h) in want.items()}


def test_profile_of_nothing(spark):
    df = spark.createDataFrame([], "key string, s long, h string")
    assert skew.profile_keys(df, "key", "s", "h").count() == 0
    assert skew.keys_above(df, "key", "s", "h", 0.02).count() == 0
    nulls = spark.createDataFrame([(None, 1, "a")], "key string, s long, h string")
    assert skew.profile_keys(nulls, "key", "s", "h").count() == 0


def test_keys_above_takes_the_exact_share(spark, rows):
    data = [("a",)] * 50 + [("b",)] * 2 + [("c",)] + [(f"x{k}",) for k in range(47)]
    df = spark.createDataFrame(data, "key string").withColumns({"s": F.lit(1), "h": F.lit("h")})
    assert [r[0] for r in rows(skew.keys_above(df, "key", "s", "h", 0.02))] == ["a", "b"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("most", [0, 1000])
def test_split_join_equals_join(spark, rows, how, most):
    left = spark.createDataFrame([(k, i) for i, (k, *_) in enumerate(hot_rows())], "k string, i long")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("unmatched", 4), (None, 5)], "k string, v long")
    got = skew.split_join(left, right, ["k"], how, share=0.05, most=most)
    assert rows(got) == rows(left.join(right, "k", how).select(*got.columns))


def test_heavy_values_is_bounded_and_finds_hot_keys(spark):
    df = spark.range(10_000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    heavy, n = skew.heavy_values(df, F.col("k"), 0.01)
    assert heavy == [0] and n == 10_000


REFS = [(1, 1, 1), (2, 1, None), (3, None, 1), (4, None, None), (5, 9, 1), (6, 9, None), (7, 1, 9)]


@pytest.mark.parametrize(("match", "orphans"), [("simple", [5, 7]), ("partial", [5, 6, 7]), ("full", [2, 3, 5, 6, 7])])
def test_match_semantics(spark, match, orphans):
    refs = spark.createDataFrame([(*r, "x") for r in REFS], "id int, a int, b int, key string")
    targets = spark.createDataFrame([(1, 1, "y"), (1, 1, "z"), (2, 1, "y")], "a int, b int, key string")
    got = orphan_references(refs, targets, ["a", "b"], match)
    assert sorted(r["id"] for r in got.collect()) == orphans and got.columns == refs.columns


def test_no_targets_and_no_references(spark):
    refs = spark.createDataFrame([(1, 7), (2, None)], "id int, a int")
    assert [r["id"] for r in orphan_references(refs, refs.select("a").limit(0), ["a"]).collect()] == [1]
    assert orphan_references(refs.limit(0), refs.select("a"), ["a"]).count() == 0
    with pytest.raises(ValueError):
        orphan_references(refs, refs, ["a"], "some")


def test_lifetimes_against_brute_force(spark, no_broadcast):
    r = random.Random(4)
    time = lambda: r.choice([None, *map(float, range(8))])
    targets = [(k, time()) for k in range(12)]
    removals = [(r.choice([None, *range(14)]), time()) for _ in range(20)]
    refs = [(i, r.choice([None, *range(15)]), time()) for i in range(400)]
    arrived = dict(targets)

    def orphan(key, at):
        if key is None:
            return False
        if key not in arrived:
            return True
        a = arrived[key]
        if a is not None and at is not None and a > at:
            return True
        return any(k == key and g is not None and (at is None or g <= at) and not (a is not None and a > g) for k, g in removals)

    alive = lifetimes(spark.createDataFrame(targets, "key long, arrived double"), spark.createDataFrame(removals, "key long, removed double")).withColumnRenamed("key", "ref")
    got = orphan_references(spark.createDataFrame(refs, "id long, ref long, at double"), alive, ["ref"], "simple", "at")
    assert sorted(x["id"] for x in got.collect()) == sorted(i for i, k, t in refs if orphan(k, t))


def test_month(spark):
    df = spark.createDataFrame([(1704067199.9,), (1704067200.0,), (None,)], "t double")
    assert [r[0] for r in df.select(month_of("t")).collect()] == ["2023-12", "2024-01", "none"]


def test_members_below(spark, rows):
    dirs = spark.createDataFrame([(1, "/a"), (2, "/a/b"), (3, "/a/bc"), (4, None)], "id long, path string")
    files = spark.createDataFrame([("/a/b/x", 1), ("/a/bc/y/z", 2), ("/a", 3), ("/other", 4), (None, 5)], "path string, v int")
    got = containment.members_below(dirs, files, "id", "path", "path", ["v"])
    assert rows(got) == [(1, "b/x", 1), (1, "bc/y/z", 2), (2, "x", 1), (3, "y/z", 2)]
    assert containment.members_below(dirs.limit(0), files, "id", "path", "path", ["v"]).count() == 0
    assert rows(containment.explode_ancestors(files, "path", "/a").select("path", "ancestor")) == [("/a/b/x", "/a"), ("/a/b/x", "/a/b"), ("/a/bc/y/z", "/a"), ("/a/bc/y/z", "/a/bc"), ("/a/bc/y/z", "/a/bc/y")]


def test_roll_up(spark, rows, monkeypatch):
    import hashlib

    data = [(1, "b", "d1", 5, 1.0), (1, "a", "d2", None, 3.0), (2, "b", "d1", 7, None), (2, "a", "d2", 1, 2.0), (3, "x", None, 1, 1.0)]
    members = spark.createDataFrame(data, "dir_id long, rel_path string, digest string, size_bytes long, mtime double")
    assert rows(rollup.directory_totals(members)) == [(1, 2, 5, 3.0), (2, 2, 8, 2.0), (3, 1, 1, 1.0)]
    whole = hashlib.sha256(b"a|d2\nb|d1\n").hexdigest()
    assert rows(rollup.directory_hashes(members)) == [(1, whole), (2, whole)]
    monkeypatch.setattr(rollup, "TREE_FILES", 1)
    assert rows(rollup.directory_hashes(members)) == [(1, whole), (2, whole)]
    many = [(k % 3, f"f{k:05d}", f"d{k}") for k in range(30_000)]
    monkeypatch.setattr(rollup, "TREE_FILES", 9_000)
    want = [(d, hashlib.sha256("".join(f"{f}|{x}\n" for e, f, x in many if e == d).encode()).hexdigest()) for d in range(3)]
    assert rows(rollup.directory_hashes(spark.createDataFrame(many, "dir_id long, rel_path string, digest string"))) == want
    dirs = spark.createDataFrame([(5, "h"), (3, "h"), (4, "h"), (6, ""), (7, ""), (8, None), (9, "one")], "id long, tree string")
    assert rows(rollup.equal_groups(dirs, "id", "tree")) == [(3, 3, 3), (4, 3, 3), (5, 3, 3)]
    assert rows(rollup.equal_pairs(dirs, "id", "tree")) == [(3, 4), (3, 5), (4, 5)]


def random_sets(seed, n, universe=30):
    r = random.Random(seed)
    return {k: {f"t{min(r.randint(0, universe), r.randint(0, universe))}" for _ in range(r.randint(1, 12))} for k in range(n)}


def frame(spark, sets):
    return spark.createDataFrame([(k, x) for k, s in sets.items() for x in s for _ in range(2)] + [(None, "t1"), (0, None), (0, "")], "s long, x string")


@pytest.mark.parametrize("threshold", [0.1, 0.5, 1.0])
@pytest.mark.parametrize("slice_, chunk", [(2000, 4096), (3, 4)])
def test_similarity_joins_equal_brute_force(spark, rows, monkeypatch, threshold, slice_, chunk):
    monkeypatch.setattr(sets, "LIST_SLICE", slice_)
    monkeypatch.setattr(sets, "CHUNK", chunk)
    one, two = random_sets(1, 25), random_sets(2, 20)
    a, b = similarity.distinct_members(frame(spark, one), "s", "x"), similarity.distinct_members(frame(spark, two), "s", "x")
    like = lambda x, y: len(x & y) / len(x | y) >= threshold
    assert rows(similarity.similar_pairs(a, threshold).select("a", "b", "k")) == sorted(((i, j, len(one[i] & one[j])) for i, j in itertools.combinations(one, 2) if like(one[i], one[j])), key=str)
    assert rows(similarity.similar_pairs(a, threshold, b).select("a", "b", "k", "n1", "n2")) == sorted(((i, j, len(one[i] & two[j]), len(one[i]), len(two[j])) for i in one for j in two if like(one[i], two[j])), key=str)


def test_blocks_keep_sets_apart(spark, rows):
    df = spark.createDataFrame([(1, "x", 0), (2, "x", 0), (3, "x", 1)], "s long, x string, d int")
    assert rows(similarity.with_jaccard(similarity.similar_pairs(similarity.distinct_members(df, "s", "x", "d"), 0.5))) == [(1, 2, 1.0, 1, 0, 0)]
    assert similarity.possible_pairs(df, "d", 5).first()[0] == 0


def classes(spark, function, *values):
    return spark.range(1).select(function(*[F.lit(v) for v in values])).first()[0]


@pytest.mark.parametrize(("values", "name"), [
    ((0.1, 0.0, 3, 3, 1, 1), "no_match"), ((1.0, 1.0, 3, 3, 0, 0), "exact"), ((1.0, 1.0, 4, 3, 0, 0), "partial_match"), ((0.5, 0.0, 3, 3, 1, 0), "local_is_ahead"), ((0.5, 0.0, 3, 3, 0, 1), "github_is_ahead"), ((0.5, 0.0, 3, 3, 1, 1), "diverged"),
])
def test_content_class(spark, values, name):
    assert classes(spark, matching.content_class, *values) == name


@pytest.mark.parametrize(("values", "name"), [
    ((1.0, 1.0, 3, 3, 0, 0), "exact"), ((0.9, 0.0, 3, 3, 1, 0), "local_is_ahead"), ((0.9, 0.0, 3, 3, 0, 1), "github_is_ahead"), ((0.9, 0.0, 3, 3, 0, 0), "diverged"), ((0.6, 0.0, 3, 3, 1, 1), "diverged"), ((0.6, 0.0, 3, 3, 1, 0), "partial_match"), ((0.1, 0.0, 3, 3, 1, 0), "name_only"),
])
def test_graded_class(spark, values, name):
    assert classes(spark, matching.graded_class, *values) == name


def test_similar_names_equal_brute_force(spark):
    from difflib import SequenceMatcher

    r = random.Random(3)
    words = ["tide", "diet", "My-App", "my_app", "my app2", "böse", "BÖSE-x", "a", "", *["".join(r.choice("abc_-") for _ in range(r.randint(1, 7))) for _ in range(60)]]
    one, two = words[::2], words[1::2]
    flat = lambda x: x.lower().replace("-", "_").replace(" ", "_")
    want = {(x, y) for x in one for y in two if x and y and SequenceMatcher(None, flat(x), flat(y)).ratio() >= 0.8}
    frames = [spark.createDataFrame([(w,) for w in ws] + [(None,)], "name string") for ws in (one, two)]
    assert {(x["local_name"], x["remote_name"]) for x in matching.similar_names(*frames).collect()} == want


def test_merges(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 20, None), ("c", 30, "z"), (None, 40, "n")], "k string, v int, w string")
    assert rows(merge.upsert(old, new, ["k"])) == [("a", 1, "x"), ("b", 20, None), ("c", 30, "z"), (None, 40, "n")]
    assert rows(merge.upsert(old, new, ["k"], ["v"])) == [("a", 1, "x"), ("b", 20, "y"), ("c", 30, "z"), (None, 40, "n")]
    assert rows(merge.upsert(old, new.drop("w"), ["k"])) == [("a", 1, "x"), ("b", 20, "y"), ("c", 30, None), (None, 40, None)]
    assert rows(merge.upsert(old, new.limit(0), ["k"])) == rows(old)
    twice = new.unionByName(spark.createDataFrame([("c", 3, "first")], new.schema))
    assert rows(merge.insert_or_ignore(old, twice, ["k"], [F.col("v")])) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, "first"), (None, 40, "n")]
    assert rows(merge.replace_groups(old, new, "k")) == [("a", 1, "x"), ("b", 20, None), ("c", 30, "z"), (None, 40, "n")]
    assert rows(merge.prefer_first([new, old], ["k"]))[:2] == [("a", 1, "x"), ("b", 20, None)]
    assert rows(merge.mark_rows(old, spark.createDataFrame([("b",)], "i string"), "k", "w", F.lit("done"))) == [("a", 1, "x"), ("b", 2, "done")]
    assert rows(merge.latest_per_key(twice, ["k"], [F.col("v")])) == [("b", 20, None), ("c", 3, "first"), (None, 40, "n")]
    assert rows(merge.latest_per_key(twice, ["k"], [F.col("v")], 2)) == rows(twice) and rows(merge.latest_per_key(old.unionByName(new), ["w"], [F.col("v")], 2, 2)) == rows(old.unionByName(new))
    ids = merge.stable_ids(old, ["k"])
    assert rows(ids) == rows(merge.stable_ids(old, ["k"])) and ids.select("row_key").distinct().count() == 2


def test_fresh_files(spark, rows):
    known = spark.createDataFrame([("/a", 1.0), ("/b", 2.0), ("/d", None)], "path string, mtime double")
    found = spark.createDataFrame([("/a", 1.005), ("/b", 2.02), ("/c", 1.0), ("/d", 1.0)], "path string, mtime double")
    assert rows(merge.unchanged(found, known, "path", "mtime").select("path")) == [("/a",)]
    assert rows(merge.to_process(found, known, "path", "mtime").select("path")) == [("/b",), ("/c",), ("/d",)]


def test_spread_keeps_rows(spark):
    df = spark.range(10).coalesce(1)
    assert spread(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and spread(df).count() == 10
