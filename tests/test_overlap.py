"""Overlap queries over a small tree with directories of several depths."""

from difflib import SequenceMatcher
from itertools import combinations

import pytest

from foldmark.plans import overlap

#: id, path, depth, stored file count.
DIRS = [(1, "/r", 0, 9), (2, "/r/p", 1, 5), (3, "/r/q", 1, 4), (4, "/r/p/src", 2, 3), (5, "/r/q/src", 2, 3), (6, "/r/p/doc", 2, 2), (7, "/r/q/few", 2, 1), (8, "/r/p/src/in", 3, 2), (9, "/r/q/src/in", 3, 2)]
FILES = {"/r/p/src/a": "A", "/r/p/src/in/b": "B", "/r/p/src/in/c": "C", "/r/p/doc/d": "D", "/r/p/doc/e": "E", "/r/q/src/a": "A", "/r/q/src/in/b": "B", "/r/q/src/in/x": "X", "/r/q/few/d": "D"}
#: id, name, contents.
REPOS = [(1, "src", "YZ"), (2, "SRC-", "AYZVW"), (3, "in", "BCX"), (4, "far", "ABC"), (5, "p", "STUV"), (6, "none", "")]


def sha(name, digits):
    return f"{ord(name):0{digits}x}"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tree"))
    files = [(k, p, sha(d, 64), sha(d, 40), 1, 1.0, 1.0) for k, (p, d) in enumerate(FILES.items())]
    spark.createDataFrame(files, "id long, abs_path string, sha256 string, git_sha1 string, size_bytes long, mtime double, scanned_at double").write.parquet(f"{at}/files.parquet")
    dirs = [(i, p, p.rsplit("/", 1)[1], depth, n) for i, p, depth, n in DIRS]
    spark.createDataFrame(dirs, "id long, abs_path string, name string, depth long, file_count long").write.parquet(f"{at}/directories.parquet")
    repos = [(i, n, 1.0) for i, n, _ in REPOS]
    spark.createDataFrame(repos, "id long, name string, fetched_at double").write.parquet(f"{at}/github_repos.parquet")
    held = [(i, p, sha(p, 40)) for i, _, names in REPOS for p in names]
    spark.createDataFrame(held, "repo_id long, path string, git_sha1 string").write.parquet(f"{at}/github_files.parquet")
    return at


def below(path):
    return {d for p, d in FILES.items() if p.startswith(path + "/")}


def pairs(threshold):
    worth = [(i, p, depth) for i, p, depth, n in DIRS if depth <= 2 and n >= 2]
    same = [(a, b) for a, b in combinations(worth, 2) if a[2] == b[2]]
    score = {(a[0], b[0]): len(below(a[1]) & below(b[1])) / len(below(a[1]) | below(b[1])) for a, b in same}
    return {k: round(v, 9) for k, v in score.items() if v >= threshold}


@pytest.mark.parametrize("query, threshold", [(overlap.near_dirs, 0.5), (overlap.near_dirs_low, 0.1)])
def test_directories_of_every_compared_depth_meet_their_like(spark, root, query, threshold):
    got = {(r["a"], r["b"]): round(r["similarity"], 6) for r in query(spark, root).collect()}
    assert got == {k: round(v, 6) for k, v in pairs(threshold).items()}
    assert (4, 5) in got


def test_classes_count_their_links(spark, root):
    ends = [x for pair in pairs(0.5) for x in pair]
    got = {r["dir_id"]: (r["class_id"], r["n_links"]) for r in overlap.near_dir_classes(spark, root).collect()}
    assert got == {i: (i, ends.count(i)) for i, p, depth, n in DIRS if depth <= 2 and n >= 2}


def matched(alike):
    """Pairs of a directory and a repository, by content or by name only."""
    flat = lambda s: s.lower().replace("-", "_").replace(" ", "_")
    out = {}
    for i, p, _, n in DIRS:
        for j, name, held in REPOS:
            one, two = below(p), set(held)
            if n < 3 or len(one) < 3 or not two:
                continue
            content = len(one & two) / len(one | two)
            named = SequenceMatcher(None, flat(p.rsplit("/", 1)[1]), flat(name)).ratio() >= 0.8
            if named and content < 0.15 if alike else content >= 0.15:
                out[i, j] = (round(content, 6), len(one - two), len(two - one))
    return out


def test_directories_of_any_depth_match_repositories(spark, root):
    got = {(r["a"], r["b"]): (round(r["content"], 6), r["local_ahead"], r["remote_ahead"]) for r in overlap.content_matches(spark, root).collect()}
    assert got == matched(False) and (4, 4) in got


def test_alike_names_without_content_are_name_only(spark, root):
    rows = overlap.name_only_matches(spark, root).collect()
    got = {(r["a"], r["b"]): (round(r["content"], 6), r["local_ahead"], r["remote_ahead"]) for r in rows}
    assert got == matched(True) and {(4, 1), (4, 2)} <= set(got) and {r["graded"] for r in rows} == {"name_only"}
