import hashlib
import os
import posixpath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldmark.functions import digests, logs, names, paths, scalars


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(("path", "place"), [
    ("/mnt/c/a/b", "/mnt/c/a/b"), ("C:\\a\\b", "/mnt/c/a/b"), ("c:/a//b/", "/mnt/c/a/b"), ("/mnt/C/x", "/mnt/c/x"), ("C:", "/mnt/c"), ("D:\\", "/mnt/d"), ("C:\\..\\a", "/mnt/c/a"), ("/home/u/../v/./w/", "/home/v/w"),
    ("//a//b", "/a/b"), ("/..", "/"), ("/a/.git/x", "/a/.git/x"), ("/mnt/c/a\\b", "/mnt/c/a\\b"), ("/mnt/./C/x", "/mnt/c/x"), ("/Home/A", "/Home/A"), ("", None), ("  ", None), (None, None),
])
def test_resolved_path(spark, path, place):
    assert one(spark, path, paths.resolved_path) == place


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), max_size=8), min_size=1, max_size=30))
def test_resolved_path_agrees_with_posix(spark, many):
    given_ = ["/" + "/".join(x) for x in many]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(given_)], "k int, p string").select("k", paths.resolved_path(F.col("p")))
    assert dict(map(tuple, df.collect())) == {k: "/" + posixpath.normpath(p).lstrip("/") for k, p in enumerate(given_)}


@pytest.mark.parametrize(("path", "drive", "depth", "parent", "letter"), [
    ("/mnt/c/foo", "c", 3, "/mnt/c", "foo"), ("/mnt/d", "d", 2, "/mnt", "d"), ("/home/user", "home", 2, "/home", "user"), ("/", "root", 0, "", "root"), ("/media/myusb", "media", 2, "/media", "myusb"), ("/x", "x", 1, "/", "x"),
])
def test_path_parts(spark, path, drive, depth, parent, letter):
    row = spark.createDataFrame([(path,)], "v string").select(paths.drive_of(F.col("v")), paths.depth_of(F.col("v")), paths.parent_of(F.col("v")), paths.mount_letter(F.col("v"))).first()
    assert tuple(row) == (drive, depth, parent, letter)


@pytest.mark.parametrize(("name", "suffix", "split"), [("a.tar.gz", ".gz", ".gz"), (".bashrc", "", ""), ("x.", "", "."), ("A.PY", ".py", ".PY"), ("..a", ".a", ""), ("plain", "", ""), ("a\nb.c", ".c", ".c")])
def test_suffixes(spark, name, suffix, split):
    assert one(spark, name, paths.suffix_of) == suffix
    assert one(spark, name, paths.splitext_suffix) == split == os.path.splitext(name)[1]


@pytest.mark.parametrize(("value", "digest"), [
    ("a" * 40, "a" * 40), (" " + "AB" * 20 + "\n", "ab" * 20), ("sha1:" + "0" * 40, "0" * 40), ("SHA-1:" + "F" * 40, "f" * 40), ("a" * 39, None), ("a" * 41, None), ("g" * 40, None), ("n/a", None), ("", None), (None, None), ("x" * 100_000, None),
])
def test_usable_digest(spark, value, digest):
    assert one(spark, value, lambda c: digests.usable_digest(c, 40)) == digest


@pytest.mark.parametrize("content", [b"", b"abc", b"\x00\xff" * 50, "ä".encode()])
def test_content_digests(spark, content):
    row = spark.createDataFrame([(bytearray(content),)], "v binary").select(digests.sha256_hex(F.col("v")), digests.git_blob_sha1(F.col("v"))).first()
    assert tuple(row) == (hashlib.sha256(content).hexdigest(), hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest())


@pytest.mark.parametrize(("n", "text"), [(1234567890, "1.1 GB"), (345000000, "329.0 MB"), (12345, "12.1 KB"), (512, "512 B"), (0, "0 B"), (1024, "1.0 KB"), (None, None)])
def test_format_bytes(spark, n, text):
    assert one(spark, n, scalars.format_bytes, "long") == text


def test_format_bytes_rejects_negative_sizes(spark):
    with pytest.raises(Exception, match="negative"):
        one(spark, -1, scalars.format_bytes, "long")


def test_rounding_is_half_even(spark):
    assert one(spark, 0.0625, scalars.percent_value, "double") == 6.2
    assert one(spark, 0.0625, scalars.percent_text, "double") == "6.2%"


def test_ratio_of_nothing_is_zero(spark):
    assert one(spark, 0, lambda c: scalars.ratio(c, c), "long") == 0.0
    assert spark.range(1).select(scalars.set_jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))).first()[0] == 0.0


def test_text_scalars(spark):
    assert one(spark, "a b/ä.c", scalars.safe_name) == "a_b_ä.c"
    assert one(spark, "baldini_3", lambda c: scalars.branch_name(c, F.lit("2026-05-19"))) == "staging/local-baldini_3-2026-05-19"
    assert one(spark, "o/n/x", scalars.owner_of) == "o" and one(spark, "o/n/x", scalars.name_part_of) == "n/x" and one(spark, "o", scalars.name_part_of) is None
    assert one(spark, " a, b,,a ,", scalars.topic_list) == ["a", "b"]
    assert one(spark, "<a href='x'>&", scalars.html_escape) == "&lt;a href=&#39;x&#39;&gt;&amp;"
    assert one(spark, "50%_\\", scalars.like_literal) == "50\\%\\_\\\\"
    assert one(spark, "it's", scalars.shell_quote) == "'it'\\''s'"
    assert one(spark, "", lambda c: scalars.or_default(c, "-")) == "-"
    assert one(spark, 1234567, scalars.thousands, "long") == "1,234,567"


@pytest.mark.parametrize(("text", "seconds"), [("2024-01-02T03:04:05+00:00", 1704164645), ("2024-01-02 03:04:05", 1704164645), ("2024-01-02T03:04:05Z", 1704164645), ("1704164645", 1704164645), ("2024-01-02T05:04:05+02:00", 1704164645), ("soon", None), ("", None), (None, None)])
def test_parse_time(spark, text, seconds):
    assert one(spark, text, lambda c: F.unix_seconds(scalars.parse_time(c))) == seconds


@pytest.mark.parametrize(("a", "b", "ratio"), [("tide", "diet", 0.25), ("diet", "tide", 0.5), ("My-App x", "my_app_x", 1.0), (None, "a", None)])
def test_name_ratio(spark, a, b, ratio):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(names.name_ratio(F.col("a"), F.col("b"))).first()[0] == ratio


@pytest.mark.parametrize(("name", "plain"), [("My-Project_backup", "my project"), ("latest", "la"), ("x_v2-copy", "x"), ("proj 7", "proj"), ("", "")])
def test_plain_name(spark, name, plain):
    assert one(spark, name, names.plain_name) == plain


def test_best_name_ratio(spark):
    df = spark.createDataFrame([("app_backup", "app"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(names.best_name_ratio(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_globs(spark):
    df = spark.createDataFrame([("a/.git/b",), ("a/git/b",), ("x.pyc",), ("src/x.py",)], "p string")
    assert [r[0] for r in df.select(names.excluded_path(F.col("p"), ["**/.git/**", "*.pyc"])).collect()] == [True, False, True, False]
    assert one(spark, "a", lambda c: names.matches_glob(c, [])) is False


def test_log_lines(spark):
    assert one(spark, "Traceback (most recent call last):", logs.is_error) is True
    assert one(spark, "ERROR database is locked", logs.is_error) is False
    row = spark.createDataFrame([("Hashing: 120file [00:01, 33.5file/s]",)], "v string").select(logs.progress_count(F.col("v")), logs.progress_rate(F.col("v"))).first()
    assert tuple(row) == (120, 33.5)
