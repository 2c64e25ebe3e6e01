"""Queries of roll-ups, duplicate trees and similarity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.functions.digests import GIT_SHA1_DIGITS, SHA256_DIGITS, usable_digest
from foldmark.functions.paths import resolved_path
from foldmark.functions.scalars import ratio
from foldmark.operators import matching, patterns, rollup, similarity
from foldmark.operators.containment import explode_ancestors, members_below
from foldmark.operators.merge import keep_one, upsert
from foldmark.operators.sets import meet
from foldmark.operators.skew import split_join
from foldmark.plans.relational import one_row
from foldmark.plans.tables import table
from foldmark.plans.training import digest_sql, resolved_sql
from foldmark.session import Scratch

#: Least content similarity, depth and files of compared directories; the reference values of the operator.
LEAST_SIMILARITY, MAX_DEPTH, MIN_FILES = 0.10, 2, 2
MATCH_MIN_FILES = 3


def _below(spark: SparkSession, root: str, columns: tuple[str, ...], where: str = "true") -> DataFrame:
    """dir_id, rel_path and columns of the latest row of each file below each directory, digests in their compared form."""
    digests = {"sha256": usable_digest(F.col("sha256"), SHA256_DIGITS), "git_sha1": usable_digest(F.col("git_sha1"), GIT_SHA1_DIGITS)}
    files = table(spark, root, "files").select("id", resolved_path(F.col("abs_path")).alias("place"), *[digests.get(c, F.col(c)).alias(c) for c in columns], "scanned_at")
    live = keep_one(files.where("place is not null"), ["place"], [-F.col("scanned_at"), -F.col("id")])
    return members_below(table(spark, root, "directories").where(where), live, "id", "abs_path", "place", list(columns))


def file_ancestors(spark: SparkSession, root: str) -> DataFrame:
    """JN13, JN9: how many file rows lie below every ancestor of their resolved path, directories or not."""
    files = table(spark, root, "files").select(resolved_path(F.col("abs_path")).alias("place")).where("place like '/%'")
    return explode_ancestors(files, "place").groupBy("ancestor").agg(F.count("*").alias("n_rows"))


def dir_totals(spark: SparkSession, root: str) -> DataFrame:
    """AGG7, JN10: files, bytes and newest mtime below every directory."""
    return rollup.directory_totals(_below(spark, root, ("size_bytes", "mtime")))


def dir_hashes(spark: SparkSession, root: str) -> DataFrame:
    """AGG8: the tree hash of every directory."""
    below = Scratch(spark, "below").write(_below(spark, root, ("sha256",)), "below")
    return rollup.directory_hashes(below.withColumnRenamed("sha256", "digest"))


def dirs_upserted(spark: SparkSession, root: str) -> DataFrame:
    """SNK2: the directories after a roll-up of the files: count, bytes and tree hash of those with files are set, parent, depth and name stay."""
    below = Scratch(spark, "below").write(_below(spark, root, ("sha256", "size_bytes", "mtime")), "below")
    sums = rollup.directory_totals(below).select(F.col("dir_id").alias("id"), "file_count", F.col("total_size").alias("total_size_bytes"))
    hashes = rollup.directory_hashes(below.withColumnRenamed("sha256", "digest")).select(F.col("dir_id").alias("id"), "tree_hash")
    d = table(spark, root, "directories").select("id", "parent_path", "depth", "name", "file_count", "total_size_bytes", "tree_hash")
    return upsert(d, split_join(sums, hashes, ["id"], "left"), ["id"])


def stale_counts(spark: SparkSession, root: str) -> DataFrame:
    """SNK2: directories whose stored counts differ from their files."""
    d = table(spark, root, "directories").select(F.col("id").alias("dir_id"), F.col("file_count").alias("stored"))
    return split_join(rollup.directory_totals(_below(spark, root, ("size_bytes", "mtime"))), d, ["dir_id"]).where("stored is null or stored <> file_count").select("dir_id", "stored", "file_count")


def equal_dirs(spark: SparkSession, root: str) -> DataFrame:
    """JN14, AGG10 by groups: directories of equal tree hash with the first of their group."""
    return rollup.equal_groups(table(spark, root, "directories").where("file_count >= 2"), "id", "tree_hash")


def equal_dir_pairs(spark: SparkSession, root: str) -> DataFrame:
    """JN14: all pairs of equal tree hash."""
    return rollup.equal_pairs(table(spark, root, "directories").where("file_count >= 2"), "id", "tree_hash")


def pairs_possible(spark: SparkSession, root: str) -> DataFrame:
    """JN15, AGG14: how many pairs of one depth a comparison would have, less the equal ones."""
    d = table(spark, root, "directories").where(F.col("file_count") >= MIN_FILES).where(F.col("depth") <= MAX_DEPTH)
    groups = d.where("tree_hash is not null and tree_hash <> ''").groupBy("depth", "tree_hash").agg(F.count("*").alias("n"))
    exact = groups.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("n_exact"))
    all_pairs = d.groupBy("depth").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("n_all"))
    return one_row(all_pairs, exact).select("n_all", "n_exact", F.greatest(F.col("n_all") - F.col("n_exact"), F.lit(0)).alias("n_possible"))


def _compared(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the directories that FLT1 takes, each depth by itself: which hold the same tree (s, class, n), and the trees and contents of the first of every class."""
    worth = f"depth <= {MAX_DEPTH} and file_count >= {MIN_FILES}"
    depths = table(spark, root, "directories").where(worth).select(F.col("id").alias("dir_id"), "depth")
    below = split_join(_below(spark, root, ("sha256",), worth).where("sha256 is not null"), depths, ["dir_id"])
    below = Scratch(spark, "below").write(below.select("dir_id", "depth", "sha256", F.concat_ws("|", "rel_path", "sha256").alias("cell")), "below")
    trees = similarity.distinct_members(below, "dir_id", "cell", "depth")
    classes = similarity.equal_sets(trees)
    first = classes.where("s = class").select("s")
    sets = similarity.distinct_members(split_join(below, first.withColumnRenamed("s", "dir_id"), ["dir_id"], "left_semi"), "dir_id", "sha256", "depth")
    return classes, split_join(trees, first, ["s"], "left_semi"), sets


def near_dirs(spark: SparkSession, root: str, threshold: float = 0.5) -> DataFrame:
    """FLT1, JN15, JN16, AGG9, AGG11, AGG12, FN12: directories of MAX_DEPTH and MIN_FILES, each depth with itself, that share at least half of their contents.

    Directories of equal trees are one class, whose first stands for all in the pairs; near_dir_classes has the others.
    """
    _, _, sets = _compared(spark, root)
    return similarity.with_jaccard(similarity.similar_pairs(sets, threshold))


def near_dir_classes(spark: SparkSession, root: str, threshold: float = 0.5) -> DataFrame:
    """Every compared directory with the class of its tree and the number of classes near to it."""
    classes, _, sets = _compared(spark, root)
    ends = similarity.similar_pairs(sets, threshold).select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return split_join(classes, ends, ["class"], "left").select(F.col("s").alias("dir_id"), F.col("class").alias("class_id"), F.col("n").alias("n_files"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_dirs_low(spark: SparkSession, root: str) -> DataFrame:
    """JN16 at the low reference threshold, with both similarities, between the first of every class; the result is quadratic where all folders share common files."""
    _, trees, sets = _compared(spark, root)
    found = similarity.overlaps(similarity.with_jaccard(similarity.similar_pairs(sets, LEAST_SIMILARITY)), trees, trees)
    return found.select("a", "b", "similarity", "common", "only1", "only2", F.bround(ratio(F.col("k"), F.col("n1") + F.col("n2") - F.col("k")), 6).alias("structural"))


def _match_sides(spark: SparkSession, root: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Content and structure members of directories with MATCH_MIN_FILES files, at any depth, and as many contents, and of repositories; and the files of the directories. All are read from tables of scratch."""
    local = scratch.write(_below(spark, root, ("git_sha1",), f"file_count >= {MATCH_MIN_FILES}"), "local")
    held = table(spark, root, "github_files").select("repo_id", "path", usable_digest(F.col("git_sha1"), GIT_SHA1_DIGITS).alias("git_sha1"))
    remote = scratch.write(held.where("git_sha1 is not null and repo_id is not null"), "remote")
    cells = lambda df, s, path: similarity.distinct_members(df.where("git_sha1 is not null").select(F.col(s).alias("s"), F.concat_ws("|", path, "git_sha1").alias("cell")), "s", "cell", within=scratch)
    sets = similarity.distinct_members(local, "dir_id", "git_sha1", within=scratch).where(F.col("n") >= MATCH_MIN_FILES)
    counts = local.groupBy("dir_id").agg(F.count("*").alias("file_count"))
    return sets, similarity.distinct_members(remote, "repo_id", "git_sha1", within=scratch), cells(local, "dir_id", "rel_path"), cells(remote, "repo_id", "path"), counts


def _parts(k: Column, n1: Column, n2: Column) -> list[Column]:
    # unrounded values classify, rounded ones are stored
    return [k.alias("common"), (n1 - k).alias("local_ahead"), (n2 - k).alias("remote_ahead"), n2.alias("remote_files"), ratio(k, n1 + n2 - k).alias("content")]


def _arguments() -> tuple[Column, ...]:
    """What the classifications take."""
    return tuple(F.col(c) for c in ("content", "structure", "file_count", "remote_files", "local_ahead", "remote_ahead"))


def _classified(found: DataFrame, local_cells: DataFrame, remote_cells: DataFrame, counts: DataFrame) -> tuple[DataFrame, tuple]:
    """The pairs (a, b, k, n1, n2) with common, ahead counts and both similarities, and the arguments of the classifications."""
    k, n1, n2 = F.col("k"), F.col("n1"), F.col("n2")
    rows = found.select("*", *_parts(k, n1, n2)).drop("k", "n1", "n2")
    rows = similarity.overlaps(rows, local_cells, remote_cells).withColumn("structure", ratio(k, n1 + n2 - k))
    return split_join(rows, counts.withColumnRenamed("dir_id", "a"), ["a"]), _arguments()


def _pair() -> list:
    return ["a", "b", "common", "local_ahead", "remote_ahead", F.bround("content", 6).alias("content"), F.bround("structure", 6).alias("structure")]


def content_matches(spark: SparkSession, root: str) -> DataFrame:
    """JN17, FLT2, FLT6, AGG13, CLS1, CLS2, FN12: directories against repositories, with both classifications."""
    sides = Scratch(spark, "sides")
    local, remote, local_cells, remote_cells, counts = _match_sides(spark, root, sides)
    files = Scratch(spark, "counts").write(counts.select(F.col("dir_id").alias("a"), "file_count"), "counts")
    found = patterns.matched_pairs(local, remote, local_cells, remote_cells, matching.LEAST_CONTENT, files)
    sides.clear()
    ck, c1, c2 = F.col("ck"), F.col("c1"), F.col("c2")
    rows, args = found.select("a", "b", "file_count", *_parts(F.col("k"), F.col("n1"), F.col("n2")), ratio(ck, c1 + c2 - ck).alias("structure")), _arguments()
    return rows.select(*_pair(), matching.content_class(*args).alias("class"), matching.graded_class(*args).alias("graded"))


def name_only_matches(spark: SparkSession, root: str) -> DataFrame:
    """JN18: directories and repositories whose names are alike and whose contents are not, with the ratio of the names and the class."""
    local, remote, local_cells, remote_cells, counts = _match_sides(spark, root, Scratch(spark, "sides"))
    d = split_join(table(spark, root, "directories").select(F.col("id").alias("a"), F.col("name").alias("local_name")), local.select(F.col("s").alias("a")).distinct(), ["a"], "left_semi")
    r = split_join(table(spark, root, "github_repos").select(F.col("id").alias("b"), F.col("name").alias("remote_name")), remote.select(F.col("s").alias("b")).distinct(), ["b"], "left_semi")
    alike = Scratch(spark, "names").write(matching.similar_names(d.select("local_name"), r.select("remote_name")), "alike")
    # a pair without common members has k = 0, so the bound is the anti-join with the content matches
    named = Scratch(spark, "names").write(meet(alike, d, ["local_name"], F.lit(True)), "local")
    found = similarity.overlaps(meet(named, r, ["remote_name"], F.lit(True)).select("a", "b", "ratio"), local, remote)
    found = found.where(F.col("k") < F.lit(matching.LEAST_CONTENT) * (F.col("n1") + F.col("n2") - F.col("k")) - 1e-9)
    rows, args = _classified(found, local_cells, remote_cells, counts)
    return rows.select(*_pair(), "ratio", matching.graded_class(*args).alias("graded"))


def name_matches(spark: SparkSession, root: str) -> DataFrame:
    """JN18: names of directories with MATCH_MIN_FILES and of repositories that are alike."""
    d = table(spark, root, "directories").where(f"file_count >= {MATCH_MIN_FILES}").select("name")
    return matching.similar_names(d, table(spark, root, "github_repos").select("name"))


QUERIES = {f.__name__: f for f in (file_ancestors, dir_totals, dir_hashes, dirs_upserted, stale_counts, equal_dirs, equal_dir_pairs, pairs_possible, near_dirs, near_dir_classes, near_dirs_low, content_matches, name_only_matches, name_matches)}

_BELOW = f"""
live AS (
  SELECT place, {digest_sql("sha256", 64)} AS sha256, {digest_sql("git_sha1", 40)} AS git_sha1, size_bytes, mtime
  FROM (SELECT *, {resolved_sql("abs_path")} AS place FROM files) WHERE place IS NOT NULL QUALIFY row_number() OVER (PARTITION BY place ORDER BY scanned_at DESC, id DESC) = 1
),
above AS (SELECT l.*, array_to_string(string_split(place, '/')[1:u.k], '/') AS up FROM live l, unnest(range(1, len(string_split(place, '/')))) AS u(k)),
below AS (SELECT d.id AS dir_id, d.depth, d.file_count AS stored, substr(a.place, length(a.up) + 2) AS rel_path, a.sha256, a.git_sha1, a.size_bytes, a.mtime FROM above a JOIN directories d ON d.abs_path = a.up)"""

_HASHES = "SELECT dir_id, sha256(string_agg(rel_path || '|' || sha256 || chr(10), '' ORDER BY encode(rel_path || '|' || sha256 || chr(10)))) AS tree_hash FROM below WHERE sha256 IS NOT NULL GROUP BY dir_id"

_NEAR = """
w AS (SELECT DISTINCT dir_id AS s, depth, rel_path, sha256 FROM below WHERE depth <= 2 AND stored >= 2 AND sha256 IS NOT NULL),
trees AS (SELECT s, depth, string_agg(rel_path || '|' || sha256, chr(10) ORDER BY encode(rel_path || '|' || sha256)) AS tree, count(*) AS n_files FROM w GROUP BY s, depth),
classes AS (SELECT s, min(s) OVER (PARTITION BY depth, tree) AS class, n_files FROM trees),
firsts AS (SELECT w.* FROM w JOIN classes c ON c.s = w.s AND c.class = w.s),
m AS (SELECT DISTINCT s, depth, sha256 AS x FROM firsts),
z AS (SELECT s, count(*) AS n FROM m GROUP BY s),
k AS (SELECT p.s AS a, q.s AS b, count(*) AS k FROM m p JOIN m q ON p.x = q.x AND p.depth = q.depth AND p.s < q.s GROUP BY ALL),
near AS (SELECT a, b, k / (p.n + q.n - k) AS exact_similarity, round_even(k / (p.n + q.n - k), 6) AS similarity, k AS common, p.n - k AS only1, q.n - k AS only2 FROM k JOIN z p ON p.s = a JOIN z q ON q.s = b)"""

SQL = {
    "file_ancestors": f"SELECT array_to_string(p[1:u.k], '/') AS ancestor, count(*) AS n_rows FROM (SELECT string_split({resolved_sql('abs_path')}, '/') AS p FROM files WHERE starts_with({resolved_sql('abs_path')}, '/')), unnest(range(2, len(p))) AS u(k) GROUP BY 1",
    "dir_totals": f"WITH {_BELOW} SELECT dir_id, count(*) AS file_count, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_size, max(mtime) AS newest FROM below GROUP BY dir_id",
    "dir_hashes": f"WITH {_BELOW} {_HASHES}",
    "dirs_upserted": f"""
WITH {_BELOW}, h AS ({_HASHES}), t AS (SELECT dir_id, count(*) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM below GROUP BY dir_id)
SELECT d.id, d.parent_path, d.depth, d.name, CASE WHEN t.n IS NULL THEN d.file_count ELSE t.n END AS file_count, CASE WHEN t.n IS NULL THEN d.total_size_bytes ELSE t.bytes END AS total_size_bytes, CASE WHEN t.n IS NULL THEN d.tree_hash ELSE h.tree_hash END AS tree_hash
FROM directories d LEFT JOIN t ON t.dir_id = d.id LEFT JOIN h ON h.dir_id = d.id""",
    "stale_counts": f"WITH {_BELOW} SELECT dir_id, d.file_count AS stored, n AS file_count FROM (SELECT dir_id, count(*) AS n FROM below GROUP BY 1) JOIN directories d ON d.id = dir_id WHERE d.file_count IS NULL OR d.file_count <> n",
    "equal_dirs": "SELECT id AS dir_id, min(id) OVER w AS first_id, count(*) OVER w AS group_size FROM directories WHERE file_count >= 2 AND tree_hash <> '' WINDOW w AS (PARTITION BY tree_hash) QUALIFY count(*) OVER w >= 2",
    "equal_dir_pairs": "SELECT a.id AS dir1_id, b.id AS dir2_id FROM directories a JOIN directories b ON a.tree_hash = b.tree_hash AND a.id < b.id WHERE a.file_count >= 2 AND b.file_count >= 2 AND a.tree_hash <> ''",
    "pairs_possible": """
WITH d AS (SELECT * FROM directories WHERE file_count >= 2 AND depth <= 2),
x AS (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS n_exact FROM (SELECT count(*) AS n FROM d WHERE tree_hash <> '' GROUP BY depth, tree_hash)),
y AS (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS n_all FROM (SELECT count(*) AS n FROM d GROUP BY depth))
SELECT n_all, n_exact, greatest(n_all - n_exact, 0) AS n_possible FROM x, y""",
    "near_dirs": f"WITH {_BELOW}, {_NEAR} SELECT * EXCLUDE (exact_similarity) FROM near WHERE exact_similarity >= 0.5",
    "near_dir_classes": f"""
WITH {_BELOW}, {_NEAR},
links AS (SELECT s, count(*) AS n FROM (SELECT a AS s FROM near WHERE exact_similarity >= 0.5 UNION ALL SELECT b FROM near WHERE exact_similarity >= 0.5) GROUP BY s)
SELECT c.s AS dir_id, c.class AS class_id, n_files, coalesce(l.n, 0) AS n_links FROM classes c LEFT JOIN links l ON l.s = c.class""",
    "near_dirs_low": f"""
WITH {_BELOW}, {_NEAR},
cz AS (SELECT s, count(*) AS n FROM firsts GROUP BY s),
ck AS (SELECT p.s AS a, q.s AS b, count(*) AS k FROM firsts p JOIN firsts q ON p.rel_path = q.rel_path AND p.sha256 = q.sha256 AND p.depth = q.depth AND p.s < q.s GROUP BY ALL)
SELECT n.* EXCLUDE (exact_similarity), round_even(coalesce(ck.k, 0) / (p.n + q.n - coalesce(ck.k, 0)), 6) AS structural
FROM near n LEFT JOIN ck ON ck.a = n.a AND ck.b = n.b JOIN cz p ON p.s = n.a JOIN cz q ON q.s = n.b WHERE exact_similarity >= 0.1""",
    "content_matches": f"""
WITH {_BELOW},
w AS (SELECT * FROM below WHERE stored >= 3), g AS (SELECT repo_id, path, {digest_sql("git_sha1", 40)} AS git_sha1 FROM github_files WHERE repo_id IS NOT NULL),
l AS (SELECT DISTINCT dir_id AS s, git_sha1 AS x FROM w WHERE git_sha1 IS NOT NULL), lz AS (SELECT s, count(*) AS n FROM l GROUP BY s HAVING count(*) >= 3),
r AS (SELECT DISTINCT repo_id AS s, git_sha1 AS x FROM g WHERE git_sha1 IS NOT NULL), rz AS (SELECT s, count(*) AS n FROM r GROUP BY s),
k AS (SELECT l.s AS a, r.s AS b, count(*) AS k FROM l JOIN r ON l.x = r.x GROUP BY ALL),
lc AS (SELECT DISTINCT dir_id AS s, rel_path || '|' || git_sha1 AS x FROM w WHERE git_sha1 IS NOT NULL), rc AS (SELECT DISTINCT repo_id AS s, path || '|' || git_sha1 AS x FROM g WHERE git_sha1 IS NOT NULL),
lcz AS (SELECT s, count(*) AS n FROM lc GROUP BY s), rcz AS (SELECT s, count(*) AS n FROM rc GROUP BY s),
tk AS (SELECT lc.s AS a, rc.s AS b, count(*) AS k FROM lc JOIN rc ON lc.x = rc.x GROUP BY ALL),
fc AS (SELECT dir_id, count(*) AS n FROM w GROUP BY 1),
j AS (SELECT k.a, k.b, k.k AS common, lz.n - k.k AS local_ahead, rz.n - k.k AS remote_ahead, k.k / (lz.n + rz.n - k.k) AS c, coalesce(tk.k, 0) / (lcz.n + rcz.n - coalesce(tk.k, 0)) AS t, fc.n = rz.n AS same_count
  FROM k JOIN lz ON lz.s = k.a JOIN rz ON rz.s = k.b JOIN lcz ON lcz.s = k.a JOIN rcz ON rcz.s = k.b JOIN fc ON fc.dir_id = k.a LEFT JOIN tk ON tk.a = k.a AND tk.b = k.b)
SELECT a, b, common, local_ahead, remote_ahead, round_even(c, 6) AS content, round_even(t, 6) AS structure,
  CASE WHEN t = 1 AND same_count THEN 'exact' WHEN local_ahead > 0 AND remote_ahead = 0 THEN 'local_is_ahead' WHEN remote_ahead > 0 AND local_ahead = 0 THEN 'github_is_ahead' WHEN local_ahead > 0 AND remote_ahead > 0 THEN 'diverged' ELSE 'partial_match' END AS class,
  CASE WHEN t = 1 AND same_count THEN 'exact' WHEN c >= 0.8 AND local_ahead > 0 AND remote_ahead = 0 THEN 'local_is_ahead' WHEN c >= 0.8 AND remote_ahead > 0 AND local_ahead = 0 THEN 'github_is_ahead'
    WHEN c >= 0.8 OR c >= 0.5 AND local_ahead > 0 AND remote_ahead > 0 THEN 'diverged' ELSE 'partial_match' END AS graded
FROM j WHERE c >= 0.15""",
}
