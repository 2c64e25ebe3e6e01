"""Queries of joins, aggregations, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.functions import scalars
from foldmark.functions.digests import GIT_SHA1_DIGITS, SHA256_DIGITS, usable_digest
from foldmark.functions.paths import resolved_path
from foldmark.operators import merge
from foldmark.operators.skew import split_join
from foldmark.plans.scalars import CODE_SUFFIXES
from foldmark.plans.tables import table
from foldmark.plans.training import digest_sql, resolved_sql

#: Labels of match classes in reports: fixed values.
CLASS_LABELS = {"exact": "Exact", "local_is_ahead": "Local Ahead", "github_is_ahead": "GitHub Ahead", "diverged": "Diverged", "partial_match": "Partial", "name_only": "Name Only"}


def one_row(*parts: DataFrame) -> DataFrame:
    """One row of all columns of parts that have one row each."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _dirs(spark: SparkSession, root: str, tag: str, *columns: str) -> DataFrame:
    return table(spark, root, "directories").select(F.col("id").alias(f"{tag}_id"), *[F.col(c).alias(f"{tag}_{c}") for c in columns])


def pair_details(spark: SparkSession, root: str) -> DataFrame:
    """JN1: pairs with both of their directories. A directory may be in very many pairs, so hot sides are split."""
    pairs = table(spark, root, "dir_pairs").select("id", "dir1_id", "dir2_id", "content_similarity", "is_exact_duplicate")
    return split_join(split_join(pairs, _dirs(spark, root, "dir1", "abs_path", "total_size_bytes"), ["dir1_id"]), _dirs(spark, root, "dir2", "abs_path"), ["dir2_id"])


def match_details(spark: SparkSession, root: str) -> DataFrame:
    """JN2, PRJ5: matches with their directory and repository and a class label."""
    m = table(spark, root, "local_github_matches").select("id", F.col("local_dir_id").alias("dir_id"), F.col("github_repo_id").alias("repo_id"), "match_type")
    r = table(spark, root, "github_repos").select(F.col("id").alias("repo_id"), "full_name")
    rows = split_join(split_join(m, _dirs(spark, root, "dir", "abs_path"), ["dir_id"]), r, ["repo_id"])
    return rows.select("id", "dir_abs_path", "full_name", scalars.label_of(F.col("match_type"), CLASS_LABELS, "Other").alias("label"))


def pairs_with_exact_match(spark: SparkSession, root: str) -> DataFrame:
    """JN3: left join with a constant in the condition."""
    pairs = table(spark, root, "dir_pairs").where("is_exact_duplicate = 1").select("id", "dir1_id")
    exact = table(spark, root, "local_github_matches").where("match_type = 'exact'").groupBy(F.col("local_dir_id").alias("dir1_id")).agg(F.min("github_repo_id").alias("repo_id"))
    return split_join(pairs, exact, ["dir1_id"], "left")


def unmatched_dirs(spark: SparkSession, root: str) -> DataFrame:
    """JN4, JN5, PRJ4: directories without any match of enough content, with how often they are a side of an exact pair."""
    matched = table(spark, root, "local_github_matches").where("content_similarity >= 0.15").select(F.col("local_dir_id").alias("id")).dropna().distinct()
    sides = table(spark, root, "dir_pairs").where("is_exact_duplicate = 1").select(F.explode(F.array("dir1_id", "dir2_id")).alias("id")).groupBy("id").agg(F.count("*").alias("n_exact"))
    rows = split_join(table(spark, root, "directories").select("id", "abs_path"), matched, ["id"], "left_anti")
    return split_join(rows, sides, ["id"], "left").select("id", "abs_path", F.coalesce("n_exact", F.lit(0)).alias("n_exact"))


def never_matched_dirs(spark: SparkSession, root: str) -> DataFrame:
    """AGG18's definition of an orphan: no match of any kind."""
    matched = table(spark, root, "local_github_matches").select(F.col("local_dir_id").alias("id")).dropna().distinct()
    return split_join(table(spark, root, "directories").select("id"), matched, ["id"], "left_anti")


def scans_of_roots(spark: SparkSession, root: str) -> DataFrame:
    """JN6: scans with the directory on their root path, if there is one."""
    d = table(spark, root, "directories").select(F.col("abs_path").alias("root_path"), F.col("id").alias("dir_id"))
    return split_join(table(spark, root, "scan_meta").select("scan_id", "root_path"), d, ["root_path"], "left")


def dirs_with_code(spark: SparkSession, root: str) -> DataFrame:
    """JN7, JN8, JN11, FLT9: directories with a code file anywhere below, all in one join."""
    from foldmark.operators.containment import members_below

    code = table(spark, root, "files").where(F.lower("extension").isin(*CODE_SUFFIXES)).select(resolved_path(F.col("abs_path")).alias("place"))
    return members_below(table(spark, root, "directories"), code, "id", "abs_path", "place", []).select("dir_id").distinct()


def tree_rows_of_repos(spark: SparkSession, root: str) -> DataFrame:
    """JN19, JN20: tree rows of known repositories; others drop out."""
    r = table(spark, root, "github_repos").select(F.col("id").alias("repo_id"), "full_name")
    return split_join(table(spark, root, "github_files").select("id", "repo_id"), r, ["repo_id"])


def unfetched_repos(spark: SparkSession, root: str) -> DataFrame:
    """JN21: repositories without a tree that holds a text file."""
    have = table(spark, root, "github_files").where(F.lower("path").endswith(".md")).select(F.col("repo_id").alias("id")).dropna().distinct()
    return split_join(table(spark, root, "github_repos").select("id", "full_name"), have, ["id"], "left_anti")


def status_counts(spark: SparkSession, root: str) -> DataFrame:
    """AGG2: counts of all tables and their interesting parts, one pass per table."""
    def counts(name: str, **conditions: str) -> DataFrame:
        row = table(spark, root, name).agg(*[F.count_if(F.expr(c)).alias(k) for k, c in conditions.items()])
        return row.select(F.expr(f"stack({len(conditions)}, {', '.join(f'{chr(39)}{k}{chr(39)}, {k}' for k in conditions)}) as (metric, n)"))

    parts = [
        counts("files", files="true", files_without_digest="sha256 is null or sha256 = ''"), counts("directories", directories="true"),
        counts("dir_pairs", exact_pairs="is_exact_duplicate = 1", near_pairs="is_exact_duplicate = 0 and content_similarity >= 0.5"),
        counts("github_repos", repos_fetched="fetched_at is not null"), counts("github_files", tree_rows="true"), counts("local_github_matches", matches="true"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(spark: SparkSession, root: str) -> DataFrame:
    """AGG1, AGG3, AGG6, AGG18, Q9: totals, and recoverable bytes by pair and by distinct directory."""
    d, m = table(spark, root, "directories"), table(spark, root, "local_github_matches")
    files = table(spark, root, "files").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))
    dirs = d.agg(F.count("*").alias("n_dirs"))
    matched = m.agg(F.countDistinct("local_dir_id").alias("n_matched"))
    pairs = table(spark, root, "dir_pairs").where("is_exact_duplicate = 1").select(F.col("dir2_id").alias("dir_id"))
    sized = split_join(pairs, _dirs(spark, root, "dir", "total_size_bytes"), ["dir_id"])
    per_dir = sized.groupBy("dir_id").agg(F.count("*").alias("n"), F.max("dir_total_size_bytes").alias("s"))
    recover = per_dir.agg(F.coalesce(F.sum(F.col("n") * F.col("s")), F.lit(0)).alias("pair_bytes"), F.coalesce(F.sum("s"), F.lit(0)).alias("dir_bytes"))
    return one_row(files, dirs, matched, recover).withColumn("n_unmatched", F.greatest(F.col("n_dirs") - F.col("n_matched"), F.lit(0)))


def match_classes(spark: SparkSession, root: str) -> DataFrame:
    """AGG5, DSH3: matches per class, and a row for directories without one if there are any."""
    classes = table(spark, root, "local_github_matches").where("match_type is not null").groupBy("match_type").agg(F.count("*").alias("n"))
    alone = never_matched_dirs(spark, root).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("orphan").alias("match_type"), "n")
    return classes.unionByName(alone)


def classes_by_flag(spark: SparkSession, root: str) -> DataFrame:
    """AGG4, AGG15: two-level groups with the total of the upper level."""
    m = table(spark, root, "local_github_matches").select(F.coalesce("match_type", F.lit("none")).alias("match_type"), (F.col("content_similarity") >= 0.5).alias("strong"))
    low = m.groupBy("match_type", "strong").agg(F.count("*").alias("n"))
    return low.join(F.broadcast(low.groupBy("match_type").agg(F.sum("n").alias("n_class"))), "match_type").orderBy("match_type", F.desc("n"))


def bytes_by_suffix(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "files")
    return f.groupBy(F.lower("extension").alias("suffix")).agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"), F.count_if(F.col("size_bytes") == 0).alias("n_empty"))


def digests_in_many_drives(spark: SparkSession, root: str) -> DataFrame:
    """AGG3, AGG10: contents of two or more rows, digests in their compared form."""
    f = table(spark, root, "files").select(usable_digest(F.col("sha256"), SHA256_DIGITS).alias("sha256"), "drive").where("sha256 is not null")
    return f.groupBy("sha256").agg(F.count("*").alias("n"), F.countDistinct("drive").alias("n_drives")).where("n >= 2")


def largest_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """SRT3, SRT5, DSH4: the ten largest directories that an exact pair could free."""
    d = _dirs(spark, root, "dir", "abs_path", "total_size_bytes")
    sides = table(spark, root, "dir_pairs").where("is_exact_duplicate = 1").select(F.col("dir2_id").alias("dir_id")).distinct()
    return split_join(sides, d, ["dir_id"]).orderBy(F.desc("dir_total_size_bytes"), "dir_abs_path").limit(10)


def top_pairs(spark: SparkSession, root: str) -> DataFrame:
    """SRT2, SRT6: the twenty most similar pairs that are not equal."""
    p = table(spark, root, "dir_pairs").where("is_exact_duplicate = 0 and content_similarity is not null")
    return p.orderBy(F.desc("content_similarity"), "id").limit(20).select("id", "content_similarity")


def table_page(spark: SparkSession, root: str) -> DataFrame:
    """DSH1: the third page of 25 rows of the repositories by name."""
    return table(spark, root, "github_repos").orderBy("full_name").offset(50).limit(25).select("id", "full_name")


def drives_in_order(spark: SparkSession, root: str) -> DataFrame:
    """SRT4, SRT7: drives, single letters first."""
    from foldmark.functions.paths import drive_of

    d = table(spark, root, "directories").select(drive_of(F.col("abs_path")).alias("drive")).groupBy("drive").agg(F.count("*").alias("n_dirs"))
    return d.orderBy(F.when(F.length("drive") == 1, 0).otherwise(1), "drive")


def repo_names_anywhere(spark: SparkSession, root: str) -> DataFrame:
    """SET1, SET3: names of repositories and directories, each once with the side it was first found on."""
    r = table(spark, root, "github_repos").select("name", F.lit("repo").alias("side"))
    d = table(spark, root, "directories").select("name", F.lit("dir").alias("side"))
    return merge.prefer_first([r, d], ["name"]).where("name is not null")


def shared_digests(spark: SparkSession, root: str) -> DataFrame:
    """SET2: how many different digests both sides, only one and only the other hold."""
    digests = lambda name: table(spark, root, name).select(usable_digest(F.col("git_sha1"), GIT_SHA1_DIGITS).alias("git_sha1")).dropna().distinct()
    one, two = digests("files").withColumn("l", F.lit(1)), digests("github_files").withColumn("r", F.lit(1))
    return one.join(two, "git_sha1", "full_outer").agg(F.count_if(F.expr("l = 1 and r = 1")).alias("common"), F.count_if(F.expr("r is null")).alias("only_local"), F.count_if(F.expr("l is null")).alias("only_remote"))


def latest_file_rows(spark: SparkSession, root: str) -> DataFrame:
    """AGG16, SNK10: of each path the row scanned last."""
    f = table(spark, root, "files").select("abs_path", "id", "scanned_at")
    return merge.keep_one(f, ["abs_path"], [-F.col("scanned_at"), -F.col("id")]).select("abs_path", "id")


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id up to half of the largest, and the others; none of an empty table. The bound is a scalar subquery, read when the plan runs."""
    half = rows.agg(F.expr("max(id) div 2")).scalar()
    return rows.where(F.col("id") <= half), rows.where(F.col("id") > half)


def _scans(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Rows of files as known before some moment (ids up to the median) and as found after it, one per path."""
    f = table(spark, root, "files").select("abs_path", "id", "scan_id", "drive", "sha256", "size_bytes", "mtime", "scanned_at")
    early, late = _halves(f)
    order = [-F.col("scanned_at"), -F.col("id")]
    return merge.keep_one(early, ["abs_path"], order), merge.keep_one(late, ["abs_path"], order)


#: Columns that a new scan of a known path does not change.
_KEPT = ("drive", "id")


def files_upserted(spark: SparkSession, root: str) -> DataFrame:
    """SNK1: upsert on the path that leaves some columns as they were."""
    old, new = _scans(spark, root)
    return merge.upsert(old, new, ["abs_path"], [c for c in old.columns if c not in ("abs_path", *_KEPT)]).select("abs_path", "id", "drive", "sha256", "scan_id")


def files_ignored(spark: SparkSession, root: str) -> DataFrame:
    """SNK6, SNK11: rows of new paths only."""
    old, new = _scans(spark, root)
    return merge.insert_or_ignore(old, new, ["abs_path"], [F.col("id")]).select("abs_path", "id")


def files_to_hash(spark: SparkSession, root: str) -> DataFrame:
    """JN22, STR4: found rows that are new or whose mtime moved."""
    old, new = _scans(spark, root)
    return merge.to_process(new, old, "abs_path", "mtime").select("abs_path", "id")


def trees_replaced(spark: SparkSession, root: str) -> DataFrame:
    """SNK7: new trees replace the old rows of their repositories."""
    g = table(spark, root, "github_files").where("repo_id is not null").select("id", "repo_id", "path")
    old, new = _halves(g)
    return merge.replace_groups(old, new, "repo_id")


def scans_marked(spark: SparkSession, root: str) -> DataFrame:
    """SNK3, SNK9: a status set in listed rows, and totals supplied for some columns only."""
    s = table(spark, root, "scan_meta").select("id", "scan_id", "total_files", "status")
    counted = table(spark, root, "files").groupBy("scan_id").agg(F.count("*").alias("total_files"))
    filled = merge.upsert(s, counted.join(s.select("scan_id"), "scan_id", "left_semi"), ["scan_id"], ["total_files"])
    return merge.mark_rows(filled, table(spark, root, "scan_meta").where("total_dirs is null").select("id"), "id", "status", F.lit("unfinished"))


def repos_refetched(spark: SparkSession, root: str) -> DataFrame:
    """SNK8: an upsert that keeps the time of the first fetch."""
    r = table(spark, root, "github_repos").select("full_name", "description", "fetched_at")
    new = r.where("description is null").select("full_name", F.lit("none given").alias("description"), F.lit(0.0).alias("fetched_at"))
    return merge.upsert(r, new, ["full_name"], ["description"])


QUERIES = {f.__name__: f for f in (
    pair_details, match_details, pairs_with_exact_match, unmatched_dirs, never_matched_dirs, scans_of_roots, dirs_with_code, tree_rows_of_repos, unfetched_repos, status_counts, summary, match_classes, classes_by_flag, bytes_by_suffix,
    digests_in_many_drives, largest_duplicates, top_pairs, table_page, drives_in_order, repo_names_anywhere, shared_digests, latest_file_rows, files_upserted, files_ignored, files_to_hash, trees_replaced, scans_marked, repos_refetched,
)}

_ONCE = "QUALIFY row_number() OVER (PARTITION BY abs_path ORDER BY scanned_at DESC, id DESC) = 1"
_OLD_NEW = f"""
old AS (SELECT * FROM files WHERE id <= (SELECT max(id) // 2 FROM files) {_ONCE}),
new AS (SELECT * FROM files WHERE id > (SELECT max(id) // 2 FROM files) {_ONCE})"""
_code = ", ".join(f"'{s}'" for s in CODE_SUFFIXES)
_labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_LABELS.items())

SQL = {
    "pair_details": """
SELECT p.id, p.dir1_id, p.dir2_id, p.content_similarity, p.is_exact_duplicate, a.abs_path AS dir1_abs_path, a.total_size_bytes AS dir1_total_size_bytes, b.abs_path AS dir2_abs_path
FROM dir_pairs p JOIN directories a ON a.id = p.dir1_id JOIN directories b ON b.id = p.dir2_id""",
    "match_details": f"SELECT m.id, d.abs_path AS dir_abs_path, r.full_name, CASE m.match_type {_labels} ELSE 'Other' END AS label FROM local_github_matches m JOIN directories d ON d.id = m.local_dir_id JOIN github_repos r ON r.id = m.github_repo_id",
    "pairs_with_exact_match": "SELECT p.id, p.dir1_id, min(m.github_repo_id) AS repo_id FROM dir_pairs p LEFT JOIN local_github_matches m ON m.local_dir_id = p.dir1_id AND m.match_type = 'exact' WHERE p.is_exact_duplicate = 1 GROUP BY p.id, p.dir1_id",
    "unmatched_dirs": """
SELECT d.id, d.abs_path, count(x.side) AS n_exact FROM directories d
LEFT JOIN (SELECT dir1_id AS side FROM dir_pairs WHERE is_exact_duplicate = 1 UNION ALL SELECT dir2_id FROM dir_pairs WHERE is_exact_duplicate = 1) x ON x.side = d.id
WHERE d.id NOT IN (SELECT local_dir_id FROM local_github_matches WHERE content_similarity >= 0.15 AND local_dir_id IS NOT NULL) GROUP BY d.id, d.abs_path""",
    "never_matched_dirs": "SELECT id FROM directories WHERE id NOT IN (SELECT local_dir_id FROM local_github_matches WHERE local_dir_id IS NOT NULL)",
    "scans_of_roots": "SELECT s.scan_id, s.root_path, d.id AS dir_id FROM scan_meta s LEFT JOIN directories d ON d.abs_path = s.root_path",
    "dirs_with_code": f"""
WITH c AS (SELECT DISTINCT {resolved_sql('abs_path')} AS p FROM files WHERE lower(extension) IN ({_code})),
up AS (SELECT DISTINCT array_to_string(string_split(p, '/')[1:u.k], '/') AS up FROM c, unnest(range(1, len(string_split(p, '/')))) AS u(k))
SELECT DISTINCT id AS dir_id FROM directories JOIN up ON up = abs_path""",
    "tree_rows_of_repos": "SELECT f.id, f.repo_id, r.full_name FROM github_files f JOIN github_repos r ON r.id = f.repo_id",
    "unfetched_repos": "SELECT id, full_name FROM github_repos r WHERE NOT EXISTS (SELECT 1 FROM github_files f WHERE f.repo_id = r.id AND ends_with(lower(f.path), '.md'))",
    "status_counts": """
SELECT 'files' AS metric, count(*) AS n FROM files UNION ALL SELECT 'files_without_digest', count(*) FROM files WHERE sha256 IS NULL OR sha256 = '' UNION ALL SELECT 'directories', count(*) FROM directories
UNION ALL SELECT 'exact_pairs', count(*) FROM dir_pairs WHERE is_exact_duplicate = 1 UNION ALL SELECT 'near_pairs', count(*) FROM dir_pairs WHERE is_exact_duplicate = 0 AND content_similarity >= 0.5
UNION ALL SELECT 'repos_fetched', count(*) FROM github_repos WHERE fetched_at IS NOT NULL UNION ALL SELECT 'tree_rows', count(*) FROM github_files UNION ALL SELECT 'matches', count(*) FROM local_github_matches""",
    "summary": """
WITH p AS (SELECT d.id, d.total_size_bytes AS s FROM dir_pairs p JOIN directories d ON d.id = p.dir2_id WHERE p.is_exact_duplicate = 1)
SELECT (SELECT count(*) FROM files) AS n_files, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM files) AS n_bytes, (SELECT count(*) FROM directories) AS n_dirs, (SELECT count(DISTINCT local_dir_id) FROM local_github_matches) AS n_matched,
  (SELECT CAST(coalesce(sum(s), 0) AS BIGINT) FROM p) AS pair_bytes, (SELECT CAST(coalesce(sum(s), 0) AS BIGINT) FROM (SELECT DISTINCT id, s FROM p)) AS dir_bytes,
  greatest((SELECT count(*) FROM directories) - (SELECT count(DISTINCT local_dir_id) FROM local_github_matches), 0) AS n_unmatched""",
    "match_classes": """
SELECT match_type, count(*) AS n FROM local_github_matches WHERE match_type IS NOT NULL GROUP BY match_type
UNION ALL SELECT 'orphan', count(*) FROM directories WHERE id NOT IN (SELECT local_dir_id FROM local_github_matches WHERE local_dir_id IS NOT NULL) HAVING count(*) > 0""",
    "classes_by_flag": "SELECT match_type, strong, n, CAST(sum(n) OVER (PARTITION BY match_type) AS BIGINT) AS n_class FROM (SELECT coalesce(match_type, 'none') AS match_type, content_similarity >= 0.5 AS strong, count(*) AS n FROM local_github_matches GROUP BY ALL)",
    "bytes_by_suffix": "SELECT lower(extension) AS suffix, count(*) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS n_bytes, count(*) FILTER (size_bytes = 0) AS n_empty FROM files GROUP BY 1",
    "digests_in_many_drives": f"SELECT sha256, count(*) AS n, count(DISTINCT drive) AS n_drives FROM (SELECT {digest_sql('sha256', 64)} AS sha256, drive FROM files) WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) >= 2",
    "largest_duplicates": "SELECT d.id AS dir_id, d.abs_path AS dir_abs_path, d.total_size_bytes AS dir_total_size_bytes FROM directories d WHERE d.id IN (SELECT dir2_id FROM dir_pairs WHERE is_exact_duplicate = 1) ORDER BY d.total_size_bytes DESC NULLS LAST, d.abs_path LIMIT 10",
    "top_pairs": "SELECT id, content_similarity FROM dir_pairs WHERE is_exact_duplicate = 0 AND content_similarity IS NOT NULL ORDER BY content_similarity DESC, id LIMIT 20",
    "table_page": "SELECT id, full_name FROM github_repos ORDER BY full_name LIMIT 25 OFFSET 50",
    "drives_in_order": "SELECT CASE WHEN p[2] = 'mnt' THEN lower(p[3]) ELSE p[2] END AS drive, count(*) AS n_dirs FROM (SELECT string_split(abs_path, '/') AS p FROM directories) GROUP BY 1",
    "repo_names_anywhere": "SELECT name, CASE WHEN bool_or(side = 'repo') THEN 'repo' ELSE 'dir' END AS side FROM (SELECT name, 'repo' AS side FROM github_repos UNION ALL SELECT name, 'dir' FROM directories) WHERE name IS NOT NULL GROUP BY name",
    "shared_digests": f"""
WITH l AS (SELECT DISTINCT {digest_sql('git_sha1', 40)} AS g FROM files), r AS (SELECT DISTINCT {digest_sql('git_sha1', 40)} AS g FROM github_files)
SELECT count(*) FILTER (l.g IS NOT NULL AND r.g IS NOT NULL) AS common, count(*) FILTER (r.g IS NULL) AS only_local, count(*) FILTER (l.g IS NULL) AS only_remote
FROM (SELECT g FROM l WHERE g IS NOT NULL) l FULL JOIN (SELECT g FROM r WHERE g IS NOT NULL) r ON l.g = r.g""",
    "latest_file_rows": f"SELECT abs_path, id FROM files {_ONCE}",
    "files_upserted": f"WITH {_OLD_NEW} SELECT coalesce(o.abs_path, n.abs_path) AS abs_path, coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.drive ELSE o.drive END AS drive, CASE WHEN n.id IS NULL THEN o.sha256 ELSE n.sha256 END AS sha256, CASE WHEN n.id IS NULL THEN o.scan_id ELSE n.scan_id END AS scan_id FROM old o FULL JOIN new n ON o.abs_path = n.abs_path",
    "files_ignored": f"WITH {_OLD_NEW} SELECT abs_path, id FROM old UNION ALL SELECT abs_path, id FROM new WHERE abs_path NOT IN (SELECT abs_path FROM old)",
    "files_to_hash": f"WITH {_OLD_NEW} SELECT abs_path, id FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.abs_path = n.abs_path AND abs(o.mtime - n.mtime) < 0.01)",
    "trees_replaced": """
WITH g AS (SELECT id, repo_id, path, id > (SELECT max(id) // 2 FROM github_files WHERE repo_id IS NOT NULL) AS fresh FROM github_files WHERE repo_id IS NOT NULL)
SELECT id, repo_id, path FROM g WHERE fresh OR repo_id NOT IN (SELECT repo_id FROM g WHERE fresh)""",
    "scans_marked": "SELECT s.id, s.scan_id, coalesce(f.n, s.total_files) AS total_files, CASE WHEN s.total_dirs IS NULL THEN 'unfinished' ELSE s.status END AS status FROM scan_meta s LEFT JOIN (SELECT scan_id, count(*) AS n FROM files GROUP BY 1) f ON f.scan_id = s.scan_id",
    "repos_refetched": "SELECT full_name, coalesce(description, 'none given') AS description, fetched_at FROM github_repos",
}
