"""Queries for the general problems: hot keys and references without a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.functions.digests import GIT_SHA1_DIGITS, SHA256_DIGITS, usable_digest
from foldmark.functions.paths import drive_of, parent_of, resolved_path
from foldmark.operators.references import lifetimes, month_of, orphan_references
from foldmark.operators.skew import keys_above, profile_keys
from foldmark.plans.tables import table

#: Least share of the rows with a usable digest that makes a digest a case of p1_found.
FOUND_SHARE = 0.02


def _content_rows(spark: SparkSession, root: str) -> list[tuple[str, DataFrame]]:
    files = table(spark, root, "files").select(
        usable_digest(F.col("sha256"), SHA256_DIGITS).alias("digest"), F.col("size_bytes").alias("bytes"), drive_of(resolved_path(F.col("abs_path"))).alias("holder")
    )
    tree = table(spark, root, "github_files").select(usable_digest(F.col("git_sha1"), GIT_SHA1_DIGITS).alias("digest"), F.col("size_bytes").alias("bytes"), F.col("repo_id").cast("string").alias("holder"))
    return [("files", files), ("github_files", tree)]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    parts = [keys_above(rows, "digest", "bytes", "holder", FOUND_SHARE).select(F.lit(name).alias("src_table"), "digest") for name, rows in _content_rows(spark, root)]
    return parts[0].unionByName(parts[1])


def p1_profile(spark: SparkSession, root: str) -> DataFrame:
    """Rows, bytes and number of drives (of the resolved path) or repos of every usable digest."""
    parts = [profile_keys(rows, "digest", "bytes", "holder").select(F.lit(name).alias("src_table"), "digest", "n_rows", "total_size", "n_holders") for name, rows in _content_rows(spark, root)]
    return parts[0].unionByName(parts[1])


def _references(spark: SparkSession, root: str) -> DataFrame:
    """Every orphan reference: src_table, ref_column, row_id, period."""
    gone = table(spark, root, "removals")
    alive = lambda name, arrived, entity: lifetimes(
        table(spark, root, name).select(F.col("id").alias("key"), F.col(arrived).alias("arrived")),
        gone.where(F.col("entity") == entity).select(F.col("entity_id").alias("key"), F.col("removed_at").alias("removed")),
    ).withColumnRenamed("key", "ref_id")
    directories, repos = alive("directories", "scanned_at", "directory"), alive("github_repos", "fetched_at", "repo")
    matches, tree = table(spark, root, "local_github_matches"), table(spark, root, "github_files")
    found = []
    for source, rows, column, targets, at in (
        ("local_github_matches", matches, "local_dir_id", directories, F.col("analyzed_at")),
        ("local_github_matches", matches, "github_repo_id", repos, F.col("analyzed_at")),
        ("github_files", tree, "repo_id", repos, F.lit(None).cast("double")),
    ):
        refs = rows.select(F.lit(source).alias("src_table"), F.lit(column).alias("ref_column"), F.col("id").alias("row_id"), F.col(column).alias("ref_id"), at.alias("ref_time"))
        found.append(orphan_references(refs, targets, ["ref_id"], "simple", "ref_time"))
    return found[0].unionByName(found[1]).unionByName(found[2]).select("src_table", "ref_column", "row_id", month_of("ref_time").alias("period"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _references(spark, root)


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphans by table, column and month."""
    return _references(spark, root).groupBy("src_table", "ref_column", "period").agg(F.count("*").alias("n_orphans"))


def p3_composite(spark: SparkSession, root: str) -> DataFrame:
    """Rows of files whose (drive, folder), taken as one composite reference under partial match, names no directory: with both known a directory of that drive and path must be there, with a null drive one of that path."""
    place = resolved_path(F.col("abs_path"))
    refs = table(spark, root, "files").select("id", F.lower("drive").alias("drive"), parent_of(place).alias("folder"))
    targets = table(spark, root, "directories").select(F.lower("drive").alias("drive"), F.col("abs_path").alias("folder"))
    return orphan_references(refs, targets, ["drive", "folder"], "partial").withColumnRenamed("id", "row_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p3_found, p3_report, p3_composite)}

_DIGEST = "CASE WHEN regexp_full_match(lower(trim({c}, E' \\t\\r\\n')), '([a-z][a-z0-9_/-]*:)?[0-9a-f]{{{n}}}') THEN right(lower(trim({c}, E' \\t\\r\\n')), {n}) END"


def digest_sql(column: str, digits: int) -> str:
    return _DIGEST.format(c=column, n=digits)


def resolved_sql(column: str) -> str:
    """resolved_path in DuckDB's SQL."""
    windows = f"regexp_matches({column}, '^[A-Za-z]:([/\\\\]|$)')"
    plain = f"CASE WHEN {windows} THEN replace(substr({column}, 3), '\\', '/') ELSE {column} END"
    folded = (
        f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split({plain}, '/'), lambda x: [x])), "
        "lambda a, b: CASE WHEN b[1] IN ('', '.') THEN a WHEN b[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, b) END)"
    )
    path = f"(CASE WHEN {windows} OR starts_with({column}, '/') THEN '/' ELSE '' END || array_to_string({folded}, '/'))"
    drive = f"(CASE WHEN {windows} THEN rtrim('/mnt/' || lower(substr({column}, 1, 1)) || {path}, '/') WHEN regexp_matches({path}, '^/mnt/[A-Z](/|$)') THEN '/mnt/' || lower(substr({path}, 6, 1)) || substr({path}, 7) ELSE {path} END)"
    return f"(CASE WHEN trim({column}) <> '' THEN {drive} END)"


_CONTENT = f"""
content AS (
  SELECT 'files' AS src_table, {digest_sql("sha256", 64)} AS digest, size_bytes AS bytes,
    CASE WHEN starts_with(p, '/mnt/') THEN string_split(p, '/')[3] ELSE string_split(p, '/')[2] END AS holder
  FROM (SELECT sha256, size_bytes, {resolved_sql("abs_path")} AS p FROM files)
  UNION ALL
  SELECT 'github_files', {digest_sql("git_sha1", 40)}, size_bytes, CAST(repo_id AS VARCHAR) FROM github_files
)"""

_ORPHANS = """
targets AS (
  SELECT 'directory' AS entity, id, scanned_at AS arrived FROM directories
  UNION ALL SELECT 'repo', id, fetched_at FROM github_repos
),
refs AS (
  SELECT 'local_github_matches' AS src_table, 'local_dir_id' AS ref_column, id AS row_id, 'directory' AS entity, local_dir_id AS ref_id, analyzed_at AS t FROM local_github_matches
  UNION ALL SELECT 'local_github_matches', 'github_repo_id', id, 'repo', github_repo_id, analyzed_at FROM local_github_matches
  UNION ALL SELECT 'github_files', 'repo_id', id, 'repo', repo_id, NULL FROM github_files
),
orphans AS (
  SELECT r.src_table, r.ref_column, r.row_id, coalesce(strftime(make_timestamp(CAST(floor(r.t) AS BIGINT) * 1000000), '%Y-%m'), 'none') AS period
  FROM refs r LEFT JOIN targets g ON g.entity = r.entity AND g.id = r.ref_id
  WHERE r.ref_id IS NOT NULL AND (
    g.id IS NULL OR g.arrived > r.t
    OR EXISTS (SELECT 1 FROM removals m WHERE m.entity = r.entity AND m.entity_id = r.ref_id AND m.removed_at IS NOT NULL
               AND (r.t IS NULL OR m.removed_at <= r.t) AND (g.arrived IS NULL OR g.arrived <= m.removed_at)))
)"""

SQL = {
    "p1_found": f"WITH {_CONTENT} SELECT src_table, digest FROM (SELECT *, sum(n) OVER (PARTITION BY src_table) AS total FROM (SELECT src_table, digest, count(*) AS n FROM content WHERE digest IS NOT NULL GROUP BY ALL)) WHERE n >= 0.02 * total",
    "p1_profile": f"WITH {_CONTENT} SELECT src_table, digest, count(*) AS n_rows, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_size, count(DISTINCT holder) AS n_holders FROM content WHERE digest IS NOT NULL GROUP BY ALL",
    "p3_found": f"WITH {_ORPHANS} SELECT * FROM orphans",
    "p3_report": f"WITH {_ORPHANS} SELECT src_table, ref_column, period, count(*) AS n_orphans FROM orphans GROUP BY ALL",
    "p3_composite": f"""
WITH r AS (SELECT id AS row_id, lower(drive) AS drive, array_to_string(string_split(p, '/')[1:len(string_split(p, '/')) - 1], '/') AS folder FROM (SELECT id, drive, {resolved_sql("abs_path")} AS p FROM files)),
t AS (SELECT DISTINCT lower(drive) AS drive, abs_path AS folder FROM directories)
SELECT r.* FROM r WHERE (drive IS NOT NULL OR folder IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.folder = r.folder AND t.drive = r.drive) AND NOT (r.drive IS NULL AND EXISTS (SELECT 1 FROM t WHERE t.folder = r.folder))
  AND NOT (r.folder IS NULL AND EXISTS (SELECT 1 FROM t WHERE t.drive = r.drive))""",
}
