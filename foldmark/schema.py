"""The tables: schemas and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Column lists as DDL: fixed values.
SCHEMAS = {
    "files": "id long, scan_id string, drive string, abs_path string, rel_path string, filename string, extension string, size_bytes long, sha256 string, git_sha1 string, mtime double, scanned_at double",
    "directories": "id long, scan_id string, drive string, abs_path string, parent_path string, depth long, name string, file_count long, total_size_bytes long, tree_hash string, scanned_at double",
    "dir_pairs": "id long, dir1_id long, dir2_id long, content_similarity double, structural_similarity double, is_exact_duplicate long, common_files long, unique_to_dir1 long, unique_to_dir2 long, analyzed_at double",
    "github_repos": "id long, org string, name string, full_name string, clone_url string, ssh_url string, default_branch string, last_commit_at string, is_private long, topics string, description string, fetched_at double",
    "github_files": "id long, repo_id long, path string, git_sha1 string, size_bytes long",
    "local_github_matches": "id long, local_dir_id long, github_repo_id long, content_similarity double, structural_similarity double, match_type string, local_ahead_count long, github_ahead_count long, analyzed_at double",
    "uploads": "file_id long, abs_path string, remote_path string, uploaded_at double",
    "scan_meta": "id long, scan_id string, started_at double, completed_at double, root_path string, total_files long, total_dirs long, total_bytes long, status string",
}

#: Natural keys.
KEYS = {"files": ["abs_path"], "directories": ["abs_path"], "github_repos": ["full_name"], "uploads": ["file_id"], "scan_meta": ["scan_id"]}


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(name))


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create all tables that do not exist yet; running it again changes nothing."""
    for name, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns.replace(' long', ' BIGINT')}) USING parquet")
    return list(SCHEMAS)
