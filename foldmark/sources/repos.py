"""Repository catalogues and file trees from JSON dumps of a hosting service's API."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.functions.paths import splitext_suffix
from foldmark.operators.merge import keep_one

_REPO = "struct<id: bigint, name: string, full_name: string, owner: struct<login: string>, clone_url: string, ssh_url: string, default_branch: string, pushed_at: string, private: boolean, fork: boolean, topics: array<string>, description: string>"
_TREE = "struct<sha: string, truncated: boolean, tree: array<struct<path: string, type: string, sha: string, size: bigint>>>"
_REF = "struct<ref: string, object: struct<sha: string>>"


def repo_catalogue(pages: DataFrame, skip_forks: bool = False) -> DataFrame:
    """Repositories of pages (page_no, json: an array of repositories), each full name once from its first page. Pages that are no array give none."""
    rows = pages.select("page_no", F.posexplode(F.from_json("json", f"array<{_REPO}>")).alias("at", "r"))
    rows = rows.select("page_no", "at", "r.*").where("full_name is not null")
    if skip_forks:
        rows = rows.where("not coalesce(fork, false)")
    first = keep_one(rows, ["full_name"], [F.col("page_no"), F.col("at")])
    return first.select("id", F.col("owner.login").alias("org"), "name", "full_name", "clone_url", "ssh_url", F.coalesce("default_branch", F.lit("main")).alias("default_branch"), F.col("pushed_at").alias("last_commit_at"), F.coalesce(F.col("private").cast("long"), F.lit(0)).alias("is_private"), F.array_join("topics", ",").alias("topics"), "description")


def tree_files(trees: DataFrame, binary_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """repo_id, path, git_sha1, size_bytes, truncated of the blobs of trees (repo_id, json), without those of a binary suffix."""
    rows = trees.select("repo_id", F.from_json("json", _TREE).alias("t")).select("repo_id", F.coalesce("t.truncated", F.lit(False)).alias("truncated"), F.explode("t.tree").alias("e"))
    kept = rows.where(F.col("e.type") == "blob")
    if binary_suffixes:
        kept = kept.where(~F.lower(splitext_suffix(F.col("e.path"))).isin(*binary_suffixes))
    return kept.select("repo_id", F.col("e.path").alias("path"), F.col("e.sha").alias("git_sha1"), F.col("e.size").alias("size_bytes"), "truncated")


def head_digests(refs: DataFrame) -> DataFrame:
    """repo_id and head of refs (repo_id, json): the answer may be one reference or a list, of which the first counts."""
    one = F.from_json("json", _REF)["object"]["sha"]
    many = F.get(F.from_json("json", f"array<{_REF}>"), F.lit(0))["object"]["sha"]
    return refs.select("repo_id", F.when(F.trim("json").startswith("["), many).otherwise(one).alias("head"))
