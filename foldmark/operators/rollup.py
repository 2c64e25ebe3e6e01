"""Roll-up of files to all directories above them, and directories of equal content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.operators.skew import split_join

#: Directories of more files than this are hashed by a stream of their sorted lines, with the same result.
TREE_FILES = 100_000


def tree_hash(line: Column) -> Column:
    """SHA-256 of the sorted lines. As one aggregate, for groups of bounded size."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256)


def directory_totals(members: DataFrame) -> DataFrame:
    """dir_id, file_count, total_size, newest of members (dir_id, size_bytes, mtime). Combined before the shuffle, so a root that holds all files is no hot group."""
    return members.groupBy("dir_id").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"), F.max("mtime").alias("newest"))


def directory_hashes(members: DataFrame) -> DataFrame:
    """dir_id and tree_hash of members (dir_id, rel_path, digest): the SHA-256 of the sorted lines ``rel|digest`` with a line end each. Rows without a digest are left out.

    Directories of up to TREE_FILES files are collected and hashed by an
    aggregate. The lines of larger ones are sorted, spilling to disk as they
    need, and pass through a running digest, so no task holds an unbounded
    directory; the hash is the same either way.
    """
    rows = members.where("rel_path is not null and digest is not null").select("dir_id", F.concat("rel_path", F.lit("|"), "digest", F.lit("\n")).alias("line"))
    large = rows.groupBy("dir_id").agg(F.count("*").alias("n")).where(F.col("n") > TREE_FILES).select("dir_id")
    if large.isEmpty():
        return rows.groupBy("dir_id").agg(tree_hash(F.col("line")).alias("tree_hash"))
    small = split_join(rows, large, ["dir_id"], "left_anti").groupBy("dir_id").agg(tree_hash(F.col("line")).alias("tree_hash"))
    kind = rows.schema["dir_id"].dataType.simpleString()
    streamed = split_join(rows, large, ["dir_id"], "left_semi").repartition("dir_id").sortWithinPartitions("dir_id", "line").mapInPandas(_running_hashes, f"dir_id {kind}, tree_hash string")
    return small.unionByName(streamed)


def _running_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, digest = None, None
    for batch in batches:
        done = []
        for dir_id, lines in batch.groupby("dir_id", sort=False)["line"]:
            if digest is None or dir_id != current:
                if digest is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = dir_id, hashlib.sha256()
            digest.update("".join(lines).encode())
        yield pd.DataFrame(done, columns=["dir_id", "tree_hash"])
    if digest is not None:
        yield pd.DataFrame([(current, digest.hexdigest())], columns=["dir_id", "tree_hash"])


def equal_groups(directories: DataFrame, dir_id: str, key: str) -> DataFrame:
    """Every directory whose non-empty key another shares: dir_id, first_id (smallest of the group), group_size. Linear where pairs would be quadratic."""
    rows = directories.select(F.col(dir_id).alias("dir_id"), F.col(key).alias("k")).where("k is not null and k <> ''")
    groups = rows.groupBy("k").agg(F.min("dir_id").alias("first_id"), F.count("*").alias("group_size")).where("group_size >= 2")
    return rows.join(groups, "k").select("dir_id", "first_id", "group_size")


def equal_pairs(directories: DataFrame, dir_id: str, key: str) -> DataFrame:
    """dir1_id < dir2_id of all directories of equal non-empty key. As many rows as there are such pairs; equal_groups is the linear form."""
    rows = directories.select(F.col(dir_id).alias("i"), F.col(key).alias("k")).where("k is not null and k <> ''")
    return rows.select(F.col("i").alias("dir1_id"), "k").join(rows.select(F.col("i").alias("dir2_id"), "k"), "k").where("dir1_id < dir2_id").select("dir1_id", "dir2_id")
