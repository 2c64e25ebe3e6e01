"""Reading and writing tables, and merging two stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.operators.merge import insert_or_ignore, prefer_first
from foldmark.schema import KEYS, schema_of

#: How swapped tables are written, as two copies lie on disk during a swap: numbers as differences, ids without a dictionary, pages that hold long runs.
COMPACT = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#id": "false", "parquet.page.row.count.limit": "1000000"}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table by its declared schema; missing columns read as null, so older files still fit."""
    return spark.read.schema(schema_of(name)).parquet(f"{root}/{name}.parquet")


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """Write a table. ``partition_by`` with overwrite replaces only the partitions that df holds."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(f"{root}/{name}.parquet")


def swap_table(df: DataFrame, root: str, name: str) -> None:
    """Replace a table with a plan that may read it: written beside it, then the live one is renamed away, the new one into its place, and only then the old one deleted. After a failure in between, ``restore_table`` brings back the old one."""
    spark = df.sparkSession
    fresh, live, old = f"{root}/{name}.parquet.new", f"{root}/{name}.parquet", f"{root}/{name}.parquet.old"
    restore_table(spark, root, name)
    df.write.mode("overwrite").options(**COMPACT).parquet(fresh)
    path, fs = _files(spark, live)
    if fs.exists(path(live)) and not fs.rename(path(live), path(old)):
        raise OSError(f"could not move {live}")
    if not fs.rename(path(fresh), path(live)):
        fs.rename(path(old), path(live))
        raise OSError(f"could not replace {live}")
    fs.delete(path(old), True)


def restore_table(spark: SparkSession, root: str, name: str) -> None:
    """Undo a swap that was cut off: where the live table is missing the old one takes its place, otherwise what is left of the old one goes."""
    live, old = f"{root}/{name}.parquet", f"{root}/{name}.parquet.old"
    path, fs = _files(spark, live)
    if fs.exists(path(old)):
        if fs.exists(path(live)):
            fs.delete(path(old), True)
        else:
            fs.rename(path(old), path(live))


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(at).getFileSystem(spark._jsc.hadoopConfiguration())


def store_pairs(pairs: DataFrame, root: str, analyzed_at: float) -> None:
    """Replace the dir_pairs table with pairs (dir1_id, dir2_id, content_similarity, structural_similarity, is_exact_duplicate, common_files, unique_to_dir1, unique_to_dir2), numbered by the pair. Storing twice leaves one copy."""
    _store(pairs, root, "dir_pairs", ("dir1_id", "dir2_id"), analyzed_at)


def store_matches(matches: DataFrame, root: str, analyzed_at: float) -> None:
    """Replace the local_github_matches table with matches (local_dir_id, github_repo_id, content_similarity, structural_similarity, match_type, local_ahead_count, github_ahead_count)."""
    _store(matches, root, "local_github_matches", ("local_dir_id", "github_repo_id"), analyzed_at)


def _pair_number(one: str, two: str) -> Column:
    """The same for a pair at any time: both ids in one number, which compresses where rows of one come together, or a hash of those that are null, below 0 or of more than 31 bits."""
    fits = F.col(one).between(0, 2**31 - 1) & F.col(two).between(0, 2**31 - 1)
    return F.when(fits, F.shiftleft(F.col(one).cast("long"), 32).bitwiseOR(F.col(two).cast("long"))).otherwise(F.xxhash64(one, two, F.col(one).isNull()))


def _store(rows: DataFrame, root: str, name: str, keys: tuple[str, str], analyzed_at: float) -> None:
    shaped = rows.withColumns({"id": _pair_number(*keys), "analyzed_at": F.lit(analyzed_at)})
    swap_table(shaped.select(*[F.col(f.name).cast(f.dataType) if f.name in shaped.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema_of(name).fields]), root, name)


def merged_store(spark: SparkSession, root: str, other: str) -> dict[str, DataFrame]:
    """Repositories of both stores where the other's win, and files of both where ours stay."""
    repos = prefer_first([read_table(spark, other, "github_repos"), read_table(spark, root, "github_repos")], KEYS["github_repos"])
    files = insert_or_ignore(read_table(spark, root, "files"), read_table(spark, other, "files"), KEYS["files"], [F.col("id")])
    return {"github_repos": repos, "files": files}
