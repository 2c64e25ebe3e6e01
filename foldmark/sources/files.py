"""Scanning folders: content, digests and path parts of files."""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.functions import paths
from foldmark.operators.merge import to_process

#: Bytes read at once when a file is hashed as a stream: fixed value.
CHUNK = 65_536
#: Files listed per batch.
LISTED = 10_000
#: Most files an estimate reports: fixed value.
ESTIMATE_CAP = 5_000_000


def new_scan_id(now: float, token: str) -> str:
    """Name of a scan: ``scan-``, whole epoch seconds, and the first six characters of a random hex token. Both are given, so that a scan can be repeated."""
    return f"scan-{int(now)}-{token[:6]}"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 and git blob SHA-1 of files in one pass over their bytes, however large; null for files that cannot be read."""
    for batch in batches:
        sha256, sha1 = [], []
        for path in batch["abs_path"]:
            a, b = hashlib.sha256(), hashlib.sha1(usedforsecurity=False)
            try:
                with open(path, "rb") as f:
                    b.update(b"blob %d\0" % os.fstat(f.fileno()).st_size)
                    while chunk := f.read(CHUNK):
                        a.update(chunk)
                        b.update(chunk)
                sha256.append(a.hexdigest())
                sha1.append(b.hexdigest())
            except OSError:
                sha256.append(None)
                sha1.append(None)
        yield batch.assign(sha256=sha256, git_sha1=sha1)


def _entries(folder: str, bare: Sequence[str]) -> tuple[list[str], list[tuple]]:
    """Folders and files (abs_path, size_bytes, mtime) of one folder that no pattern excludes; symbolic links and what cannot be read are left out."""
    folders, found = [], []
    try:
        with os.scandir(folder) as listed:
            for e in listed:
                if e.is_symlink() or any(fnmatch.fnmatch(e.name, p) for p in bare):
                    continue
                if e.is_dir():
                    folders.append(e.path)
                elif e.is_file():
                    found.append((e.path, e.stat().st_size, e.stat().st_mtime))
    except OSError:
        pass
    return folders, found


def list_files(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> DataFrame:
    """abs_path, size_bytes, mtime of the files below a folder that all executors can read.

    The driver opens folders only until there are a few per core; the executors
    walk them. Unlike the binary file source this also lists empty files.
    """
    bare = [p.removeprefix("**/").removesuffix("/**") for p in exclude]
    seeds, found = [root], []
    enough = 4 * spark.sparkContext.defaultParallelism
    for _ in range(3):
        if len(seeds) >= enough:
            break
        opened = [_entries(folder, bare) for folder in seeds]
        found += [f for _, files in opened for f in files]
        seeds = [d for folders, _ in opened for d in folders]
    schema = "abs_path string, size_bytes long, mtime double"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed in batch["seed"]:
                open_ = [seed]
                rows: list[tuple] = []
                while open_:
                    folders, files = _entries(open_.pop(), bare)
                    open_ += folders
                    rows += files
                    if len(rows) >= LISTED:
                        yield pd.DataFrame(rows, columns=["abs_path", "size_bytes", "mtime"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["abs_path", "size_bytes", "mtime"])

    here = spark.createDataFrame(found, schema)
    if not seeds:
        return here
    below = spark.createDataFrame([(s,) for s in seeds], "seed string").repartition(min(len(seeds), enough))
    return here.unionByName(below.mapInPandas(walk, schema))


def scan_files(spark: SparkSession, root: str, exclude: Sequence[str] = (), previous: DataFrame | None = None, scan_id: str = "scan", scanned_at: float = 0.0) -> DataFrame:
    """Files below ``root`` with the columns of the files table but the id.

    Paths with a segment that matches an exclude pattern are left out,
    symbolic links too. With ``previous`` only files that are new or whose
    mtime moved come out, and only their content is read. Clock and scan id are
    given, so that a scan can be repeated. An empty folder gives no rows.
    """
    root = root.rstrip("/") or "/"
    found = list_files(spark, root, exclude)
    if previous is not None:
        found = to_process(found, previous, "abs_path", "mtime")
    hashed = found.mapInPandas(_digests, "abs_path string, size_bytes long, mtime double, sha256 string, git_sha1 string")
    name = paths.base_name(F.col("abs_path"))
    rel = F.substr("abs_path", F.lit(len(root) + 2 if root != "/" else 2))
    return hashed.select(
        F.lit(scan_id).alias("scan_id"), paths.drive_of(F.col("abs_path")).alias("drive"), "abs_path", rel.alias("rel_path"), name.alias("filename"), paths.suffix_of(name).alias("extension"), "size_bytes", "sha256", "git_sha1", "mtime", F.lit(scanned_at).alias("scanned_at")
    )


def estimated_count(files: DataFrame) -> DataFrame:
    """One row: the number of files, and whether counting stopped at ESTIMATE_CAP, so that there may be more."""
    return files.limit(ESTIMATE_CAP).agg(F.count("*").alias("n_files"), (F.count("*") >= ESTIMATE_CAP).alias("capped"))


def directories_of(files: DataFrame, root: str, scan_id: str = "scan", scanned_at: float = 0.0) -> DataFrame:
    """The directories table, but the id, rolled up from files below ``root``: every directory that holds a file somewhere below it."""
    from foldmark.operators import rollup
    from foldmark.operators.containment import explode_ancestors

    root = root.rstrip("/") or "/"
    below = explode_ancestors(files.select("abs_path", "sha256", "size_bytes", "mtime"), "abs_path", root)
    members = below.select(F.col("ancestor").alias("dir_id"), F.substr("abs_path", F.length("ancestor") + 2).alias("rel_path"), F.col("sha256").alias("digest"), "size_bytes", "mtime")
    sums = rollup.directory_totals(members)
    hashes = rollup.directory_hashes(members)
    p = F.col("dir_id")
    depth = (paths.depth_of(p) - (0 if root == "/" else root.count("/"))).cast("long")
    return sums.join(hashes, "dir_id", "left").select(
        F.lit(scan_id).alias("scan_id"), paths.drive_of(p).alias("drive"), p.alias("abs_path"), F.when(p == root, F.lit("")).otherwise(paths.parent_of(p)).alias("parent_path"), depth.alias("depth"), paths.base_name(p).alias("name"), "file_count",
        F.col("total_size").alias("total_size_bytes"), "tree_hash", F.col("newest").alias("newest_mtime"), F.lit(scanned_at).alias("scanned_at"),
    )
