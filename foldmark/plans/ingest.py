"""Queries that go through the readers, writers and streams: inputs in their notation are made from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.operators.merge import keep_one
from foldmark.plans import overlap
from foldmark.plans.relational import CLASS_LABELS, match_classes, match_details, pair_details, summary, unmatched_dirs
from foldmark.plans.scalars import BINARY_SUFFIXES
from foldmark.plans.tables import table
from foldmark.session import Scratch
from foldmark.sources import files, logs, mounts, repos, tables
from foldmark.streaming import incremental, uploads

#: Rows of one page of a dump, of which a listing service has many.
PAGE_ROWS = 50


def repos_from_json(spark: SparkSession, root: str) -> DataFrame:
    """SRC5: the repository catalogue from pages of JSON."""
    r = table(spark, root, "github_repos")
    one = F.struct("id", "name", "full_name", F.struct(F.col("org").alias("login")).alias("owner"), "clone_url", "ssh_url", "default_branch", F.col("last_commit_at").alias("pushed_at"), (F.col("is_private") == 1).alias("private"), F.split("topics", ",").alias("topics"), "description")
    pages = r.groupBy(F.expr(f"id div {PAGE_ROWS}").alias("page_no")).agg(F.to_json(F.collect_list(one)).alias("json"))
    return repos.repo_catalogue(pages)


def trees_from_json(spark: SparkSession, root: str) -> DataFrame:
    """SRC6, FLT11: tree rows from trees in JSON, without folders and binary files."""
    g = table(spark, root, "github_files")
    blob = F.struct("path", F.lit("blob").alias("type"), F.col("git_sha1").alias("sha"), F.col("size_bytes").alias("size"))
    folder = F.struct(F.lit("src").alias("path"), F.lit("tree").alias("type"), F.lit("0").alias("sha"), F.lit(None).cast("long").alias("size"))
    parts = g.groupBy("repo_id", F.expr(f"id div {PAGE_ROWS}").alias("page")).agg(F.collect_list(blob).alias("blobs"))
    trees = parts.select("repo_id", F.to_json(F.struct(F.lit(False).alias("truncated"), F.concat(F.array(folder), "blobs").alias("tree"))).alias("json"))
    return repos.tree_files(trees, BINARY_SUFFIXES).select("repo_id", "path", "git_sha1", "size_bytes")


def heads_from_json(spark: SparkSession, root: str) -> DataFrame:
    """SRC7: the head of a branch from an answer that is an object, or a list of them."""
    r = table(spark, root, "github_repos")
    ref = F.struct(F.lit("refs/heads/main").alias("ref"), F.struct(F.sha1(F.encode("full_name", "UTF-8")).alias("sha")).alias("object"))
    return repos.head_digests(r.select(F.col("id").alias("repo_id"), F.when(F.col("id") % 2 == 0, F.to_json(ref)).otherwise(F.to_json(F.array(ref, ref))).alias("json")))


def drives_from_mounts(spark: SparkSession, root: str) -> DataFrame:
    """SRC8, SRC9, FLT13: the drives from the lines of a mount table, one for each root of a scan between system mounts."""
    d = table(spark, root, "directories").where("depth = 0").select(F.col("abs_path").alias("p"), "id")
    windows = F.col("p").rlike("^/mnt/[a-z]/")
    mount = F.when(windows, F.substring("p", 1, 6)).otherwise(F.replace("p", F.lit(" "), F.lit("\\040")))
    device = F.when(windows, F.concat(F.upper(F.substring("p", 6, 1)), F.lit(":"))).otherwise(F.concat(F.lit("/dev/disk"), F.col("id")))
    lines = d.select(F.col("id").alias("line_no"), F.concat(device, F.lit(" "), mount, F.lit(" "), F.when(windows, "drvfs").otherwise("ext4"), F.lit(" rw")).alias("value"))
    noise = d.select((-F.col("id") - 1).alias("line_no"), F.concat(F.lit("none /proc/"), "id", F.lit(" proc rw")).alias("value")).unionByName(d.select((-F.col("id") - 1).alias("line_no"), F.lit("broken line").alias("value")))
    return mounts.drives(mounts.mount_entries(lines.unionByName(noise))).select("mount_point", "letter", "label", "is_windows", "fs_type")


def _worker_lines(spark: SparkSession, root: str) -> DataFrame:
    """A line per file row, with its scan as the worker: progress, errors and names."""
    f = table(spark, root, "files")
    speed = F.concat("size_bytes", F.lit("file [0:01, "), F.expr("id % 97 / 8.0D").cast("string"), F.lit("file/s]"))
    text = F.when(F.col("id") % 3 == 0, speed).when(F.col("sha256").isNull(), F.concat(F.lit("FAILED to read "), "filename")).when(F.col("id") % 500 == 7, F.lit("WORKER_DONE")).otherwise(F.col("filename"))
    return f.select(F.col("scan_id").alias("worker"), F.col("id").alias("line_no"), text.alias("value")).where("value is not null")


def worker_progress(spark: SparkSession, root: str) -> DataFrame:
    """AGG17, FN31, FN32: per worker its last count and rate, whether it is done, and the last error of one that is not."""
    return logs.worker_progress(_worker_lines(spark, root))


def run_status(spark: SparkSession, root: str) -> DataFrame:
    """FN33: one row over all workers."""
    return logs.run_status(logs.worker_progress(_worker_lines(spark, root)), 1_000_000)


def log_tail(spark: SparkSession, root: str) -> DataFrame:
    """SRC10, SRT8: the last eight lines of a log."""
    return logs.tail(_worker_lines(spark, root).select("line_no", "value"))


def _written(folder: str):
    import os

    def write(batches):
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                place = os.path.join(folder, name)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "wb") as f:
                    f.write(text)
            yield batch[["name"]]

    return write


def scanned_texts(spark: SparkSession, root: str) -> DataFrame:
    """SRC1, SRC2, SRC3, FN1, FN2, FLT12: a folder with every text as a file, scanned without what lies in excluded folders. The shared folder must be one of a file system."""
    scratch = Scratch(spark, "texts")
    folder = scratch.root.removeprefix("file://")
    texts = table(spark, root, "documents").where("text is not null")
    name = F.concat(F.when(F.col("doc_id") % 10 == 0, "node_modules").otherwise(F.concat(F.lit("d"), F.expr("doc_id % 16"))), F.lit("/"), "doc_id", F.lit(".txt"))
    written = texts.select(name.alias("name"), F.encode("text", "UTF-8").alias("text")).mapInPandas(_written(folder), "name string")
    # the files must be there before they are listed
    scratch.write(written, ".written")
    found = files.scan_files(spark, folder, ["**/node_modules/**", ".written"])
    return found.select("rel_path", "filename", "extension", "size_bytes", "sha256", "git_sha1")


def estimated_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC12."""
    return files.estimated_count(table(spark, root, "files"))


def merged_stores(spark: SparkSession, root: str) -> DataFrame:
    """SRC11, SNK11: two stores attached and merged, here the rows of either half of the repositories and files as stores of their own: what is in both comes from one side."""
    scratch = Scratch(spark, "stores")
    for store, kept in (("ours", "id % 3 < 2"), ("theirs", "id % 3 > 0")):
        for name in ("github_repos", "files"):
            rows = tables.read_table(spark, root, name).where(kept).withColumn("id", F.col("id") * 2 + (1 if store == "theirs" else 0))
            tables.write_table(rows if name == "github_repos" else keep_one(rows, ["abs_path"], [-F.col("id")]), f"{scratch.root}/{store}", name)
    merged = tables.merged_store(spark, f"{scratch.root}/ours", f"{scratch.root}/theirs")
    return merged["github_repos"].select(F.lit("github_repos").alias("table_name"), F.col("full_name").alias("natural_key"), "id").unionByName(merged["files"].select(F.lit("files").alias("table_name"), F.col("abs_path").alias("natural_key"), "id"))


def pairs_stored(spark: SparkSession, root: str) -> DataFrame:
    """SNK4: near directories written to dir_pairs twice and read back."""
    scratch = Scratch(spark, "stored")
    near = overlap.near_dirs(spark, root).select(F.col("a").alias("dir1_id"), F.col("b").alias("dir2_id"), F.col("similarity").alias("content_similarity"), F.lit(0).alias("is_exact_duplicate"), F.col("common").alias("common_files"), F.col("only1").alias("unique_to_dir1"), F.col("only2").alias("unique_to_dir2"))
    for _ in range(2):
        tables.store_pairs(near, scratch.root, 0.0)
    return tables.read_table(spark, scratch.root, "dir_pairs").select("dir1_id", "dir2_id", "content_similarity", "common_files", "unique_to_dir1", "unique_to_dir2")


def matches_stored(spark: SparkSession, root: str) -> DataFrame:
    """SNK5: content matches written to local_github_matches twice and read back."""
    scratch = Scratch(spark, "stored")
    found = overlap.content_matches(spark, root).select(F.col("a").alias("local_dir_id"), F.col("b").alias("github_repo_id"), F.col("content").alias("content_similarity"), F.col("structure").alias("structural_similarity"), F.col("class").alias("match_type"), F.col("local_ahead").alias("local_ahead_count"), F.col("remote_ahead").alias("github_ahead_count"))
    for _ in range(2):
        tables.store_matches(found, scratch.root, 0.0)
    return tables.read_table(spark, scratch.root, "local_github_matches").select("local_dir_id", "github_repo_id", "content_similarity", "match_type", "local_ahead_count", "github_ahead_count")


def streamed_uploads(spark: SparkSession, root: str) -> DataFrame:
    """STR1, STR2, STR3, JN21: all rows of files as a stream, each file id copied and recorded once."""
    scratch = Scratch(spark, "uploads")
    tables.read_table(spark, root, "files").write.parquet(f"{scratch.root}/in")
    for _ in range(2):
        query = uploads.upload_stream(uploads.scanned_files(spark, f"{scratch.root}/in"), lambda df: df, f"{scratch.root}/up", "/base", f"{scratch.root}/mark", once=True)
        uploads.drain(query)
    return spark.read.parquet(f"{scratch.root}/up").select("file_id", "remote_path")


def streamed_counts(spark: SparkSession, root: str) -> DataFrame:
    """STR8: rows and bytes per digest, counted over a stream."""
    scratch = Scratch(spark, "counts")
    tables.read_table(spark, root, "files").write.parquet(f"{scratch.root}/in")

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{scratch.root}/out")

    counts = incremental.content_counts(uploads.scanned_files(spark, f"{scratch.root}/in"))
    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{scratch.root}/mark").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{scratch.root}/out")


def statuses_shown(spark: SparkSession, root: str) -> DataFrame:
    """DSH5: the status of scans where one set by hand goes before the stored one, and pending stands for none."""
    s = table(spark, root, "scan_meta").select("id", "scan_id", "status")
    by_hand = s.where("id % 2 = 0").select("id", F.lit("checked").alias("set_status"))
    return s.join(by_hand, "id", "left").select("id", F.coalesce("set_status", F.nullif("status", F.lit("")), F.lit("pending")).alias("status"))


def report_sections(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """SNK12, SNK13: the sections of the analytics report and page, whole."""
    d = table(spark, root, "directories")
    pairs = pair_details(spark, root)
    one, two = F.col("dir1_abs_path").alias("kept"), F.col("dir2_abs_path").alias("copy")
    out = {
        "Executive Summary": summary(spark, root),
        "Exact Local Duplicates": pairs.where("is_exact_duplicate = 1").select(one, two, F.col("dir1_total_size_bytes").alias("size_bytes")).orderBy(F.desc_nulls_last("size_bytes"), "kept", "copy"),
        "Near-Duplicate Local Dirs": pairs.where("is_exact_duplicate = 0 and content_similarity >= 0.5").select(one, two, "content_similarity").orderBy(F.desc("content_similarity"), "kept", "copy"),
        "Match Classes": match_classes(spark, root).orderBy(F.desc("n"), "match_type"),
    }
    matches = match_details(spark, root)
    for label in CLASS_LABELS.values():
        out[f"Matches: {label}"] = matches.where(F.col("label") == label).select("dir_abs_path", "full_name").orderBy("dir_abs_path", "full_name")
    out["Orphan Directories"] = unmatched_dirs(spark, root).orderBy("abs_path")
    freed = pairs.where("is_exact_duplicate = 1").select(F.col("dir2_id").alias("id")).distinct()
    out["Space Recovery Estimate"] = d.join(freed, "id", "left_semi").select("abs_path", "total_size_bytes").orderBy(F.desc_nulls_last("total_size_bytes"), "abs_path")
    return out


def report_rows(spark: SparkSession, root: str) -> DataFrame:
    """SNK12, SNK13: how many rows each section of the report holds."""
    parts = [df.agg(F.lit(name).alias("section"), F.count("*").alias("n_rows")) for name, df in report_sections(spark, root).items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


QUERIES = {f.__name__: f for f in (
    repos_from_json, trees_from_json, heads_from_json, drives_from_mounts, worker_progress, run_status, log_tail, scanned_texts, estimated_files, merged_stores, pairs_stored, matches_stored, streamed_uploads, streamed_counts, statuses_shown, report_rows,
)}

_LINES = """
lines AS (SELECT scan_id AS worker, id AS line_no,
  CASE WHEN id % 3 = 0 THEN size_bytes || 'file [0:01, ' || CAST(id % 97 / 8.0::DOUBLE AS VARCHAR) || 'file/s]' WHEN sha256 IS NULL THEN 'FAILED to read ' || filename WHEN id % 500 = 7 THEN 'WORKER_DONE' ELSE filename END AS value FROM files),
seen AS (SELECT *, regexp_extract(value, '(\\d+)file \\[.*?,\\s*([\\d.]+)file/s', 1) AS c, regexp_extract(value, '(\\d+)file \\[.*?,\\s*([\\d.]+)file/s', 2) AS r,
  trim(value) <> '' AND NOT regexp_matches(trim(value), '(?i)database is locked|NotADirectoryError|integer expression|WARNING|Hashing|file/s|cached=|\\d+%')
    AND regexp_matches(trim(value), 'Traceback \\(most recent|^\\s*File \\".*\\", line \\d|^(?:ERROR|FATAL|CRITICAL)|SystemExit|subprocess.*[Ee]rror|FAILED|[Kk]illed by signal|command not found') AS bad FROM lines WHERE value IS NOT NULL),
progress AS (SELECT worker, CAST(arg_max(c, line_no) FILTER (c <> '') AS BIGINT) AS n_files, CAST(arg_max(r, line_no) FILTER (c <> '') AS DOUBLE) AS rate, bool_or(contains(value, 'DONE')) AS done, arg_max(trim(value), line_no) FILTER (bad) AS e FROM seen GROUP BY worker)"""

_binary = ", ".join(f"'{s}'" for s in BINARY_SUFFIXES)

SQL = {
    "repos_from_json": "SELECT id, org, name, full_name, clone_url, ssh_url, coalesce(default_branch, 'main') AS default_branch, last_commit_at, CAST(coalesce(is_private = 1, false) AS BIGINT) AS is_private, topics, description FROM github_repos",
    "trees_from_json": f"SELECT repo_id, path, git_sha1, size_bytes FROM github_files WHERE lower(regexp_extract(regexp_replace(string_split(path, '/')[-1], '^\\.+', ''), '^.+(\\.[^.]*)$', 1, 's')) NOT IN ({_binary})",
    "heads_from_json": "SELECT id AS repo_id, sha1(full_name) AS head FROM github_repos",
    "drives_from_mounts": """
SELECT DISTINCT ON (mount_point) mount_point, CASE WHEN mount_point = '/' THEN 'root' ELSE lower(string_split(mount_point, '/')[-1]) END AS letter, CASE WHEN w THEN upper(mount_point[6]) || ':' ELSE 'disk' || id END AS label, w AS is_windows, CASE WHEN w THEN 'drvfs' ELSE 'ext4' END AS fs_type
FROM (SELECT id, regexp_matches(abs_path, '^/mnt/[a-z]/') AS w, CASE WHEN regexp_matches(abs_path, '^/mnt/[a-z]/') THEN abs_path[1:6] ELSE abs_path END AS mount_point FROM directories WHERE depth = 0) ORDER BY mount_point, id""",
    "worker_progress": f"WITH {_LINES} SELECT worker, n_files, rate, done, CASE WHEN NOT done THEN e END AS error FROM progress",
    "run_status": f"""
WITH {_LINES}, p AS (SELECT worker, n_files, rate, done, CASE WHEN NOT done THEN e END AS error FROM progress),
t AS (SELECT CAST(coalesce(sum(n_files), 0) AS BIGINT) AS n_files, coalesce(sum(rate), 0.0) AS rate, count(*) FILTER (done) AS n_done, arg_min(error, worker) FILTER (error IS NOT NULL) AS error FROM p)
SELECT *, CASE WHEN n_done = 1000000 THEN 'done' WHEN n_files > 0 THEN 'active' WHEN error IS NULL AND n_done > 0 THEN 'waiting' ELSE 'starting' END AS stage FROM t""",
    "log_tail": f"WITH {_LINES} SELECT line_no, value FROM seen ORDER BY line_no DESC LIMIT 8",
    "scanned_texts": "SELECT 'd' || doc_id % 16 || '/' || doc_id || '.txt' AS rel_path, doc_id || '.txt' AS filename, '.txt' AS extension, strlen(text) AS size_bytes, sha256(text) AS sha256, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS git_sha1 FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 0",
    "estimated_files": "SELECT least(count(*), 5000000) AS n_files, count(*) >= 5000000 AS capped FROM files",
    "merged_stores": """
WITH r AS (SELECT 'github_repos' AS table_name, full_name AS natural_key, id * 2 + 1 AS id, 0 AS o FROM github_repos WHERE id % 3 > 0 UNION ALL SELECT 'github_repos', full_name, id * 2, 1 FROM github_repos WHERE id % 3 < 2),
f AS (SELECT 'files', abs_path, max(id) * 2, 0 FROM files WHERE id % 3 < 2 GROUP BY abs_path UNION ALL SELECT 'files', abs_path, max(id) * 2 + 1, 1 FROM files WHERE id % 3 > 0 GROUP BY abs_path),
u AS (SELECT * FROM r UNION ALL SELECT * FROM f)
SELECT table_name, natural_key, id FROM u QUALIFY row_number() OVER (PARTITION BY table_name, natural_key ORDER BY o) = 1""",
    "pairs_stored": f"SELECT a AS dir1_id, b AS dir2_id, similarity AS content_similarity, common AS common_files, only1 AS unique_to_dir1, only2 AS unique_to_dir2 FROM ({overlap.SQL['near_dirs']})",
    "matches_stored": f"SELECT a AS local_dir_id, b AS github_repo_id, content AS content_similarity, class AS match_type, local_ahead AS local_ahead_count, remote_ahead AS github_ahead_count FROM ({overlap.SQL['content_matches']})",
    "streamed_uploads": "SELECT id AS file_id, '/base/' || regexp_replace(min(abs_path), '^/+', '') AS remote_path FROM files WHERE abs_path IS NOT NULL GROUP BY id",
    "streamed_counts": "SELECT sha256, count(*) AS n_rows, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS n_bytes FROM files WHERE sha256 <> '' GROUP BY sha256",
    "statuses_shown": "SELECT id, CASE WHEN id % 2 = 0 THEN 'checked' ELSE coalesce(nullif(status, ''), 'pending') END AS status FROM scan_meta",
}
