"""Queries of projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.functions import digests, names, paths, scalars
from foldmark.plans.tables import table
from foldmark.plans.training import digest_sql, resolved_sql

#: Suffixes of files whose content is not text: fixed values.
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".tiff", ".tif", ".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".mp3", ".wav", ".aac", ".ogg", ".flac", ".m4a", ".wma",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".tgz", ".bin", ".exe", ".dll", ".so", ".dylib", ".obj", ".o", ".a", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".pyc", ".pyd", ".pyo", ".whl", ".egg", ".class", ".jar", ".db", ".sqlite", ".sqlite3", ".lock", ".woff", ".woff2", ".eot", ".ttf", ".otf",
)
#: Suffixes of source code: fixed values.
CODE_SUFFIXES = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".java", ".kt", ".scala", ".rb", ".php", ".cs", ".cpp", ".c", ".h", ".hpp", ".rs", ".swift", ".sh", ".bash", ".zsh", ".html", ".css", ".scss", ".sql", ".tf", ".r", ".jl",
)
EXCLUDED = ("**/.git/**", "**/node_modules/**", "**/__pycache__/**", "old", "lib1*", "*.pyc")


def path_parts(spark: SparkSession, root: str) -> DataFrame:
    """PRJ1, FN5, FN7: decomposition of directory paths."""
    p = F.col("abs_path")
    return table(spark, root, "directories").select(
        "id", paths.drive_of(p).alias("drive"), paths.depth_of(p).cast("long").alias("path_depth"), paths.parent_of(p).alias("parent"), paths.base_name(p).alias("base"), paths.last_segments(p, 2).alias("tail"), paths.mount_letter(p).alias("letter")
    )


def resolved_paths(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").select("id", paths.resolved_path(F.col("abs_path")).alias("place"))


def suffixes(spark: SparkSession, root: str) -> DataFrame:
    """FN3, FN4: the two notions of a suffix, per file name."""
    n = F.col("filename")
    return table(spark, root, "files").select("filename").distinct().select("filename", paths.suffix_of(n).alias("suffix"), paths.splitext_suffix(n).alias("split_suffix"))


def byte_sizes(spark: SparkSession, root: str) -> DataFrame:
    """FN14, FN15, FN30: sizes as text; null for a size that is null or negative."""
    n = F.when(F.col("total_size_bytes") >= 0, F.col("total_size_bytes"))
    return table(spark, root, "directories").select("id", scalars.format_bytes(n).alias("size_text"), scalars.thousands(n).alias("size_digits"), F.floor(n / 1024).alias("kib"), F.bround(n / (1 << 30), 2).alias("gib"))


def percentages(spark: SparkSession, root: str) -> DataFrame:
    """FN11, FN13: percentages of ratios of counts, halves to even."""
    rows = table(spark, root, "dir_pairs")
    share = scalars.ratio(F.col("common_files"), F.col("common_files") + F.col("unique_to_dir1") + F.col("unique_to_dir2"))
    return rows.select("id", scalars.percent_value(share).alias("percent"), scalars.percent_text(share).alias("percent_text"))


def content_digests(spark: SparkSession, root: str) -> DataFrame:
    """FN1, FN2: SHA-256 and git blob SHA-1 of whole texts."""
    content = F.encode("text", "UTF-8")
    return table(spark, root, "documents").where("text is not null").select("doc_id", digests.sha256_hex(content).alias("sha256"), digests.git_blob_sha1(content).alias("git_sha1"))


def usable_digests(spark: SparkSession, root: str) -> DataFrame:
    """FLT3: rows with a digest, in compared form."""
    return table(spark, root, "files").select("id", digests.usable_digest(F.col("git_sha1"), 40).alias("git_sha1")).where("git_sha1 is not null")


def repo_names(spark: SparkSession, root: str) -> DataFrame:
    """FN17, FN19, FN20, FN21, FN22, FN23, FN24, PRJ4: names and topics of repositories."""
    n = F.col("name")
    return table(spark, root, "github_repos").select(
        "id", scalars.owner_of(F.col("full_name")).alias("owner"), scalars.name_part_of(F.col("full_name")).alias("repo"), names.plain_name(n).alias("plain"), scalars.safe_name(n).alias("safe"), scalars.branch_name(n, F.lit("2026-05-19")).alias("branch"),
        scalars.script_name(F.col("id"), F.lit(2), F.lit("copy"), n).alias("script"), F.right("full_name", F.lit(40)).alias("short"), F.array_join(scalars.topic_list(F.col("topics")), ",").alias("topics"), scalars.or_default(F.col("description"), "-").alias("description"),
    )


def escaped(spark: SparkSession, root: str) -> DataFrame:
    """FN8, FN25, FN26: escaping for HTML, LIKE and a script element."""
    p = F.col("abs_path")
    return table(spark, root, "files").select("id", scalars.html_escape(p).alias("html"), scalars.like_literal(p).alias("like_text"), scalars.shell_quote(p).alias("quoted"), scalars.script_safe_json(F.concat(F.lit("<"), p)).alias("embedded"))


def commit_times(spark: SparkSession, root: str) -> DataFrame:
    """FN28: last_commit_at in its several notations as epoch seconds."""
    return table(spark, root, "github_repos").select("id", F.unix_seconds(scalars.parse_time(F.col("last_commit_at"))).alias("committed"))


def json_rows(spark: SparkSession, root: str) -> DataFrame:
    """FN25: rows as JSON objects."""
    return table(spark, root, "scan_meta").select("id", F.to_json(F.struct("scan_id", "total_files", "status"), {"ignoreNullFields": "false"}).alias("json"))


def event_props(spark: SparkSession, root: str) -> DataFrame:
    """FN34: a value out of JSON."""
    return table(spark, root, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def name_ratios(spark: SparkSession, root: str) -> DataFrame:
    """FN16, FN18: both ratios of the names of each match."""
    m = table(spark, root, "local_github_matches")
    d = table(spark, root, "directories").select(F.col("id").alias("local_dir_id"), F.col("name").alias("local_name"))
    r = table(spark, root, "github_repos").select(F.col("id").alias("github_repo_id"), F.col("name").alias("repo_name"))
    rows = m.join(d, "local_dir_id").join(r, "github_repo_id")
    return rows.select("id", names.name_ratio(F.col("local_name"), F.col("repo_name")).alias("ratio"), names.best_name_ratio(F.col("local_name"), F.col("repo_name")).alias("best_ratio"))


def dirs_to_compare(spark: SparkSession, root: str) -> DataFrame:
    """FLT1, SRT1: directories worth comparing, shallow ones first."""
    return table(spark, root, "directories").where("file_count >= 2 and depth <= 2").select("id", "abs_path", "depth", "file_count").orderBy("depth", "abs_path")


def fetched_repos(spark: SparkSession, root: str) -> DataFrame:
    """FLT4."""
    return table(spark, root, "github_repos").where("fetched_at is not null").select("id", "full_name")


def strong_pairs(spark: SparkSession, root: str) -> DataFrame:
    """FLT5, FLT8: similar enough or exactly equal."""
    return table(spark, root, "dir_pairs").where((F.col("content_similarity") >= 0.5) | (F.col("is_exact_duplicate") == 1)).select("id", "dir1_id", "dir2_id")


def matches_by_class(spark: SparkSession, root: str) -> DataFrame:
    """FLT6, FLT7, FLT9, DSH2."""
    m = table(spark, root, "local_github_matches")
    return m.where((F.col("content_similarity") >= 0.15) & F.col("match_type").isin("exact", "diverged", "partial_match")).select("id", "match_type")


def open_scans(spark: SparkSession, root: str) -> DataFrame:
    """FLT10: a status that is known and is not done."""
    return table(spark, root, "scan_meta").where("status != 'done'").select("id", "scan_id", "status")


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """FLT11, FN4, FN9: tree entries that are not binary, and whether they are code."""
    suffix = F.lower(paths.splitext_suffix(F.col("path")))
    return table(spark, root, "github_files").select("id", suffix.alias("suffix"), suffix.isin(*CODE_SUFFIXES).alias("is_code")).where(~F.col("suffix").isin(*BINARY_SUFFIXES))


def kept_files(spark: SparkSession, root: str) -> DataFrame:
    """FLT12, FN35: files none of whose path segments is excluded."""
    return table(spark, root, "files").where(~names.excluded_path(F.col("rel_path"), EXCLUDED)).select("id")


QUERIES = {f.__name__: f for f in (
    path_parts, resolved_paths, suffixes, byte_sizes, percentages, content_digests, usable_digests, repo_names, escaped, commit_times, json_rows, event_props, name_ratios, dirs_to_compare, fetched_repos, strong_pairs, matches_by_class, open_scans, text_files, kept_files
)}

_in = lambda values: ", ".join(f"'{v}'" for v in values)
_base = "string_split({0}, '/')[-1]"
_split_suffix = "regexp_extract(regexp_replace(string_split({0}, '/')[-1], '^\\.+', ''), '^.+(\\.[^.]*)$', 1, 's')"
_plain = "trim(regexp_replace(lower(name), '[-_.\\s]+', ' ', 'g'))"
_copy_words = "|".join(sorted(names.COPY_WORDS, key=len, reverse=True))


def _size_text(n: str) -> str:
    tier = lambda unit, label: f"WHEN {n} >= {unit} THEN printf('%.1f {label}', round_even({n} / {unit}, 1))"
    return f"CASE {tier(1 << 30, 'GB')} {tier(1 << 20, 'MB')} {tier(1 << 10, 'KB')} ELSE {n} || ' B' END"


SQL = {
    "path_parts": """
SELECT id, CASE WHEN p[2] = 'mnt' AND len(p) >= 3 AND p[3] <> '' THEN lower(p[3]) WHEN p[2] = '' THEN 'root' ELSE p[2] END AS drive, CASE WHEN abs_path = '/' THEN 0 ELSE len(p) - 1 END AS path_depth,
  CASE WHEN abs_path = '/' THEN '' WHEN len(p) = 2 THEN '/' ELSE array_to_string(p[1:len(p) - 1], '/') END AS parent, p[-1] AS base, array_to_string(p[-2:], '/') AS tail, CASE WHEN p[-1] = '' THEN 'root' ELSE lower(p[-1]) END AS letter
FROM (SELECT id, abs_path, string_split(abs_path, '/') AS p FROM directories)""",
    "resolved_paths": f"SELECT id, {resolved_sql('abs_path')} AS place FROM files",
    "suffixes": f"SELECT DISTINCT filename, lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1, 's')) AS suffix, {_split_suffix.format('filename')} AS split_suffix FROM files",
    "byte_sizes": f"SELECT id, {_size_text('total_size_bytes')} AS size_text, format('{{:,}}', total_size_bytes) AS size_digits, total_size_bytes // 1024 AS kib, round_even(total_size_bytes / {1 << 30}, 2) AS gib FROM (SELECT id, CASE WHEN total_size_bytes >= 0 THEN total_size_bytes END AS total_size_bytes FROM directories)",
    "percentages": """
SELECT id, p AS percent, printf('%.1f', p) || '%' AS percent_text FROM (
  SELECT id, round_even(coalesce(common_files / nullif(common_files + unique_to_dir1 + unique_to_dir2, 0), 0.0) * 100, 1) AS p FROM dir_pairs)""",
    "content_digests": "SELECT doc_id, sha256(text) AS sha256, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS git_sha1 FROM documents WHERE text IS NOT NULL",
    "usable_digests": f"SELECT id, git_sha1 FROM (SELECT id, {digest_sql('git_sha1', 40)} AS git_sha1 FROM files) WHERE git_sha1 IS NOT NULL",
    "repo_names": f"""
SELECT id, string_split(full_name, '/')[1] AS owner, CASE WHEN contains(full_name, '/') THEN substr(full_name, strpos(full_name, '/') + 1) END AS repo, trim(regexp_replace(regexp_replace({_plain}, '(?:\\s*(?:{_copy_words}))+$', ''), '\\s+\\d+$', '')) AS plain,
  safe, 'staging/local-' || safe || '-2026-05-19' AS branch, printf('%03d_2_copy__', id) || safe || '.sh' AS script, right(full_name, 40) AS short,
  array_to_string(list_filter(topic_list, lambda x, i: list_position(topic_list, x) = i), ',') AS topics, coalesce(nullif(description, ''), '-') AS description
FROM (SELECT *, regexp_replace(name, '[^\\p{{L}}\\p{{N}}\\-_.]', '_', 'g') AS safe, list_filter(list_transform(string_split(topics, ','), lambda x: trim(x)), lambda x: x <> '') AS topic_list FROM github_repos)""",
    "escaped": """
SELECT id, replace(replace(replace(replace(replace(abs_path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, replace(replace(replace(abs_path, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS like_text,
  '''' || replace(abs_path, '''', '''\\''''''') || '''' AS quoted, replace('<' || abs_path, '</', '<\\/') AS embedded FROM files""",
    "json_rows": "SELECT id, CAST(json_object('scan_id', scan_id, 'total_files', total_files, 'status', status) AS VARCHAR) AS json FROM scan_meta",
    "event_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "commit_times": """
SELECT id, CAST(floor(CASE WHEN regexp_full_match(t, '[0-9]{9,11}([.][0-9]+)?') THEN CAST(t AS DOUBLE) WHEN NOT regexp_full_match(t, '[0-9]+([.][0-9]+)?') THEN epoch(TRY_CAST(t AS TIMESTAMP)) END) AS BIGINT) AS committed FROM (SELECT id, trim(last_commit_at) AS t FROM github_repos)""",
    "dirs_to_compare": "SELECT id, abs_path, depth, file_count FROM directories WHERE file_count >= 2 AND depth <= 2",
    "fetched_repos": "SELECT id, full_name FROM github_repos WHERE fetched_at IS NOT NULL",
    "strong_pairs": "SELECT id, dir1_id, dir2_id FROM dir_pairs WHERE content_similarity >= 0.5 OR is_exact_duplicate = 1",
    "matches_by_class": "SELECT id, match_type FROM local_github_matches WHERE content_similarity >= 0.15 AND match_type IN ('exact', 'diverged', 'partial_match')",
    "open_scans": "SELECT id, scan_id, status FROM scan_meta WHERE status <> 'done'",
    "text_files": f"SELECT * FROM (SELECT id, suffix, suffix IN ({_in(CODE_SUFFIXES)}) AS is_code FROM (SELECT id, lower({_split_suffix.format('path')}) AS suffix FROM github_files)) WHERE suffix NOT IN ({_in(BINARY_SUFFIXES)})",
    "kept_files": "SELECT id FROM files WHERE len(list_filter(string_split(rel_path, '/'), lambda x: x IN ('.git', 'node_modules', '__pycache__', 'old') OR x GLOB 'lib1*' OR x GLOB '*.pyc')) = 0",
}
