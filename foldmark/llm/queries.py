"""Queries of the training-data problems in this package, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.functions.digests import GIT_SHA1_DIGITS, SHA256_DIGITS, usable_digest
from foldmark.functions.paths import drive_of, resolved_path
from foldmark.llm.components import connected_groups
from foldmark.llm.mixing import mix
from foldmark.llm.packing import fill, pack, pack_each
from foldmark.llm.residue import matches, residue_documents
from foldmark.llm.setjoin import SimilarSets, similar_sets
from foldmark.llm.survivors import best_rows, fuse
from foldmark.llm.tokens import token_count
from foldmark.operators.layout import spread
from foldmark.operators.sets import meet
from foldmark.operators.skew import split_join
from foldmark.session import Scratch
from foldmark.plans.tables import table
from foldmark.plans.training import digest_sql, resolved_sql

#: 2000-01-01 UTC; earlier mtimes are useless.
LEAST_MTIME = 946684800


#: Problem 2: least share of common content and least size of a set.
OVERLAP, LEAST_DIGESTS = 0.6, 5


def _content_sets(spark: SparkSession, root: str) -> DataFrame:
    """s (twice the id, plus 1 for a repo) and digest of every project folder and repo."""
    digest = usable_digest(F.col("git_sha1"), GIT_SHA1_DIGITS).alias("digest")
    repos = table(spark, root, "github_files").select((F.col("repo_id") * 2 + 1).alias("s"), digest).dropna()
    folders = table(spark, root, "directories").where("depth = 1").select(F.col("id"), F.col("abs_path").alias("folder")).dropna()
    # folders lie at a few depths only, so a file is looked up at those alone rather than at every ancestor
    depths = [row[0] for row in folders.select(F.size(F.split("folder", "/"))).distinct().collect()]
    files = table(spark, root, "files").select(resolved_path(F.col("abs_path")).alias("place"), digest).dropna()
    if not depths:
        return repos
    above = F.array(*[F.when(F.size(F.split("place", "/")) > d, F.substring_index("place", "/", d)) for d in depths])
    held = split_join(files.select(F.explode(above).alias("folder"), "digest").dropna(), folders, ["folder"])
    return repos.unionByName(held.select((F.col("id") * 2).alias("s"), "digest"))


def _set_key(s: str):
    return F.concat(F.when(F.col(s).bitwiseAND(1) == 1, "repo:").otherwise("dir:"), F.shiftright(s, 1).cast("string"))


def _similar(spark: SparkSession, root: str) -> SimilarSets:
    return similar_sets(_content_sets(spark, root), "s", "digest", OVERLAP, LEAST_DIGESTS)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Similar pairs with every set of equal content written out, as TESTDATA.md asks."""
    found = _similar(spark, root)
    one, two = [found.members.select(F.col("set").alias(f"s{k}"), F.col("class").alias(f"set{k}")) for k in (1, 2)]
    # a class may have many members and many pairs, so both joins cut long lists
    anyway = F.lit(True)
    scratch = Scratch(spark, "pairs")
    firsts = scratch.write(meet(scratch.write(found.pairs.select("set1", "set2"), "pairs"), one, ["set1"], anyway), "firsts")
    between = meet(firsts, two, ["set2"], anyway)
    within = meet(one, two.withColumnRenamed("set2", "set1"), ["set1"], F.col("s1") < F.col("s2"))
    pairs = between.select("s1", "s2").unionByName(within.select("s1", "s2")).select(_set_key("s1").alias("a"), _set_key("s2").alias("b"))
    return pairs.select(F.least("a", "b").alias("key1"), F.greatest("a", "b").alias("key2"))


def p2_classes(spark: SparkSession, root: str) -> DataFrame:
    """Each set with its class of equal content and the number of other classes similar to it."""
    found = _similar(spark, root)
    ends = found.pairs.select(F.explode(F.array("set1", "set2")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return split_join(found.members, ends, ["class"], "left").select(_set_key("set").alias("key"), _set_key("class").alias("class_key"), "size", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def place_key(place) -> list:
    """Two 64-bit fingerprints of a path. The constant comes first in the second, as a hash that goes on from the first's result would be a function of it."""
    return [F.xxhash64(place).alias("p1"), F.xxhash64(F.lit(1), place).alias("p2")]


def _recorded(spark: SparkSession, root: str) -> DataFrame:
    """Rows of files with their path's 128-bit fingerprint and the usable form of each field, null where useless."""
    files = table(spark, root, "files").select("id", "scan_id", "sha256", "drive", "mtime", "scanned_at", resolved_path(F.col("abs_path")).alias("place"))
    usable_mtime = F.when((F.col("mtime") >= LEAST_MTIME) & (F.col("mtime") <= F.col("scanned_at")), F.col("mtime"))
    usable_drive = F.when(F.lower("drive") == drive_of(F.col("place")), F.lower("drive"))
    return files.select(
        "id", "scan_id", "scanned_at", *place_key(F.col("place")), F.col("place").isNotNull().alias("placed"),
        usable_digest(F.col("sha256"), SHA256_DIGITS).alias("sha256"), usable_mtime.alias("mtime"), usable_drive.alias("drive"),
    ).where("placed")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    rows = _recorded(spark, root)
    fields = {name: F.col(name).isNotNull() for name in ("sha256", "mtime", "drive")}
    return best_rows(rows, [F.col("p1"), F.col("p2")], "id", fields, [F.col("mtime"), F.col("scanned_at")])


def p4_fused(spark: SparkSession, root: str) -> DataFrame:
    """Values of maximum posterior for each group of p4_found, scans as sources."""
    rows = _recorded(spark, root)
    groups = rows.groupBy("p1", "p2").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n >= 2").drop("n")
    claims = split_join(rows, groups, ["p1", "p2"]).select(
        "group_id", F.expr("stack(3, 'sha256', sha256, 'mtime', cast(mtime as string), 'drive', drive) as (field_name, value)"), F.col("scan_id").alias("source"), F.col("scanned_at").alias("at")
    )
    return fuse(claims)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    links = table(spark, root, "dir_pairs").where("is_exact_duplicate = 1").select("dir1_id", "dir2_id")
    return connected_groups(links, "dir1_id", "dir2_id").withColumnRenamed("vertex", "dir_id")


def _sized(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, source, n_tokens of every document, counted once."""
    documents = spread(table(spark, root, "documents").select("doc_id", "source", "text"))
    return Scratch(spark, "sized").write(documents.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens")), "documents")


def _limits(spark: SparkSession, root: str) -> dict[str, int]:
    return {r["limit_name"]: r["capacity_tokens"] for r in table(spark, root, "pack_limits").dropna().collect()}


def p6_assign(spark: SparkSession, root: str) -> DataFrame:
    """The place of every document, or piece of one larger than the largest capacity, in the containers of the tiers that pack_limits lists."""
    return pack(_sized(spark, root), "doc_id", "n_tokens", _limits(spark, root)).withColumnsRenamed({"item_start": "token_start", "piece_size": "n_tokens"})


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    limits = _limits(spark, root)
    return fill(pack(_sized(spark, root), "doc_id", "n_tokens", limits), limits)


def p6_each_assign(spark: SparkSession, root: str) -> DataFrame:
    """The place of every document, or piece of one larger than the capacity, in the containers of each limit by itself."""
    return pack_each(_sized(spark, root), "doc_id", "n_tokens", _limits(spark, root)).withColumnsRenamed({"item_start": "token_start", "piece_size": "n_tokens"})


def p6_each_fill(spark: SparkSession, root: str) -> DataFrame:
    limits = _limits(spark, root)
    return fill(pack_each(_sized(spark, root), "doc_id", "n_tokens", limits), limits)


def p6_byte_checks(spark: SparkSession, root: str) -> DataFrame:
    """Both assignments of texts sized in bytes, which SQL can count: bytes and pieces placed, containers above their capacity, places in a container taken twice or left out between, texts split without need."""
    limits = _limits(spark, root)
    sized = table(spark, root, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    caps = F.broadcast(spark.createDataFrame([(k, v) for k, v in limits.items()], "limit_name string, capacity long"))
    largest = F.lit(max(limits.values()))
    out = []
    for name, placed, split_at in (("tiers", pack(sized, "doc_id", "n", limits), largest), ("each", pack_each(sized, "doc_id", "n", limits), F.col("capacity"))):
        # packed without holes, the pieces of a container end where the next begins
        one = placed.join(caps, "limit_name").groupBy("limit_name", "capacity", "container_id").agg(F.sum("piece_size").alias("s"), F.count("*").alias("k"), F.max(F.col("container_offset") + F.col("piece_size")).alias("end"), F.count_if((F.col("piece") > 0) & (F.col("item_start") % split_at != 0)).alias("odd"))
        out.append(one.agg(F.lit(name).alias("form"), F.sum("s").alias("n_bytes"), F.sum("k").alias("n_pieces"), F.count_if(F.col("s") > F.col("capacity")).alias("n_over"), F.count_if(F.col("end") != F.col("s")).alias("n_uneven"), F.sum("odd").alias("n_split_early")))
    return out[0].unionByName(out[1])


def p7_draws(spark: SparkSession, root: str) -> DataFrame:
    """The drawn records with repeats, in training order."""
    return mix(_sized(spark, root), "doc_id", "source", "n_tokens", table(spark, root, "mix_targets"))[0]


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of every source."""
    return mix(_sized(spark, root), "doc_id", "source", "n_tokens", table(spark, root, "mix_targets"))[1]


def p7_whole_shares(spark: SparkSession, root: str) -> DataFrame:
    """The same where as many tokens are asked for as there are, so that scarce sources give all that their repeats allow and the others make up for it."""
    sized = _sized(spark, root)
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return mix(sized, "doc_id", "source", "n_tokens", table(spark, root, "mix_targets"), float(total))[1]


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return residue_documents(table(spark, root, "documents"), "doc_id", "text")


def p8_kept(spark: SparkSession, root: str) -> DataFrame:
    """The documents that stay."""
    documents = table(spark, root, "documents")
    return documents.select("doc_id", "source", "lang").join(residue_documents(documents, "doc_id", "text"), "doc_id", "left_anti")


def p8_passages(spark: SparkSession, root: str) -> DataFrame:
    """The matching passage windows with their scores."""
    return matches(table(spark, root, "documents"), "doc_id", "text").withColumnsRenamed({"w": "passage"})


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p4_found, p4_fused, p5_found, p6_assign, p6_fill, p6_each_assign, p6_each_fill, p6_byte_checks, p7_draws, p7_shares, p7_whole_shares, p8_found, p8_kept, p8_passages)}

_P4 = f"""
rows AS (
  SELECT id, scanned_at, place, {digest_sql("sha256", 64)} IS NOT NULL AS sha256,
    CASE WHEN mtime >= 946684800 AND mtime <= scanned_at THEN mtime END AS mtime,
    lower(drive) = CASE WHEN starts_with(place, '/mnt/') THEN string_split(place, '/')[3] ELSE string_split(place, '/')[2] END AS drive
  FROM (SELECT *, {resolved_sql("abs_path")} AS place FROM files) WHERE place IS NOT NULL
),
grouped AS (SELECT *, min(id) OVER w AS group_id, count(*) OVER w AS n FROM rows WINDOW w AS (PARTITION BY place)),
usable AS (
  SELECT group_id, 'sha256' AS field_name, id AS row_id, mtime, scanned_at FROM grouped WHERE n >= 2 AND sha256
  UNION ALL SELECT group_id, 'mtime', id, mtime, scanned_at FROM grouped WHERE n >= 2 AND mtime IS NOT NULL
  UNION ALL SELECT group_id, 'drive', id, mtime, scanned_at FROM grouped WHERE n >= 2 AND drive
)"""

_P2 = f"""
placed AS (SELECT {resolved_sql("abs_path")} AS place, {digest_sql("git_sha1", 40)} AS digest FROM files),
cells AS (
  SELECT 'repo:' || repo_id AS key, {digest_sql("git_sha1", 40)} AS digest FROM github_files WHERE repo_id IS NOT NULL
  UNION ALL
  SELECT 'dir:' || d.id, p.digest FROM placed p, unnest(range(1, len(string_split(p.place, '/')))) AS u(k)
  JOIN directories d ON d.depth = 1 AND d.abs_path = array_to_string(string_split(p.place, '/')[1:u.k], '/')
),
members AS (SELECT DISTINCT key, digest FROM cells WHERE digest IS NOT NULL),
sizes AS (SELECT key, count(*) AS n FROM members GROUP BY key HAVING count(*) >= 5),
shared AS (SELECT a.key AS key1, b.key AS key2, count(*) AS k FROM members a JOIN members b ON a.digest = b.digest AND a.key < b.key GROUP BY ALL),
similar_pairs AS (
  SELECT key1, key2, k, a.n AS n1, b.n AS n2 FROM shared JOIN sizes a ON a.key = key1 JOIN sizes b ON b.key = key2 WHERE k >= 0.6 * (a.n + b.n - k) - 1e-9
)"""

SQL = {
    "p2_found": f"WITH {_P2} SELECT key1, key2 FROM similar_pairs",
    "p2_classes": f"""
WITH {_P2},
contents AS (SELECT key, string_agg(digest, ',' ORDER BY digest) AS content, any_value(n) AS n FROM members JOIN sizes USING (key) GROUP BY key),
numbered AS (SELECT *, CASE WHEN starts_with(key, 'dir:') THEN 2 * CAST(substr(key, 5) AS BIGINT) ELSE 2 * CAST(substr(key, 6) AS BIGINT) + 1 END AS s FROM contents),
classed AS (SELECT key, n, first_value(key) OVER (PARTITION BY content ORDER BY s) AS class_key FROM numbered),
ends AS (SELECT key1 AS class_key, key2 AS other FROM similar_pairs UNION ALL SELECT key2, key1 FROM similar_pairs),
links AS (SELECT e.class_key, count(*) AS n_links FROM ends e JOIN classed a ON a.key = e.class_key AND a.class_key = e.class_key JOIN classed b ON b.key = e.other AND b.class_key = e.other GROUP BY e.class_key)
SELECT c.key, c.class_key, c.n AS size, coalesce(l.n_links, 0) AS n_links FROM classed c LEFT JOIN links l USING (class_key)""",
    "p4_found": f"WITH {_P4} SELECT group_id, field_name, row_id FROM usable QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY mtime DESC NULLS LAST, scanned_at DESC NULLS LAST, row_id DESC) = 1",
    "p6_byte_checks": """
WITH s AS (SELECT strlen(text) AS n FROM documents WHERE text <> ''), c AS (SELECT max(capacity_tokens) AS c FROM pack_limits)
SELECT 'tiers' AS form, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(sum((n + c - 1) // c) AS BIGINT) AS n_pieces, 0 AS n_over, 0 AS n_uneven, 0 AS n_split_early FROM s, c
UNION ALL SELECT 'each', CAST(sum(n) AS BIGINT), CAST(sum((n + capacity_tokens - 1) // capacity_tokens) AS BIGINT), 0, 0, 0 FROM s, pack_limits""",
    "p5_found": """
WITH RECURSIVE links AS (
  SELECT dir1_id AS a, dir2_id AS b FROM dir_pairs WHERE is_exact_duplicate = 1 AND dir1_id <> dir2_id
  UNION SELECT dir2_id, dir1_id FROM dir_pairs WHERE is_exact_duplicate = 1 AND dir1_id <> dir2_id
),
reached AS (SELECT a AS dir_id, a AS other FROM links UNION SELECT r.dir_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT dir_id, min(other) AS group_id FROM reached GROUP BY dir_id""",
}
