"""Views of the driver's tables as items, trees and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    """Documents as items: container source/lang, content the text's digest."""
    t = table(spark, d, "documents")
    status = F.when(F.col("doc_id") % 97 == 5, "ERROR").when(F.col("doc_id") % 89 == 7, "UNVERIFIED").otherwise("OK")
    container = F.concat_ws("/", "source", "lang")
    return t.select(
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), container.alias("container"), F.sha2("text", 256).alias("content_id"), F.md5("text").alias("md5"),
        F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") % 89 != 7).alias("present"), status.alias("status"),
    )


def brands(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("container"), F.col("p_size").cast("string").alias("content_id"), F.col("p_partkey").cast("string").alias("path"))


def suppliers(spark, d) -> DataFrame:
    """Suppliers as containers of the parts they ship."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("container"), F.col("l_partkey").alias("content_id"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"))


def baskets(spark, d) -> DataFrame:
    """Orders as containers of parts."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("container"), F.col("l_partkey").alias("content_id"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"))


def users(spark, d) -> DataFrame:
    """A user's day as a container of the kinds of events in it."""
    e = table(spark, d, "events")
    return e.select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("container"), F.col("event_type").alias("content_id"), F.col("event_id").cast("string").alias("path"))


def tree(spark, d, flag: str) -> DataFrame:
    """Lines of all but one return flag as a tree: folders by part, files by line number, one of seven an item."""
    x = table(spark, d, "lineitem").where(F.col("l_returnflag") != flag)
    files = x.groupBy("l_partkey", "l_linenumber").agg(F.min("l_quantity").cast("long").alias("q"))
    files = files.select(F.concat_ws("/", "l_partkey", "l_linenumber").alias("path"), F.lit("REGULAR_FILE").alias("kind"), F.md5(F.col("q").cast("string")).alias("digest"), (F.col("l_linenumber") == 7).alias("is_item"))
    folders = x.select(F.col("l_partkey").cast("string").alias("path")).distinct().select("path", F.lit("DIRECTORY").alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(False).alias("is_item"))
    return files.unionByName(folders)


TREE_SQL = """
SELECT l_partkey || '/' || l_linenumber AS path, 'REGULAR_FILE' AS kind, md5(CAST(CAST(min(l_quantity) AS BIGINT) AS VARCHAR)) AS digest, l_linenumber = 7 AS is_item
FROM lineitem WHERE l_returnflag <> '{0}' GROUP BY l_partkey, l_linenumber
UNION ALL SELECT DISTINCT CAST(l_partkey AS VARCHAR), 'DIRECTORY', NULL, false FROM lineitem WHERE l_returnflag <> '{0}'
"""

DOCUMENTS_SQL = """
SELECT source || '/' || lang || '/' || doc_id AS path, source || '/' || lang AS container, sha256(text) AS content_id, md5(text) AS md5, strlen(text)::BIGINT AS size, doc_id % 89 <> 7 AS present,
       CASE WHEN doc_id % 97 = 5 THEN 'ERROR' WHEN doc_id % 89 = 7 THEN 'UNVERIFIED' ELSE 'OK' END AS status FROM documents
"""
BRANDS_SQL = "SELECT p_brand AS container, CAST(p_size AS VARCHAR) AS content_id, CAST(p_partkey AS VARCHAR) AS path FROM part"
SUPPLIERS_SQL = "SELECT l_suppkey AS container, l_partkey AS content_id, l_orderkey || '/' || l_linenumber AS path FROM lineitem"
BASKETS_SQL = "SELECT l_orderkey AS container, l_partkey AS content_id, l_orderkey || '/' || l_linenumber AS path FROM lineitem"
USERS_SQL = "SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS container, event_type AS content_id, CAST(event_id AS VARCHAR) AS path FROM events"


def snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two scans: the index of run 1 and what run 2 sees, each event in one of them or both. A user's events of one type play a file, whose size and time come from them."""
    e = table(spark, d, "events").select(F.concat(F.lit("/lib"), (F.col("user_id") % 3).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("path"), F.concat(F.lit("/lib"), (F.col("user_id") % 3).cast("string")).alias("root"), "event_id")
    of = lambda cut: e.where(cut).groupBy("path", "root").agg(F.count("*").alias("size"), F.max("event_id").alias("mtime"), F.md5(F.min("event_id").cast("string")).alias("content_id"))
    old = of("event_id % 200 < 120").withColumns({"status": F.lit("OK"), "first_seen": F.lit(1), "last_seen": F.lit(1), "present": F.lit(True)})
    return old, of("event_id % 200 > 4")


SNAPSHOT_SQL = """
o AS (SELECT '/lib' || user_id % 3 || '/' || user_id || '/' || event_type AS path, '/lib' || user_id % 3 AS root, count(*) AS size, max(event_id) AS mtime, md5(CAST(min(event_id) AS VARCHAR)) AS content_id FROM events WHERE event_id % 200 < 120 GROUP BY ALL),
s AS (SELECT '/lib' || user_id % 3 || '/' || user_id || '/' || event_type AS path, '/lib' || user_id % 3 AS root, count(*) AS size, max(event_id) AS mtime, md5(CAST(min(event_id) AS VARCHAR)) AS content_id FROM events WHERE event_id % 200 > 4 GROUP BY ALL)
"""


def urls(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


URLS_SQL = "SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages"


def roots(spark, d) -> DataFrame:
    """Four small trees of parts by size, for the lattice: a folder, files by brand, one root at odds with another."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 4).cast("int").alias("root"), "p_brand", "p_size")
    files = p.groupBy("root", "p_size").agg(F.md5(F.max("p_brand")).alias("digest"))
    files = files.select("root", F.concat(F.lit("s/"), F.col("p_size").cast("string")).alias("path"), F.lit("REGULAR_FILE").alias("kind"), F.when(F.col("root") < 2, F.md5(F.col("p_size").cast("string"))).otherwise(F.col("digest")).alias("digest"), (F.col("p_size") == 1).alias("is_item"))
    base = spark.range(4).select(F.col("id").cast("int").alias("root")).withColumn("path", F.explode(F.array(F.lit("."), F.lit("s"))))
    folders = base.select("root", "path", F.lit("DIRECTORY").alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(False).alias("is_item"))
    all_ = files.unionByName(folders)
    return all_.withColumn("entry", F.crc32(F.concat_ws(":", F.col("root").cast("string"), "path")))


ROOTS_SQL = """
WITH p AS (SELECT (p_partkey % 4)::INT AS root, p_brand, p_size FROM part)
SELECT root, 's/' || p_size AS path, 'REGULAR_FILE' AS kind, CASE WHEN root < 2 THEN md5(CAST(p_size AS VARCHAR)) ELSE md5(max(p_brand)) END AS digest, p_size = 1 AS is_item
FROM p GROUP BY root, p_size
UNION ALL SELECT r.root::INT, x.path, 'DIRECTORY', NULL, false FROM range(4) r(root), (VALUES ('.'), ('s')) x(path)
"""
