"""Sources: trees of files, run snapshots, strict CSV and JSON reports. Schemas are explicit, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinfold.functions import columns as C
from kinfold.functions.python import json_duplicate_key

ITEM_EXTENSIONS = (".bms", ".bme", ".bml", ".pms", ".bmson")
ITEMS = "path string, root string, container string, name string, extension string, size long, mtime timestamp, md5 string, content_id string, status string, present boolean, first_seen long, last_seen long"
DUPLICATES = "sha256 string, md5 string, group_paths int, root_id long, absolute_path string, parent_folder string, filename string, extension string, size long, mtime_utc string"
CANDIDATES = "folder_a string, folder_b string, physical_files_a int, physical_files_b int, charts_a int, charts_b int, common int, coverage_a double, coverage_b double, jaccard double, relationship string"
CLUSTERS = "kind string, cluster_id string, folder_count int, folder_path string"


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime, content of every file under root; links are not followed by the file source."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def stats(files: DataFrame) -> DataFrame:
    """Without content: the reader then lists files and opens none."""
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def items(files: DataFrame, root: str, run_id: int, extensions=ITEM_EXTENSIONS) -> DataFrame:
    """The item index of a tree: files with these extensions (case-blind), digests of their bytes, container and name."""
    path = F.regexp_replace(C.slashes(F.col("path")), "^file:/+", "/")
    x = files.select(path.alias("path"), "length", "modificationTime", "content")
    x = x.withColumn("extension", C.extension(F.col("path"))).where(F.col("extension").isin(*extensions))
    return x.select(
        "path", F.lit(root).alias("root"), C.parent(F.col("path")).alias("container"), C.name(F.col("path")).alias("name"), "extension",
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("content_id"),
        F.lit("OK").alias("status"), F.lit(True).alias("present"), F.lit(run_id).cast("long").alias("first_seen"), F.lit(run_id).cast("long").alias("last_seen"),
    )


def stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, stable: whether size and time of a file are the same in two listings around a read."""
    b = before.select("path", F.struct("size", "mtime").alias("b"))
    return b.join(after.select("path", F.struct("size", "mtime").alias("a")), "path", "left").select("path", F.col("a").eqNullSafe(F.col("b")).alias("stable"))


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that must have exactly this schema, nullability aside."""
    df = spark.read.parquet(path)
    want = [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema)]
    if df.dtypes != want:
        raise ValueError(f"{path}: schema is {df.dtypes}, expected {want}")
    return df


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header and types must match; a row that doesn't fit fails the read."""
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def csv_form(files: DataFrame, header: str) -> DataFrame:
    """path, code of what is wrong with a CSV file as bytes: NOT_UTF8, BOM, CR, NO_FINAL_LF, WRONG_HEADER."""
    text = F.decode(F.col("content"), "ISO-8859-1")  # a letter for each byte
    rules = [
        (~F.is_valid_utf8(F.col("content").cast("string")), "NOT_UTF8"), (text.startswith("ï»¿"), "BOM"), (text.contains("\r"), "CR"),
        (~text.endswith("\n"), "NO_FINAL_LF"), (F.substring_index(text, "\n", 1) != header, "WRONG_HEADER"),
    ]
    return files.select("path", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in rules]))).alias("code"))


def json_report(files: DataFrame, schema: str) -> DataFrame:
    """path, value, code: a report of exactly these fields, or why it isn't one (DUPLICATE_KEY, INVALID, UNKNOWN_FIELD)."""
    text = F.col("content").cast("string")
    fields = F.array(*[F.lit(f.name) for f in StructType.fromDDL(schema)])
    twice = json_duplicate_key(text)
    keys = F.json_object_keys(text)
    code = F.when(twice.isNull() | keys.isNull(), "INVALID").when(twice != "", "DUPLICATE_KEY").when(F.size(F.array_except(keys, fields)) > 0, "UNKNOWN_FIELD").when(F.size(F.array_except(fields, keys)) > 0, "MISSING_FIELD")
    return files.select("path", F.from_json(text, schema).alias("value"), code.alias("code"))


def bindings(files: DataFrame) -> DataFrame:
    """path, bytes, sha256 of report files."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
