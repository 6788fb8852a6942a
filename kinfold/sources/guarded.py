"""Reads and listings that turn failures into rows: a file that vanishes or can't be read is a status, not a failed job.

Paths are those of a file system that driver and executors share. Links are named and never followed.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import columns as C
from kinfold.operators.relations import checkpointed

ENTRY = "path string, kind string, size long, mtime_ns long, native_id string, links long, status string"
READ = "path string, size_before long, mtime_before long, size_after long, mtime_after long, sha256 string, md5 string, bytes long, attempts int, status string"
CHUNK = 1 << 16
ATTEMPTS = 2
# Fixed values of the file format: magic, and the write and read versions of rollback journals.
DATABASE_MAGIC = b"SQLite format 3\0"
ROLLBACK = b"\x01\x01"


class StaleSource(RuntimeError):
    """A source is no longer what was accepted."""


class TooDeep(ValueError):
    """Folders nest deeper than a walk may go."""


def facts(path: str) -> dict:
    """What the file system says of a path, links not followed. Raises OSError."""
    s = os.lstat(path)
    kind = "REPARSE" if stat.S_ISLNK(s.st_mode) else "DIRECTORY" if stat.S_ISDIR(s.st_mode) else "REGULAR_FILE" if stat.S_ISREG(s.st_mode) else "OTHER"
    return {"path": path, "kind": kind, "size": s.st_size if kind == "REGULAR_FILE" else None, "mtime_ns": s.st_mtime_ns, "native_id": f"{s.st_dev:x}:{s.st_ino:x}", "links": s.st_nlink, "status": "OK"}


def failed(path: str, status: str) -> dict:
    return {"path": path, "kind": "UNKNOWN", "size": None, "mtime_ns": None, "native_id": None, "links": None, "status": status}


def entry(path: str) -> dict:
    try:
        return facts(path)
    except OSError:
        return failed(path, "METADATA_ERROR")


def children(folder: str) -> Iterator[dict]:
    """The entries of a folder, or one row that says that they can't be listed."""
    try:
        names = sorted(os.listdir(folder))
    except OSError:
        yield failed(folder, "ENUMERATION_ERROR")
        return
    for n in names:
        yield entry(os.path.join(folder, n))


def mapped(df: DataFrame, rows: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """For each row of df the rows that `rows` gives, as Arrow batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            held = []
            for r in b.to_pylist():
                for out in rows(r):
                    held.append(out)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.mapInArrow(run, schema)


def walk(spark: SparkSession, roots: list[str], most_depth: int = 128) -> DataFrame:
    """Every entry at and below the top-most of the roots.

    Folders are listed level by level, those of a level in parallel, so one wide root is no single task. A root inside
    another is not listed twice. A folder that can't be listed keeps its own row and adds one with ENUMERATION_ERROR.
    """
    top = sorted({r.rstrip("/") or "/" for r in roots})
    top = [r for r in top if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in top)]
    level = checkpointed(mapped(spark.createDataFrame([(r,) for r in top], "path string"), lambda r: iter([entry(r["path"])]), ENTRY))
    found = level
    for _ in range(most_depth):
        folders = level.where("kind = 'DIRECTORY'").select("path")
        if folders.isEmpty():
            return found
        level = checkpointed(mapped(folders.repartition("path"), lambda r: children(r["path"]), ENTRY))
        found = found.unionByName(level)
    if level.where("kind = 'DIRECTORY'").isEmpty():
        return found
    raise TooDeep(f"folders nest deeper than {most_depth}")


def hashed(path: str) -> tuple[str, str, int]:
    h, m, n = hashlib.sha256(), hashlib.md5(usedforsecurity=False), 0
    with open(path, "rb", opener=lambda p, flags: os.open(p, flags | os.O_NOFOLLOW)) as f:
        while part := f.read(CHUNK):
            h.update(part)
            m.update(part)
            n += len(part)
    return h.hexdigest(), m.hexdigest(), n


def guarded_read(path: str, attempts: int = ATTEMPTS) -> dict:
    """One row of READ: the digest counts only if the file was the same before, during and after the read."""
    out = dict.fromkeys(("size_before", "mtime_before", "size_after", "mtime_after", "sha256", "md5")) | {"path": path, "bytes": 0, "attempts": 0, "status": "UNSTABLE"}
    try:
        for k in range(1, attempts + 1):
            before = facts(path)
            out |= {"attempts": k, "size_before": before["size"], "mtime_before": before["mtime_ns"]}
            if before["kind"] != "REGULAR_FILE":
                return out | {"status": "REPARSE"}
            digest, md5, n = hashed(path)
            after = facts(path)
            out |= {"bytes": out["bytes"] + n, "size_after": after["size"], "mtime_after": after["mtime_ns"]}
            if before == after and n == before["size"]:
                return out | {"sha256": digest, "md5": md5, "status": "SUCCESS"}
    except FileNotFoundError:
        return out | {"status": "MISSING"}
    except NotADirectoryError:
        return out | {"status": "MISSING"}
    except OSError:
        return out | {"status": "UNREADABLE"}
    return out


def read_charts(paths: DataFrame) -> DataFrame:
    """paths (path) -> READ: SUCCESS, MISSING, REPARSE, UNREADABLE or UNSTABLE for each."""
    return mapped(paths.select("path"), lambda r: iter([guarded_read(r["path"])]), READ)


def read_content(expected: DataFrame) -> DataFrame:
    """expected (rows of ENTRY) -> READ with SUCCESS, ERROR, UNSTABLE, or STALE where the entry is no longer the accepted one."""

    def one(r: dict) -> Iterator[dict]:
        want = {k: r[k] for k in ("kind", "size", "mtime_ns", "native_id")}

        def same() -> bool:
            try:
                now = facts(r["path"])
            except OSError:
                return False
            return want["kind"] == "REGULAR_FILE" and all(now[k] == v for k, v in want.items())

        out = dict.fromkeys(("size_before", "mtime_before", "size_after", "mtime_after", "sha256", "md5")) | {"path": r["path"], "bytes": 0, "attempts": 0, "status": "STALE"}
        if same():
            out = guarded_read(r["path"])
            out["status"] = "STALE" if not same() else "ERROR" if out["status"] == "UNREADABLE" else out["status"]
        yield out if out["status"] == "SUCCESS" else out | {"sha256": None, "md5": None}

    return mapped(expected.select("path", "kind", "size", "mtime_ns", "native_id"), one, READ)


def refuse_stale(reads: DataFrame) -> DataFrame:
    """reads, or StaleSource if any entry has changed since it was accepted."""
    bad = reads.where("status = 'STALE'").agg(F.count("*").alias("n"), F.min("path").alias("path")).first()
    if bad.n:
        raise StaleSource(f"{bad.n} sources have changed, {bad.path} first")
    return reads


def database_header(head) -> C.Column:
    """OK, or why the first bytes of a file are no header of a database with a rollback journal: SHORT, MAGIC, JOURNAL."""
    return (
        F.when(head.isNull() | (F.octet_length(head) < 100), "SHORT").when(F.substring(head, 1, 16) != F.lit(DATABASE_MAGIC), "MAGIC")
        .when(F.substring(head, 19, 2) != F.lit(ROLLBACK), "JOURNAL").otherwise("OK")
    )
