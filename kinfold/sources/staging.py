"""Building a planned tree in a new folder: leases on sources, copies with a running hash, a check of what was built.

targets: path (relative), kind, source (a path; null for folders), sha256 and size of files.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.relations import checkpointed
from kinfold.sources import guarded

COPY = "path string, source string, sha256 string, bytes long, state string"


class NotAdmitted(ValueError):
    """A plan that must not be built."""


def admitted(entries: DataFrame, ledger: DataFrame, conflicts: DataFrame, violations: DataFrame) -> None:
    """Raises unless the plan has entries, no conflicts, a ledger and no violation of its own rules."""
    for what, bad in (("no entries", entries.isEmpty()), ("no ledger", ledger.isEmpty()), ("conflicts", not conflicts.isEmpty()), ("violations", not violations.isEmpty())):
        if bad:
            raise NotAdmitted(what)


def lease(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """path, kind, size, mtime_ns, native_id, sha256 of sources or inputs as they are now; one that can't be read raises."""
    e = checkpointed(guarded.mapped(paths.select("path").distinct(), lambda r: iter([guarded.entry(r["path"])]), guarded.ENTRY))
    if not e.where("kind <> 'REGULAR_FILE' OR status <> 'OK'").isEmpty():
        raise guarded.StaleSource("a source is no regular file")
    read = checkpointed(guarded.refuse_stale(checkpointed(guarded.read_content(e))))
    if not read.where("status <> 'SUCCESS'").isEmpty():
        raise guarded.StaleSource("a source can't be read")
    return checkpointed(e.join(read.select("path", "sha256"), "path"))


def changed(held: DataFrame, rehash: bool = False) -> DataFrame:
    """path of leased files that are no longer what they were, by what the file system says, with rehash also by content."""
    now = guarded.mapped(held.select("path"), lambda r: iter([guarded.entry(r["path"])]), guarded.ENTRY)
    same = ["path", "kind", "size", "mtime_ns", "native_id"]
    out = held.join(now.select(same), same, "left_anti").select("path")
    if rehash:
        read = guarded.read_charts(held.select("path")).select("path", "sha256")
        out = out.union(held.join(read, ["path", "sha256"], "left_anti").select("path")).distinct()
    return out


def aliases(held: DataFrame) -> DataFrame:
    """native_id under which more than one leased path lies."""
    return held.groupBy("native_id").agg(F.count("*").alias("n")).where("n > 1").select("native_id")


def copy_file(source: str, target: str, sha256: str) -> tuple[int, str]:
    """Bytes and state of one copy. It is written beside its place and linked to it, so it appears whole and replaces nothing.

    A task that runs again finds its earlier copy and takes it if the content is right.
    """
    temporary = f"{target}.{uuid.uuid4().hex}.tmp"
    h, n = hashlib.sha256(), 0
    try:
        with open(source, "rb") as a, open(temporary, "xb") as b:
            while part := a.read(guarded.CHUNK):
                h.update(part)
                b.write(part)
                n += len(part)
            b.flush()
            os.fsync(b.fileno())
        if h.hexdigest() != sha256:
            return n, "DIGEST_MISMATCH"
        try:
            os.link(temporary, target)
        except FileExistsError:
            return n, "COPIED" if guarded.guarded_read(target)["sha256"] == sha256 else "EXISTS"
        return n, "COPIED"
    except OSError:
        return n, "FAILED"
    finally:
        if os.path.lexists(temporary):
            os.unlink(temporary)


def build(spark: SparkSession, targets: DataFrame, folder: str) -> DataFrame:
    """Copies of all files of targets into folder, which must be new. COPY for each file."""
    os.makedirs(folder)

    def place(path: str) -> str:
        full = os.path.normpath(os.path.join(folder, path))
        if not full.startswith(folder.rstrip("/") + "/"):
            raise ValueError(f"{path} leaves the folder")
        return full

    def make(r: dict) -> Iterator[dict]:
        full = place(r["path"])
        if r["kind"] == "DIRECTORY":
            os.makedirs(full, exist_ok=True)
            return
        os.makedirs(os.path.dirname(full), exist_ok=True)
        n, state = copy_file(r["source"], full, r["sha256"])
        yield {"path": r["path"], "source": r["source"], "sha256": r["sha256"], "bytes": n, "state": state}

    return checkpointed(guarded.mapped(targets.where("path <> '.'").select("path", "kind", "source", "sha256").repartition("path"), make, COPY))


def inspected(spark: SparkSession, targets: DataFrame, folder: str, held: DataFrame) -> DataFrame:
    """path, code of what is wrong with a built folder: it is listed and hashed anew, whatever the copies said.

    UNEXPECTED, MISSING, KIND, SIZE, DIGEST, ALIAS (a link to another file of the folder or to a leased source). Empty
    if the folder is the plan.
    """
    base = folder.rstrip("/") + "/"
    there = guarded.walk(spark, [folder]).where(F.col("path") != folder.rstrip("/"))
    read = guarded.read_charts(there.where("kind = 'REGULAR_FILE'").select("path")).select("path", F.col("sha256").alias("own"))
    there = there.join(read, "path", "left").withColumn("path", F.substr("path", F.lit(len(base) + 1))).withColumnsRenamed({"kind": "own_kind", "size": "own_size"}).drop("status", "mtime_ns")
    sources = held.select("native_id").distinct().withColumn("leased", F.lit(True))
    there = there.join(sources, "native_id", "left")
    want = targets.where("path <> '.'").select("path", "kind", "size", "sha256")
    x = want.join(there, "path", "full_outer")
    file = F.col("kind") == "REGULAR_FILE"
    code = (
        F.when(F.col("kind").isNull(), "UNEXPECTED").when(F.col("own_kind").isNull(), "MISSING").when(F.col("kind") != F.col("own_kind"), "KIND")
        .when(file & ((F.col("links") != 1) | F.col("leased")), "ALIAS").when(file & ~F.col("size").eqNullSafe(F.col("own_size")), "SIZE")
        .when(file & ~F.col("sha256").eqNullSafe(F.col("own")), "DIGEST")
    )
    return x.select("path", code.alias("code")).where("code IS NOT NULL")
