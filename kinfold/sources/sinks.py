"""Sinks: write-once runs, CSV and JSON reports, receipts."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.python import dotnet_double
from kinfold.sources import files


def write_run(df: DataFrame, folder: str, run_id: int, *partition: str) -> str:
    """df as Parquet in folder/run=<id>; a run that exists is never written again."""
    path = f"{folder}/run={run_id}"
    df.write.mode("errorifexists").partitionBy(*partition).parquet(path)
    return path


STORE = {"owner": "kinfold", "version": 1, "path_comparison": "ordinal"}


class ForeignStore(ValueError):
    """A folder of runs that is another program's, of another version, or compares paths in another way."""


def claim_store(spark: SparkSession, store: str) -> None:
    """Marks a new or empty folder as a store of ours; any other folder must bear that mark already."""
    jvm = spark._jvm
    own = jvm.org.apache.hadoop.fs.Path(store, "_meta.json")
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(own):
        stream = fs.open(own)
        try:
            found = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            raise ForeignStore(f"{own} is no JSON") from None
        finally:
            stream.close()
        wrong = [k for k, v in STORE.items() if found.get(k) != v]
        if wrong:
            raise ForeignStore(f"{own}: {wrong[0]} is {found.get(wrong[0])!r}")
        return
    if fs.exists(own.getParent()) and any(s.getPath().getName() != "_writer.lock" for s in fs.listStatus(own.getParent())):
        raise ForeignStore(f"{store} holds files but no _meta.json")
    stream = fs.create(own, False)
    try:
        stream.write(bytearray(json.dumps(STORE).encode()))
    finally:
        stream.close()


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """CSV with LF, quotes only where needed, numbers as .NET writes them, in order.

    A report that people read is one file for as long as it is small; a sort over ranges leaves one file a range and
    file names in order.
    """
    out = df.orderBy(*order)
    for name, kind in df.dtypes:
        if kind == "double":
            out = out.withColumn(name, dotnet_double(name))
        elif kind == "boolean":
            out = out.withColumn(name, F.col(name).cast("string"))
    out.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\n").option("emptyValue", "").csv(path)


def write_csv_file(df: DataFrame, path: str, *order: str) -> None:
    """As write_csv, in one file with one header: the sorted parts are written by the executors and then streamed together."""
    spark = df.sparkSession
    jvm, parts = spark._jvm, path + ".parts"
    write_csv(df, parts, *order)
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(place(parts)) if s.getPath().getName().startswith("part-"))
    header = (",".join(df.columns) + "\n").encode()
    out = fs.create(place(path), False)
    try:
        out.write(bytearray(header))
        for n in names:
            own = fs.open(place(f"{parts}/{n}"))
            try:
                if fs.getFileStatus(place(f"{parts}/{n}")).getLen() > len(header):
                    own.seek(len(header))
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 16, False)
            finally:
                own.close()
    finally:
        out.close()
    fs.delete(place(parts), True)


def publish_json(value: dict, path: str) -> None:
    """A small JSON document, written beside its place and linked to it: it appears whole, and never replaces another."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".tmp-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.link(temporary, path)
    finally:
        os.unlink(temporary)


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256 of every file of a report folder, read back."""
    return files.bindings(files.tree(spark, folder))
