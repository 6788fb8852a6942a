"""Shared pieces of the training-data operators: table readers, Arrow slicing, checkpoints, distributed ranks and sketches."""

from __future__ import annotations

import ctypes
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch on its way to Python, of a slice of it, and of a piece of a text that arrays are made of.
ARROW_BYTES = 2 << 20
SLICE_BYTES = 1 << 20
PIECE_BYTES = 1 << 18
SLICE_CELLS = 1 << 16
MERGED_AT_ONCE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own where it is unset, as in tests."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="kinfold-checkpoint-"))
    return where or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder, so that lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def id_kind(docs: DataFrame, column: str = "doc_id") -> str:
    """The type of the id column as DDL, for the schema of a function over Arrow batches."""
    return docs.schema[column].dataType.simpleString()


def arrow_kind(docs: DataFrame, column: str = "doc_id") -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)


def in_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """df.mapInArrow(fn, schema) with batches cut at ARROW_BYTES before they are built; a longer row makes one of its own.

    The session's bound by bytes is lowered for that and never raised, as a bound by rows holds no memory of long texts.
    A worker gives what it doesn't use back after each partition.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))

    def lean(batches):
        try:
            yield from fn(batches)
        finally:
            given_back()

    return df.mapInArrow(lean, schema)


def given_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where the text of a slice would pass `most` bytes; one long text makes a slice of its own."""
    for batch in batches:
        lengths = np.nan_to_num(pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False).astype("float64"))
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
    return [v or b"" for v in values]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return [v or "" for v in batch.column(batch.schema.get_field_index(column)).to_pylist()]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES.encode())] = True
PLACES = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word, the number of words of each text, the number of code points in words of each text.

    A word's hash is the mixed sum of its bytes, each times an odd number drawn for its place in the word. The bytes
    are taken in pieces of PIECE_BYTES that end between words, so that a long text costs eight bytes a word, and
    only a word longer than a piece more than that.
    """
    blob = b"\n".join(texts) + b"\n"
    data = np.frombuffer(blob.lower() if lower else blob, np.uint8)  # bytes.lower() is A-Z only
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    hashes, counts, points = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    lo = 0
    while lo < len(data) and len(texts):
        hi = lo + PIECE_BYTES
        while hi < len(data) and not IS_SPACE[data[hi - 1]]:
            more = np.nonzero(IS_SPACE[data[hi : hi + PIECE_BYTES]])[0]
            hi += int(more[0]) + 1 if len(more) else PIECE_BYTES
        hi = min(hi, len(data))
        start, own, inside = piece_words(data[lo:hi])
        t0, t1 = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(ends, hi, side="left"))
        stops = np.minimum(ends[t0 : t1 + 1], hi) - lo
        counts[t0 : t0 + len(stops)] += np.diff(np.r_[0, np.searchsorted(start, stops)])
        points[t0 : t0 + len(stops)] += np.diff(np.r_[0, np.cumsum(inside & (data[lo:hi] & 0xC0 != 0x80), dtype=np.int32)[stops - 1]])
        hashes.append(own)
        lo = hi
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts, points


def piece_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of these bytes start, their hashes, and which bytes lie in words."""
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    start = np.nonzero(first)[0]
    if not len(start):
        return start, np.zeros(0, np.uint64), inside
    at = np.nonzero(inside)[0]
    head = np.searchsorted(at, start)
    length = np.diff(np.r_[head, len(at)])
    place = at - np.repeat(start, length)
    value = data[at].astype(np.uint64) + np.uint64(1)
    longest = int(length.max())
    table = PLACES if longest <= len(PLACES) else np.r_[PLACES, mix(np.arange(len(PLACES), longest, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)]
    value *= table[place]
    return start, mix(np.add.reduceat(value, head)), inside


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each run of `width` words that lies in one text."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashes[:n] * PLACES[0]
    for i in range(1, width):
        h += hashes[i : n + i] * PLACES[i]
    inside = np.ones(n, bool)
    ends = np.cumsum(counts)
    for i in range(1, width):
        cut = ends[:-1] - i
        inside[cut[(cut >= 0) & (cut < n)]] = False
    start = np.nonzero(inside)[0]
    return start, mix(h[start])


def text_crc(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(column: str = "doc_id"):
    """True for the fold that no model learns from: crc32 of doc_id as text is divisible by 5. A null id is in it."""
    return F.coalesce(text_crc(column) % 5 == 0, F.lit(True))


def small_or_not(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most `most_rows` rows by count; beyond that Spark joins by shuffle and splits skewed keys."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def ranked(df: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with `rank`, the row's number from 0 among its group in the given order.

    Sorted by range over (group, order), so a group of any size is spread over many tasks; a table of rows per
    partition and group turns numbers within a partition into ranks. JVM operators only. The range is found from a
    sample, so df is evaluated twice: give a checkpointed df if that costs much.
    Null order values come first. Rows equal in all of `order` get an arbitrary order among themselves.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    laid = checkpointed(laid.withColumn("_part", F.shiftright("_at", 33)))
    runs = laid.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_part")
    before = (Window.partitionBy(*group) if group else before).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    runs = checkpointed(runs).withColumnsRenamed({k: f"_r{k}" for k in ("_part", *group)})
    same = F.col("_part") == F.col("_r_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_r{g}"))
    return laid.join(small_or_not(runs, 200_000), same).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, "rank")


def running(df: DataFrame, order: list[str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """df with `rank`, the row's number from 0 in the order, and for each name: column of `sums` the sum over all rows before.

    As ranked(): a range sort, then a table of sums by partition; no task sees more than its partition. Rows should
    differ in `order`, nulls come first.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = checkpointed(laid.withColumn("_part", F.shiftright("_at", 33)))
    cols = {"rank": F.lit(1), **{name: F.col(c) for name, c in sums.items()}}
    totals = laid.groupBy("_part").agg(*[F.sum(c).alias(f"_t{name}") for name, c in cols.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t{name}").over(before), F.lit(0)).alias(f"_b{name}") for name in cols])
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = laid.join(F.broadcast(totals), F.col("_part") == F.col("_p"))  # at most n rows
    return out.select(*df.columns, *[(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_b{name}")).alias(name) for name, c in cols.items()])


def merged(parts: DataFrame, cells: int, merge=np.add) -> np.ndarray:
    """Many arrays of `cells` uint32, given as rows of cut_up(), merged into one.

    Slices are merged in parallel, in groups first where there are many; the driver gets one array of a fixed size.
    """

    def fold(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = unpacked(raw)
                held[k] = merge(held[k], part) if k in held else part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([shrunk(v) for v in held.values()], pa.binary())], names=["slice", "cells"])

    if parts.rdd.getNumPartitions() > MERGED_AT_ONCE:  # each of these tasks takes the slices of a part of all tasks
        group = F.pmod(F.spark_partition_id(), F.lit(MERGED_AT_ONCE))
        parts = in_arrow(parts.withColumn("_group", group).repartition("slice", "_group").select("slice", parts.columns[1]), fold, "slice int, cells binary")
    out = np.zeros(cells, np.uint32)
    for r in in_arrow(parts.repartition("slice"), fold, "slice int, cells binary").collect():
        part = unpacked(bytes(r.cells))
        out[r.slice * SLICE_CELLS : r.slice * SLICE_CELLS + len(part)] = part
    return out


def shrunk(cells: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(cells, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def cut_up(cells: np.ndarray) -> pa.RecordBatch:
    """An array of uint32 as rows (slice int, cells binary), compressed byte plane by byte plane."""
    n = -(-len(cells) // SLICE_CELLS)
    packed = [shrunk(cells[i * SLICE_CELLS : (i + 1) * SLICE_CELLS]) for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "cells"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
