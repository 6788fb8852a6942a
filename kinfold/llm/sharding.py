"""Sharding along a Hilbert curve: metadata dimensions quantised, rows sorted by curve index, runs cut into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
BITS = 4


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a point on the Hilbert curve of len(point) dimensions (Skilling, Programming the Hilbert curve, 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in reversed(range(bits)):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


def curve(dims: list, bits: int = BITS):
    """The index as a Column: a look-up in the table of all cells, whose size is 2 ** (bits * dimensions)."""
    n = len(dims)
    cells = range(1 << (bits * n))
    table = [hilbert_index(tuple(c >> (bits * (n - 1 - i)) & ((1 << bits) - 1) for i in range(n)), bits) for c in cells]
    cell = F.lit(0)
    for d in dims:
        cell = cell * (1 << bits) + d
    return F.element_at(F.split(F.lit(",".join(map(str, table))), ","), (cell + 1).cast("int")).cast("int")


def code(column: str):
    """The whole value as text that sorts by its bytes; null is empty and comes first."""
    return F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit(""))


def cuts(df: DataFrame, dim: str, rows: str, bits: int = BITS) -> list:
    """The distinct values of dim at which the quantiles of the rows lie, each value of df standing for `rows` of them, and the quantiles up to it.

    Values are counted map-side and sorted by range; of each, the rows before it are found from the sums of the
    partitions. The driver gets 2**bits - 1 values at most.
    """
    values = df.groupBy(dim).agg(F.sum(rows).alias("n")).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), dim)
    values = common.checkpointed(values.withColumn("part", F.spark_partition_id()))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = values.groupBy("part").agg(F.sum("n").alias("own")).withColumn("start", F.coalesce(F.sum("own").over(above), F.lit(0)))
    total = parts.agg(F.sum("own")).first()[0]
    if not total:
        return []
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy(dim).rowsBetween(Window.unboundedPreceding, 0))
    v = values.join(F.broadcast(parts.select("part", "start")), "part").withColumn("upto", upto)  # a row for each partition
    v = v.withColumn("before", F.col("upto") - F.col("n"))
    # quantile i lies in the value with before < i * total / 2**bits <= upto
    passed = lambda c: F.expr(f"LEAST(CAST({c} AS DECIMAL(30, 0)) * {1 << bits} DIV {total}, {(1 << bits) - 1})")
    return [(r[0], r[1]) for r in v.where(passed("upto") > passed("before")).select(dim, passed("upto").cast("int")).orderBy(dim).collect()]


def quantised(df: DataFrame, dims: list[str], rows: str, bits: int = BITS) -> DataFrame:
    """df with q_<dim>, 0 to 2**bits - 1: the number of quantiles, over all rows that df stands for, that the value passes."""
    out = df
    for d in dims:
        found = cuts(df, d, rows, bits)
        # a value that holds many quantiles is a step of as many
        steps = [F.when(F.col(d) > F.lit(c), n - before).otherwise(0) for (c, n), before in zip(found, [0, *(n for _, n in found)])]
        out = out.withColumn(f"q_{d}", sum(steps, F.lit(0)))
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve, source, lang for each row of docs.

    Law `rows`: shard s holds the ranks from ceil(s N / shards) on, so counts differ by one at most. Dimensions are
    source, lang and size, each the smallest among the rows of equal text: copies lie side by side, in one shard
    unless a cut or the size of their group forbids. Null text is empty, null source and lang come first. Repeated
    rows each get a slot; ties on the curve go by a hash of the text, then by doc_id. A text of any length is its hash and
    size here. No rows give no rows; extra columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_key"), "source", "lang")
    d = common.checkpointed(d)
    groups = d.groupBy("text_key", "size").agg(F.min(code("source")).alias("source"), F.min(code("lang")).alias("lang"), F.count("*").alias("copies"))
    groups = quantised(common.checkpointed(groups), ["source", "lang", "size"], "copies", bits)
    groups = groups.select("text_key", "size", curve([F.col("q_source"), F.col("q_lang"), F.col("q_size")], bits).alias("curve"))
    laid = d.join(groups, ["text_key", "size"])
    laid = common.ranked(common.checkpointed(laid), [], ["curve", "text_key", "size", "doc_id"])
    n = laid.count()
    shard = F.expr(f"CAST(rank * {shards} DIV {max(n, 1)} AS INT)")
    first = F.expr(f"(shard * {n}L + {shards - 1}) DIV {shards}")
    return laid.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "source", "lang"
    )


def shard_ranges(laid: DataFrame, dims: list[str]) -> DataFrame:
    """shard, n and for each dimension low_<dim> and high_<dim>: what a reader needs to leave files out. Nulls don't widen a range."""
    return laid.groupBy("shard").agg(F.count("*").alias("n"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("low", F.min), ("high", F.max))])


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(common.table(spark, sf_dir, "documents"))
