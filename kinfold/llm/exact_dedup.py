"""Exact dedup by an index of live digests, dealt in shards: each has a cuckoo filter and bucketed content behind it.

A digest that the filter doesn't know is new. A hit is looked up in its content bucket, which tells a copy from a
fingerprint met by chance. A filter that overflows is built anew, twice as large, from the shard's stored keys. The index
is a table in the shared folder; insertion and deletion read it shard by shard and write the next version.
"""

from __future__ import annotations

import random
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A filter's bucket has so many slots of 16 bits; a key is pushed on at most so often before the filter counts as full.
SLOTS, KICKS = 4, 400
FIRST_BUCKETS = 1 << 8
#: Rows that a shard is sized for: what a task holds at a time is one shard.
SHARD_ROWS = 1 << 17
CONTENT_BUCKETS = 1 << 14
#: Rows of one map task that are combined by digest before they are shuffled.
COMBINED_ROWS = 1 << 16
#: Groups of so many rows join apart from the others: broadcast if few, else dealt over so many salts.
HOT_ROWS, HOT_GROUPS, SALTS = 4096, 100_000, 64
FILTER, CONTENT, DELETE, INSERT, PROBE = range(5)


def spread(x: int) -> int:
    return (x * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20


class Cuckoo:
    """A set of 64-bit keys by 16-bit fingerprints. May answer yes for a key it doesn't hold, never no for one it holds.

    Deletion is right only for a key that was inserted; give no key twice.
    """

    def __init__(self, buckets: int = FIRST_BUCKETS, raw: bytes | None = None):
        self.slots = array("H", raw if raw is not None else bytes(2 * SLOTS * buckets))
        self.mask = len(self.slots) // SLOTS - 1
        self.random = random.Random(self.mask)

    def places(self, key: int) -> tuple[int, int, int]:
        print_ = (key >> 48) % 0xFFFF + 1
        first = key & self.mask
        return print_, first, first ^ (spread(print_) & self.mask)

    def __contains__(self, key: int) -> bool:
        print_, a, b = self.places(key)
        return print_ in self.slots[a * SLOTS : a * SLOTS + SLOTS] or print_ in self.slots[b * SLOTS : b * SLOTS + SLOTS]

    def put(self, bucket: int, print_: int, now: int = 0) -> bool:
        """Write print_ over a slot of the bucket that holds `now` (0: a free one)."""
        for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.slots[s] == now:
                self.slots[s] = print_
                return True
        return False

    def insert(self, key: int) -> bool:
        """False if the filter overflows; then it holds every other key still, with this one or one of them left out."""
        print_, a, b = self.places(key)
        if self.put(a, print_) or self.put(b, print_):
            return True
        at = self.random.choice((a, b))
        for _ in range(KICKS):
            s = at * SLOTS + self.random.randrange(SLOTS)
            print_, self.slots[s] = self.slots[s], print_
            at ^= spread(print_) & self.mask
            if self.put(at, print_):
                return True
        return False

    def delete(self, key: int) -> None:
        print_, a, b = self.places(key)
        if not self.put(a, 0, print_):
            self.put(b, 0, print_)


class Shard:
    """Live digests with the largest id and the number of rows of each; dead entries are None."""

    def __init__(self, filter_: bytes | None = None):
        self.filter = Cuckoo(raw=filter_)
        self.keys: list[bytes | None] = []
        self.keep, self.n, self.content = [], [], {}
        self.resized = self.chance = 0

    @staticmethod
    def key(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little")

    def stored(self, digest: bytes, keep, n: int) -> None:
        self.content.setdefault(int.from_bytes(digest[8:10], "little") % CONTENT_BUCKETS, []).append(len(self.keys))
        self.keys.append(digest)
        self.keep.append(keep)
        self.n.append(n)

    def find(self, digest: bytes) -> int | None:
        if self.key(digest) not in self.filter:
            return None
        for k in self.content.get(int.from_bytes(digest[8:10], "little") % CONTENT_BUCKETS, ()):
            if self.keys[k] == digest:
                return k
        self.chance += 1
        return None

    def insert(self, digest: bytes, keep, n: int) -> None:
        k = self.find(digest)
        if k is not None:
            self.n[k] += n
            if keep is not None and (self.keep[k] is None or keep > self.keep[k]):
                self.keep[k] = keep
            return
        self.stored(digest, keep, n)
        if not self.filter.insert(self.key(digest)):
            self.resize()

    def resize(self) -> None:
        """A filter of twice the buckets, or more, from the stored keys."""
        buckets = 2 * (self.filter.mask + 1)
        while True:
            self.resized += 1
            self.filter = Cuckoo(buckets)
            if all(self.filter.insert(self.key(d)) for d in self.keys if d is not None):
                return
            buckets *= 2

    def delete(self, digest: bytes) -> None:
        k = self.find(digest)
        if k is not None:
            self.filter.delete(self.key(digest))
            self.content[int.from_bytes(digest[8:10], "little") % CONTENT_BUCKETS].remove(k)
            self.keys[k] = None


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the whole text in UTF-8, null as empty) of each row."""
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"))


def combined(rows: DataFrame) -> DataFrame:
    """digest, keep, n: rows of equal digest that meet in a task made one, so that a hot text is few rows to the shuffle."""
    kind = common.arrow_kind(rows)

    def combine(batches):
        groups: dict[bytes, list] = {}
        taken = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(groups, pa.binary()), pa.array([g[0] for g in groups.values()], kind), pa.array([g[1] for g in groups.values()], pa.int64())], names=["digest", "keep", "n"])

        for b in batches:
            for doc_id, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = groups.get(digest)
                if g is None:
                    groups[digest] = [doc_id, 1]
                else:
                    g[1] += 1
                    if doc_id is not None and (g[0] is None or doc_id > g[0]):
                        g[0] = doc_id
            taken += b.num_rows
            if taken >= COMBINED_ROWS:
                yield out()
                groups, taken = {}, 0
        if groups:
            yield out()

    return common.in_arrow(rows.select("doc_id", "digest"), combine, f"digest binary, keep {common.id_kind(rows)}, n long")


def shard_of(shards: int):
    """By a hash of its own, so that a shard's digests differ in all bits that its filter and buckets look at."""
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def dealt(df: DataFrame) -> DataFrame:
    """Rows by shard in one task each, the filter first, then content, deletions, insertions."""
    return df.repartition("shard").sortWithinPartitions("shard", "kind")


def by_shard(batches) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Runs of rows (kind, digest, keep, n, filter) of one shard each."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    row = next(rows, None)
    while row is not None:
        shard = row[0]

        def run():
            nonlocal row
            while row is not None and row[0] == shard:
                yield row[1:]
                row = next(rows, None)

        yield shard, run()


class Index:
    """The live digests of some documents, in a table of the shared folder."""

    def __init__(self, spark: SparkSession, folder: str, shards: int, id_kind: str):
        self.spark, self.folder, self.shards, self.id_kind = spark, folder, shards, id_kind

    @classmethod
    def build(cls, rows: DataFrame, shards: int | None = None) -> Index:
        """The index of the digests of rows: doc_id, digest."""
        spark = rows.sparkSession
        shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_ROWS))
        return cls(spark, "", shards, common.id_kind(rows)).next(inserts=rows)

    def table(self) -> DataFrame:
        kept = self.spark.read.schema(f"shard int, kind int, digest binary, keep {self.id_kind}, n long, filter binary").parquet(self.folder)
        return kept.select("shard", "kind", "digest", "keep", "n", "filter")  # a column that files are parted by comes last

    def content(self) -> DataFrame:
        """shard, digest, keep, n of each live digest."""
        return self.table().where(F.col("kind") == CONTENT).select("shard", "digest", "keep", "n")

    def insert(self, rows: DataFrame) -> Index:
        return self.next(inserts=rows)

    def delete(self, rows: DataFrame) -> Index:
        """Without the digests of rows, whatever documents hold them; digests that are not live change nothing."""
        return self.next(deletes=rows)

    def next(self, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> Index:
        """The next version, with the deletions made before the insertions."""
        kind = None
        parts = [self.table()] if self.folder else []
        for what, rows in ((DELETE, deletes), (INSERT, inserts)):
            if rows is not None:
                kind = kind or common.arrow_kind(rows)
                keep = F.col("keep") if what == INSERT else F.lit(None)
                parts.append(combined(rows).select(shard_of(self.shards).alias("shard"), F.lit(what).alias("kind"), "digest", keep.cast(self.id_kind).alias("keep"), "n", F.lit(None).cast("binary").alias("filter")))
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        names = ["shard", "kind", "digest", "keep", "n", "filter"]

        def change(batches):
            for number, run in by_shard(batches):
                shard = Shard()
                for what, digest, keep, n, filter_ in run:
                    if what == FILTER:
                        shard.filter = Cuckoo(raw=filter_)
                    elif what == CONTENT:
                        shard.stored(digest, keep, n)
                    elif what == DELETE:
                        shard.delete(digest)
                    else:
                        shard.insert(digest, keep, n)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([FILTER], pa.int32()), pa.array([None], pa.binary()), pa.array([None], kind), pa.array([0], pa.int64()), pa.array([shard.filter.slots.tobytes()], pa.binary())], names=names)
                live = [k for k, d in enumerate(shard.keys) if d is not None]
                for at in range(0, len(live), 1 << 14):
                    some = live[at : at + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(some), pa.int32()), pa.array([CONTENT] * len(some), pa.int32()), pa.array([shard.keys[k] for k in some], pa.binary()), pa.array([shard.keep[k] for k in some], kind), pa.array([shard.n[k] for k in some], pa.int64()), pa.nulls(len(some), pa.binary())], names=names)

        folder = f"{common.shared_folder(self.spark)}/digests-{uuid.uuid4().hex}"
        out = common.in_arrow(dealt(all_), change, f"shard int, kind int, digest binary, keep {self.id_kind}, n long, filter binary")
        out.write.partitionBy("kind").parquet(folder)
        return Index(self.spark, folder, self.shards, self.id_kind)

    def hits(self, rows: DataFrame) -> DataFrame:
        """digest, keep, n of the live digests among those of rows: only what the filters let pass is looked up in the content."""
        probes = combined(rows).select(shard_of(self.shards).alias("shard"), F.lit(PROBE).alias("kind"), "digest", F.lit(None).cast("binary").alias("filter"))
        filters = self.table().where(F.col("kind") == FILTER).select("shard", "kind", "digest", "filter")

        def probe(batches):
            for _, run in by_shard(batches):
                filter_, passed = Cuckoo(), set()
                for what, digest, raw in run:
                    if what == FILTER:
                        filter_ = Cuckoo(raw=raw)
                    elif Shard.key(digest) in filter_:
                        passed.add(digest)
                if passed:
                    yield pa.RecordBatch.from_arrays([pa.array(passed, pa.binary())], names=["digest"])

        passed = common.in_arrow(dealt(filters.unionByName(probes)), probe, "digest binary")
        return passed.join(self.content(), "digest").select("digest", "keep", "n")

    def find(self, docs: DataFrame) -> DataFrame:
        """doc_id, digest, keep_id, live of each row of docs: whether its text is live in the index, and under which id."""
        rows = common.checkpointed(digested(docs))
        return with_groups(rows, common.checkpointed(self.hits(rows))).select("doc_id", "digest", F.col("keep").alias("keep_id"), F.col("n").isNotNull().alias("live"))


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (doc_id, digest) with keep and n of their digest in groups, null where it has none.

    Groups of HOT_ROWS rows and more are broadcast if they are few by count, else dealt over SALTS keys each, so that no
    key of a join holds more than HOT_ROWS rows or that part of a hot group.
    """
    hot = groups.where(F.col("n") >= HOT_ROWS).select(F.col("digest").alias("hot_digest"), F.col("keep").alias("hot_keep"), F.col("n").alias("hot_n"))
    if hot.limit(HOT_GROUPS + 1).count() <= HOT_GROUPS:
        first = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    else:
        dealt_hot = hot.withColumn("hot_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        first = salted.join(dealt_hot, (F.col("digest") == F.col("hot_digest")) & (F.col("salt") == F.col("hot_salt")), "left")
    cold = groups.where(F.col("n") < HOT_ROWS).select(F.col("digest").alias("cold_digest"), F.col("keep").alias("cold_keep"), F.col("n").alias("cold_n"))
    # rows that are settled get a key of their own, shorter than any digest
    key = F.when(F.col("hot_n").isNull(), F.col("digest")).otherwise(F.monotonically_increasing_id().cast("string").cast("binary"))
    out = first.withColumn("cold_key", key).join(cold, F.col("cold_key") == F.col("cold_digest"), "left")
    pick = lambda c: F.when(F.col("hot_n").isNotNull(), F.col(f"hot_{c}")).otherwise(F.col(f"cold_{c}")).alias(c)
    return out.select("doc_id", "digest", pick("keep"), pick("n"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs; of equal texts the row of the largest doc_id stays.

    docs needs doc_id (of any type that orders) and text; other columns are ignored. Null text is empty, and empty texts
    are a group. Rows that repeat with the same id count and are all returned, kept or dropped alike. A null id is less
    than any other: such a row stays only if its group has no other id. No rows in, none out. The length of a text only
    costs its hash. Texts are equal by SHA-256.
    """
    rows = common.checkpointed(digested(docs))
    groups = Index.build(rows).content().where(F.col("n") > 1)  # others keep themselves
    out = with_groups(rows, groups)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256 FROM d JOIN g USING (text)
"""
