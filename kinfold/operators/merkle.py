"""Manifests as Merkle trees over tables in key order: one root however a table is partitioned, proofs of single rows, and a
search that finds the rows in which two tables differ through the nodes in which they differ.

Where a node ends is told by the rows themselves: a row whose digest ends in enough zero bits is the last of its leaf,
one with more zero bits also ends nodes further up. So a change moves only the nodes around it, and equal stretches of
two tables have equal nodes. Levels come from rounds of aggregation, numbered by running counts of the ends before.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import columns as C
from kinfold.operators.budget import running_sums
from kinfold.operators.relations import checkpointed, stored
from kinfold.operators.validate import canonical_bytes, row_tokens

#: Zero bits that end a leaf, and further ones that end a node of the next level: some 256 rows and 16 nodes each.
LEAF_BITS, NODE_BITS = 8, 4
#: Differing nodes of a level that are broadcast in the search; below more of them the next level is taken whole.
BROADCAST = 100_000
#: What one pass over the rows in order gives: the different rows, height null, and the leaves, whose height is that of
#: their last row. A leaf that may go on in the task before or after has its children there in place of its digest.
LAID = "part int, leaf long, at long, digest binary, rows long, height int, made binary, children binary, held long"


def sha(raw: Column) -> Column:
    return F.unhex(F.sha2(raw, 256))


def heights(digests: np.ndarray) -> np.ndarray:
    """How many levels of nodes each row ends, from digests of 32 bytes in rows."""
    low = np.zeros(len(digests), np.uint64)
    for k in range(26, 32):  # 48 bits
        low = (low << np.uint64(8)) | digests[:, k]
    zeros = np.where(low == 0, 48, np.log2(np.maximum(low & (~low + np.uint64(1)), np.uint64(1)).astype(float)).astype(np.int64))
    return np.where(zeros < LEAF_BITS, 0, 1 + (zeros - LEAF_BITS) // NODE_BITS)


def node_digest(level: Column, children: Column) -> Column:
    """The digest of a node: its level, and digest and row count of each child in order."""
    return sha(F.concat(F.unhex(F.lpad(F.hex(level.cast("long")), 4, "0")), F.unhex(F.array_join(F.transform(children, lambda x: F.concat(F.hex(x["digest"]), F.lpad(F.hex(x["rows"]), 16, "0"))), ""))))


def different_rows(df: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """key, digest, rows of each different row: what orders it, the digest of its canonical bytes, how often it occurs."""
    keys = [C.ordinal(F.col(c)) if df.schema[c].dataType.typeName() == "string" else F.col(c) for c in order]
    rows = df.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), sha(row_tokens(df, fields)).alias("digest"))
    return rows.groupBy("key", "digest").agg(F.count("*").alias("rows"))


def laid_out(batches, part: int, arrow: pa.Schema):
    """Rows of LAID from batches (digest, rows) of the different rows of a task in order; the open leaf alone is held."""
    leaf, at, open_ = 0, 0, []

    def rows_of(n: int, **own) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def leaves(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        """Leaves (leaf, height, children); the first of a task and one that no row ends are left open."""
        whole = [k > 0 and h > 0 for k, h, _ in found]
        made = [hashlib.sha256(b"\0\1" + c).digest() if w else None for w, (_, _, c) in zip(whole, found)]
        total = [int(np.frombuffer(c, np.uint8).reshape(-1, 40)[:, 32:].copy().view(">i8").sum()) for _, _, c in found]
        return rows_of(
            len(found), part=pa.array([part] * len(found)), leaf=pa.array([k for k, _, _ in found]), rows=pa.array(total), height=pa.array([h for _, h, _ in found]),
            made=pa.array(made, pa.binary()), children=pa.array([None if w else c for w, (_, _, c) in zip(whole, found)], pa.binary()), held=pa.array([len(c) // 40 for _, _, c in found]),
        )

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        rows = b.column(1).to_numpy()
        children = np.empty((n, 40), np.uint8)
        children[:, :32] = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(n, 32)
        children[:, 32:] = rows.astype(">i8").view(np.uint8).reshape(n, 8)
        height = heights(children[:, :32])
        stop, found, start = height > 0, [], 0
        own = leaf + np.cumsum(stop) - stop
        for end in np.nonzero(stop)[0].tolist():
            found.append((leaf, int(height[end]), b"".join([*open_, children[start : end + 1].tobytes()])))
            leaf, start, open_ = leaf + 1, end + 1, []
        if start < n:
            open_.append(children[start:].tobytes())
        yield rows_of(n, part=pa.array(np.full(n, part, np.int32)), leaf=pa.array(own), at=pa.array(np.arange(at, at + n)), digest=b.column(0), rows=pa.array(rows))
        if found:
            yield leaves(found)
        at += n
    if open_:
        yield leaves([(leaf, 0, b"".join(open_))])


def lowest(df: DataFrame, fields: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The different rows as nodes of level 0 (at, parent, digest, rows), and order, digest, rows, height of the leaves above.

    The columns alone are shuffled, once, by ranges of the order; equal rows meet there. Digests are made after that, and stored
    with what each task knows of its leaves. Counts by task number rows and leaves; the leaves that ranges cut are put together.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(LAID))
    text = {c: f"__k{i}" for i, c in enumerate(order) if df.schema[c].dataType.typeName() == "string"}
    by = [text.get(c, c) for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = df.select(*dict.fromkeys([*fields, *[c for c in order if c not in text]]), *[C.ordinal(F.col(c)).alias(k) for c, k in text.items()]).repartitionByRange(n, *by)
    rows = here.select(*by, sha(row_tokens(here, fields)).alias("__digest")).groupBy(*by, "__digest").agg(F.count("*").alias("__rows")).sortWithinPartitions(*by, "__digest")
    laid = stored(rows.select("__digest", "__rows").mapInArrow(lambda batches: laid_out(batches, TaskContext.get().partitionId(), arrow), LAID))
    parts = laid.where("height IS NOT NULL")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = parts.groupBy("part").agg(F.sum("held").alias("n"), F.count_if(F.col("height") > 0).alias("stops"))
    starts = checkpointed(sums.select(F.col("part").alias("__part"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in ("n", "stops")]))
    numbered = lambda x: x.join(F.broadcast(starts), F.col("part") == F.col("__part")).withColumn("parent", F.col("leaf") + F.col("__stops"))
    level = numbered(laid.where("height IS NULL")).select((F.col("at") + F.col("__n")).alias("at"), "parent", "digest", "rows")
    parts = numbered(parts)
    cut = parts.where("made IS NULL").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("part", "children", "height"))).alias("c"), F.sum("rows").alias("rows"))
    bytes_ = F.aggregate("c", F.unhex(F.lit("0001")), lambda a, x: F.concat(a, x["children"]))
    cut = cut.select(F.col("parent").alias("order"), sha(bytes_).alias("digest"), "rows", F.element_at("c", -1)["height"].alias("height"))
    return level, parts.where("made IS NOT NULL").select(F.col("parent").alias("order"), F.col("made").alias("digest"), "rows", "height").unionByName(cut)


def tree(df: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """level, place, parent, digest, rows of each node: level 0 the different rows, above it nodes up to one root.

    place numbers the nodes of a level in order, parent is the place of the node above, null for the root. Text keys are
    ordered by UTF-16 units. A row that repeats is one node with its count, so that no leaf grows with copies. Nulls
    have a token of their own. A task holds a node's children, some hundreds. An empty table has no nodes. The rows are
    shuffled and stored once; what a caller keeps of the nodes needs no checkpoint.
    """
    rows, now = lowest(df, fields, order)
    levels = [(0, rows)]
    for level in range(1, 64):
        stop = (F.col("height") > level).cast("long")
        now = running_sums(now, [], ["order"], {"at": F.lit(1).cast("long"), "stops": stop})
        now = checkpointed(now.withColumn("at", F.col("at") - 1).withColumn("parent", F.col("stops") - stop))
        if now.count() <= 1:
            levels.append((level, now.withColumn("parent", F.lit(None).cast("long"))))
            break
        levels.append((level, now))
        up = now.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "rows", "height"))).alias("c"))
        now = up.select(F.col("parent").alias("order"), node_digest(F.lit(level + 1), F.col("c")).alias("digest"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["rows"]).alias("rows"), F.element_at("c", -1)["height"].alias("height"))
    return reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("level"), F.col("at").alias("place"), "parent", "digest", "rows") for k, x in levels])


def root(nodes: DataFrame) -> str | None:
    """The digest at the top, in hex."""
    found = nodes.where("parent IS NULL").select(F.lower(F.hex("digest"))).first()
    return found[0] if found else None


def top(nodes: DataFrame) -> int:
    return nodes.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0]


def proofs(nodes: DataFrame, digests: DataFrame) -> DataFrame:
    """digest, path for each of digests (digest) that is a row of the tree: from the leaf upwards the children of the nodes
    above it and its place among them."""
    above = nodes.where("level > 0")
    families = nodes.where("parent IS NOT NULL").groupBy("level", "parent").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "rows"))).alias("c"))
    now = digests.select("digest").distinct().join(nodes.where("level = 0"), "digest").select(F.col("digest").alias("row"), "place", "parent")
    parts = []
    for level in range(top(nodes)):
        own = families.where(F.col("level") == level).select("parent", "c")
        step = now.join(own, "parent")
        place = (F.col("place") - F.col("c")[0]["place"]).cast("int")
        parts.append(step.select("row", F.struct(F.lit(level + 1).alias("level"), place.alias("place"), F.transform("c", lambda x: F.struct(x["digest"].alias("digest"), x["rows"].alias("rows"))).alias("children")).alias("step")))
        up = above.where(F.col("level") == level + 1).select(F.col("place").alias("_p"), F.col("parent").alias("_up"))
        now = checkpointed(step.join(up, F.col("parent") == F.col("_p")).select("row", F.col("parent").alias("place"), F.col("_up").alias("parent")))
    if not parts:
        return now.select(F.col("row").alias("digest"), F.array().cast("array<struct<level:int,place:int,children:array<struct<digest:binary,rows:bigint>>>>").alias("path"))
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("row").alias("digest")).agg(F.array_sort(F.collect_list("step")).alias("path"))


def proven(path: Column, digest: Column, root_hex: str) -> Column:
    """Whether the path leads from this row to this root: each node's digest is made of its children and stands in the next."""
    start = F.struct(digest.alias("digest"), F.lit(True).alias("holds"))
    step = lambda a, s: F.struct(node_digest(s["level"], s["children"]).alias("digest"), (a["holds"] & F.coalesce(F.get(s["children"], s["place"])["digest"] == a["digest"], F.lit(False))).alias("holds"))
    return F.aggregate(path, start, step, lambda a: a["holds"] & (a["digest"] == F.unhex(F.lit(root_hex))))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """side ('A' or 'B'), digest, rows of the different rows that the other tree hasn't, or not as often.

    From the top down: of the nodes below differing ones only those go on whose digest no such node of the other side
    has. A round reads one level and carries what differs, so the work follows the difference; below more than BROADCAST
    differing nodes a level is taken whole. The rows of both sides are shuffled once, by digest.
    """
    level = max(top(a), top(b))
    trees, open_ = {"A": a, "B": b}, {}
    for side, nodes in trees.items():
        open_[side] = nodes.where(F.col("level") == level)
    while level > 0:
        # a side whose top lies lower joins with its root
        here = {s: checkpointed(open_[s].unionByName(trees[s].where((F.col("level") == level) & F.col("parent").isNull())).distinct()) for s in trees}
        left = {s: here[s].join(here[o].select("digest", "rows"), ["digest", "rows"], "left_anti").select("place") for s, o in (("A", "B"), ("B", "A"))}
        level -= 1
        for s in trees:
            parents = checkpointed(left[s].select(F.col("place").alias("_p")))
            open_[s] = trees[s].where(F.col("level") == level)
            if parents.limit(BROADCAST + 1).count() <= BROADCAST:
                open_[s] = open_[s].join(F.broadcast(parents), F.col("parent") == F.col("_p"), "left_semi")
    if level < 0:
        return a.select(F.lit("A").alias("side"), "digest", "rows").limit(0)
    both = open_["A"].select(F.lit(True).alias("own"), "digest", "rows").unionByName(open_["B"].select(F.lit(False).alias("own"), "digest", "rows"))
    found = both.groupBy("digest", "rows").agg(F.count_if("own").alias("a"), F.count_if(~F.col("own")).alias("b")).where("a = 0 OR b = 0")
    times = F.sequence(F.lit(1).cast("long"), F.col("a") + F.col("b"))  # nodes of one digest stay apart
    return found.select(F.when(F.col("b") == 0, "A").otherwise("B").alias("side"), "digest", "rows", F.explode(times)).select("side", "digest", "rows")


def manifest(domain: str, groups: list[tuple[str, DataFrame, list[str], list[str]]]) -> tuple[list[dict], str]:
    """name, fields, rows, root of each group of tables (name, table, fields, order), and the seal over them in order.

    The driver holds a row for each group; the tables' digests are made by Spark.
    """
    out = []
    for name, df, fields, order in groups:
        nodes = tree(df, fields, order)
        rows = nodes.where("level = 0").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        out.append({"name": name, "fields": ",".join(fields), "rows": rows, "root": root(nodes)})
    return out, hashlib.sha256(canonical_bytes(domain, [("groups", ["name", "fields", "rows", "root"], out)])).hexdigest()
