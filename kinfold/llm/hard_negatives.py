"""Hard-negative mining over a vector-approximation file.

Each dimension's whole numbers are cut into cells of about equal population, counted over all rows; a row's approximation
is a byte for each dimension. For an anchor, a table of dimension and cell gives what that cell can add to the score at
least and at most, and sums of looked-up entries bound every row's score. Only rows whose bounds may enter a result are
scored exactly. Anchors and rows meet in a grid: blocks of anchors that a task holds, splits of rows that it streams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
CELLS = 64
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors that a task holds, rows of a split that it streams past them, and the rows and anchors of one step.
ANCHOR_BLOCK, ROW_SPLIT = 1 << 14, 1 << 20
STEP_ROWS, STEP_ANCHORS = 1024, 256
#: Of a step, at most so large a share is scored exactly before the step's own bounds are used to leave rows out.
FREE_SHARE = 0.02
NO_WINDOW = (1, 0)


def bound_of(dims: int) -> int:
    """Whole numbers are held within this either way, so that 100 times a score stays in 64 bits."""
    return 1 << ((55 - max(dims - 1, 0).bit_length()) // 2)


def whole_vectors(vectors: pa.Array) -> list[np.ndarray | None]:
    """floor(SCALE * x) of each component in doubles; None for a null vector or one with a null or non-finite component."""
    if not len(vectors):
        return []
    flat = vectors.flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is NaN
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vectors), 0))
    ends = np.cumsum(size)
    bad = np.r_[0, np.cumsum(~np.isfinite(x))]
    good = (bad[ends] == bad[ends - size]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(x * SCALE)
    out: list[np.ndarray | None] = []
    for lo, hi, ok in zip((ends - size).tolist(), ends.tolist(), good.tolist()):
        most = bound_of(hi - lo)
        out.append(np.clip(whole[lo:hi], -most, most).astype(np.int32) if ok else None)
    return out


def taken(rows: DataFrame) -> DataFrame:
    """vec_id, label, dims, vec: the rows that take part, vec as little-endian 32-bit numbers."""

    def read(batches):
        for b in batches:
            vectors = whole_vectors(b.column(2))
            at = [i for i, v in enumerate(vectors) if v is not None]
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(index), b.column(1).take(index), pa.array([len(vectors[i]) for i in at], pa.int32()), pa.array([vectors[i].tobytes() for i in at], pa.binary())], names=["vec_id", "label", "dims", "vec"])

    some = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    return common.in_arrow(some.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector"), read, "vec_id long, label long, dims int, vec binary")


def matrix(vec: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec.to_pylist()), np.int32).reshape(len(vec), dims)


def bucket(x: np.ndarray) -> np.ndarray:
    """Numbers below 128 either way are buckets of their own, larger ones fall into 32 buckets an octave; order is kept."""
    size = np.abs(x.astype(np.int64))
    octave = np.maximum(np.frexp(np.maximum(size, 1).astype(float))[1] - 7, 0)
    return np.where(x < 0, -1, 1) * ((octave << 7) + (size >> octave))


def cells(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By the number of dimensions: the least and greatest number of each (dimension, cell), over all rows.

    Tasks count buckets, which are added up; a dimension's buckets in order are dealt over CELLS cells of about equal
    population. The driver gets at most CELLS rows for each dimension.
    """

    def count(batches):
        held: dict[int, list] = {}
        for b in batches:
            dims_ = b.column(0).to_numpy()
            for dims in np.unique(dims_).tolist():
                if not dims:
                    continue
                x = matrix(b.column(1).filter(pa.array(dims_ == dims)), dims)
                key = (np.arange(dims)[None, :] << 20) + (bucket(x) + (1 << 19))
                held.setdefault(dims, []).append(summed(key.ravel(), np.ones(x.size, np.int64), x.ravel(), x.ravel()))
                if len(held[dims]) > 32:
                    held[dims] = [summed(*(np.concatenate(c) for c in zip(*held[dims])))]
        for dims, parts in held.items():
            key, n, lo, hi = summed(*(np.concatenate(c) for c in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), dims, np.int32)), pa.array((key >> 20).astype(np.int32)), pa.array(((key & 0xFFFFF) - (1 << 19)).astype(np.int32)), pa.array(n), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["dims", "dim", "bucket", "n", "lo", "hi"])

    counted = common.in_arrow(rows.select("dims", "vec"), count, "dims int, dim int, bucket int, n long, lo int, hi int")
    counted = counted.groupBy("dims", "dim", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = Window.partitionBy("dims", "dim")
    before = F.sum("n").over(own.orderBy("bucket")) - F.col("n")
    cell = F.floor((before + F.col("n") / 2) * CELLS / F.sum("n").over(own)).cast("int")
    found = counted.withColumn("cell", cell).groupBy("dims", "dim", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    edges: dict[tuple[int, int], list] = {}
    for r in found.collect():
        edges.setdefault((r.dims, r.dim), []).append((r.lo, r.hi))
    for (dims, dim), cut in edges.items():
        if dims not in out:
            out[dims] = np.zeros((dims, CELLS), np.int64), np.zeros((dims, CELLS), np.int64)
        cut = sorted(cut)
        cut += cut[-1:] * (CELLS - len(cut))
        out[dims][0][dim], out[dims][1][dim] = zip(*cut)
    return out


def summed(key, n, lo, hi):
    order = np.argsort(key, kind="stable")
    key, n, lo, hi = key[order], n[order], lo[order], hi[order]
    first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    return key[first], np.add.reduceat(n, first), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)


def approximated(rows: DataFrame, cut: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """rows with code: the cell of each dimension as a byte."""

    def read(batches):
        for b in batches:
            dims_ = b.column(2).to_numpy()
            codes = np.full(b.num_rows, b"", object)
            for dims in np.unique(dims_).tolist():
                at = np.nonzero(dims_ == dims)[0]
                if dims:
                    x = matrix(b.column(3).take(pa.array(at)), dims)
                    code = np.stack([np.searchsorted(cut[dims][1][d], x[:, d], side="left") for d in range(dims)], axis=1).astype(np.uint8)
                    codes[at] = [c.tobytes() for c in code]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes.tolist(), pa.binary())], names=["vec_id", "label", "dims", "vec", "code"])

    return common.in_arrow(rows.select("vec_id", "label", "dims", "vec"), read, "vec_id long, label long, dims int, vec binary, code binary")


class Block:
    """Anchors of one block with their windows, and the best rows of each window so far.

    windows[a, w] is the least and greatest score that window w of anchor a takes; ids and scores are its k best rows,
    by falling score and then by id, free places with the least number.
    """

    FREE = np.iinfo(np.int64).min

    def __init__(self, vec: np.ndarray, ids: np.ndarray, labels: np.ndarray, windows: np.ndarray, cut, same_label: bool, k: int):
        self.vec, self.ids, self.labels, self.windows, self.same_label, self.k = vec.astype(np.int64), ids, labels, windows, same_label, k
        self.lo, self.hi = cut
        a, w = windows.shape[:2]
        self.scores = np.full((a, w, k), self.FREE)
        self.rows = np.full((a, w, k), self.FREE)
        most = np.abs(self.vec).max(initial=1) * max(np.abs(self.lo).max(initial=1), np.abs(self.hi).max(initial=1)) * max(vec.shape[1], 1)
        self.kind = np.int32 if most < 2**31 else np.int64
        self.bounded = self.scored = 0

    def bounds(self, some: slice, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score of each (row, anchor), by a look-up for each dimension."""
        q = self.vec[some].T
        least, most = (np.zeros((len(codes), q.shape[1]), self.kind) for _ in range(2))
        entry = np.empty_like(least)
        for d in range(len(q)):
            low, high = np.outer(self.lo[d], q[d]), np.outer(self.hi[d], q[d])
            for table, out in ((np.minimum(low, high), least), (np.maximum(low, high), most)):
                np.take(table.astype(self.kind), codes[:, d], axis=0, out=entry, mode="clip")
                out += entry
        return least, most

    def pass_rows(self, ids: np.ndarray, labels: np.ndarray, vec: np.ndarray, codes: np.ndarray) -> None:
        """Rows in ascending order of ids, from call to call too: a later row of an equal score comes after."""
        for r in range(0, len(ids), STEP_ROWS):
            rows = slice(r, r + STEP_ROWS)
            for a in range(0, len(self.ids), STEP_ANCHORS):
                self.step(slice(a, a + STEP_ANCHORS), ids[rows], labels[rows], vec[rows], codes[rows])

    def step(self, some: slice, ids, labels, vec, codes) -> None:
        least, most = self.bounds(some, codes)
        same = labels[:, None] == self.labels[some][None, :]
        out = same if not self.same_label else ~same
        out |= ids[:, None] == self.ids[some][None, :]
        windows = self.windows[some]
        kth = self.scores[some][:, :, -1]
        may = np.zeros(least.shape, bool)
        for w in range(windows.shape[1]):
            low, high = windows[:, w, 0], windows[:, w, 1]
            may |= (most >= low) & (least <= high) & (most > kth[:, w])
        may &= ~out
        self.bounded += may.size
        if may.sum() > FREE_SHARE * may.size and len(ids) > self.k:  # the step's own bounds tell more than what was scored so far
            kept = np.zeros(may.shape, bool)
            for w in range(windows.shape[1]):
                low, high = windows[:, w, 0], windows[:, w, 1]
                sure = np.where(may & (least >= low) & (most <= high), least.astype(np.int64), self.FREE)
                bar = np.partition(sure, len(ids) - self.k, axis=0)[len(ids) - self.k]  # k rows of the step reach it for sure
                kept |= (most >= low) & (least <= high) & (most > kth[:, w]) & (most >= bar)
            may &= kept
        row, own = np.nonzero(may)
        self.scored += len(row)
        if not len(row):
            return
        score = np.concatenate([np.einsum("ij,ij->i", vec[row[i : i + 4096]], self.vec[some][own[i : i + 4096]]) for i in range(0, len(row), 4096)])
        for w in range(windows.shape[1]):
            fits = (score >= windows[own, w, 0]) & (score <= windows[own, w, 1]) & (score > kth[own, w])
            if not fits.any():
                continue
            who = np.unique(own[fits])
            at = some.start + who
            anchor = np.r_[np.repeat(who, self.k), own[fits]]
            scores = np.r_[self.scores[at, w].ravel(), score[fits]]
            rows = np.r_[self.rows[at, w].ravel(), ids[row[fits]]]
            order = np.lexsort((rows, ~scores, anchor))
            anchor, first = anchor[order], np.searchsorted(anchor[order], who)
            best = order[(first[:, None] + np.arange(self.k)[None, :])]
            self.scores[at, w], self.rows[at, w] = scores[best], rows[best]


def grid(anchors: DataFrame, rows: DataFrame, by: list[str], block: int, split: int) -> tuple[DataFrame, DataFrame]:
    """anchors and rows with _a and _s, so that each block of anchors meets each split of rows with equal `by`.

    Anchors are copied once for each split, rows once for each block; rows without an anchor go.
    """
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / split).cast("long").alias("_splits"))
    counts = counts.join(anchors.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("long").alias("_blocks")), by)
    counts = common.small_or_not(common.checkpointed(counts), 100_000)
    a = anchors.join(counts, by).withColumn("_a", F.pmod(F.xxhash64("vec_id", "vec"), F.col("_blocks"))).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_splits") - 1)))
    r = rows.join(counts, by).withColumn("_s", F.pmod(F.xxhash64("vec_id", "vec"), F.col("_splits"))).withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return a.drop("_splits", "_blocks"), r.drop("_splits", "_blocks")


def nearest(anchors: DataFrame, rows: DataFrame, cut: dict, by: list[str], same_label: bool, k: int, block: int, split: int) -> DataFrame:
    """vec_id, label, vec, window, score, other: for each anchor and each of its windows the first k rows.

    anchors: vec_id, label, dims, vec, windows (array of low and high). other is a row's id. Ranked by score and then by
    id; rows with the anchor's id are left out.
    """
    a, r = grid(anchors, rows, by, block, split)
    group = [*by, "_a", "_s"]
    a = a.select(*group, F.lit(0).alias("_kind"), "vec_id", *[c for c in ("label", "dims") if c not in by], "vec", F.lit(None).cast("binary").alias("code"), "windows")
    r = r.select(*group, F.lit(1).alias("_kind"), "vec_id", *[c for c in ("label", "dims") if c not in by], "vec", "code", F.lit(None).cast(anchors.schema["windows"].dataType).alias("windows"))
    both = a.unionByName(r).repartition(*group).sortWithinPartitions(*group, "_kind", "vec_id")
    names = both.columns

    def run(batches):
        held, block_, now = [], None, None

        def opened():
            t = pa.Table.from_batches(held).combine_chunks()
            dims = t.column("dims")[0].as_py()
            windows = np.array([[(w["low"], w["high"]) for w in ws] for ws in t.column("windows").to_pylist()], np.int64)
            none = np.zeros((0, CELLS), np.int64)
            return t, Block(matrix(t.column("vec").combine_chunks(), dims), t.column("vec_id").to_numpy(), t.column("label").to_numpy(), windows, cut.get(dims, (none, none)), same_label, k)

        def closed():
            t, b = block_
            at, w, place = np.nonzero(b.scores > Block.FREE)
            index = pa.array(at)
            return pa.RecordBatch.from_arrays(
                [*(t.column(c).combine_chunks().take(index) for c in ("vec_id", "label", "vec")), pa.array(w.astype(np.int32)), pa.array(b.scores[at, w, place]), pa.array(b.rows[at, w, place])], names=["vec_id", "label", "vec", "window", "score", "other"]
            )

        for batch in batches:
            keys = np.stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in group], axis=1)
            kinds = batch.column(names.index("_kind")).to_numpy()
            change = np.nonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (kinds[1:] != kinds[:-1])])[0].tolist() if len(keys) else []
            for lo, hi in zip(change, [*change[1:], len(keys)]):
                part, key = batch.slice(lo, hi - lo), tuple(keys[lo].tolist())
                if key != now:
                    if block_:
                        yield closed()
                    held, block_, now = [], None, key
                if kinds[lo] == 0:
                    held.append(part)
                elif held:
                    block_ = block_ or opened()
                    col = {c: part.column(names.index(c)) for c in ("vec_id", "label", "dims", "vec", "code")}
                    dims = col["dims"][0].as_py()
                    codes = np.frombuffer(b"".join(col["code"].to_pylist()), np.uint8).reshape(len(part), dims)
                    block_[1].pass_rows(col["vec_id"].to_numpy(), col["label"].to_numpy(), matrix(col["vec"], dims).astype(np.int64), codes)
        if block_:
            yield closed()

    got = common.in_arrow(both, run, "vec_id long, label long, vec binary, window int, score long, other long")
    first = F.row_number().over(Window.partitionBy("vec_id", "label", "vec", "window").orderBy(F.desc("score"), "other"))
    return got.withColumn("rank", first).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = ANCHOR_BLOCK, split: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, vector (array of numbers); anchor: a condition on vec_id and label. A score is the inner product
    of floor(256 * x). An anchor's positives are its first rows of the same label, its negatives for each of them the
    first rows of another label with a score from low to high hundredths of the positive's. Ties go by vec_id.
    Rows without vec_id or label, and vectors with a null or non-finite component, take no part; vectors of different
    lengths don't meet. Rows that repeat count as often as they occur, an anchor that repeats counts once; rows with
    an anchor's id are not its partners. Numbers beyond bound_of(dims), 16.7 million at 64 dimensions, are held at it. No
    rows in, none out; other columns are ignored. A hot label is cut into splits like all rows.
    """
    spark = rows.sparkSession
    all_ = common.checkpointed(taken(rows))
    cut = cells(all_)
    all_ = common.checkpointed(approximated(all_, cut))
    if split is None:  # some tasks for each core, and no split above ROW_SPLIT
        split = min(ROW_SPLIT, max(1024, all_.count() // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1))
    anchors = all_.where(anchor).drop("code").distinct()
    open_ = F.array(F.struct(F.lit(Block.FREE + 1).alias("low"), F.lit(2**63 - 1).alias("high")))
    near = nearest(anchors.withColumn("windows", open_), all_, cut, ["label", "dims"], True, positives, block, split)
    near = common.checkpointed(near.select("vec_id", "label", "vec", "rank", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
    x, y = F.col("positive_score") * low, F.col("positive_score") * high  # rounded up and down to whole scores
    window = F.struct((F.expr(f"positive_score * {low} div 100") + (x % 100 > 0).cast("long")).alias("low"), (F.expr(f"positive_score * {high} div 100") - (y % 100 < 0).cast("long")).alias("high"))
    listed = near.groupBy("vec_id", "label", "vec").agg(F.sort_array(F.collect_list(F.struct("rank", window.alias("w")))).alias("found"))  # at most `positives` each
    none = F.struct(F.lit(NO_WINDOW[0]).cast("long").alias("low"), F.lit(NO_WINDOW[1]).cast("long").alias("high"))
    windows = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(F.col("found"), i)["w"], none))
    asking = anchors.join(listed, ["vec_id", "label", "vec"]).withColumn("windows", windows).drop("found")
    far = nearest(asking, all_, cut, ["dims"], False, negatives, block, split)
    far = far.select("vec_id", "label", "vec", (F.col("window") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.withColumnRenamed("rank", "place")
    out = far.join(near, ["vec_id", "label", "vec", "place"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector")), F.col("vec_id") % 100 == 0)


ORACLE = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM e),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id AS id, r.label, list_dot_product(a.v, r.v)::BIGINT AS score
      FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id))::INTEGER AS rank,
       s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
