"""N-gram Jaccard join by vertical partitioning, and the components of its links.

Exact: sets are sets of 64-bit shingle hashes, every link of similarity >= 0.75 between different sets is either found
or lies within a component that other links already join.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 5
PERCENT = 75
SKETCH_BITS = 22
FRAGMENTS = 8
SMALL_BUCKET = 6
#: Rows of an open bucket that a task holds, and rows by which a cell of the count must exceed the usual for its shingles'
#: buckets to be dealt over several tasks, about that many each.
LONG_BUCKET = 50_000
HOT = 2_000
MOST_BITS = 4096
SEEN = 100_000


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and the set size of each text."""
    words, counts, _ = common.hashed_words(texts, lower=True)
    _, h = common.windows(words, counts, width)
    sizes = np.maximum(counts - width + 1, 0)
    few = np.nonzero((counts > 0) & (counts < width))[0]
    if len(few):
        first = np.cumsum(counts) - counts
        own = [common.mix(np.array([np.sum(words[first[d] : first[d] + counts[d]] * common.PLACES[: counts[d]])]) ^ np.uint64(counts[d])) for d in few.tolist()]
        h = np.insert(h, (np.cumsum(sizes) - sizes)[few], np.concatenate(own))
        sizes[few] = 1
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[(ends - sizes)[sizes > 0]] = True
    sizes = np.diff(np.r_[0, np.r_[0, np.cumsum(fresh)][ends]])
    return h[fresh], sizes


def parity_bits(tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each set a row of bits, twice its size or more up to MOST_BITS; a bit is the parity of the shingles that fall on it.

    Two rows differ in at most as many bits as their sets in shingles, also when the longer is folded to the shorter.
    """
    width = 1 << np.ceil(np.log2(np.clip(2 * sizes, 64, MOST_BITS))).astype(np.int64)
    ends = np.cumsum(width)
    bit = (tokens >> np.uint64(24)).astype(np.int64) & np.repeat(width - 1, sizes)
    raw = np.packbits((np.bincount(bit + np.repeat(ends - width, sizes), minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(bool), bitorder="little").tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip((ends - width).tolist(), ends.tolist())]


def differing(x: bytes, y: bytes) -> int:
    """Number of different bits, the longer row folded to the length of the shorter."""
    if len(x) < len(y):
        x, y = y, x
    n, a = 8 * len(x), int.from_bytes(x, "little")
    while n > 8 * len(y):
        n //= 2
        a = (a >> n) ^ (a & ((1 << n) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def possible(percent: int):
    """Drops pairs whose bits show that too few shingles can be shared. Columns a, na, b, nb, u, v, bits, bits."""

    def run(batches):
        for t in batches:
            na, nb = t.column(1).to_pylist(), t.column(3).to_pylist()
            most = [(p + q - differing(x, y)) // 2 for p, q, x, y in zip(na, nb, t.column(6).to_pylist(), t.column(7).to_pylist())]
            keep = pa.array([100 * o >= percent * (p + q - o) for o, p, q in zip(most, na, nb)], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(t.columns[:6]), names=["a", "na", "b", "nb", "u", "v"]).filter(keep)

    return run


def set_hashes(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set: with its size, the name of the class of equal sets. 0 for the empty set."""
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = common.mix(np.add.reduceat(common.mix(tokens), starts) + np.bitwise_xor.reduceat(common.mix(tokens ^ np.uint64(0xA5A5A5A5)), starts))
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def profiled(docs: DataFrame, width: int) -> DataFrame:
    """Two kinds of rows from one pass: (doc_id, n, cls, bits) of each document, and slices of a count of all shingles by hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches):
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        for part in common.slices(batches, "text"):
            tokens, sizes = shingle_sets(common.utf8(part, "text"), width)
            np.add.at(cells, tokens & np.uint64((1 << SKETCH_BITS) - 1), np.uint32(1))
            none = pa.nulls(part.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), signed(set_hashes(tokens, sizes)), none, pa.array(parity_bits(tokens, sizes), pa.binary())], names=["doc_id", "n", "cls", "slice", "bits"])
        rows = common.cut_up(cells)
        null = lambda t: pa.nulls(rows.num_rows, t)
        yield pa.RecordBatch.from_arrays([null(docs_type), null(pa.int64()), null(pa.int64()), rows.column(0), rows.column(1)], names=["doc_id", "n", "cls", "slice", "bits"])

    docs_type = common.arrow_kind(docs)
    return common.in_arrow(docs.select("doc_id", "text"), measure, f"doc_id {kind}, n long, cls long, slice int, bits binary")


def rarity(cells: np.ndarray) -> np.ndarray:
    """How full each cell of the count is, 0 to 255: sixteenths of a standard deviation around the usual, octaves far above.

    A shingle occurs in at most as many documents as its cell counts. The global order of shingles is by this figure:
    any order gives the same links, but with rare shingles first few sets meet in a prefix.
    """
    usual = float(np.median(cells))
    z = (cells - usual) / np.sqrt(usual + 1)
    return np.where(z <= 4, 128 + 16 * z, 192 + 4 * np.log2(np.maximum(z, 4) / 4)).clip(0, 255).astype(np.uint8)


class Order:
    """The global order of shingles, by rarity and then by hash, its fragments, and which shingles are hot. Its size is that of the count."""

    def __init__(self, cells: np.ndarray, hot: int = HOT):
        self.rare = rarity(cells)
        mass = np.bincount(self.rare, cells.astype(np.float64) + 1e-9, 256)
        self.before, self.mass, self.total = np.cumsum(mass) - mass, mass, mass.sum()
        parts = np.ceil((cells.astype(np.float64) - np.median(cells)) / hot)
        self.hot = np.nonzero(parts > 1)[0]
        self.parts = parts[self.hot].astype(np.uint64)

    def cell(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens & np.uint64(len(self.rare) - 1)).astype(np.int64)

    def fragment(self, tokens: np.ndarray, pieces: int) -> np.ndarray:
        """The fragment of each shingle: runs of the global order that hold about as many shingles each."""
        rare = self.rare[self.cell(tokens)]
        place = (self.before[rare] + self.mass[rare] * (tokens.astype(np.float64) / 2.0**64)) / self.total
        return np.minimum((place * pieces).astype(np.int64), pieces - 1)

    def bucket(self, tokens: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The shingle, but for a hot one a number for each part of its sets; parts are drawn anew for every shingle."""
        out = tokens.copy()
        if len(self.hot):
            cell = self.cell(tokens)
            at = np.minimum(np.searchsorted(self.hot, cell), len(self.hot) - 1)
            hit = np.nonzero(self.hot[at] == cell)[0]
            part = common.mix(cls[hit] ^ common.mix(tokens[hit])) % self.parts[at[hit]]
            out[hit] = common.mix(tokens[hit] + (part + np.uint64(1)) * common.PLACES[0])
        return out


def ordered(tokens: np.ndarray, sizes: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """tokens, sorted by hash in each set, in the global order: by rarity, then by hash."""
    key = np.repeat(np.arange(len(sizes)), sizes) << 8 | rare[tokens & np.uint64(len(rare) - 1)]
    return tokens[np.argsort(key, kind="stable")]


def prefixes(docs: DataFrame, rare, width: int, percent: int) -> DataFrame:
    """bucket, n, place, cls, token for the first n - ceil(percent n / 100) + 1 shingles of each set in the global order.

    Two linked sets share one of them. The bucket is the shingle, or of a hot shingle one of several. A task leaves out copies of sets that it has just seen; the rest of them meet at their tokens.
    """

    def emit(batches):
        order, seen = rare.value, set()
        for part in common.slices(batches, "text"):
            tokens, sizes = shingle_sets(common.utf8(part, "text"), width)
            cls = set_hashes(tokens, sizes)
            new = np.zeros(len(sizes), bool)
            for i, c in enumerate(cls.tolist()):
                if sizes[i] and c not in seen:
                    seen.add(c)
                    new[i] = True
            if len(seen) > SEEN:
                seen.clear()
            tokens, cls, sizes = tokens[np.repeat(new, sizes)], cls[new], sizes[new]
            if not len(tokens):
                continue
            tokens = ordered(tokens, sizes, order.rare)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(tokens)) - (np.cumsum(sizes) - sizes)[doc]
            first = place < (sizes - (-(-percent * sizes // 100)) + 1)[doc]
            own = tokens[first]
            yield pa.RecordBatch.from_arrays([signed(order.bucket(own, cls[doc[first]])), pa.array(sizes[doc[first]]), pa.array(place[first]), signed(cls[doc[first]]), signed(own)], names=["bucket", "n", "place", "cls", "token"])

    return common.in_arrow(docs.select("text"), emit, "bucket long, n long, place long, cls long, token long")


def bucket_pairs(percent: int, long_bucket: int = LONG_BUCKET):
    """The reader of one partition sorted by (bucket, n, place, cls): candidate pairs (kind 0), rows of large buckets and of
    parts of hot shingles (kind 1).

    In a bucket of up to SMALL_BUCKET classes all pairs that may link; in a larger one each class with a pivot among
    the classes of like size, the one with the fewest rarer shingles: buckets of the same near copies tend to agree on
    it. So pairs grow with the rows. A task holds one batch and the rows of its last bucket, of a long bucket
    the last pivot only.
    """

    def run(batches):
        rest, long_token = np.zeros((0, 5), np.int64), None
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if not len(rows):
                continue
            rows = np.concatenate([rest, rows])
            open_at = int(np.searchsorted(rows[:, 0], rows[-1, 0], side="left"))
            if len(rows) - open_at > long_bucket:
                yield from candidates(rows, percent, long_token)
                long_token = rows[-1, 0]
                last = rows[open_at:]
                rest = last[pivots(last, percent)[-1:]]
            else:
                yield from candidates(rows[:open_at], percent, long_token)
                rest = rows[open_at:]
        yield from candidates(rest, percent, long_token)

    return run


def may_link(na, pa_, nb, pb, percent: int):
    """Whether two sets of sizes na and nb can link whose first common shingle has these places: none before it is shared,
    so at most the shingles from it on are. Works on numbers, arrays and Columns."""
    least = functools.reduce(lambda x, y: x & y, [(100 + percent) * (n - p) >= percent * (na + nb) for n, p in ((na, pa_), (nb, pb))])
    return least & (100 * na >= percent * nb) & (100 * nb >= percent * na)


def size_band(n, percent: int):
    """Number of the band of sizes that n is in. Bands are a little wider than the ratio of two sets that link."""
    return F.floor(F.log(n) / F.log(F.lit(100.5 / percent))).cast("int")


def pivots(rows: np.ndarray, percent: int) -> np.ndarray:
    """For rows of one token by size, the pivot of each: of the sizes that may link with the first, the smallest place; then the next."""
    n = rows[:, 1]
    out, s = np.zeros(len(n), np.int64), 0
    while s < len(n):
        e = int(np.searchsorted(percent * n, 100 * n[s], side="right"))
        out[s:e] = s + int(np.lexsort((rows[s:e, 3], rows[s:e, 2]))[0])
        s = e
    return out


def candidates(rows: np.ndarray, percent: int, long_token):
    if not len(rows):
        return
    rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]
    token, n = rows[:, 0], rows[:, 1]
    start = np.nonzero(np.r_[True, token[1:] != token[:-1]])[0]
    count = np.diff(np.r_[start, len(token)])
    some = (count > 1) | (token[start] != rows[start, 4])  # a part of a hot shingle is never alone
    start, count = start[some], count[some]
    large = (count > SMALL_BUCKET) | (token[start] == long_token if long_token is not None else False) | (token[start] != rows[start, 4])
    left, right, kept = [], [], []
    for a in range(SMALL_BUCKET):
        for b in range(a + 1, SMALL_BUCKET):
            s = start[~large & (count > b)]
            left.append(s + a)
            right.append(s + b)
    for s, c in zip(start[large].tolist(), count[large].tolist()):
        i = np.arange(s, s + c)
        pivot = s + pivots(rows[i], percent)
        left.append(np.minimum(pivot, i)[pivot != i])
        right.append(np.maximum(pivot, i)[pivot != i])
        kept.append(i)
    i, j = np.concatenate(left), np.concatenate(right)
    ok = may_link(n[i], rows[i, 2], n[j], rows[j, 2], percent)
    i, j = i[ok], j[ok]
    swap = (n[i] == n[j]) & (rows[i, 3] > rows[j, 3])  # a pair has the same order in every bucket
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    out = np.zeros((0, 5), np.int64)
    if len(i):
        out = np.unique(np.c_[rows[i, 3], rows[i, 1], rows[j, 3], rows[j, 1]], axis=0)
        out = np.c_[out, np.zeros(len(out), np.int64)]
    kind = np.zeros(len(out), np.int32)
    if kept:
        k = np.concatenate(kept)
        out = np.concatenate([out, np.c_[rows[k, 3], rows[k, 1], rows[k, 4], np.zeros(len(k), np.int64), rows[k, 2]]])
        kind = np.r_[kind, np.ones(len(k), np.int32)]
    if len(out):
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *(pa.array(np.ascontiguousarray(out[:, c])) for c in range(5))], names=["kind", "a", "na", "b", "nb", "place"])


def fragments(docs: DataFrame, wanted: DataFrame, members: DataFrame, order, width: int, pieces: int) -> DataFrame:
    """cls, n, frag, tokens: the sets of the wanted classes cut into fragments of the global order of shingles.

    One document stands for each class. A bit filter of a fixed size drops most other documents before the join.
    """
    spark = docs.sparkSession
    reps = common.checkpointed(members.join(wanted, ["cls", "n"], "left_semi").groupBy("cls", "n").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    cells = 1 << 23

    def bits(batches):
        own = np.zeros(cells, bool)
        for b in batches:
            own[b.column(0).to_numpy() & (cells - 1)] = True
        yield common.cut_up(np.packbits(own, bitorder="little").view(np.uint32))

    mask = common.merged(common.in_arrow(reps.select(F.xxhash64("doc_id").alias("h")), bits, "slice int, cells binary"), cells // 32, np.bitwise_or)
    mask = spark.sparkContext.broadcast(mask)

    def sieve(batches):
        own = np.unpackbits(mask.value.view(np.uint8), bitorder="little").astype(bool)
        for b in batches:
            hit = own[b.column(2).to_numpy() & (cells - 1)]
            if hit.any():
                yield b.filter(pa.array(hit)).select(["doc_id", "text"])

    kept = common.in_arrow(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")), sieve, docs.select("doc_id", "text").schema)
    kept = kept.join(reps, "doc_id", "left_semi").select("text")

    def cut(batches):
        for part in common.slices(batches, "text"):
            tokens, sizes = shingle_sets(common.utf8(part, "text"), width)
            if not len(tokens):
                continue
            cls, doc, frag = set_hashes(tokens, sizes), np.repeat(np.arange(len(sizes)), sizes), order.value.fragment(tokens, pieces)
            by = np.argsort(doc * pieces + frag, kind="stable")
            tokens, frag = tokens[by], frag[by]
            head = np.nonzero(np.r_[True, (doc[1:] != doc[:-1]) | (frag[1:] != frag[:-1])])[0]
            raw = tokens.tobytes()
            packed = [raw[8 * a : 8 * b] for a, b in zip(head.tolist(), np.r_[head[1:], len(doc)].tolist())]
            yield pa.RecordBatch.from_arrays([signed(cls[doc[head]]), pa.array(sizes[doc[head]]), pa.array(frag[head].astype(np.int32)), pa.array(packed, pa.binary())], names=["cls", "n", "frag", "tokens"])

    return common.in_arrow(kept, cut, "cls long, n long, frag int, tokens binary")


def overlaps(batches):
    for b in batches:
        x, y = (c.to_pylist() for c in b.columns[3:5])
        both = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(both, pa.int64())], names=["u", "v", "frag", "both"])


def links(docs: DataFrame, pairs: DataFrame, node: DataFrame, members: DataFrame, order, width: int, percent: int, pieces: int = FRAGMENTS) -> DataFrame:
    """u, v (nodes) of the pairs of classes that are links: overlaps are counted fragment by fragment and summed."""
    x, y = (node.select(F.col("cls").alias(c), F.col("n").alias("n" + c), F.col("node").alias(k), F.col("bits").alias("bits" + c)) for c, k in (("a", "u"), ("b", "v")))
    kind = node.schema["node"].dataType.simpleString()
    near = pairs.join(x, ["a", "na"]).join(y, ["b", "nb"]).select("a", "na", "b", "nb", "u", "v", "bitsa", "bitsb")
    near = common.checkpointed(common.in_arrow(near, possible(percent), f"a long, na long, b long, nb long, u {kind}, v {kind}"))
    ends = near.select(F.col("a").alias("cls"), F.col("na").alias("n")).union(near.select("b", "nb")).distinct()
    parts = common.checkpointed(fragments(docs, ends, members, order, width, pieces))
    one = near.join(parts.select(F.col("cls").alias("a"), F.col("n").alias("na"), "frag", F.col("tokens").alias("x")), ["a", "na"])
    two = one.join(parts.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "frag", F.col("tokens").alias("y")), ["b", "nb", "frag"])
    counted = common.in_arrow(two.select("u", "v", "frag", "x", "y"), overlaps, f"u {kind}, v {kind}, frag int, both long")
    both = counted.groupBy("u", "v", "frag").agg(F.max("both").alias("both")).groupBy("u", "v").agg(F.sum("both").alias("both"))  # max: a doc_id may have several rows
    linked = near.select("u", "v", "na", "nb").distinct().join(both, ["u", "v"])
    return linked.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """node, root of the undirected edges (u, v); root is the smallest node of the component.

    Large-star and small-star rounds (Kiveris et al., Connected Components in MapReduce and Beyond, 2014): every round
    is two aggregations over the edges, the number of rounds grows with the logarithm of the longest path. Raises if
    the rounds don't end.
    """
    e = common.checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    last = None
    for _ in range(60):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = common.checkpointed(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
        last = now
    raise RuntimeError("components: no end after 60 rounds")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, count_links: bool = False, hot: int = HOT, long_bucket: int = LONG_BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; with count_links also n_links, of its class with other classes.

    Equal sets are one class with its smallest doc_id as node. Candidates are classes that share a shingle of their
    prefixes in the global order. First round: a few pairs of each bucket, verified, give components. Second round:
    in large buckets, pairs of like size between classes of different components; so a group of near copies of any size
    costs about a pair for each member and shingle, and no link between components is missed. A hot shingle's sets are
    dealt over several buckets, drawn anew for each shingle, which the second round joins where components differ. Of a
    pair in that round the smaller set must have the shingle early, so sets that share only a frequent passage, late in
    the order, don't meet. With count_links the second
    round takes the pairs within components too, so all links are verified: the work grows with the square of a group.

    Null or empty text has an empty set and links with nothing; fewer words than `width` are one shingle. A row with
    null doc_id takes part in nothing and gets a null component. Repeated rows return as often as they occur. Shingles of
    equal rarity go by their hashes, so ties cost candidates and never links. A long text costs a worker eight bytes a
    word and its distinct shingles. No rows give no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    seen = common.checkpointed(profiled(docs, width))
    order = spark.sparkContext.broadcast(Order(common.merged(seen.where("slice IS NOT NULL").select("slice", "bits"), 1 << SKETCH_BITS), hot))
    members = seen.where("slice IS NULL").select("doc_id", "n", "cls", "bits")
    usable = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    linked = members.where("n > 0 AND doc_id IS NOT NULL")
    laid = prefixes(usable, order, width, percent).repartition("bucket").sortWithinPartitions("bucket", "n", "place", "cls")
    found = common.checkpointed(common.in_arrow(laid, bucket_pairs(percent, long_bucket), "kind int, a long, na long, b long, nb long, place long"))
    node = common.checkpointed(linked.groupBy("cls", "n").agg(F.min("doc_id").alias("node"), F.first("bits").alias("bits")))
    linked = linked.select("doc_id", "cls", "n")
    first = common.checkpointed(links(usable, found.where("kind = 0").drop("kind", "place").distinct(), node, linked, order, width, percent))
    comps = components(first)
    large = found.where("kind = 1").select(F.col("b").alias("token"), F.col("a").alias("cls"), F.col("na").alias("n"), "place").distinct()
    large = large.join(node.drop("bits"), ["cls", "n"]).join(comps, "node", "left").select("token", "cls", "n", "place", F.coalesce("root", "node").alias("comp"))
    large = common.checkpointed(large)
    if not count_links:
        split = large.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        large = common.checkpointed(large.join(common.small_or_not(common.checkpointed(split), 200_000), "token", "left_semi"))
    if not large.isEmpty():
        x, y = (large.select("token", *(F.col(c).alias(c + k) for c in ("cls", "n", "place", "comp"))) for k in "xy")
        # x is the smaller set; its partner's size lies in the same band or the next, so a bucket is joined band by band
        x = x.where(may_link(F.col("nx"), F.col("placex"), F.col("nx"), F.lit(0), percent)).withColumn("band", size_band(F.col("nx"), percent))
        y = y.withColumn("band", F.explode(F.array(*[size_band(F.col("ny"), percent) - i for i in (0, 1)])))
        apart = F.struct("nx", "clsx") < F.struct("ny", "clsy")
        if not count_links:
            apart = apart & (F.col("compx") != F.col("compy"))
        across = x.join(y, ["token", "band"]).where(apart & may_link(*map(F.col, ("nx", "placex", "ny", "placey")), percent))
        across = across.select(F.col("clsx").alias("a"), F.col("nx").alias("na"), F.col("clsy").alias("b"), F.col("ny").alias("nb")).distinct()
        second = common.checkpointed(links(usable, across, node, linked, order, width, percent))
        if not second.isEmpty():
            first = first.union(second)
            comps = components(first)
    comps = comps.withColumnRenamed("node", "_member")
    of = node.join(comps, F.col("node") == F.col("_member"), "left")
    counts = []
    if count_links:
        pairs = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        degree = pairs.union(pairs.select("v", "u")).groupBy("u").agg(F.count("*").alias("n_links")).withColumnRenamed("u", "_node")
        of, counts = of.join(degree, F.col("node") == F.col("_node"), "left"), [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    of = of.select(F.col("cls").alias("_cls"), F.col("n").alias("_n"), F.coalesce("root", "node").alias("component_id"), *counts)
    members = members.drop("bits")
    out = members.join(of, (F.col("cls") == F.col("_cls")) & (F.col("n") == F.col("_n")), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *counts)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id. Rows without words or doc_id all stay, and so do rows that repeat with one id."""
    keep = jaccard_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__kf_id")).distinct()
    return docs.join(keep, F.col("doc_id") == F.col("__kf_id"), "left_semi").unionByName(docs.where("doc_id IS NULL"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i+4], ' ')) AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * both_ >= 75 * (a.n + b.n - both_)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
