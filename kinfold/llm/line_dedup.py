"""Line dedup: line hashes in range partitions, sorted by document and position, streamed once; keep bitmaps come back."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_DOCUMENTS = 10
NULL_ID = -(2**63)
SPACES = common.SPACES.encode()
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def whole_number(docs: DataFrame) -> bool:
    return isinstance(docs.schema["doc_id"].dataType, INTEGERS)


def document(docs: DataFrame):
    """doc_id as long, or as text with a letter before it where it is no whole number; null has the first place of its own."""
    if whole_number(docs):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    return F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))


def lines(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, tkey, pos of each line with a key of at least one code point; tkey tells texts apart that share a doc_id.

    The key is the line with white space stripped at both ends and A-Z lower-cased; h1 and h2 are its 128-bit hash.
    """

    def hashed(batches):
        for part in common.slices(batches, "text"):
            row, pos, digests = [], [], []
            for i, text in enumerate(common.utf8(part, "text")):
                for k, line in enumerate(text.lower().split(b"\n")):  # bytes.lower() is A-Z only
                    key = line.strip(SPACES)
                    if key:
                        row.append(i)
                        pos.append(k)
                        digests.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), part.column(0).take(at), part.column(1).take(at), pa.array(pos, pa.int32())], names=["h1", "h2", "doc_id", "tkey", "pos"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(document(docs).alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    return common.in_arrow(rows, hashed, f"h1 long, h2 long, doc_id {'long' if whole_number(docs) else 'string'}, tkey long, pos int")


def streamed(keep_first: bool, at_least: int, numbers: bool = True):
    """The reader of one sorted partition. It yields rows to drop, and rows of runs that touch the partition's ends.

    kind 0: the line goes. kind 1: undecided, the run may go on in a neighbour. kind 2: the run is known to go. A task
    holds one batch, and the rows of fewer than `at_least` documents of the run that is open at the batch's end.
    numbers: document ids are whole numbers, else text. Rows without an id are documents by their texts.
    """
    none = NULL_ID if numbers else ""

    def packed(kind: int, h1, h2, doc, tkey, pos) -> pa.RecordBatch:
        whole = [pa.array(np.asarray(c, np.int64), pa.int64()) for c in (h1, h2, tkey)]
        ids = pa.array(doc, pa.int64() if numbers else pa.string())
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(ids), pa.int32()), *whole[:2], ids, whole[2], pa.array(np.asarray(pos, np.int32))], names=["kind", "h1", "h2", "doc_id", "tkey", "pos"])

    def run(batches):
        key, held, documents, last, goes, first = None, [], 0, (None, None), False, True

        def closed(edge: bool):
            """What is left to say of the open run, now that it ends; edge: it touches an end of the partition."""
            if key is None or not edge:
                return
            if goes:
                yield packed(2, [key[0]], [key[1]], [none], [0], [0])
            elif held:
                d, t, p = (np.concatenate(x) for x in zip(*held))
                yield packed(1, np.full(len(d), key[0]), np.full(len(d), key[1]), d, t, p)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, doc, tkey, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            change = np.ones(n, bool)
            change[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            change[0] = key != (h1[0], h2[0])
            new_doc = np.ones(n, bool)
            new_doc[1:] = change[1:] | (doc[1:] != doc[:-1]) | ((doc[1:] == none) & (tkey[1:] != tkey[:-1]))
            new_doc[0] = change[0] or doc[0] != last[0] or (doc[0] == none and tkey[0] != last[1])
            starts = np.nonzero(change)[0]
            drop = np.zeros(n, bool)
            if keep_first:
                drop = ~change
                for s in starts.tolist() if first else starts[-1:].tolist():
                    yield from closed(first)
                    first = key is None
                    key, held = (h1[s], h2[s]), [(doc[s : s + 1], tkey[s : s + 1], pos[s : s + 1])]
                    if not first:  # runs within the batch need no more than `drop`
                        s = starts[-1]
                        key, held = (h1[s], h2[s]), [(doc[s : s + 1], tkey[s : s + 1], pos[s : s + 1])]
                        break
                last = (doc[-1], tkey[-1])
            else:
                ends = [*starts.tolist(), n]
                if not change[0]:  # rows that belong to the open run
                    e = ends[0]
                    documents += int(new_doc[:e].sum())
                    if not goes:
                        held.append((doc[:e], tkey[:e], pos[:e]))
                        if documents >= at_least:
                            goes = True
                            d, t, p = (np.concatenate(x) for x in zip(*held))
                            yield packed(0, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), d, t, p)
                            held = []
                    else:
                        drop[:e] = True
                if len(starts):
                    yield from closed(first)
                    first = key is None
                    counts = np.add.reduceat(new_doc.astype(np.int64), starts)
                    lengths = np.diff(ends)
                    whole = counts >= at_least
                    drop[starts[0] :] = np.repeat(whole, lengths)
                    if first and len(starts) > 1:  # the first run of the partition ends in this batch
                        s, e = ends[0], ends[1]
                        key, goes, held = (h1[s], h2[s]), bool(whole[0]), [(doc[s:e], tkey[s:e], pos[s:e])]
                        yield from closed(True)
                        first = False
                    s = starts[-1]
                    key, goes, documents = (h1[s], h2[s]), bool(whole[-1]), int(counts[-1])
                    held = [] if goes else [(doc[s:], tkey[s:], pos[s:])]
                last = (doc[-1], tkey[-1])
            if drop.any():
                k = int(drop.sum())
                yield packed(0, np.zeros(k, np.int64), np.zeros(k, np.int64), doc[drop], tkey[drop], pos[drop])
        yield from closed(True)

    return run


def dropped_lines(docs: DataFrame, keep_first: bool = False, at_least: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, tkey, pos of each line that goes.

    The range covers document and position too, so a line that a third of all documents share is spread over many
    tasks. Only the first and the last run of a partition can go on elsewhere; their undecided rows, a few for each
    partition, are settled together afterwards.
    """
    rows = common.checkpointed(lines(docs))  # the range is found from a first pass over them
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, "h1", "h2", "doc_id", "tkey", "pos").sortWithinPartitions("h1", "h2", "doc_id", "tkey", "pos")
    found = common.checkpointed(common.in_arrow(laid, streamed(keep_first, at_least, whole_number(docs)), f"kind int, h1 long, h2 long, doc_id {'long' if whole_number(docs) else 'string'}, tkey long, pos int"))
    sure = found.where("kind = 0").select("doc_id", "tkey", "pos")
    edge = found.where("kind > 0")
    by, none = edge.groupBy("h1", "h2"), F.lit(NULL_ID if whole_number(docs) else "")
    if keep_first:
        first = by.agg(F.min(F.struct("doc_id", "tkey", "pos")).alias("first"))
        settled = edge.join(first, ["h1", "h2"]).where(F.struct("doc_id", "tkey", "pos") != F.col("first"))
    else:
        goes = by.agg((F.max("kind") == 2).alias("known"), F.count_distinct(F.struct("doc_id", F.when(F.col("doc_id") == none, F.col("tkey")))).alias("n")).where((F.col("known")) | (F.col("n") >= at_least))
        settled = edge.where("kind = 1").join(goes, ["h1", "h2"], "left_semi")
    return sure.unionByName(settled.select("doc_id", "tkey", "pos"))


def pack_bits(drop: np.ndarray) -> bytes:
    """Compressed keep bitmap: a bit for each line up to the byte of the last dropped one, 0 where the line goes."""
    keep = np.ones((int(drop.max()) // 8 + 1) * 8, bool)
    keep[drop] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def keep_bitmaps(docs: DataFrame, keep_first: bool = False, at_least: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, tkey, keep: one row for each text that loses a line; keep is its compressed bitmap, lines past it stay.

    keep_first false: keys in at least `at_least` documents lose all lines. True: of equal keys the first line by
    document and position stays; whole numbers order by value, other ids by their text, null first. Null text is one
    empty line; empty keys never go. Rows without doc_id are documents by their texts. Rows equal in doc_id and text
    count once and get the same bitmap. No rows in, none out. A long text costs a worker its lines and a row for each;
    extra columns are ignored.
    """

    gone = dropped_lines(docs, keep_first, at_least)
    per = gone.groupBy("doc_id", "tkey").agg(F.collect_set("pos").alias("drop"))

    def bits(batches):
        for b in batches:
            drops = b.column(2)
            flat, off = drops.values.to_numpy(), drops.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack_bits(flat[off[i] : off[i + 1]]) for i in range(b.num_rows)], pa.binary())], names=["doc_id", "tkey", "keep"])

    return common.in_arrow(per, bits, f"doc_id {'long' if whole_number(docs) else 'string'}, tkey long, keep binary")


def unpack_bits(keep: bytes | None, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    if keep:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:n]
        out[: len(bits)] = bits.astype(bool)
    return out


def with_bitmaps(docs: DataFrame, keep: DataFrame) -> DataFrame:
    marked = docs.withColumn("__kf_tkey", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("__kf_doc", document(docs))
    keep = keep.select(F.col("doc_id").alias("__kf_kdoc"), F.col("tkey").alias("__kf_ktkey"), F.col("keep").alias("__kf_keep"))
    return marked.join(keep, (marked["__kf_doc"] == keep["__kf_kdoc"]) & (marked["__kf_tkey"] == keep["__kf_ktkey"]), "left")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")

    def digest(batches):
        for part in common.slices(batches, "text"):
            n_lines, n_dropped, sha = [], [], []
            for text, keep in zip(common.utf8(part, "text"), part.column(2).to_pylist()):
                if keep is None:
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    sha.append(hashlib.sha256(text).hexdigest())
                    continue
                rows = text.split(b"\n")
                mask = unpack_bits(keep, len(rows))
                n_lines.append(len(rows))
                n_dropped.append(int((~mask).sum()))
                sha.append(hashlib.sha256(b"\n".join(r for r, k in zip(rows, mask) if k)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = with_bitmaps(docs, keep_bitmaps(docs)).select("doc_id", "text", "__kf_keep")
    return common.in_arrow(joined, digest, f"doc_id {common.id_kind(docs)}, n_lines long, n_dropped long, kept_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that many documents share; n_chars follows. A document that loses every line stays, empty."""
    names = docs.columns
    at = names.index("text")

    def cut(batches):
        for part in common.slices(batches, "text"):
            texts = []
            for text, keep in zip(part.column(at).cast(pa.binary()).to_pylist(), part.column(len(names)).to_pylist()):
                if keep is not None:
                    rows = (text or b"").split(b"\n")
                    text = b"\n".join(r for r, k in zip(rows, unpack_bits(keep, len(rows))) if k)
                texts.append(None if text is None else text.decode("utf-8", "replace"))
            columns = [part.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = common.in_arrow(with_bitmaps(docs, keep_bitmaps(docs)).select(*[F.col(f"`{c}`") for c in names], "__kf_keep"), cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM g)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM g)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
