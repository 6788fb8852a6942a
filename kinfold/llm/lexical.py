"""Ranked lexical search: Fagin's threshold algorithm over impact-sorted lists and a forward index of the documents.

Documents are read once into a forward index (their terms and how often each occurs), written to the shared folder. Its
tasks cut it into segments of bounded size. In a segment each term has a list of its documents by falling impact; for
each item the lists are read in turns, every document met is scored in full by the forward index, and reading stops
when what an unseen document could still score falls strictly below the kth score. The best of all segments are merged.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TERM, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
TOP = 10
#: A block of items holds at most so many, with about so many different terms; each block reads the documents anew.
BLOCK_ITEMS, BLOCK_TERMS = 20_000, 1_000_000
SEGMENT_POSTINGS = 1 << 20
#: Depth of the first turn over an item's lists; each turn goes half as deep again.
FIRST_TURN = 32


def found(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text with repeats, in lists of at most a piece of it; a piece ends between terms."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + common.PIECE_BYTES) if len(text) - at > common.PIECE_BYTES else None
        end = gap.start() if gap else len(text)
        yield TERM.findall(text[at:end].lower())  # bytes.lower() is A-Z only
        at = end


def blocks(items: DataFrame) -> Iterator[tuple[list, list[list[bytes]]]]:
    """The items with terms, in blocks: their ids, and the different terms of each. Rows equal in id and text count once."""
    ids, terms, size = [], [], 0
    for r in items.select("item_id", "text").distinct().toLocalIterator():
        own = sorted({t for piece in found((r.text or "").encode()) for t in piece})
        if not own:
            continue
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(own) > BLOCK_TERMS):
            yield ids, terms
            ids, terms, size = [], [], 0
        ids.append(r.item_id)
        terms.append(own)
        size += len(own)
    if ids:
        yield ids, terms


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of each row with a term: all its terms counted, and those of the vocabulary with their counts."""

    def read(batches):
        width = max(len(vocabulary), 1)
        for part in common.slices(batches, "text"):
            n, keys = np.zeros(part.num_rows, np.int64), []
            for i, text in enumerate(common.utf8(part, "text")):
                for piece in found(text):
                    n[i] += len(piece)
                    keys.append(np.fromiter((k for t in piece if (k := vocabulary.get(t)) is not None), np.int64) + i * width)
            key, tf = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            cuts = np.searchsorted(key, np.arange(part.num_rows + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v.astype(np.int32))) for v in (key % width, tf)]
            out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return common.in_arrow(docs.select("doc_id", "text"), read, f"doc_id {common.id_kind(docs)}, n long, terms array<int>, tfs array<int>")


def document_counts(index: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def count(batches):
        df = np.zeros(terms, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in common.in_arrow(index.select("terms"), count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the block
        out[r.term] = r.df
    return out


def impacts(term: np.ndarray, tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each posting adds to a score, in 64-bit integers."""
    m = 10 + (90 * n * documents) // length
    return weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Segment:
    """Impact-sorted lists and the forward index of some documents; order is each document's place by its id."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, order: np.ndarray):
        self.term, self.impact, self.order = term, impact, order
        self.start = np.searchsorted(doc, np.arange(len(order) + 1))
        by = np.lexsort((-impact, term))
        self.list_doc, self.list_impact, listed = doc[by], impact[by], term[by]
        self.names, first = np.unique(listed, return_index=True)
        self.bounds = np.r_[first, len(by)]
        self.seen = np.full(len(order), -1, np.int64)
        self.turns = 0

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The whole scores of these documents for the wanted terms, by the forward index."""
        lo, size = self.start[docs], self.start[docs + 1] - self.start[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)
        return np.add.reduceat(np.where(wanted[self.term[at]], self.impact[at], 0), ends - size)  # documents here have a posting

    def best(self, item: int, terms: np.ndarray, wanted: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best with a score of `floor` or more, ties by the order of ids."""
        at = np.searchsorted(self.names, terms)
        at = at[(at < len(self.names))]
        at = at[np.isin(self.names[at], terms)]
        lo, hi = self.bounds[at], self.bounds[at + 1]
        docs, scores, depth, turn = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST_TURN
        while len(lo):
            self.turns += 1
            met = np.unique(np.concatenate([self.list_doc[a + depth : min(a + depth + turn, b)] for a, b in zip(lo, hi)]))
            met = met[self.seen[met] != item]
            self.seen[met] = item
            if len(met):
                got = self.scores(met, wanted)
                good = got >= floor
                docs, scores = np.r_[docs, met[good]], np.r_[scores, got[good]]
                first = np.lexsort((self.order[docs], -scores))[:k]
                docs, scores = docs[first], scores[first]
            depth += turn
            turn += turn >> 1
            more = lo + depth < hi
            lo, hi = lo[more], hi[more]
            # an unseen document stands in each list no higher than the next posting
            kth = max(floor, int(scores[-1]) if len(scores) == k else 0)
            if int(self.list_impact[lo + depth].sum()) < kth:
                break
        return docs, scores


def ranked_block(index: DataFrame, terms: list[np.ndarray], weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item, doc_id, score: the best of each segment for each item of the block, at least the k best of all among them."""
    flat, cuts = np.concatenate(terms), np.cumsum([0, *map(len, terms)])
    kind = common.arrow_kind(index)

    def run(batches):
        wanted, floors = np.zeros(len(weight), bool), np.ones(len(cuts) - 1, np.int64)
        held, postings = [], 0

        def closed():
            table = pa.Table.from_batches(held).combine_chunks()
            lists, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
            size = pc.list_value_length(lists).to_numpy()
            term, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            impact = impacts(term, tf, table.column("n").to_numpy()[doc], weight, documents, length)
            order = np.empty(len(size), np.int64)
            order[pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(size))
            segment = Segment(term, doc, impact, order)
            out = []
            for item in range(len(floors)):
                own = flat[cuts[item] : cuts[item + 1]]
                wanted[own] = True
                docs, scores = segment.best(item, own, wanted, k, int(floors[item]))
                wanted[own] = False
                if len(scores) == k:
                    floors[item] = max(floors[item], scores[-1])  # others of this task must reach it too
                out.append((np.full(len(docs), item), docs, scores))
            item, docs, scores = (np.concatenate(x) for x in zip(*out))
            ids = table.column("doc_id").combine_chunks().take(pa.array(docs))
            return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids.cast(kind), pa.array(scores)], names=["item", "doc_id", "score"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                postings += len(b.column(2).flatten())
            if postings >= SEGMENT_POSTINGS:
                yield closed()
                held, postings = [], 0
        if held:
            yield closed()

    some = index.where(F.size("terms") > 0)
    return common.in_arrow(some, run, f"item int, doc_id {common.id_kind(index)}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents of the highest score above 0, ties by ascending doc_id.

    items needs item_id and text, docs doc_id and text; other columns are ignored. A null or empty text has no terms: such
    an item gives no rows, such a document isn't counted. Repeated documents count and are ranked as often as they
    occur; items equal in id and text count once, items that share only the id are ranked each on its own. A null doc_id
    stands last among ties. Empty tables give no rows. A text of any length is read in pieces. The items go in blocks
    through the driver, each of a bounded number of terms. Scores are 64-bit: 90 * n * N must stay below 2^63.
    """
    spark = docs.sparkSession
    parts, kind = [], items.schema["item_id"].dataType.simpleString()
    for ids, own in blocks(items):
        vocabulary = {t: i for i, t in enumerate(sorted({t for ts in own for t in ts}))}
        where = f"{common.shared_folder(spark)}/forward-{uuid.uuid4().hex}"
        forward(docs, vocabulary).write.parquet(where)
        index = spark.read.parquet(where)
        documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_counts(index, len(vocabulary))
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        terms = [np.array([vocabulary[t] for t in ts]) for ts in own]
        names = spark.createDataFrame([Row(item=i, item_id=x) for i, x in enumerate(ids)], f"item int, item_id {kind}")
        best = ranked_block(index, terms, weight, max(documents, 1), max(length, 1), k)
        first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = best.withColumn("rank", first.cast("int")).where(F.col("rank") <= k)
        parts.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # at most BLOCK_ITEMS rows
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {common.id_kind(docs)}, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term, nn),
s AS (SELECT item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN d ON d.doc_id = p.doc_id, c GROUP BY item_id, p.doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
