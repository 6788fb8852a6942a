"""Hard negatives, exact dedup and lexical search against brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import common, exact_dedup, hard_negatives, lexical

DOCS = "doc_id long, text string, digest string, n string, keep string, hot_n int, item int, terms string, score string, rank int, salt int"
EXTRA = ("d", "n", "k", 1, 2, "t", "s", 3, 4)


def awkward_texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéABC7") for _ in range(r.randint(1, 5))) for _ in range(200)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(1, 60))) for i in range(120)]
    rows += [(i, rows[i % 7][1]) for i in range(200, 260)]  # copies
    rows += [(i, "the same hot text") for i in range(300, 420)]
    rows += [(500, None), (501, ""), (502, " \n\t-_."), (None, "the same hot text"), (None, "only without id"), (503, "only without id"), (None, None), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(600, text(60_000)), (601, "x" * 700_000), (602, "one·two\x1cthree 日本語 ０１ ǅ Éé É"), (603, "ﬀ" * 300_000 + " a7")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return common.checkpointed(spark.createDataFrame([(*r, *EXTRA) for r in awkward_texts()], DOCS).repartition(5))


# 11


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    most = hard_negatives.bound_of(len(v))
    return [max(-most, min(most, math.floor(Fraction(256) * Fraction(x)))) for x in v]


def mined(rows, is_anchor, positives=5, negatives=10):
    """Every pair scored; rows are (vec_id, label, vector)."""
    good = [(i, y, whole(v)) for i, y, v in rows if i is not None and y is not None and whole(v) is not None]
    out = []
    for i, y, v in {(i, y, tuple(v)) for i, y, v in good if is_anchor(i)}:
        others = sorted(((-dot(v, w), j, z) for j, z, w in good if j != i and len(w) == len(v)))
        for score, j, _ in [o for o in others if o[2] == y][:positives]:
            fit = [o for o in others if o[2] != y and 30 * -score <= -100 * o[0] <= 90 * -score][:negatives]
            out += [(i, j, k + 1, o[1], -score, -o[0]) for k, o in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, label int, vector array<double>, rank int, window string, code string, dims int, _a int, _s string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", "c", 2, 3, "s") for r in rows], VECTORS).repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_hard_negatives_brute_force(spark):
    r = random.Random(8)
    point = lambda n: [r.gauss(0, 0.3) for _ in range(n)]
    same = point(6)
    rows = [(i, r.choice([0, 0, 0, 1, 2, -3]), point(6)) for i in range(260)]
    rows += [(1000 + i, i % 2, same) for i in range(60)]  # ties of equal vectors
    rows += [(2000, 0, point(4)), (2010, 1, point(4)), (2020, 0, point(4)), (2030, 0, []), (2040, 1, []), (2050, 0, [0.0] * 6), (2060, 9, point(6))]
    rows += [(3000, None, same), (3010, 1, None), (None, 0, same), (3020, 1, [0.1] * 5 + [None]), (3030, 0, [0.1] * 5 + [float("nan")]), (3040, 0, [float("inf")] * 6)]
    rows += [(3050, 0, [1e30, -1e30, 1.0, 0.0, 0.0, 0.0]), (10, 1, point(6)), (20, rows[20][1], rows[20][2]), (25, rows[25][1], rows[25][2])]
    want = mined(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    for block, split in ((1 << 14, 1 << 20), (5, 40)):
        assert got(hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, block=block, split=split)) == want
    none = vectors(spark, []).where("vec_id > 0")
    assert got(hard_negatives.hard_negatives(none, F.col("vec_id") % 10 == 0)) == []
    assert got(hard_negatives.hard_negatives(vectors(spark, rows[:9]), F.lit(False))) == []


def test_bounds_hold_and_spare_exact_scores():
    r = np.random.default_rng(2)
    vec = np.floor(r.normal(0, 40, (3000, 32))).astype(np.int32)
    cut = np.zeros((32, hard_negatives.CELLS), np.int64), np.zeros((32, hard_negatives.CELLS), np.int64)
    for d in range(32):
        for c, part in enumerate(np.array_split(np.unique(vec[:, d]), hard_negatives.CELLS)):
            cut[0][d, c], cut[1][d, c] = (part[0], part[-1]) if len(part) else (cut[0][d, c - 1], cut[1][d, c - 1])
    codes = np.stack([np.searchsorted(cut[1][d], vec[:, d]) for d in range(32)], axis=1).astype(np.uint8)
    windows = np.tile(np.array([[0, 12_000]]), (8, 1, 1)).astype(np.int64)
    b = hard_negatives.Block(vec[:8], np.arange(8), np.zeros(8, np.int64), windows, cut, False, 10)
    least, most = b.bounds(slice(0, 8), codes)
    exact = vec.astype(np.int64) @ vec[:8].T.astype(np.int64)
    assert (least <= exact).all() and (exact <= most).all()
    b.pass_rows(np.arange(3000), np.ones(3000, np.int64), vec.astype(np.int64), codes)
    for a in range(8):
        first = sorted((-s, i) for i, s in enumerate(exact[:, a].tolist()) if 0 <= s <= 12_000 and i != a)[:10]
        assert [(-s, i) for s, i in zip(b.scores[a, 0].tolist(), b.rows[a, 0].tolist())] == first
    assert b.scored < b.bounded / 10


def test_cells_cover_all_rows(spark):
    rows = [(i, 0, [float(i % 300), -1.0 * i, 0.5]) for i in range(2000)]
    lo, hi = hard_negatives.cells(hard_negatives.taken(vectors(spark, rows)))[3]
    assert (lo <= hi).all() and (hi[:, :-1] <= hi[:, 1:]).all()
    assert lo[0].min() == 0 and hi[0].max() == 299 * 256 and lo[1].min() == -1999 * 256 and hi[1].max() == 0 and set(lo[2]) == {128}
    counts = Counter(np.searchsorted(hi[0], [256 * (i % 300) for i in range(2000)]).tolist())
    assert len(counts) > 40 and max(counts.values()) < 2000 / 20


# 12


def kept(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return sorted(((i, best[t or ""], len(by[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("hot,groups", [(4096, 100_000), (20, 100_000), (20, 0)])
def test_exact_dedup(docs, monkeypatch, hot, groups):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", groups)
    monkeypatch.setattr(exact_dedup, "SALTS", 5)
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(docs).collect()), key=str) == kept(awkward_texts())
    assert exact_dedup.exact_dedup(docs.where("false")).collect() == []


def test_exact_dedup_by_names(docs):
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    want = kept([(None if i is None else f"d{i:05d}", t) for i, t in awkward_texts()])
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(named).collect()), key=str) == want


def test_cuckoo_filter_holds_what_it_was_given():
    r = random.Random(1)
    keys = [r.getrandbits(64) for _ in range(3000)]
    shard, told = exact_dedup.Shard(), [k.to_bytes(8, "little") + bytes(24) for k in keys]  # all in one content bucket
    for k, digest in enumerate(told):
        shard.insert(digest, k, 1)
        if k % 500 == 0:
            shard.insert(digest, k + 5, 2)
    assert shard.resized >= 2 and all(shard.find(d) == k for k, d in enumerate(told))
    assert (shard.n[500], shard.keep[500]) == (3, 505)
    for d in told[::2]:
        shard.delete(d)
        shard.delete(d)
    assert all(shard.find(d) is None for d in told[::2]) and all(shard.find(d) is not None for d in told[1::2])
    absent = [r.getrandbits(64) for _ in range(20_000)]
    assert sum(k in shard.filter for k in absent) < 20
    for k, d in enumerate(told[::2]):
        shard.insert(d, k, 7)
    assert all(shard.n[shard.find(d)] == 7 for d in told[::2])
    again = exact_dedup.Cuckoo(raw=shard.filter.slots.tobytes())
    assert all(k in again for k in keys)


def test_index_over_versions(spark, docs):
    rows = exact_dedup.digested(docs)
    first = exact_dedup.Index.build(rows.where("doc_id < 250"), shards=3)
    second = first.insert(rows.where("doc_id >= 250 OR doc_id IS NULL"))
    gone = [r.text for r in docs.where("doc_id IN (3, 300, 600)").select("text").distinct().collect()]
    third = second.delete(rows.where("doc_id IN (3, 300, 600)"))
    back = third.insert(rows.where("doc_id = 600"))
    all_ = awkward_texts()
    by = lambda some: {hashlib.sha256((t or "").encode()).digest(): (k, n) for _, k, n, _, _ in () for t in ()} or {bytes.fromhex(s): (k, n) for _, k, n, _, s in kept(some)}
    live = lambda index: {bytes(r.digest): (r.keep, r.n) for r in index.content().collect()}
    assert live(first) == by([x for x in all_ if x[0] is not None and x[0] < 250])
    assert live(second) == by(all_) == live(exact_dedup.Index.build(rows, shards=7))
    assert live(third) == by([x for x in all_ if x[1] not in gone])
    assert live(back) == by([x for x in all_ if x[1] not in gone or x[0] == 600])
    found = {(r.doc_id, bytes(r.digest)): (r.keep_id, r.live) for r in third.find(docs).collect()}
    left = live(third)
    assert len(found) == len(set(all_)) and all(v == ((left[d][0], True) if d in left else (None, False)) for (_, d), v in found.items())


# 13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def ranked(rows, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length, df = len(counts), sum(x[2] for x in counts), Counter(t for _, c, _ in counts for t in c)
    w = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
    out = []
    for item, text in set(items):
        scores = [(sum(w(t) * ((10**9 * c[t]) // (1000 * c[t] + 8 * (10 + (90 * m * n) // length))) for t in set(terms(text)) if t in c), i) for i, c, m in counts]
        best = sorted((-s, i is None, i or 0, i) for s, i in scores if s > 0)[:k]
        out += [(item, r + 1, b[3], -b[0]) for r, b in enumerate(best)]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, rank int, doc_id string")


ITEMS = [(1, "the same hot text"), (2, "a b C7 dé"), (3, None), (4, "..."), (5, "zzzz unknownword"), (6, "日本語 one two"), (1, "the same hot text"), (8, "X" * 700_000), (None, "hot"), (9, "TEXT text Text")]


@pytest.mark.parametrize("postings,block", [(1 << 20, 20_000), (50, 3)])
def test_lexical_search(spark, docs, monkeypatch, postings, block):
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", postings)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical, "FIRST_TURN", 2)
    items = ITEMS + [(100 + i, awkward_texts()[i][1]) for i in range(20)]
    assert sorted((tuple(r) for r in lexical.search(docs, items_of(spark, items)).collect()), key=str) == ranked(awkward_texts(), items)


def test_lexical_search_without_rows(spark, docs):
    items = items_of(spark, ITEMS)
    assert lexical.search(docs.where("false"), items).collect() == []
    assert lexical.search(docs, items.where("false")).collect() == []
    assert lexical.search(docs.where("doc_id = 501"), items).collect() == []


def test_long_texts_are_counted_whole(monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice("ab-é 日7Z") for _ in range(5000))
    whole_ = [t.encode() for t in terms(text)]
    for size in (1, 7, 100):
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        assert [t for piece in lexical.found(text.encode()) for t in piece] == whole_


def test_threshold_stops_before_the_lists_end():
    r = np.random.default_rng(5)
    doc = np.repeat(np.arange(20_000), 3)
    term = np.concatenate([r.choice(30, 3, replace=False) for _ in range(20_000)])
    by = np.lexsort((term, doc))
    doc, term = doc[by], term[by].astype(np.int64)
    impact = (r.pareto(1.0, len(doc)) * 1000).astype(np.int64) + 1
    segment = lexical.Segment(term, doc, impact, np.arange(20_000))
    wanted = np.zeros(30, bool)
    own = np.array([1, 4, 9])
    wanted[own] = True
    docs_, scores = segment.best(0, own, wanted, 10, 1)
    total = np.bincount(doc, np.where(wanted[term], impact, 0), 20_000).astype(np.int64)
    want = sorted((-s, i) for i, s in enumerate(total.tolist()))[:10]
    assert [(-s, i) for s, i in zip(scores.tolist(), docs_.tolist())] == want
    assert (segment.seen == 0).sum() < 4000  # documents scored, of about 6,000 with a term
