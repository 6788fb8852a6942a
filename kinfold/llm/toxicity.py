"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import bisect
import itertools
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample, documents of each label, taken by hash of doc_id.
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
SHORTEST, LONGEST = 4, 10
MIN_DOCUMENTS, MIN_CONTEXTS, MIN_ODDS = 6, 4, 2.5
#: A term is frequent in a text if it takes one in DENSE words: of stems that also begin harmless words, frequency tells.
DENSE = 150
#: L1 penalties of a term, in toxic documents that it must explain alone, of which folds of the training sample choose
#: one, and steps of a fit and of a fit to a fold.
PENALTIES, ROUNDS, FOLD_ROUNDS = (0.5, 1.0, 2.0, 4.0), 600, 150
# What digits and signs stand for inside a word, and letters of other scripts that look like Latin ones.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ı": "i", "ʟ": "i", "ß": "ss", "6": "b",
}
#: Cherokee capitals and the Latin ones that they look like.
CHEROKEE = {
    "Ꭰ": "d", "Ꭱ": "r", "Ꭲ": "t", "Ꭵ": "i", "Ꭺ": "a", "Ꭻ": "j", "Ꭼ": "e", "Ꮃ": "w", "Ꮇ": "m", "Ꮋ": "h", "Ꮐ": "g", "Ꮒ": "h", "Ꮓ": "z", "Ꮢ": "r", "Ꮤ": "w", "Ꮥ": "s", "Ꮩ": "v", "Ꮪ": "s", "Ꮮ": "l", "Ꮯ": "c", "Ꮲ": "p", "Ꮶ": "k", "Ᏼ": "b",
}
INVISIBLE = "­​‌‍⁠﻿"
OTHER = re.compile(r"[\W_]+")
#: Blocks whose characters are folded by what they decompose to: accented Latin, raised and lowered letters, letter-like
#: signs, Roman numerals, enclosed letters, full-width forms, mathematical letters and digits, squared letters.
DECOMPOSED = (range(0xC0, 0x250), range(0x1D2C, 0x1DC0), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0x2100, 0x2150), range(0x2160, 0x2180), range(0x2460, 0x2500), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x1F100, 0x1F190))


def folding() -> dict[int, str | None]:
    """Accents, full-width, raised, enclosed and mathematical letters go by decomposition; look-alikes and digits become
    letters; i and l are one letter."""
    table: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
    for p in [p for block in DECOMPOSED for p in block]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(p)).lower() if not unicodedata.combining(c))
        if len(base) == 1 or unicodedata.category(chr(p))[0] in "LN":  # a sign that stands for several characters is no letter
            table[p] = "".join(DIGITS.get(c, LOOKALIKES.get(c, c)) for c in base)
    for p in range(0x300, 0x370):
        table[p] = None
    for c, base in (LOOKALIKES | DIGITS | {x: base for c, base in CHEROKEE.items() for x in (c, c.lower())}).items():
        table[ord(c)] = "".join(DIGITS.get(b, b) for b in base)
    return table


FOLD = folding()


def folded(text: str) -> str:
    """Lower case, folded, words apart by one space, a space at both ends. `!` at a word's end is no letter."""
    text = text.lower()
    if "!" in text:
        text = re.sub(r"!+(?!\w)", " ", text)
    return f" {OTHER.sub(' ', text.translate(FOLD)).strip()} "


def word_features(word: str):
    """Starts of a word, so that a stem covers its forms; a short word as a whole."""
    if len(word) < SHORTEST:
        yield f" {word} "
    else:
        for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
            yield " " + word[:n]


def term_density(text: str) -> dict[str, bool]:
    """The terms of a text, and whether a term takes at least one in DENSE of its words."""
    words = folded(text).split()
    n: Counter = Counter()
    for w, k in Counter(words).items():
        for f in word_features(w):
            n[f] += k
    return {f: k * DENSE >= len(words) for f, k in n.items()}


@dataclass
class Model:
    terms: dict[str, float]
    exceptions: list[str]
    weights: np.ndarray

    def automaton(self):
        found = ahocorasick.Automaton()
        for t, w in self.terms.items():
            found.add_word(t, (len(t), w))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found if len(found) else None


def hits(text: str, automaton) -> tuple[float, int]:
    """Sum of the weights of the matches outside exception phrases, one for each place, and their number."""
    if automaton is None:
        return 0.0, 0
    at: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(text):
        start = end - n + 1
        if w is None:
            spared.append((start, end))
        elif w > at.get(start, 0.0):
            at[start] = w
    if spared:
        # phrases from the left; of those that begin at or before a place, the furthest end tells
        spared.sort()
        begins, reach = [a for a, _ in spared], list(itertools.accumulate((b for _, b in spared), max))
        at = {s: w for s, w in at.items() if not ((k := bisect.bisect_right(begins, s)) and reach[k - 1] > s)}
    return sum(at.values()), len(at)


def features(text: str, automaton) -> list[float]:
    """Constant, saturating sum of weights, the sum for each hundred words, whether anything matched."""
    total, n = hits(text, automaton)
    words = text.count(" ") - 1 if len(text) > 2 else 0
    return [1.0, math.log1p(total), math.log1p(100 * total / (words + 20)), float(n > 0)]


def labelled(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """toxic (0 or 1), text and fold (1 to 4) of the sample: at most about `toxic` and `clean` documents outside the held-out fold."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~common.held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = common.checkpointed(own)
    n = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).where("toxic IN (0, 1)").collect()}
    u = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, toxic / max(n.get(1, 0), 1)).otherwise(clean / max(n.get(0, 0), 1))
    own = own.where("toxic IN (0, 1)").where(u < share)
    # The sample's size is bound by its shares; a hash that fails that bound would join by shuffle.
    own = common.small_or_not(own, 2 * (toxic + clean))
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(own, "doc_id").select("toxic", "text", (common.text_crc() % 5).cast("int").alias("fold"))


def explaining(y: list[int], terms: list[list[int]], n: int, penalty: float = 1.0, rounds: int = ROUNDS) -> list[int]:
    """Terms that sparse() gives any weight."""
    return np.nonzero(sparse(y, terms, n, penalty, rounds)[0] > 0.05)[0].tolist()


def chosen_penalty(y: list[int], terms: list[list[int]], fold: list[int], n: int) -> float:
    """The penalty under which fits to all folds but one tell the labels of that one best; of equal ones the largest.

    All of it is the training sample: the held-out fold of the corpus has no part in it.
    """
    loss = dict.fromkeys(PENALTIES, 0.0)
    for f in sorted(set(fold)):
        rest, own = [i for i, k in enumerate(fold) if k != f], [i for i, k in enumerate(fold) if k == f]
        if len({y[i] for i in rest}) < 2:
            continue
        for penalty in PENALTIES:
            w, base = sparse([y[i] for i in rest], [terms[i] for i in rest], n, penalty, FOLD_ROUNDS)
            z = np.array([base + w[terms[i]].sum() for i in own])
            loss[penalty] += float(np.logaddexp(0, np.where(np.array([y[i] for i in own]) == 1, -z, z)).sum())
    return min(reversed(PENALTIES), key=lambda x: round(loss[x], 6))


def sparse(y: list[int], terms: list[list[int]], n: int, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and base of a logistic regression on presence, with weights of at least 0 and an L1 penalty.

    A term whose toxic documents others explain already, as words that happen to stand in them or a start shared with
    harmless words, gets none. Accelerated proximal gradient steps; the work is by terms present and rounds.
    """
    if not any(terms):
        return np.zeros(n), 0.0
    y = np.array(y, float)
    doc = np.repeat(np.arange(len(y)), [len(x) for x in terms])
    term = np.array([i for x in terms for i in x], np.int64)
    order = np.lexsort((term, doc, y[doc] if len(doc) else doc))  # sums come in the same order whatever the partitions
    doc, term = doc[order], term[order]
    per_term = np.bincount(term, minlength=n).astype(float)
    # curvature of a coordinate is at most a quarter of its documents times the terms of one of them
    most = max((len(x) for x in terms), default=0) + 1
    step = 4.0 / (np.maximum(per_term, 1.0) * most)
    w, base = np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ahead, ahead_base, t = w, base, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ahead_base + np.bincount(doc, ahead[term], len(y)), -30, 30)))
        g = np.bincount(term, (p - y)[doc], n)
        new = np.maximum(ahead - step * (g + penalty), 0.0)
        new_base = ahead_base - 4.0 / (len(y) * most) * float((p - y).sum())
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_base = new + (t - 1) / after * (new - w), new_base + (t - 1) / after * (new_base - base)
        w, base, t = new, new_base, after
    return w, base


def learn_terms(sample: DataFrame) -> tuple[dict[str, float], list[str]]:
    """Word starts that mark toxic documents, with smoothed log odds as weights, and phrases that excuse them.

    The odds are those of a term's presence or of its frequency (DENSE), whichever tell more.

    A term needs MIN_DOCUMENTS toxic documents in which it is frequent and MIN_CONTEXTS different words before it in these, so that copies of
    one toxic document don't teach its other words. Of these the terms are kept that explain labels which the others
    don't (explaining). A term that tells by presence is
    excused after a word that clean documents alone put before it, in three or more.
    """

    def count(batches):
        by = Counter()
        for part in common.slices(batches, "text"):
            for y, text in zip(part.column(0).to_pylist(), common.strings(part, "text")):
                for f, dense in term_density(text).items():
                    by[f, dense, y] += 1
        if by:
            f, dense, y = zip(*by)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(dense), pa.array(y, pa.int32()), pa.array(list(by.values()), pa.int64())], names=["f", "dense", "toxic", "n"])

    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}, []
    by = common.in_arrow(sample, count, "f string, dense boolean, toxic int, n long").groupBy("f")
    of = lambda toxic, dense: F.coalesce(F.sum(F.when(F.expr(f"toxic = {toxic}" + " AND dense" * dense), F.col("n"))), F.lit(0))
    by = by.agg(of(1, False).alias("pos"), of(0, False).alias("neg"), of(1, True).alias("dense_pos"), of(0, True).alias("dense_neg"))
    odds = lambda pos, neg: F.log((F.col(pos) + 0.5) / (n[1] + 1)) - F.log((F.col(neg) + 0.5) / (n[0] + 1))
    by = by.where(F.col("dense_pos") >= MIN_DOCUMENTS).withColumns({"once": odds("pos", "neg"), "often": odds("dense_pos", "dense_neg")})
    rows = by.where(F.greatest("once", "often") >= MIN_ODDS).collect()  # as many as a bounded sample has
    wanted = {r.f: (r.pos, max(r.once, r.often), r.often > r.once, (r.pos, r.neg, r.dense_pos, r.dense_neg)) for r in rows}
    # a start that the same documents have as a shorter one says nothing new
    wanted = {f: v for f, v in wanted.items() if not any(f[:k] in wanted and wanted[f[:k]][3] == v[3] for k in range(SHORTEST + 1, len(f)))}

    def contexts(batches):
        for part in common.slices(batches, "text"):
            found = set()
            for y, text in zip(part.column(0).to_pylist(), common.strings(part, "text")):
                before = ""
                for w in folded(text).split():
                    found.update((f, before, y) for f in word_features(w) if f in wanted)
                    before = w
            if found:
                f, b, y = zip(*sorted(found))
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(b), pa.array(y, pa.int32())], names=["f", "before", "toxic"])

    seen = common.in_arrow(sample, contexts, "f string, before string, toxic int").groupBy("f", "before").agg(F.count_if(F.expr("toxic = 1")).alias("pos"), F.count_if(F.expr("toxic = 0")).alias("neg"))
    seen = common.checkpointed(seen)
    diverse = {r.f for r in seen.groupBy("f").agg(F.count_if(F.expr("pos > 0")).alias("n")).where(F.col("n") >= MIN_CONTEXTS).collect()}
    names = sorted(diverse)
    number = {f: i for i, f in enumerate(names)}

    def present(batches):
        for part in common.slices(batches, "text"):
            found = [sorted(number[f] for f, dense in term_density(x).items() if f in number and (dense or not wanted[f][2])) for x in common.strings(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "fold", "terms"])

    rows = common.in_arrow(sample, present, "toxic int, fold int, terms array<int>").collect()  # a row for each sampled document
    y, own = [r.toxic for r in rows], [r.terms for r in rows]
    picked = explaining(y, own, len(names), chosen_penalty(y, own, [r.fold for r in rows], len(names)))
    chosen = dict(sorted((names[i], wanted[names[i]][1]) for i in picked))
    excuse = seen.where("neg >= 3 AND pos = 0 AND before <> ''").orderBy("f", "before").collect()
    return chosen, [f" {r.before}{r.f}" for r in excuse if r.f in chosen and not wanted[r.f][2]]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Logistic regression with equal total weight of both labels' odds kept as they are, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * np.r_[0, w[1:]]
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.diag(np.r_[0, np.ones(len(w) - 1)])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Model:
    sample = common.checkpointed(labelled(docs, labels, toxic, clean))  # bounded by its documents, read five times
    terms, exceptions = learn_terms(sample)
    model = Model(terms, exceptions, np.array([-3.0, 0, 0, 0]))
    own = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        automaton = own.value.automaton()
        for part in common.slices(batches, "text"):
            x = [features(folded(t), automaton) for t in common.strings(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in zip(*x))], names=["y", "a", "b", "c", "d"])

    rows = common.in_arrow(sample, measure, "y int, a double, b double, c double, d double").collect()  # four numbers of each sampled document
    if len({r.y for r in rows}) == 2:
        rows.sort()
        x = np.array([r[1:] for r in rows])
        model.weights = fit(x, np.array([r.y for r in rows], float))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, hits for each row of docs.

    Null and empty texts match nothing and get the score of such texts. Of terms that begin at one place the heaviest
    counts; a long text costs its folded copy and its matches. Repeated rows return as often as they occur;
    a null doc_id is held out; no rows give no rows; extra columns are ignored. Without both labels to learn from,
    nothing matches and every score is below one half.
    """
    own = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        m = own.value
        automaton = m.automaton()
        for part in common.slices(batches, "text"):
            x = np.array([features(folded(t), automaton) for t in common.strings(part, "text")])
            p = 1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(x[:, 3] > 0)], names=["doc_id", "held_out", "score", "predicted", "matched"])

    return common.in_arrow(docs.select("doc_id", common.held_out().alias("held_out"), "text"), score, f"doc_id {kind}, held_out boolean, score double, predicted int, matched boolean")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, train(docs, common.table(spark, sf_dir, "labels")))
