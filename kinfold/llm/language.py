"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores with a switching penalty labels spans."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the training sample, documents of each language, taken by hash of doc_id.
TRAIN_DOCUMENTS = 1500
BUCKET_BITS = 16
PENALTY = 12.0
VITERBI_BYTES = 12 << 20
#: Scores of bytes held at once, and languages counted at once by a task.
SCORES = 1 << 24
HELD = 128
# First and last code point of the ranges in which scripts write letters, and the script.
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"),
    (0x0A80, 0x0AFF, "gujarati"), (0x0B00, 0x0B7F, "oriya"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0D80, 0x0DFF, "sinhala"),
    (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"), (0x0F00, 0x0FFF, "tibetan"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"),
)
NAMES = tuple(dict.fromkeys(s for _, _, s in SCRIPTS))
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Marks belong to the letters that they follow; a word of marks alone is none.
NOT_WORDS = regex.compile(r"[^\p{L}\p{M}\p{Nl}\p{No}]+|(?<![\p{L}\p{M}])\p{M}+|[\p{Nl}\p{No}]+")
#: Beyond so many scores a text is labelled part by part, in two passes.
LONG_SCORES = 1 << 24
LONG_PART = 1 << 18


def cleaned(text: str) -> str:
    """Lower-case words of letters and their marks, a space between them."""
    text = text.lower()
    return " ".join((NOT_LETTERS if text.isascii() else NOT_WORDS).sub(" ", text).split())


@functools.lru_cache(1 << 15)
def script_of(letter: str) -> int:
    p = ord(letter)
    return next((1 << NAMES.index(s) for a, b, s in SCRIPTS if a <= p <= b), 0)


def scripts_of(word: str) -> int:
    """The scripts of the word's letters, as bits; 0 where no range is known."""
    bits = 0
    for c in set(word):
        bits |= script_of(c)
    return bits


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes that begin and end with a space: for each byte of a word its 3-gram's bucket, its 4-gram's, whether that
    stays in the word, and where words begin among these bytes."""
    x = np.concatenate([data, np.full(2, 32, np.uint8)]).astype(np.uint32)
    at = np.nonzero(data != 32)[0]
    a, b, c, d = x[at - 1], x[at], x[at + 1], x[at + 2]
    shift = np.uint32(32 - BUCKET_BITS)
    three = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)
    four = (three ^ np.uint32(0x5BD1E995)) * np.uint32(0x27D4EB2F) + d * np.uint32(0x165667B1)
    mixed = [((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift for h in (three, four)]
    return mixed[0], mixed[1], c != 32, np.nonzero(a == 32)[0]


#: The score of a language for a word in a script that it never writes in.
OUT = np.float32(-1e4)


@dataclass
class Model:
    """languages, log probabilities by bucket of 3-grams and 4-grams, and of each script in each language's letters."""

    languages: list[str]
    three: np.ndarray
    four: np.ndarray
    uses: dict[int, np.ndarray]

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word in each language, and its letters."""
        raw = np.frombuffer(b" " + text.encode() + b" ", np.uint8)
        three, four, inside, start = grams(raw)
        scores = np.empty((len(start), len(self.languages)), np.float32)
        rows, i = max(1, SCORES // len(self.languages)), 0
        while i < len(start):  # some words at a time: with many languages a row is wide
            j = max(i + 1, int(np.searchsorted(start, start[i] + rows)))
            a, b = start[i], start[j] if j < len(start) else len(three)
            s = self.three[three[a:b]]
            s += np.where(inside[a:b, None], self.four[four[a:b]], np.float32(0))
            scores[i:j] = np.add.reduceat(s, start[i:j] - a, axis=0)
            i = j
        letters = np.add.reduceat((raw[raw != 32] & 0xC0 != 0x80).astype(np.int64), start)
        self.narrow(scores, text)
        return scores, letters

    def candidates(self, key: int) -> np.ndarray:
        """How likely each language is to write in all of these scripts, as a sum of logarithms; OUT where it never does."""
        if key not in self.uses:
            likely = np.zeros(len(self.languages), np.float32)
            for k in range(len(NAMES)):
                if key >> k & 1:
                    likely = likely + self.uses.get(1 << k, np.full(len(likely), OUT))
            self.uses[key] = np.maximum(likely, OUT)
        return self.uses[key]

    def narrow(self, scores: np.ndarray, text: str) -> None:
        """Languages that never write in a word's scripts are out for it, unless none does; a script that a language seldom
        writes in speaks against it."""
        plain, words = 1 << NAMES.index("latin"), text.split(" ")
        odd = [] if text.isascii() else [i for i, w in enumerate(words) if not w.isascii()]
        likely = self.candidates(plain)
        if likely.max(initial=OUT) > OUT and np.ptp(likely) > 1e-3:  # words of ASCII letters alone
            if odd:
                own = np.ones(len(words), bool)
                own[odd] = False
                scores[own] += likely
            else:
                scores += likely
        by: dict[int, list[int]] = {}
        for i in odd:
            by.setdefault(scripts_of(words[i]), []).append(i)
        for key, own in by.items():
            likely = self.candidates(key)
            if likely.max(initial=OUT) > OUT and np.ptp(likely) > 1e-3:
                scores[own] += likely

    def labels(self, text: str, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """Label and letters of each word of a long text, by parts between words: a pass forward keeps the state before each
        part, a pass backward works the parts out again from the last. The same as viterbi() on the whole."""
        parts, at = [], 0
        while at < len(text):
            end = text.find(" ", at + LONG_PART)
            end = len(text) if end < 0 else end
            parts.append(text[at:end])
            at = end + 1
        before, v = [], None
        for p in parts:
            before.append(v)
            v = forward(self.words(p)[0], v, penalty)[0]
        out, letters, now = [], [], int(v.argmax())
        for p, v in zip(reversed(parts), reversed(before)):
            scores, n = self.words(p)
            _, back = forward(scores, v, penalty)
            own = np.empty(len(scores), np.int64)
            for t in range(len(scores) - 1, -1, -1):
                own[t] = now
                now = int(back[t, now])
            out.append(own)
            letters.append(n)
        return np.concatenate(out[::-1]), np.concatenate(letters[::-1])


def forward(scores: np.ndarray, v: np.ndarray | None, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The state after these words, and for each word and label the label before it. v: the state before them, if any."""
    k = scores.shape[1]
    back = np.zeros(scores.shape, np.uint8 if k <= 256 else np.uint16 if k <= 1 << 16 else np.uint32)
    own = np.arange(k)
    for t in range(len(scores)):
        if v is None:
            v = scores[t].copy()
            continue
        top = int(v.argmax())
        jump = v[top] - np.float32(penalty)
        stay = v >= jump
        back[t] = np.where(stay, own, top)
        v = np.where(stay, v, jump) + scores[t]
    return v, back


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word: sum of scores less `penalty` for each switch. All texts advance by a word at a time."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    n, steps = lengths[order], int(lengths.max(initial=0))
    active = np.searchsorted(-n, -np.arange(steps), side="left")  # texts longer than t come first
    kind = np.uint8 if scores.shape[1] <= 256 else np.uint16 if scores.shape[1] <= 1 << 16 else np.uint32
    back = np.zeros(scores.shape, kind)
    own = np.arange(scores.shape[1], dtype=kind)
    v = np.zeros((len(n), scores.shape[1]), np.float32)
    for t in range(steps):
        m = active[t]
        at = first[:m] + t
        u = v[:m]
        if t:
            top = u.argmax(axis=1)
            jump = u[np.arange(m), top] - penalty
            stay = u >= jump[:, None]
            back[at] = np.where(stay, own, top[:, None].astype(kind))
            u = np.where(stay, u, jump[:, None])
        v[:m] = u + scores[at]
    label = np.zeros(len(scores), kind)
    now = v.argmax(axis=1).astype(kind)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        label[at] = now[:m]
        now[:m] = back[at, now[:m]] if t else now[:m]
    return label


def sample(docs: DataFrame, most: int) -> DataFrame:
    """At most about `most` documents of each language outside the held-out fold, by hash of doc_id."""
    fit = docs.where(~common.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = fit.groupBy("lang").agg(F.count("*").alias("n"))
    u = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return fit.join(common.small_or_not(common.checkpointed(sizes), 50_000), "lang").where(u * F.col("n") < most).select("lang", "text")


def train(docs: DataFrame, most: int = TRAIN_DOCUMENTS) -> Model:
    """Counts of hashed byte n-grams of each language over the sample; the driver gets arrays of fixed size for each language."""
    buckets = 1 << BUCKET_BITS

    def rows_of(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([common.shrunk(v[0]) for v in held.values()]), pa.array([v[1].tobytes() for v in held.values()])], names=["lang", "grams", "scripts"])

    def count(batches):
        held: dict[str, list] = {}
        for part in common.slices(batches, "text", 1 << 20):
            by: dict[str, list[str]] = {}
            for lang, text in zip(part.column(0).to_pylist(), common.strings(part, "text")):
                by.setdefault(lang, []).append(cleaned(text))
            for lang, texts in by.items():
                joined = " ".join(texts)
                three, four, inside, start = grams(np.frombuffer(b" " + joined.encode() + b" ", np.uint8))
                row = held.setdefault(lang, [np.zeros(2 * buckets, np.int64), np.zeros(len(NAMES), np.int64)])
                if len(three):
                    row[0] += np.r_[np.bincount(three, minlength=buckets), np.bincount(four[inside], minlength=buckets)]
                for c in set(joined):
                    k = scripts_of(c)
                    if k:
                        row[1][k.bit_length() - 1] += joined.count(c)
                if len(held) >= HELD:
                    yield rows_of(held)
                    held = {}
        if held:
            yield rows_of(held)

    def add(batches):  # sorted by language
        last, row = None, None
        for b in batches:
            for lang, g, s in zip(*(c.to_pylist() for c in b.columns)):
                if lang != last and row is not None:
                    yield rows_of({last: row})
                    row = None
                row = row or [0, 0]
                last, row = lang, [row[0] + common.unpacked(g).astype(np.int64), row[1] + np.frombuffer(s, np.int64)]
        if row is not None:
            yield rows_of({last: row})

    schema = "lang string, grams binary, scripts binary"
    rows = common.in_arrow(common.in_arrow(sample(docs, most), count, schema).repartition("lang").sortWithinPartitions("lang"), add, schema).collect()
    if not rows:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros((buckets, 0), np.float32), {})
    rows.sort(key=lambda r: r.lang)
    log = np.empty((2, buckets, len(rows)), np.float32)
    for i, r in enumerate(rows):
        counts = common.unpacked(bytes(r.grams)).astype(np.float64).reshape(2, -1)
        log[:, :, i] = np.log((counts + 0.2) / (counts.sum(axis=1, keepdims=True) + 0.2 * buckets))
    letters = np.array([np.frombuffer(bytes(r.scripts), np.int64) for r in rows], np.float64).reshape(len(rows), -1)
    with np.errstate(divide="ignore"):
        likely = np.maximum(np.log(letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)), OUT).astype(np.float32)
    uses = {1 << k: likely[:, k] for k in range(len(NAMES))}
    uses[0] = np.zeros(len(rows), np.float32)
    return Model([r.lang for r in rows], log[0], log[1], uses)


def identified(docs: DataFrame, model: Model | None = None, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans for each row of docs.

    spans lists (first word, last word, language) over the words of letters; lang_pred has most letters, score is its
    share of them. A long text is worked through in parts, so it costs its words and a byte or two for each word and
    language of a part. Null text, no letter, or nothing to learn from: `und`, score 0, no spans. Ties go to the first
    language by code point. A null doc_id is held out. Repeated rows return as often as they occur; no rows give no
    rows; extra columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def label(batches):
        m = model.value
        k = len(m.languages)
        for part in common.slices(batches, "text", VITERBI_BYTES * 8 // max(8, k)):
            texts = [cleaned(t) for t in common.strings(part, "text")]
            long = {i for i, t in enumerate(texts) if (t.count(" ") + 1) * k > LONG_SCORES}
            some = [i for i, t in enumerate(texts) if t and i not in long] if k else []
            found = [m.words(texts[i]) for i in some]
            pred, score, spans = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            labelled = []
            if found:
                lengths = np.array([len(s) for s, _ in found])
                labels = np.split(viterbi(np.concatenate([s for s, _ in found]), lengths, penalty), np.cumsum(lengths)[:-1])
                labelled = [(i, own, letters) for i, own, (_, letters) in zip(some, labels, found)]
            if k:
                labelled += [(i, *m.labels(texts[i], penalty)) for i in sorted(long)]
            if labelled:
                for i, own, letters in labelled:
                    share = np.bincount(own, letters, minlength=k)
                    best = int(share.argmax())
                    pred[i], score[i] = m.languages[best], share[best] / share.sum()
                    cut = np.r_[0, np.nonzero(own[1:] != own[:-1])[0] + 1, len(own)]
                    spans[i] = [{"first": int(a), "last": int(b) - 1, "lang": m.languages[own[a]]} for a, b in zip(cut[:-1], cut[1:])]
            kinds = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred), pa.array(score), pa.array(spans, kinds)], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, spans array<struct<first: int, last: int, lang: string>>"
    return common.in_arrow(docs.select("doc_id", common.held_out().alias("held_out"), "text"), label, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(common.table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans")).drop("spans")
