"""Packing documents into token sequences: shortest-pack-first over the histogram of lengths, patterns joined back by rank."""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 1024
END = 0
#: The pre-tokeniser's pattern of byte-level BPE; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern's \s takes it. A text is encoded in parts of about PART characters that end before white
#: space; a run of LONG_RUN is taken out of the pattern's hands, which would step back over all of it.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PART, LONG_RUN = 1 << 18, 4096
LONG_SPACE = re.compile(f"{SPACE}{{{LONG_RUN},}}")
CUT = re.compile(f"(?<!{SPACE}){SPACE}")
PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, fill int"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids as little-endian 32-bit numbers, as the file's tokenizer gives them, adding no special tokens.

    A plain byte-level BPE file whose ids follow the order of its merges is run by tiktoken, several times as fast;
    any other file by the tokenizers library. Added tokens that a text spells out have their own ids, as there.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE"
    added = spec.get("added_tokens", [])
    plain = plain and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
    if plain and not model.get("ignore_merges") and not model.get("dropout"):
        special = {t["content"]: t["id"] for t in added}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged == sorted(merged) and len(ranks) == 256 + len(merged):
            import tiktoken

            fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            return functools.partial(with_added, functools.partial(encoded, fast), special)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")


def with_added(encode, added: dict[str, int], text: str) -> np.ndarray:
    """The ids of a text cut at the added tokens it spells out, leftmost first and of those the longest."""
    if not any(t in text for t in added):
        return encode(text)
    cuts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
    return np.concatenate([np.array([added[x]], "<u4") if i % 2 else encode(x) for i, x in enumerate(cuts)])


def encoded(fast, text: str) -> np.ndarray:
    """The ids of a text of any length.

    No pre-token of the pattern crosses a place where white space follows something else, so a text may be cut there.
    Of a run of white space all but its last character is one pre-token, at the text's end all of it.
    """
    text = text.encode("utf-8", "replace").decode() if not text.isascii() else text
    out, at = [], 0
    runs = [(m.start(), m.end() if m.end() == len(text) else m.end() - 1) for m in LONG_SPACE.finditer(text)] if len(text) >= LONG_RUN else []
    for start, stop in [*runs, (len(text), len(text))]:
        while at < start:
            m = CUT.search(text, at + PART, start) if start - at > PART else None
            to = m.start() if m else start
            out.append(fast.encode_to_numpy(text[at:to], disallowed_special=()))
            at = to
        if start < stop:
            out.append(np.array(fast._encode_single_piece(text[start:stop]), np.uint32))
            at = stop
    return np.concatenate(out).astype("<u4", copy=False) if out else np.zeros(0, "<u4")


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Each document's ids, with END after them, cut at multiples of `length`; fill is the piece's length as a key."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encode = encoder(path)
        for part in common.slices(batches, "text"):
            at, rows = [], []
            for i, text in enumerate(common.strings(part, "text")):
                ids = np.append(encode(text), np.uint32(END)).astype("<u4", copy=False)
                total = len(ids)
                for start in range(0, total, length):
                    own = ids[start : start + length]
                    at.append(i)
                    rows.append((start, len(own), zlib.crc32(own), total, len(own)))
            start, n, crc, total, fill = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(fill, pa.int32())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "fill"],
            )

    return common.in_arrow(docs.select("doc_id", "text"), cut, PIECE.format(kind=kind))


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns and how often each is used; a pattern is (piece length, times) from the longest.

    Lengths are placed longest first. Open packs are grouped by pattern; the pieces of one length go to the pack with
    the most room (the shortest) that takes them, all packs of that pattern at once. The work is by pattern and
    length, at most length of each, whatever the number of pieces.
    """
    open_at: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[list[tuple[int, int]], int]] = []

    def put(pattern, n, room):
        if room == 0:
            done.append((pattern, n))
        else:
            if room not in open_at:
                open_at[room] = []
                bisect.insort(rooms, room)
            open_at[room].append((pattern, n))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if rooms and rooms[-1] >= size:
                room = rooms[-1]
                pattern, n = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop()
                fits = room // size
                each = max(1, min(fits, left // n)) if left >= n else 1
                use = min(n, left)
                if use < n:
                    put(pattern, n - use, room)
                put([*pattern, (size, each)], use, room - each * size)
                left -= use * each
            else:
                each = min(length // size, left)
                packs = left // each
                put([(size, each)], packs, length - each * size)
                left -= packs * each
    return done + [x for room in rooms for x in open_at[room]]


class Slots:
    """Where the piece of a length and rank goes. Its size is that of the patterns, not of the corpus."""

    def __init__(self, patterns):
        self.by: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
        base = 0
        for pattern, n in patterns:
            offset = 0
            for size, times in pattern:
                firsts, rows = self.by.setdefault(size, ([0], []))
                rows.append((base, offset, times))
                firsts.append(firsts[-1] + n * times)
                offset += size * times
            base += n
        self.first = {k: np.array(v[0], np.int64) for k, v in self.by.items()}
        self.rows = {k: np.array(v[1], np.int64).reshape(-1, 3) for k, v in self.by.items()}

    def place(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.searchsorted(self.first[size], rank, side="right") - 1
        base, offset, times = self.rows[size][slot].T
        within = rank - self.first[size][slot]
        return base + within // times, offset + size * (within % times)


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Full pieces and rests go by their length alone, so the driver sees a histogram of at most `length` rows. A piece's
    rank among those of its length, by doc_id and start, picks its slot. Null text is empty and has END alone.
    Repeated rows and equal or null ids are packed each on its own. A long text is encoded in parts and cut into pieces
    like any other. No rows give no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    cut = common.ranked(common.checkpointed(pieces(docs, tokenizer, length)), ["fill"], ["doc_id", "start", "ids_crc32"])
    cut = common.checkpointed(cut)
    histogram = {r.fill: r.n for r in cut.groupBy("fill").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(Slots(shortest_pack_first(histogram, length)))

    def place(batches):
        for b in batches:
            fill, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
            sequence, offset = np.zeros(len(fill), np.int64), np.zeros(len(fill), np.int64)
            for size in np.unique(fill).tolist():
                at = fill == size
                sequence[at], offset[at] = slots.value.place(size, rank[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_arrow(cut, place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)
