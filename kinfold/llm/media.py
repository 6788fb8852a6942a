"""ISO media containers: write samples into boxes, walk the nested boxes of a file, decode its sample tables.

The reader touches boxes and tables; payloads stay undecoded byte ranges.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

UNIT = 576
PAD = b"\xff"
TIMESCALE = 48_000
#: Boxes whose content is boxes, with the bytes before the first one. Fixed values of the format.
NESTED = {b"moov": 0, b"moof": 0, b"traf": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes, unit: int = UNIT, chunk: int = 64, key_every: int = 16) -> bytes:
    """payload as mono 8-bit unsigned samples (codec `raw `), `unit` bytes to a table entry, `chunk` entries to a chunk.

    Every key_every-th entry is listed as a sync sample. A payload of 4 GiB or more gets a 64-bit mdat and co64.
    """
    n, rest = divmod(len(payload), unit)
    sizes = [unit] * n + [rest] * (rest > 0)
    count = len(sizes)
    chunks = -(-count // chunk)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ticks = len(payload)

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = (first + np.arange(chunks, dtype=np.int64) * chunk * unit).astype(">u8" if wide else ">u4").tobytes()
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
        runs = [(1, chunk)] if chunks and count % chunk == 0 or chunks == 1 and count == chunk else []
        if count and not runs:
            runs = ([(1, chunk)] if chunks > 1 else []) + [(chunks, count - (chunks - 1) * chunk)]
        stsz = struct.pack(">II", unit, count) if not rest else struct.pack(">II", 0, count) + np.array(sizes, ">u4").tobytes()
        stts = ([(n, unit)] if n else []) + ([(1, rest)] if rest else [])
        keys = np.arange(1, count + 1, key_every, dtype=">u4")
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">I", len(stts)), b"".join(struct.pack(">II", *x) for x in stts)),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *x, 1) for x in runs)),
            full_box(b"stsz", stsz),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets),
        )
        dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1)
        mdia = box(b"mdia", mdhd, full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    large = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    first = len(ftyp) + len(moov(0)) + len(head)
    first = len(ftyp) + len(moov(first)) + len(head)  # wide offsets lengthen moov
    return b"".join([ftyp, moov(first), head, payload])


def boxes(data: memoryview, start: int, end: int):
    """(kind, start of content, end) of each box from start to end. A box that runs past its parent raises."""
    while start < end:
        if end - start < 8:
            raise ValueError(f"box header cut at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}")
        yield kind, body, start + size
        start += size


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    number: int = 0
    tables: dict[bytes, tuple[int, int]] = field(default_factory=dict)
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def ranges(self, at: np.ndarray) -> list[tuple[int, int]]:
        """Byte ranges [start, end) of the given samples; neighbours stay apart."""
        return [(int(o), int(o + n)) for o, n in zip(self.offsets[at], self.sizes[at])]


def numbers(data: memoryview, at: int, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def sample_table(data: memoryview, t: Track) -> None:
    """Sizes and offsets of all samples, from stsz or stz2, stsc and stco or co64, and the numbers of sync samples from stss."""
    if b"stz2" in t.tables:  # sizes of 4, 8 or 16 bits
        at = t.tables[b"stz2"][0]
        bits, count = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits not in (4, 8, 16):
            raise ValueError(f"stz2 has sizes of {bits} bits")
        own = numbers(data, at + 12, (count * bits + 7) // 8 if bits < 16 else count, ">u2" if bits == 16 else "u1")
        t.sizes = np.stack([own >> 4, own & 15], axis=1).ravel()[:count] if bits == 4 else own
    elif b"stsz" in t.tables:
        size, count = struct.unpack_from(">II", data, t.tables[b"stsz"][0] + 4)
        if size * count > len(data):
            raise ValueError("stsz has more bytes of samples than the file")
        t.sizes = np.full(count, size, np.int64) if size else numbers(data, t.tables[b"stsz"][0] + 12, count, ">u4")
    else:
        raise ValueError("a track without stsz and stz2")
    missing = [k.decode() for k in (b"stsc", b"stco") if k not in t.tables and not (k == b"stco" and b"co64" in t.tables)]
    if missing:
        raise ValueError(f"a track without {missing[0]}")
    wide = b"co64" in t.tables
    at = t.tables[b"co64" if wide else b"stco"][0]
    chunks = numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u8" if wide else ">u4")
    at = t.tables[b"stsc"][0]
    runs = numbers(data, at + 8, 3 * struct.unpack_from(">I", data, at + 4)[0], ">u4").reshape(-1, 3)
    if len(chunks):
        first = np.r_[runs[:, 0], len(chunks) + 1]
        if first[0] != 1 or (np.diff(first) < 0).any():
            raise ValueError("stsc names chunks that are not there")
        ends = np.minimum(np.cumsum(np.minimum(np.repeat(runs[:, 1], np.diff(first)), count)), count)  # no more samples than there are
        chunk = np.repeat(np.arange(len(chunks)), np.diff(np.r_[0, ends]))
        before = np.cumsum(t.sizes) - t.sizes
        t.offsets = chunks[chunk] + before - before[np.r_[0, ends][chunk]]
    if b"stss" in t.tables:
        at = t.tables[b"stss"][0]
        t.keys = numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u4") - 1
    else:  # without the table every sample is a sync sample
        t.keys = np.arange(count)


@dataclass
class Fragment:
    """What a track fragment says before its runs: track, where its data starts, size and flags of a sample that says nothing else."""

    moof: int
    track: int = 0
    base: int | None = None
    size: int = 0
    flags: int = 0
    end: int | None = None


def fragment_header(data: memoryview, body: int, f: Fragment, defaults: dict[int, tuple[int, int]]) -> None:
    flags, f.track = int.from_bytes(data[body + 1 : body + 4]), struct.unpack_from(">I", data, body + 4)[0]
    f.size, f.flags = defaults.get(f.track, (0, 0))
    at = body + 8
    for bit, width in ((0x1, 8), (0x2, 4), (0x8, 4), (0x10, 4), (0x20, 4)):
        if flags & bit:
            value = int.from_bytes(data[at : at + width])
            at += width
            if bit == 0x1:
                f.base = value
            elif bit == 0x10:
                f.size = value
            elif bit == 0x20:
                f.flags = value
    if f.base is None:
        f.base = f.moof


def fragment_run(data: memoryview, body: int, stop: int, f: Fragment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, sizes and whether it is a sync sample of each sample of one run of a track fragment."""
    flags, count = int.from_bytes(data[body + 1 : body + 4]), struct.unpack_from(">I", data, body + 4)[0]
    at, start = body + 8, f.end if f.end is not None else f.base
    if flags & 0x1:
        start = f.base + struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & 0x4:
        first = struct.unpack_from(">I", data, at)[0]
        at += 4
    told = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if count > len(data):
        raise ValueError("trun has more samples than the file bytes")
    if at + 4 * len(told) * count > stop:
        raise ValueError("trun runs past its box")
    rows = numbers(data, at, len(told) * count, ">u4").reshape(count, len(told))
    sizes = rows[:, told.index(0x200)] if 0x200 in told else np.full(count, f.size, np.int64)
    own = rows[:, told.index(0x400)] if 0x400 in told else np.full(count, f.flags, np.int64)
    if first is not None and count:
        own = np.r_[first, own[1:]]
    offsets = start + np.cumsum(sizes) - sizes
    f.end = int(start + sizes.sum())
    return offsets, sizes, own & 0x10000 == 0


def read_container(raw: bytes) -> list[Track]:
    """The tracks of a file, with the samples of its movie box and of its fragments. Content of mdat is not read.

    A file that breaks the format raises ValueError or struct.error; media_files() gives it a status instead.
    """
    data, tracks = memoryview(raw), []
    defaults: dict[int, tuple[int, int]] = {}
    more: dict[int, list] = {}
    open_: list[Fragment] = []

    def walk(start: int, end: int, depth: int = 0) -> None:
        if depth > 16:
            raise ValueError("boxes nest too deep")
        for kind, body, stop in boxes(data, start, end):
            if kind == b"trak":
                tracks.append(Track())
            elif kind == b"traf":
                open_.append(Fragment(moofs[-1]))
            elif kind == b"moof":
                moofs.append(body - 8)
            if kind in NESTED:
                walk(body + NESTED[kind], stop, depth + 1)
            elif kind == b"trex":
                track, _, _, size, flags = struct.unpack_from(">IIIII", data, body + 4)
                defaults[track] = size, flags
            elif kind == b"tfhd" and open_:
                fragment_header(data, body, open_[-1], defaults)
            elif kind == b"trun" and open_:
                more.setdefault(open_[-1].track, []).append(fragment_run(data, body, stop, open_[-1]))
                counted(len(more[open_[-1].track][-1][0]))
            elif kind == b"tkhd" and tracks:
                tracks[-1].number = struct.unpack_from(">I", data, body + (20 if data[body] == 1 else 12))[0]
            elif tracks:
                t = tracks[-1]
                if kind == b"mdhd":
                    t.timescale, t.duration = struct.unpack_from(">IQ", data, body + 20) if data[body] == 1 else struct.unpack_from(">II", data, body + 12)
                elif kind == b"hdlr":
                    t.handler = bytes(data[body + 8 : body + 12]).decode("latin-1")
                elif kind == b"stsd":
                    t.codec = next((k.decode("latin-1") for k, _, _ in boxes(data, body + 8, stop)), "")
                elif kind in (b"stts", b"stss", b"stsc", b"stsz", b"stz2", b"stco", b"co64"):
                    t.tables[kind] = (body, stop)

    moofs: list[int] = []
    samples = 0

    def counted(n: int) -> None:
        """Samples that say nothing of their own take no bytes, so all of a file are held against its length."""
        nonlocal samples
        samples += n
        if samples > len(raw):
            raise ValueError("more samples than the file has bytes")

    walk(0, len(raw))
    for t in tracks:
        sample_table(data, t)
        counted(len(t.sizes))
        for offsets, sizes, sync in more.get(t.number, ()):
            t.keys = np.r_[t.keys, len(t.sizes) + np.nonzero(sync)[0]]
            t.offsets, t.sizes = np.r_[t.offsets, offsets], np.r_[t.sizes, sizes]
        if len(t.offsets) != len(t.sizes) or len(t.keys) and not 0 <= t.keys.min() <= t.keys.max() < len(t.sizes) or len(t.sizes) and int((t.offsets + t.sizes).max()) > len(raw):
            raise ValueError("a sample lies outside the file or its tables")
    return tracks


FILES = "path string, status string, tracks array<struct<codec: string, handler: string, duration: long, timescale: long, samples: long, keyframes: array<struct<start: long, end: long>>>>"


def media_files(files: DataFrame) -> DataFrame:
    """path, status, tracks of each row of files (path, content): codec, duration and the byte ranges of all key frames.

    status: OK, NO_TRACKS, EMPTY (null or no bytes), or BROKEN with the reason; one odd file doesn't stop the others.
    All counts are held against the file's length before anything is made of them: a file with more samples than bytes,
    also by tracks that share samples, is BROKEN. Repeated rows return as often as they occur, no rows give none, extra columns are ignored. A file is held whole,
    once, its tables beside it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(FILES))

    def read(batches):
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = {"path": path, "status": "EMPTY", "tracks": []}
                if raw:
                    try:
                        found = read_container(raw)
                        row["status"] = "OK" if found else "NO_TRACKS"
                        row["tracks"] = [
                            {"codec": t.codec.strip(), "handler": t.handler, "duration": t.duration, "timescale": t.timescale, "samples": len(t.sizes), "keyframes": [{"start": a, "end": z} for a, z in t.ranges(t.keys)]}
                            for t in found
                        ]
                    except (ValueError, struct.error, IndexError) as e:
                        row["status"] = f"BROKEN: {e}"
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return common.in_arrow(files.select("path", "content"), read, FILES)


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + PAD * (max(unit, -(-len(text) // unit) * unit) - len(text))


def read_payload(raw: bytes, t: Track) -> bytes:
    """All samples of a track one after another, copied in runs that lie side by side."""
    if not len(t.sizes):
        return b""
    ends = t.offsets + t.sizes
    cut = np.nonzero(t.offsets[1:] != ends[:-1])[0]
    first, last = np.r_[0, cut + 1], np.r_[cut, len(ends) - 1]
    view = memoryview(raw)
    return b"".join(view[a:b] for a, b in zip(t.offsets[first].tolist(), ends[last].tolist()))


def feature(t: Track) -> str:
    """Codec, duration in ticks at the timescale, samples, and the byte ranges of all sync samples."""
    spans = ",".join(f"{a}-{z}" for a, z in t.ranges(t.keys))
    return f"codec={t.codec.strip()};duration={t.duration}/{t.timescale};samples={len(t.sizes)};keyframes={len(t.keys)};ranges={spans}"


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id and the digest of each text stored as a container and read back; with keep_media also the file itself.

    Null text is empty; an empty text has one unit of padding. Equal texts have equal values. Repeated rows return as
    often as they occur, no rows give none, extra columns are ignored. A long text is held with its file, one at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", ")), *["media"] * keep_media]

    def store(batches):
        for part in common.slices(batches, "text"):
            rows = []
            for text in common.utf8(part, "text"):
                raw = write_container(padded(text))
                (track,) = read_container(raw)
                back = read_payload(raw, track)
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(track), *[raw] * keep_media))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in zip(*rows))], names=names)

    return common.in_arrow(docs.select("doc_id", "text"), store, f"doc_id {kind}, {SCHEMA}" + ", media binary" * keep_media)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(common.table(spark, sf_dir, "documents"))
