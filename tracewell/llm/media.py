"""Media columns: ISO base media files.

`mux` lays bytes down as the samples of one track (ftyp, moov with its sample tables, mdat);
`probe` walks nested boxes and decodes the sample tables, those of movie fragments too, into codec, duration and the
byte ranges of keyframes, without touching a payload; `payload` reads the samples back through those
tables. The parser takes any box order, 32- and 64-bit box sizes and chunk offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 576
PER_CHUNK = 16
TIMESCALE = 48_000
CODEC = b"raw8"
#: Fixed values of the format: boxes that only hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}
#: Of the boxes that hold a box, so many are told; deeper nesting is walked all the same.
DEPTH = 16


class MediaError(ValueError):
    """The bytes are no well-formed container."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(text: bytes, unit: int = SAMPLE) -> bytes:
    """text with bytes 255 appended, up to a positive multiple of unit."""
    n = max(1, -(-len(text) // unit)) * unit
    return text + b"\xff" * (n - len(text))


def mux(samples: bytes, unit: int = SAMPLE, per_chunk: int = PER_CHUNK) -> bytes:
    """A file with one track: samples of unit bytes each, chunks of per_chunk, the first of each a keyframe."""
    count, rest = divmod(len(samples), unit)
    if rest or not count:
        raise ValueError("samples must be a positive multiple of unit")
    chunks = -(-count // per_chunk)
    tail = count - (chunks - 1) * per_chunk
    duration = count * unit
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        starts = first + np.arange(chunks, dtype=np.int64) * (per_chunk * unit)
        wide = int(starts[-1]) >= 2**32
        offsets = full(b"co64" if wide else b"stco", struct.pack(">I", chunks), starts.astype(">u8" if wide else ">u4").tobytes())
        runs = [(1, per_chunk)] * (chunks > 1) + [(chunks, tail)] if tail != per_chunk or chunks == 1 else [(1, per_chunk)]
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(CODEC, bytes(6), struct.pack(">HQHHHHI", 1, 0, 1, 8, 0, 0, TIMESCALE << 16))),
            full(b"stts", struct.pack(">3I", 1, count, unit)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", a, n, 1) for a, n in runs)),
            full(b"stsz", struct.pack(">2I", 0, count), np.full(count, unit, ">u4").tobytes()),
            full(b"stss", struct.pack(">I", chunks), (np.arange(chunks, dtype=np.int64) * per_chunk + 1).astype(">u4").tobytes()),
            offsets,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1)
        hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0")
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">4H", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if len(samples) + 8 < 2**32 else 16
    size = len(moov(0))
    made = moov(len(ftyp) + size + head)
    if len(made) != size:  # offsets grew to 64 bits
        made = moov(len(ftyp) + len(made) + head)
    return ftyp + made + box(b"mdat", samples)


def walk(data: bytes, start: int = 0, end: int | None = None):
    """(path, start of body, end of body) of every box, containers before what they hold. Boxes may nest to any depth."""
    ends, kinds = [len(data) if end is None else end], []
    while ends:
        if start == ends[-1]:
            ends.pop()
            kinds[-1:] = []
            continue
        end = ends[-1]
        if end - start < 8:
            raise MediaError(f"box header cut off at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise MediaError(f"box header cut off at {start}")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise MediaError(f"box {kind!r} at {start} leaves its container")
        yield (*kinds[-DEPTH:], kind), body, start + size
        if kind in CONTAINERS:
            ends.append(start + size)
            kinds.append(kind)
            start = body
        else:
            start += size


@dataclass
class Track:
    """What the sample tables say. offsets and sizes: of each sample; keyframes: indexes from 0."""

    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    deltas: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    number: int = 0

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        return [(int(self.offsets[k]), int(self.offsets[k] + self.sizes[k])) for k in self.keyframes]


class _Tables:
    """The sample tables of one track as they are met, and the samples of its fragments."""

    def __init__(self):
        self.raw: dict[str, np.ndarray] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # offsets, sizes, deltas, whether a keyframe

    def samples(self, data: bytes):
        """offsets, sizes, deltas and keyframe marks of the samples that the tables describe."""
        raw = self.raw
        sizes = raw.get("sizes", np.zeros(0, np.int64))
        none = np.zeros(0, np.int64)
        if not len(sizes):
            return none, none, none, none.astype(bool)
        chunks, runs = raw.get("chunks", none), raw.get("runs", none.reshape(0, 3))
        if not len(chunks) or not len(runs):
            raise MediaError("samples without chunks")
        if runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
            raise MediaError("the chunk runs are out of order")
        times = np.diff(np.append(runs[:, 0], len(chunks) + 1))
        each = np.repeat(runs[:, 1], times)
        if int(each.astype(object).sum()) != len(sizes):
            raise MediaError("chunk and size tables disagree")
        of = np.repeat(np.arange(len(chunks)), each)
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(each) - each
        offsets = chunks[of] + before - before[np.minimum(first, len(sizes) - 1)][of]
        deltas = np.zeros(len(sizes), np.int64)
        if "stts" in raw:
            if int(raw["stts"][:, 0].astype(object).sum()) != len(sizes):
                raise MediaError("time and size tables disagree")
            deltas = np.repeat(raw["stts"][:, 1], raw["stts"][:, 0])
        key = np.ones(len(sizes), bool)
        if "sync" in raw:
            if ((raw["sync"] < 1) | (raw["sync"] > len(sizes))).any():
                raise MediaError("a keyframe is no sample")
            key[:] = False
            key[raw["sync"] - 1] = True
        return offsets, sizes, deltas, key

    def fill(self, track: Track, data: bytes) -> None:
        parts = [self.samples(data), *self.parts]
        offsets, sizes, deltas, key = (np.concatenate(p) for p in zip(*parts, strict=True))
        if (offsets < 0).any() or (sizes < 0).any() or (offsets > len(data) - sizes).any():
            raise MediaError("a sample leaves the file")
        track.offsets, track.sizes, track.deltas, track.keyframes = offsets, sizes, deltas, np.flatnonzero(key)
        if self.parts:
            track.duration = max(track.duration, int(deltas.astype(object).sum()))


class _Fragment:
    """A track fragment: what its header says, its defaults filled in from those of the track."""

    def __init__(self, data: bytes, at: int, end: int, moof: int, defaults: dict[int, tuple[int, int, int]]):
        flags, self.track = int.from_bytes(data[at + 1 : at + 4], "big"), _unpack(">I", data, at + 4, end)[0]
        self.base, place = moof, at + 8
        self.delta, self.size, self.flags = defaults.get(self.track, (0, 0, 0))
        for bit, kind, name in ((0x1, ">Q", "base"), (0x2, ">I", None), (0x8, ">I", "delta"), (0x10, ">I", "size"), (0x20, ">I", "flags")):
            if flags & bit:
                value = _unpack(kind, data, place, end)[0]
                place += struct.calcsize(kind)
                if name:
                    setattr(self, name, value)
        self.next = self.base

    def run(self, data: bytes, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flags, count = int.from_bytes(data[at + 1 : at + 4], "big"), _unpack(">I", data, at + 4, end)[0]
        place, first = at + 8, None
        start = self.next
        if flags & 0x1:
            start = self.base + _unpack(">i", data, place, end)[0]
            place += 4
        if flags & 0x4:
            first = _unpack(">I", data, place, end)[0]
            place += 4
        have = [name for bit, name in ((0x100, "delta"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
        if have and place + 4 * len(have) * count > end or not have and count * max(1, self.size) > len(data):
            raise MediaError("a fragment's run is cut off")
        cols = np.frombuffer(data, ">u4", len(have) * count, place).astype(np.int64).reshape(count, len(have)) if have else np.zeros((count, 0), np.int64)
        of = lambda name, default: cols[:, have.index(name)] if name in have else np.full(count, default, np.int64)
        sizes, deltas, marks = of("size", self.size), of("delta", self.delta), of("flags", self.flags).copy()
        if first is not None and count:
            marks[0] = first
        self.next = start + int(sizes.sum())
        return start + np.cumsum(sizes) - sizes, sizes, deltas, (marks & 0x10000) == 0


def _unpack(kind: str, data: bytes, at: int, end: int) -> tuple:
    if at + struct.calcsize(kind) > end:
        raise MediaError(f"a box is cut off at {at}")
    return struct.unpack_from(kind, data, at)


def _table(data: bytes, at: int, end: int, width: int, dtype: str) -> np.ndarray:
    """The entries after a count at `at`; never more than the box holds."""
    n = _unpack(">I", data, at, end)[0]
    if at + 4 + n * width > end:
        raise MediaError(f"a table is cut off at {at}")
    found = np.frombuffer(data, dtype, n * width // np.dtype(dtype).itemsize, at + 4)
    if len(found) and int(found.max()) >= 2**62:
        raise MediaError("a table entry is out of range")
    return found.astype(np.int64)


def _sizes(kind: bytes, data: bytes, at: int, end: int) -> np.ndarray:
    same, n = _unpack(">II", data, at + 4, end)
    if kind == b"stz2":  # 4, 8 or 16 bits an entry
        bits = same & 255
        if bits not in (4, 8, 16) or at + 12 + (n * bits + 7) // 8 > end:
            raise MediaError("a size table is cut off")
        if bits == 4:
            pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
            return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n].astype(np.int64)
        return np.frombuffer(data, f">u{bits // 8}", n, at + 12).astype(np.int64)
    if same:
        if n * same > len(data):
            raise MediaError("samples leave the file")
        return np.full(n, same, np.int64)
    return _table(data, at + 8, end, 4, ">u4")


def probe(data: bytes) -> list[Track]:
    """The tracks of a file, from its headers, sample tables and fragments alone. Any bytes give tracks or a MediaError.

    Work and memory are bounded by the file's length: no table is expanded to more samples than its size table, which lies in the file, or
    the file's bytes allow. Samples of movie fragments follow those of the tables. Composition offsets (ctts) move no byte and are not read.
    """
    tracks: list[Track] = []
    tables: list[_Tables] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragment, moof = None, 0
    for path, at, end in walk(data):
        kind, inside = path[-1], b"trak" in path and len(path) > 1
        if kind == b"trak":
            tracks.append(Track())
            tables.append(_Tables())
        elif kind == b"moof":
            moof = at - (16 if at >= 16 and data[at - 16 : at - 12] == b"\0\0\0\1" and data[at - 12 : at - 8] == b"moof" else 8)
        elif kind == b"trex":
            number, _, *three = _unpack(">5I", data, at + 4, end)
            defaults[number] = tuple(three)
        elif kind == b"tfhd":
            fragment = _Fragment(data, at, end, moof, defaults)
        elif kind == b"trun":
            own = next((t for t, k in zip(tables, tracks, strict=True) if fragment and k.number == fragment.track), None)
            if own is None:
                raise MediaError("a run of samples without its track")
            own.parts.append(fragment.run(data, at, end))
        if not inside or not tracks:
            continue
        track, raw = tracks[-1], tables[-1].raw
        if kind in (b"tkhd", b"mdhd"):
            wide = _unpack("B", data, at, end)[0] == 1
            if kind == b"tkhd":
                track.number = _unpack(">I", data, at + (20 if wide else 12), end)[0]
            else:
                track.timescale, track.duration = _unpack(">IQ" if wide else ">II", data, at + (20 if wide else 12), end)
                if track.duration == (2**64 - 1 if wide else 2**32 - 1):  # unknown
                    track.duration = 0
        elif kind == b"hdlr":
            track.handler = _unpack("4s", data, at + 8, end)[0].decode("latin-1")
        elif kind == b"stsd":
            track.codec = _unpack("4s", data, at + 12, end)[0].decode("latin-1")
        elif kind == b"stts":
            raw["stts"] = _table(data, at + 4, end, 8, ">u4").reshape(-1, 2)
        elif kind == b"stsc":
            raw["runs"] = _table(data, at + 4, end, 12, ">u4").reshape(-1, 3)
        elif kind in (b"stsz", b"stz2"):
            raw["sizes"] = _sizes(kind, data, at, end)
        elif kind == b"stss":
            raw["sync"] = _table(data, at + 4, end, 4, ">u4")
        elif kind in (b"stco", b"co64"):
            raw["chunks"] = _table(data, at + 4, end, 8 if kind == b"co64" else 4, ">u8" if kind == b"co64" else ">u4")
    for track, own in zip(tracks, tables, strict=True):
        own.fill(track, data)
    return tracks


def payload(data: bytes, track: Track) -> bytes:
    """The track's samples in order, read through its tables."""
    out, i, n = [], 0, len(track.sizes)
    joins = np.flatnonzero(track.offsets[1:] != (track.offsets + track.sizes)[:-1]) + 1 if n else []
    for j in [*joins, n]:  # samples that lie next to each other are one read
        if j > i:
            out.append(data[int(track.offsets[i]) : int(track.offsets[j - 1] + track.sizes[j - 1])])
        i = j
    return b"".join(out)


def describe(tracks: list[Track]) -> str:
    """One line per track: codec, handler, duration, samples, and the byte ranges of keyframes."""
    return "\n".join(f"codec={t.codec};handler={t.handler};duration={t.duration}/{t.timescale};samples={len(t.sizes)};keyframes=" + ",".join(f"{a}-{b}" for a, b in t.keyframe_ranges()) for t in tracks)


_STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a container and read back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text counts as empty, and an empty one is one sample of bytes 255. Equal texts give
    equal values; null and repeated ids pass through. One text at a time is in memory.
    Other columns are not read. The files themselves: media_files().
    """

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1):
                raw = (text.as_py() or "").encode()
                stored = mux(pad(raw))
                (track,) = probe(stored)
                back = payload(stored, track)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), describe([track])))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(c.split()[0] for c in _STORED.split(", "))]
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {_STORED}")


def media_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the container of each text as a binary column `media`."""

    def run(batches):
        for b in batches:
            for i, text in enumerate(b.column(1)):  # a row at a time: a file may be large
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([mux(pad((text.as_py() or "").encode()))], pa.binary())], names=[id_col, "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, media binary")


def probe_media(files: DataFrame, media_col: str = "media", out: str = "tracks") -> DataFrame:
    """files with an array of tracks added: codec, handler, seconds, samples and keyframe byte ranges; null where the bytes are null or no container."""
    kind = "array<struct<codec:string,handler:string,seconds:double,samples:bigint,keyframes:array<struct<start:bigint,stop:bigint>>>>"

    @F.pandas_udf(kind)
    def read(column):
        import pandas as pd

        def one(data):
            try:
                return None if data is None else [{"codec": t.codec, "handler": t.handler, "seconds": t.seconds, "samples": len(t.sizes), "keyframes": [{"start": a, "stop": b} for a, b in t.keyframe_ranges()]} for t in probe(bytes(data))]
            except MediaError:
                return None

        return pd.Series([one(x) for x in column])

    return files.withColumn(out, read(F.col(media_col)))
