"""Media columns: lossless storage in an ISO media container, and its index without decoding payloads.

The writer stores bytes as 8-bit samples of one track. The reader knows nothing of the
writer: it walks nested boxes, decodes the sample tables (times, sizes, chunks, sync
samples) and the runs of movie fragments, and derives codec, duration, and the byte ranges of keyframes of every
track; payload bytes are only sliced, never interpreted. What a table claims is checked against its box and the
file before memory is taken for it, so a small file can't ask for much.

Defined results: a null text is the empty text; every payload is padded by zero bytes to a
positive multiple of 64; a very long text is one container, held in memory with its payload; a null doc_id, or one that is no number, is null; repeated rows give repeated equal rows;
an empty table gives no rows; other columns are ignored. The stored form holds no clock or
id, so equal texts have equal values. A container that is null, broken, or nested deeper than DEPTH has no tracks
but, if it is not null, an error.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ALIGN = 64
#: Of the track: ticks a second, bytes of a sample, samples of a chunk, samples from keyframe to keyframe.
TIMESCALE, SAMPLE, CHUNK, KEYFRAMES = 8000, 64, 64, 16

# Names of boxes that hold boxes on the way to a track's tables.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"mvex", b"moof", b"traf"))
#: Boxes in boxes that are followed; valid files need six.
DEPTH = 12
# Flags of the headers of movie fragments (tfhd) and of their runs of samples (trun), and of a sample.
TF_BASE, TF_INDEX, TF_DURATION, TF_SIZE, TF_FLAGS, TF_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
TR_OFFSET, TR_FIRST, TR_DURATION, TR_SIZE, TR_FLAGS, TR_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000
# The identity matrix of movie and track headers.
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class BadContainer(ValueError):
    pass


def box(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, name) + body
    return struct.pack(">I4sQ", 1, name, len(body) + 16) + body


def full(name: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(name, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % ALIGN if data else ALIGN)


def store(payload: bytes) -> bytes:
    """An ISO media file with payload (a positive multiple of the sample size) as its only track."""
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    sync = range(1, n + 1, KEYFRAMES)
    duration = n * SAMPLE
    wide = len(payload) > (1 << 31)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        at = [first + k * CHUNK * SAMPLE for k in range(chunks)]
        stsc = [(1, CHUNK if chunks > 1 else last)] + ([(chunks, last)] if chunks > 1 and last != CHUNK else [])
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">4HI", 1, 8, 0, 0, TIMESCALE << 16))),
            full(b"stts", struct.pack(">3I", 1, n, SAMPLE)),
            full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">3I", a, b, 1) for a, b in stsc)),
            full(b"stsz", struct.pack(">2I", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *at)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        times = struct.pack(">2Q", 0, 0)
        mdia = box(b"mdia", full(b"mdhd", times, struct.pack(">IQ2H", TIMESCALE, duration, 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = full(b"tkhd", times, struct.pack(">2IQ", 1, 0, duration), bytes(8), struct.pack(">4H", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", times, struct.pack(">IQIH", TIMESCALE, duration, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return ftyp + moov(head) + box(b"mdat", payload)


def walk(data: memoryview):
    """(path, start of the box, start and end of its body) of each box, outer boxes first."""
    open_: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while open_:
        start, end, path = open_.pop()
        while start < end:
            if end - start < 8:
                raise BadContainer(f"{end - start} bytes left at {start}")
            size, name = struct.unpack_from(">I4s", data, start)
            body = start + 8
            if size == 1:
                if end - body < 8:
                    raise BadContainer(f"box {name!r} at {start} has no size")
                (size,), body = struct.unpack_from(">Q", data, body), body + 8
            elif size == 0:
                size = end - start
            stop = start + size
            if size < body - start or stop > end:
                raise BadContainer(f"box {name!r} at {start} has size {size}")
            here = (*path, name)
            yield here, start, body, stop
            if name in CONTAINERS:
                if len(here) > DEPTH:
                    raise BadContainer(f"boxes are nested deeper than {DEPTH}")
                open_.append((stop, end, path))
                start, end, path = body, stop, here
            else:
                start = stop


@dataclass
class Run:
    """Samples of a fragment that lie one behind the other: sizes is one size for all, or one each."""

    start: int
    count: int
    sizes: np.ndarray | int
    ticks: int
    sync: np.ndarray | bool
    first_sync: bool | None = None

    @property
    def bytes(self) -> int:
        return int(self.sizes.sum()) if isinstance(self.sizes, np.ndarray) else self.sizes * self.count


@dataclass
class Track:
    id: int = 0
    codec: str = ""
    kind: str = ""
    timescale: int = 0
    duration: int = 0
    times: list[tuple[int, int]] = field(default_factory=list)
    count: int = 0
    sizes: np.ndarray | int = 0  # one for all samples, or one each
    chunk_runs: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    chunks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray | None = None
    runs: list[Run] = field(default_factory=list)

    @property
    def samples(self) -> int:
        return self.count + sum(r.count for r in self.runs)

    @property
    def ticks(self) -> int:
        return sum(n * t for n, t in self.times) + sum(r.ticks for r in self.runs)

    @property
    def seconds(self) -> float:
        """As the samples' times have it, else as the header does."""
        return (self.ticks or self.duration) / self.timescale if self.timescale else 0.0

    def _firsts(self) -> np.ndarray:
        """The number of samples before each chunk, and before the end."""
        runs = self.chunk_runs
        if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(self.chunks)):
            raise BadContainer("chunks are out of order")
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(self.chunks) + 1))) if len(runs) else np.zeros(0, np.int64)
        total = sum(int(n) for n in per.tolist())
        if total != self.count:
            raise BadContainer(f"{self.count} samples, places for {total}")
        return np.concatenate([[0], np.cumsum(per)]).astype(np.int64)

    def _spans(self, first: np.ndarray, last: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and size of stretches of samples (last exclusive), none of which leaves its chunk."""
        chunk = np.searchsorted(firsts, first, "right") - 1
        if isinstance(self.sizes, np.ndarray):
            upto = np.concatenate([[0], np.cumsum(self.sizes)])
            return self.chunks[chunk] + upto[first] - upto[firsts[chunk]], upto[last] - upto[first]
        return self.chunks[chunk] + self.sizes * (first - firsts[chunk]), self.sizes * (last - first)

    def chunk_ranges(self) -> list[tuple[int, int]]:
        """(offset, size) of each chunk that has samples, and of each run of a fragment: all of the payload, in order."""
        firsts = self._firsts()
        some = np.flatnonzero(np.diff(firsts))
        at, size = self._spans(firsts[some], firsts[some + 1], firsts)
        return [*zip(at.tolist(), size.tolist()), *((r.start, r.bytes) for r in self.runs if r.count)]

    def keyframes(self) -> list[tuple[int, int]]:
        """(offset, size) of the sync samples; where every sample of a chunk or run is one, of the whole."""
        if self.sync is None:
            firsts = self._firsts()
            some = np.flatnonzero(np.diff(firsts))
            at, size = self._spans(firsts[some], firsts[some + 1], firsts)
        else:
            at, size = self._spans(self.sync - 1, self.sync, self._firsts())
        out = list(zip(at.tolist(), size.tolist()))
        for r in self.runs:
            if isinstance(r.sizes, np.ndarray) or isinstance(r.sync, np.ndarray):
                sizes = np.broadcast_to(np.asarray(r.sizes, np.int64), r.count)
                sync = np.array(np.broadcast_to(np.asarray(r.sync), r.count))
                if r.first_sync is not None and r.count:
                    sync[0] = r.first_sync
                ends = r.start + np.cumsum(sizes)
                k = np.flatnonzero(sync)
                out += zip((ends[k] - sizes[k]).tolist(), sizes[k].tolist())
            elif r.count and r.sync and r.first_sync is not False:
                out.append((r.start, r.bytes))
            elif r.count and r.sync:
                out.append((r.start + r.sizes, r.bytes - r.sizes))
            elif r.count and r.first_sync:
                out.append((r.start, r.sizes))
        return out

    def check(self, end: int) -> None:
        """Raises unless all samples lie in a file of `end` bytes and the tables fit each other."""
        if self.sync is not None and len(self.sync) and not (1 <= self.sync.min() and self.sync.max() <= self.count):
            raise BadContainer("a sync sample that is none of the samples")
        for at, size in self.chunk_ranges():
            if at < 0 or at + size > end:
                raise BadContainer(f"samples at {at} to {at + size} in a file of {end} bytes")


def _ints(data: memoryview, at: int, end: int, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if n * width > end - at:
        raise BadContainer("a table is longer than its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _sizes(data: memoryview, name: bytes, at: int, end: int) -> tuple[int, np.ndarray | int]:
    size, n = struct.unpack_from(">II", data, at + 4)
    if name == b"stsz":
        if size and size * n > len(data):
            raise BadContainer("samples are larger than the file")
        return n, size or _ints(data, at + 12, end, n, ">u4")
    bits = size & 0xFF
    if bits not in (4, 8, 16):
        raise BadContainer(f"sample sizes of {bits} bits")
    if bits == 4:
        two = _ints(data, at + 12, end, (n + 1) // 2, "u1")
        return n, np.stack([two >> 4, two & 15], 1).reshape(-1)[:n]
    return n, _ints(data, at + 12, end, n, "u1" if bits == 8 else ">u2")


@dataclass
class _Fragment:
    """What holds for the runs of a track fragment."""

    track: Track | None
    base: int
    at: int
    duration: int
    size: int
    flags: int

    def add(self, data: memoryview, at: int, end: int) -> None:
        (flags, n), at = struct.unpack_from(">II", data, at), at + 8
        flags &= 0xFFFFFF
        start, first = self.at, None
        if flags & TR_OFFSET:
            (shift,), at = struct.unpack_from(">i", data, at), at + 4
            start = self.base + shift
        if flags & TR_FIRST:
            (first,), at = struct.unpack_from(">I", data, at), at + 4
        names = [f for f in (TR_DURATION, TR_SIZE, TR_FLAGS, TR_SHIFT) if flags & f]
        table = dict(zip(names, _ints(data, at, end, n * len(names), ">u4").reshape(n, len(names)).T)) if names else {}
        sizes = table.get(TR_SIZE, self.size)
        if not isinstance(sizes, np.ndarray) and sizes * n > len(data):
            raise BadContainer("samples are larger than the file")
        ticks = int(table[TR_DURATION].sum()) if TR_DURATION in table else self.duration * n
        sync = table[TR_FLAGS] & NOT_SYNC == 0 if TR_FLAGS in table else not self.flags & NOT_SYNC
        run = Run(start, n, sizes, ticks, sync, None if first is None else not first & NOT_SYNC)
        self.at = start + run.bytes
        if self.track:
            self.track.runs.append(run)


def index(data: bytes) -> list[Track]:
    """The tracks of an ISO media file, from its boxes alone."""
    view, tracks, defaults, moof, fragment = memoryview(data), [], {}, 0, None
    try:
        for path, box_at, at, end in walk(view):
            name = path[-1]
            if name == b"trak":
                tracks.append(Track())
            elif name == b"trex":
                track, _, *own = struct.unpack_from(">5I", view, at + 4)
                defaults[track] = own
            elif name == b"moof":
                moof, fragment = box_at, None
            elif name == b"tfhd":
                flags, track = struct.unpack_from(">II", view, at)
                flags, k = flags & 0xFFFFFF, at + 8
                own = [*defaults.get(track, (0, 0, 0))]
                base = moof if flags & TF_MOOF or fragment is None else fragment.at
                if flags & TF_BASE:
                    (base,), k = struct.unpack_from(">Q", view, k), k + 8
                k += 4 * bool(flags & TF_INDEX)
                for i, flag in enumerate((TF_DURATION, TF_SIZE, TF_FLAGS)):
                    if flags & flag:
                        (own[i],), k = struct.unpack_from(">I", view, k), k + 4
                fragment = _Fragment(next((t for t in tracks if t.id == track), None), base, base, *own)
            elif name == b"trun" and fragment:
                fragment.add(view, at, end)
            if b"trak" not in path or name in CONTAINERS:
                continue
            t = tracks[-1]
            if name == b"tkhd":
                (t.id,) = struct.unpack_from(">I", view, at + (20 if view[at] == 1 else 12))
            elif name == b"hdlr":
                t.kind = bytes(view[at + 8 : at + 12]).decode("latin-1")
            elif name == b"mdhd":
                t.timescale, t.duration = struct.unpack_from(">IQ", view, at + 20) if view[at] == 1 else struct.unpack_from(">II", view, at + 12)
            elif name == b"stsd":
                t.codec = bytes(view[at + 12 : min(at + 16, end)]).decode("latin-1")
            elif name in (b"stsz", b"stz2"):
                t.count, t.sizes = _sizes(view, name, at, end)
            elif name in (b"stts", b"stss", b"stsc", b"stco", b"co64"):
                (n,) = struct.unpack_from(">I", view, at + 4)
                per, kind = {b"stts": (2, ">u4"), b"stss": (1, ">u4"), b"stsc": (3, ">u4"), b"stco": (1, ">u4"), b"co64": (1, ">i8")}[name]
                got = _ints(view, at + 8, end, n * per, kind)
                if name == b"stts":
                    t.times = list(map(tuple, got.reshape(n, 2).tolist()))
                elif name == b"stss":
                    t.sync = got
                elif name == b"stsc":
                    t.chunk_runs = got.reshape(n, 3)
                else:
                    t.chunks = got
        for t in tracks:
            t.check(len(data))
    except (struct.error, IndexError, OverflowError) as e:
        raise BadContainer(f"a box is cut off: {e}") from None
    return tracks


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring ranges as one."""
    out: list[tuple[int, int]] = []
    for at, size in ranges:
        if out and sum(out[-1]) == at:
            out[-1] = (out[-1][0], out[-1][1] + size)
        else:
            out.append((at, size))
    return out


RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
TRACK = "struct<codec:string,kind:string,timescale:long,duration_ticks:long,seconds:double,samples:long,keyframes:array<struct<offset:long,size:long>>>"
STORED = "doc_id long, n_bytes long, media binary"


def containers(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored container of every whole text."""

    def write(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        raw = [t or b"" for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([store(padded(t)) for t in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    common.prepare(docs.sparkSession)
    return common.with_text(docs, common.doc_id()).mapInArrow(common.per_chunk(write), STORED)


def _ranges(ranges: list[tuple[int, int]]) -> list[dict]:
    return [{"offset": a, "size": n} for a, n in ranges]


def media_columns(media: DataFrame) -> DataFrame:
    """Adds to a table with a binary column `media` what its containers hold: tracks (codec, kind, timescale, duration, samples and keyframe
    byte ranges of each) and media_error.

    Columns of those names that the table has are replaced.
    """
    found = pa.struct([("tracks", pa.list_(pa.struct([*((n, pa.string()) for n in ("codec", "kind")), *((n, pa.int64()) for n in ("timescale", "duration_ticks")), ("seconds", pa.float64()), ("samples", pa.int64()), ("keyframes", RANGES)]))), ("media_error", pa.string())])

    def one(data: bytes | None) -> dict | None:
        try:
            return None if data is None else {"tracks": [{"codec": t.codec, "kind": t.kind, "timescale": t.timescale, "duration_ticks": t.ticks or t.duration, "seconds": t.seconds, "samples": t.samples, "keyframes": _ranges(t.keyframes())} for t in index(data)]}
        except BadContainer as e:
            return {"media_error": str(e)}

    @F.arrow_udf(f"struct<tracks:array<{TRACK}>,media_error:string>")
    def columns(media: pa.Array) -> pa.Array:
        return pa.array((one(x) for x in media.to_pylist()), found)

    common.prepare(media.sparkSession)
    kept = [F.col(f"`{c}`") for c in media.columns if c not in ("tracks", "media_error")]
    # The row travels as one, so that no name can clash.
    rows = media.select(F.struct(*kept).alias("row"), columns("media").alias("found"))
    return rows.select("row.*", "found.tracks", "found.media_error")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, keyframes array<struct<offset:long,size:long>>"


def digest(media: bytes) -> tuple:
    """What is read back from a stored container: payload size and hash, crc of its tail, media size and hash, features, codec, seconds, keyframes."""
    (t,) = index(media)
    spans = joined(t.chunk_ranges())
    payload = b"".join(media[at : at + size] for at, size in spans)
    keys = t.keyframes()
    places = zlib.crc32(struct.pack(f">{2 * len(keys)}Q", *(x for r in keys for x in r)))
    codec = t.codec.strip()
    feature = f"codec={codec};kind={t.kind};seconds={t.seconds:.6f};samples={t.samples};keyframes={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]};places={places:08x}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature, codec, t.seconds, _ranges(keys)


def digests(docs: DataFrame) -> DataFrame:
    """Stores every text and reads it back; one row of digests for each document, with its track's codec, seconds and keyframe byte ranges."""

    def run(batches):
        for batch in batches:
            rows = [digest(m) for m in batch.column("media").to_pylist()]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), RANGES]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], re.findall(r"(?:^|, )(\w+) ", DIGEST))

    return containers(docs).mapInArrow(run, DIGEST)
