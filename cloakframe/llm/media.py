"""Operator 5: media columns from ISO containers.

A container is a sequence of boxes, some of which hold boxes. read_container walks them, decodes
a track's sample tables (stts, stsc, stsz or stz2, stco or co64, stss) and returns its codec,
handler, duration and the byte ranges of its samples and keyframes; no payload byte is looked at.
write_container makes such a file: one track of 8-bit samples ('raw '), in frames of 576.

Fragments (moof) add the samples of their runs to the track's. All tracks come back.

Null or empty payloads make a container of one padding frame. Bytes that aren't a container, or
that break off within a box, give an error text and nulls for the rest. Very long payloads are one
file each, repeated rows files of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string

from cloakframe.llm.common import prepare, shared_dir

FRAME = 576
RATE = 8000
FRAMES_IN_CHUNK = 16
#: Every so many frames is a keyframe.
KEY_EVERY = 8
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, body: bytes) -> bytes:
    n = len(body) + 8
    return (struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)) + body


def full_box(kind: bytes, body: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags) + body)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _moov(n: int, offsets: list[int], wide: bool) -> bytes:
    duration = n * FRAME
    whole, rest = divmod(n, FRAMES_IN_CHUNK)
    runs = ([(1, FRAMES_IN_CHUNK, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    keys = range(1, n + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6) + struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    tables = (
        full_box(b"stsd", struct.pack(">I", 1) + entry),
        full_box(b"stts", struct.pack(">III", 1, n, FRAME)),
        full_box(b"stsc", struct.pack(">I", len(runs)) + b"".join(struct.pack(">III", *r) for r in runs)),
        full_box(b"stsz", struct.pack(">II", FRAME, n)),
        full_box(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
        full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
    )
    info = full_box(b"smhd", bytes(4)) + box(b"dinf", full_box(b"dref", struct.pack(">I", 1) + full_box(b"url ", b"", 1))) + box(b"stbl", b"".join(tables))
    media = (
        box(b"mdhd", struct.pack(">IQQIQHH", 1 << 24, 0, 0, RATE, duration, 0x55C4, 0))
        + full_box(b"hdlr", struct.pack(">I4s12s", 0, b"soun", b"") + b"samples\0")
        + box(b"minf", info)
    )
    track = box(b"tkhd", struct.pack(">IQQIIQ8xhhhH", 1 << 24 | 7, 0, 0, 1, 0, duration, 0, 0, 0x100, 0) + MATRIX + bytes(8)) + box(b"mdia", media)
    movie = box(b"mvhd", struct.pack(">IQQIQIH10x", 1 << 24, 0, 0, RATE, duration, 0x10000, 0x100) + MATRIX + bytes(24) + struct.pack(">I", 2))
    return box(b"moov", movie + box(b"trak", track))


def write_container(payload: bytes) -> bytes:
    """A file whose frames are the payload; its length must be a positive multiple of FRAME."""
    n, odd = divmod(len(payload), FRAME)
    if odd or not n:
        raise ValueError("the payload isn't whole frames")
    head = box(b"ftyp", b"isom" + struct.pack(">I", 512) + b"isomiso2mp41")
    chunks, wide = -(-n // FRAMES_IN_CHUNK), len(payload) > 0xF0000000
    data = box(b"mdat", payload)
    first = len(head) + len(_moov(n, [0] * chunks, wide)) + len(data) - len(payload)
    return head + _moov(n, [first + k * FRAMES_IN_CHUNK * FRAME for k in range(chunks)], wide) + data


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    samples: list[tuple[int, int]] = field(default_factory=list)
    keyframes: list[tuple[int, int]] = field(default_factory=list)


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of each box's body, outer boxes first."""
    while start < end:
        if end - start < 8:
            raise ValueError("a box breaks off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError("a box breaks off")
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def _numbers(data: memoryview, at: int, end: int, form: str) -> list[tuple]:
    """A table: its number of entries, then the entries."""
    n = struct.unpack_from(">I", data, at)[0]
    size = struct.calcsize(">" + form)
    if at + 4 + n * size > end:
        raise ValueError("a table breaks off")
    return list(struct.iter_unpack(">" + form, data[at + 4 : at + 4 + n * size]))


def _media(t: Track, tab: dict, kind: bytes, data: memoryview, a: int, b: int) -> None:
    """What a box of a track says, into the track and its sample tables."""
    if kind == b"tkhd":
        t.number = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
    elif kind == b"mdhd":
        t.timescale, t.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    elif kind == b"hdlr":
        t.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
    elif kind == b"stsd":
        t.codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
    elif kind in (b"stco", b"co64"):
        tab["chunks"] = [x for (x,) in _numbers(data, a + 4, b, "I" if kind == b"stco" else "Q")]
    elif kind == b"stsc":
        tab["runs"] = _numbers(data, a + 4, b, "III")
    elif kind == b"stss":
        tab["keys"] = [x for (x,) in _numbers(data, a + 4, b, "I")]
    elif kind == b"stsz":
        one, n = struct.unpack_from(">II", data, a + 4)
        tab["sizes"] = [one] * n if one else [x for (x,) in _numbers(data, a + 8, b, "I")]
    elif kind == b"stz2":
        width, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        body = data[a + 12 : b]
        tab["sizes"] = [body[k // 2] >> (4 if k % 2 == 0 else 0) & 15 for k in range(n)] if width == 4 else [int.from_bytes(body[k * width // 8 : (k + 1) * width // 8], "big") for k in range(n)]


def _fragment(data: memoryview, start: int, end: int, at: int, tracks: dict[int, Track], rules: dict[int, tuple[int, int, int]]) -> None:
    """The samples of a movie fragment whose box begins at a place: runs of each track, one after the other."""
    for path, a, b in walk(data, start, end):
        flags = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF if b - a >= 4 else 0
        if path == (b"traf", b"tfhd"):
            number, a = struct.unpack_from(">I", data, a + 4)[0], a + 8
            base = at
            lasting, size, marks = rules.get(number, (0, 0, 0))
            if flags & 1:
                base, a = struct.unpack_from(">Q", data, a)[0], a + 8
            a += 4 * bool(flags & 2)
            if flags & 8:
                lasting, a = struct.unpack_from(">I", data, a)[0], a + 4
            if flags & 16:
                size, a = struct.unpack_from(">I", data, a)[0], a + 4
            if flags & 32:
                marks = struct.unpack_from(">I", data, a)[0]
            t, place = tracks.get(number), base
            if t is None:
                raise ValueError("a fragment of no track")
        elif path == (b"traf", b"trun"):
            n, a = struct.unpack_from(">I", data, a + 4)[0], a + 8
            if flags & 1:
                place, a = base + struct.unpack_from(">i", data, a)[0], a + 4
            first = None
            if flags & 4:
                first, a = struct.unpack_from(">I", data, a)[0], a + 4
            width = 4 * sum(bool(flags & x) for x in (0x100, 0x200, 0x400, 0x800))
            if a + n * width > b:
                raise ValueError("a table breaks off")
            for k in range(n):
                own = [lasting, size, first if k == 0 and first is not None else marks]
                for i, x in enumerate((0x100, 0x200, 0x400)):
                    if flags & x:
                        own[i], a = struct.unpack_from(">I", data, a)[0], a + 4
                a += 4 * bool(flags & 0x800)
                t.samples.append((place, own[1]))
                if not own[2] & 0x10000:
                    t.keyframes.append(t.samples[-1])
                t.duration += own[0]
                place += own[1]


def read_container(raw: bytes) -> list[Track]:
    """The tracks of a file, fragments too; ValueError if it isn't a whole container."""
    data, tracks, tables = memoryview(raw), [], []
    rules, fragments = {}, []
    try:
        for path, a, b in walk(data, 0, len(raw)):
            kind = path[-1]
            if kind == b"trak":
                tracks.append(Track())
                tables.append({})
            elif kind == b"trex":
                number, _, *rule = struct.unpack_from(">5I", data, a + 4)
                rules[number] = tuple(rule)
            elif path == (b"moof",):
                fragments.append((a, b, a - (16 if struct.unpack_from(">I", data, a - 16)[0] == 1 and bytes(data[a - 12 : a - 8]) == b"moof" else 8) if a >= 16 else a - 8))
            elif b"trak" in path[:-1]:
                _media(tracks[-1], tables[-1], kind, data, a, b)
        if not tracks:
            raise ValueError("no track")
        for t, tab in zip(tracks, tables, strict=True):
            _samples(t, tab)
        for a, b, at in fragments:
            _fragment(data, a, b, at, {t.number: t for t in tracks}, rules)
    except (struct.error, IndexError) as e:
        raise ValueError("a table breaks off") from e
    if any(a + n > len(raw) for t in tracks for a, n in t.samples):
        raise ValueError("samples lie outside the file")
    return tracks


def _samples(t: Track, tab: dict) -> None:
    """Places and sizes of the samples, from the tables."""
    sizes, runs, k, at_run = tab.get("sizes", []), tab.get("runs", []), 0, 0
    for chunk, place in enumerate(tab.get("chunks", []), 1):
        while at_run + 1 < len(runs) and runs[at_run + 1][0] <= chunk:
            at_run += 1
        for _ in range(runs[at_run][1] if runs else 0):
            if k >= len(sizes):
                break
            t.samples.append((place, sizes[k]))
            place, k = place + sizes[k], k + 1
    if k < len(sizes):
        raise ValueError("samples lie outside the file")
    # Without a table of sync samples every sample is one.
    t.keyframes = [t.samples[x - 1] for x in tab["keys"] if 0 < x <= len(sizes)] if "keys" in tab else t.samples[:]


_TRACK = "codec string, handler string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,size:long>>"
COLUMNS = f"error string, {_TRACK}, tracks array<struct<{_TRACK.replace(' string', ':string').replace(' long', ':long').replace(' array', ':array').replace(', ', ',')}>>"
_NAMES = ("error", "codec", "handler", "timescale", "duration", "n_samples", "keyframes", "tracks")
_RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
_KINDS = dict(zip(_NAMES[1:-1], (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _RANGES), strict=True))


def _read_row(raw: bytes | None) -> tuple[list[Track], str | None]:
    try:
        return read_container(raw or b""), None
    except ValueError as e:
        return [], str(e)


def _told(t: Track) -> dict:
    return {"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.samples), "keyframes": [{"offset": a, "size": n} for a, n in t.keyframes]}


def media_columns(df: DataFrame, column: str = "media") -> DataFrame:
    """df with its binary column replaced by what the container's boxes say of all tracks.

    The columns of one track are those of the first with pictures, or else of the first. Columns of
    df that have the names of the results are replaced.
    """
    rest = [f for f in df.schema.fields if f.name != column and f.name not in _NAMES]
    schema = StructType([*rest, *_parse_datatype_string(COLUMNS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_read_row(x) for x in batch.column(len(rest)).to_pylist()]
            told = [[_told(t) for t in tracks] for tracks, _ in got]
            one = [next((x for x in own if x["handler"] == "vide"), own[0]) if own else dict.fromkeys(_KINDS) for own in told]
            arrays = [*batch.columns[: len(rest)], pa.array([e for _, e in got], pa.string())]
            arrays += [pa.array([x[k] for x in one], kind) for k, kind in _KINDS.items()]
            arrays += [pa.array([own or None for own in told], pa.list_(pa.struct(list(_KINDS.items()))))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*[f"`{f.name}`" for f in rest], f"`{column}`").mapInArrow(run, schema)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 filled up with bytes 255 to whole frames, one at least; and its length before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def store_media(docs: DataFrame, path: str) -> DataFrame:
    """Writes docs (doc_id, text) as rows (doc_id, n_bytes, media) below path and reads them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [payload_of(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([write_container(p) for p, _ in got], pa.binary())], names=["doc_id", "n_bytes", "media"])

    made = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")
    made.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(t: Track) -> str:
    """What the boxes say, as text: the keyframes as their number, first, last and a checksum."""
    first, last = t.keyframes[0], t.keyframes[-1]
    ranges = zlib.crc32(b"".join(struct.pack(">QQ", *r) for r in t.keyframes))
    return f"{t.handler}/{t.codec.strip()};rate={t.timescale};duration={t.duration};samples={len(t.samples)};keyframes={len(t.keyframes)};first={first[0]}+{first[1]};last={last[0]}+{last[1]};ranges={ranges:08x}"


def op5_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every text stored in a container, read back through its sample tables."""
    prepare(spark)
    media = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                t = read_container(raw)[0]
                payload = b"".join([raw[a : a + size] for a, size in t.samples])
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(t)))
            if rows:
                kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)
