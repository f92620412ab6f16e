import hashlib
import struct
import zlib

import pytest

from cloakframe.llm.media import FRAME, box, full_box, media_columns, op5_iso_media, payload_of, read_container, write_container
from helpers import DOCS, ODD


@pytest.mark.parametrize("frames", [1, 15, 16, 17, 100])
def test_round_trip(frames):
    payload = bytes(k * 7 % 251 for k in range(frames * FRAME))
    raw = write_container(payload)
    t = read_container(raw)[0]
    assert b"".join(raw[a : a + n] for a, n in t.samples) == payload
    assert (t.codec, t.handler, t.duration, t.timescale) == ("raw ", "soun", frames * FRAME, 8000)
    assert [a for a, _ in t.keyframes] == [t.samples[k][0] for k in range(0, frames, 8)]


def test_other_tables():
    """Samples of several sizes, half-byte sizes, 64-bit offsets, no sync table and large boxes."""
    for sizes in (full_box(b"stsz", struct.pack(">II4I", 0, 4, 3, 5, 7, 2)), full_box(b"stz2", struct.pack(">II", 4, 4) + bytes([0x35, 0x72]))):
        stbl = full_box(b"stsd", struct.pack(">I", 1) + box(b"avc1", b"")) + full_box(b"stsc", struct.pack(">I6I", 2, 1, 1, 1, 2, 3, 1)) + sizes + full_box(b"co64", struct.pack(">I2Q", 2, 10, 20))
        trak = box(b"mdia", full_box(b"mdhd", struct.pack(">5I", 0, 0, 600, 1200, 0)) + box(b"minf", box(b"stbl", stbl)))
        raw = struct.pack(">I4sQ", 1, b"free", 116) + bytes(100) + box(b"moov", box(b"trak", trak))
        t = read_container(raw)[0]
        assert t.samples == t.keyframes == [(10, 3), (20, 5), (25, 7), (32, 2)]
        assert (t.codec, t.timescale, t.duration) == ("avc1", 600, 1200)


def fragmented():
    """A track of video whose samples lie in two fragments, beside one of sound with its own tables."""
    head = lambda n, kind, code: full_box(b"tkhd", struct.pack(">IIII", 0, 0, n, 0)) + box(b"mdia", full_box(b"mdhd", struct.pack(">5I", 0, 0, 90, 7, 0)) + full_box(b"hdlr", struct.pack(">I4s", 0, kind)) + box(b"minf", box(b"stbl", full_box(b"stsd", struct.pack(">I", 1) + box(code, b"")))))
    trex = full_box(b"trex", struct.pack(">5I", 2, 1, 30, 4, 0x10000))
    start = box(b"moov", box(b"trak", head(1, b"soun", b"mp4a")) + box(b"trak", head(2, b"vide", b"avc1")) + box(b"mvex", trex))

    def moof(offset):
        first = full_box(b"trun", struct.pack(">IiI", 3, offset, 0), 0x5)  # sizes and flags by the rule, the first a keyframe
        second = full_box(b"trun", struct.pack(">IIII", 1, 99, 6, 0), 0x700)
        return box(b"moof", box(b"traf", full_box(b"tfhd", struct.pack(">I", 2), 0x20000) + first + second))

    one = moof(len(moof(0)) + 8)
    base = struct.pack(">IQI", 2, 20, 5)
    two = box(b"moof", box(b"traf", full_box(b"tfhd", base, 0x11) + full_box(b"trun", struct.pack(">I", 2))))
    return start, start + one + box(b"mdat", bytes(18)) + two


def test_fragments_and_tracks(spark):
    start, raw = fragmented()
    sound, video = read_container(raw)
    at = raw.index(b"mdat") + 4
    assert sound.samples == [] and (sound.codec, video.codec, video.timescale, video.duration) == ("mp4a", "avc1", 90, 7 + 3 * 30 + 99 + 2 * 30)
    assert video.samples == [(at, 4), (at + 4, 4), (at + 8, 4), (at + 12, 6), (20, 5), (25, 5)]
    assert video.keyframes == [(at, 4), (at + 12, 6)]
    rows = [(1, raw, "mine", 5), (1, raw, "mine", 5), (2, raw[:-4], None, None), (3, start, None, 1)]
    got = media_columns(spark.createDataFrame(rows, "id int, media binary, codec string, Error int").withColumnRenamed("Error", "other"))
    assert got.columns == ["id", "other", "error", "codec", "handler", "timescale", "duration", "n_samples", "keyframes", "tracks"]
    seen = sorted(got.collect(), key=str)
    assert [(r.codec, r.handler, r.n_samples, len(r.tracks)) for r in seen[:2]] == [("avc1", "vide", 6, 2)] * 2
    assert [x.codec for x in seen[0].tracks] == ["mp4a", "avc1"] and seen[2].error and seen[2].tracks is None
    assert (seen[3].error, seen[3].n_samples, seen[3].keyframes) == (None, 0, [])


def test_digest_against_the_bytes(spark, tables):
    """The stored form's size, hash and feature, from the file that the format prescribes."""
    rows = [r for r in ODD if r[0] in (1, 2, 5)] + [(9, "é" * 4000, None, None, None, None)]
    for r in op5_iso_media(spark, tables(documents=(rows, DOCS))).collect():
        payload, _ = payload_of(next(x[1] for x in rows if x[0] == r.doc_id))
        raw = write_container(payload)
        n, at = len(payload) // FRAME, raw.index(b"mdat") + 4
        keys = [(at + k * FRAME, FRAME) for k in range(0, n, 8)]
        sums = zlib.crc32(b"".join(struct.pack(">QQ", *k) for k in keys))
        want = f"soun/raw;rate=8000;duration={len(payload)};samples={n};keyframes={len(keys)};first={keys[0][0]}+576;last={keys[-1][0]}+576;ranges={sums:08x}"
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(raw), hashlib.sha256(raw).hexdigest(), want)
        assert raw[at : at + len(payload)] == payload


def test_damaged(spark):
    good = write_container(b"x" * FRAME)
    rows = [(1, good), (2, good[:300]), (3, b""), (4, None), (5, good[:-1]), (6, b"\0\0\0\x09moov\0")]
    got = {r.id: r for r in media_columns(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert got[1].error is None and got[1].n_samples == 1 and got[1].keyframes[0]["size"] == FRAME
    assert all(got[k].error and got[k].codec is None for k in range(2, 7))


def test_query(spark, tables):
    got = sorted(map(tuple, op5_iso_media(spark, tables(documents=(ODD, DOCS))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()), key=str)
    want = [(r[0], payload_of(r[1])[0], payload_of(r[1])[1]) for r in ODD]
    assert got == sorted(((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for d, p, n in want), key=str)


def test_equal_texts_and_empty(spark, tables):
    rows = {r.doc_id: r for r in op5_iso_media(spark, tables(documents=(ODD, DOCS))).collect()}
    assert rows[1][1:] == rows[6][1:] and rows[2][1:] == rows[3][1:]
    assert op5_iso_media(spark, tables(documents=([], DOCS))).collect() == []
