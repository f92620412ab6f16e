import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloakframe.llm.common import shared_dir
from cloakframe.llm.crc32c import crc32c, masked
from cloakframe.llm.records import frame, op3_token_records, shuffled, unframe, write_records
from helpers import DOCS, ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    assert slow(b"123456789") == 0xE3069283
    data = [np.random.default_rng(i).bytes(n) for i, n in enumerate((4, 8, 510, 512, 514, 1024, 5000))]
    assert crc32c(data).tolist() == [slow(x) for x in data]
    assert len(crc32c([])) == 0


def test_frames_round_trip_and_damage():
    payloads = [bytes(range(n)) for n in (8, 12, 200)]
    records = frame(payloads)
    assert unframe(records) == payloads
    assert int.from_bytes(records[0][-4:], "little") == int(masked(crc32c(payloads[:1]))[0])
    for at in (0, 9, 14, len(records[2]) - 1):
        bad = bytearray(records[2])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            unframe([bytes(bad)])


def expected(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out, start = [], 0
    for d, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_against_whole_encoding(spark, tables):
    d = tables(documents=(ODD, DOCS))
    got = sorted(map(tuple, op3_token_records(spark, d).collect()), key=lambda r: r[1])
    assert got == expected(ODD)


def test_empty(spark, tables):
    assert op3_token_records(spark, tables(documents=([], DOCS))).collect() == []


def test_shuffled_reads(spark, tables):
    d = tables(documents=(ODD, DOCS))
    path = shared_dir(spark, "records")
    manifest = write_records(spark.read.parquet(f"{d}/documents.parquet"), path, PATH)
    got = [(doc, len(ids)) for _, name, _, _ in manifest for doc, ids in shuffled(path, name, 3)]
    assert sorted(got, key=str) == sorted([(r[0], r[2]) for r in expected(ODD)], key=str)
