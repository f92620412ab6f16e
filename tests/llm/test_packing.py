import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloakframe.llm.packing import TIERS, op8_tier_packing, pack
from helpers import DOCS, ODD


@given(st.lists(st.integers(1, 6000), max_size=40))
def test_pack_covers_each_id_once(lengths):
    windows, left = pack(lengths)
    assert not left
    seen = defaultdict(list)
    for size, window in windows:
        assert sum(n for _, _, n in window) == size <= TIERS[0] and size & (size - 1) == 0
        for doc, start, n in window:
            seen[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, m in sorted(seen[doc]):
            assert start == at
            at += m
        assert at == n


def test_against_whole_encoding(spark, tables):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    rows = [r for r in ODD if r[0] is not None][:-1]
    got = op8_tier_packing(spark, tables(documents=(rows, DOCS))).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for row in rows:
        ids = np.array([*t.encode(row[1] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[row[0]], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_empty(spark, tables):
    assert op8_tier_packing(spark, tables(documents=([], DOCS))).collect() == []
