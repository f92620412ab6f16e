import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakframe.llm.tokens import Encoder

ENCODERS = {f: Encoder(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")}
FIXED = ["", " ", "a\x1cb", "  a  b \n\n c\t d", "it's 'S don't\n  x", "<|endoftext|> hi", "é ́x", "ﬁ Σας", "日本 テ", "a\r\nb", " x", "x ", "\n", "\nx", "x\n"]


@pytest.mark.parametrize("name", ENCODERS)
def test_fixed(name):
    e = ENCODERS[name]
    assert e.encode(FIXED) == [e.whole(x) for x in FIXED]


@pytest.mark.parametrize("name", ENCODERS)
@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="ab'sSt .,\n\t!*é ́\x1f12", max_size=40)))
def test_pieces_are_the_whole(name, text):
    e = ENCODERS[name]
    assert e.encode([text, None]) == [e.whole(text), e.whole("")]


def test_new_words_are_learnt_together():
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    library, sent = e.tokenizer, []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **more)

    e.tokenizer = Counted()
    texts = [" ".join(f"w{'xyz'[i % 3] * (i % 7)}{k}ord{i}'s-é" for i in range(1500)) for k in range(4)] + ["\n".join(f"line{i}" for i in range(9)), "a\tb c  d"]
    assert e.encode(texts) == [e.whole(x) for x in texts]
    assert len(sent) < 40
