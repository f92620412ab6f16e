"""Token ids of whole texts by a public tokenizer, with each distinct piece encoded once."""

from __future__ import annotations

import json
import os
import re
from struct import Struct

import numpy as np

#: Entries that a worker keeps; beyond that it starts anew.
CACHE_ENTRIES = 1_200_000
#: Words that the library gets as one text.
TOGETHER = 1000

#: Separators that Python takes for white space and the tokenizers don't.
_ODD = re.compile("[\x1c-\x1f]").search
_SPACE = re.compile(r"\s").search
_PACK = [Struct(f"<{n}I").pack for n in range(64)]


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers.

    Both vocabularies split a text before they merge, and white space always ends a piece. So
    the ids of a text are those of its runs between white space, one after another, and a run is
    encoded by the library once and looked up afterwards. Strings of special tokens in a text
    are ordinary text. A null text is an empty one.

    A byte-level piece takes the one space before it. Keys of its cache are words without that
    space; a key that begins with a line end has none. A text with other white space than single
    spaces and line ends between words takes the longer way, by the pattern. New words go to the
    library many at once, with a space before each: an id that begins with a space begins a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.words = kind["model"].get("end_of_word_suffix") == "</w>"
        byte_level = not self.words and kind["pre_tokenizer"]["type"] == "ByteLevel"
        if not self.words and not byte_level:
            raise ValueError(f"{path}: neither a byte-level nor a word vocabulary")
        #: Bytes that an id takes.
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        vocab = self.tokenizer.get_vocab()
        #: Ids that begin with a space.
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for token, i in vocab.items() if byte_level and token[0] == "\u0120"]] = True
        self.runs = re.compile(r"\s+(?!\S)| ?\S+|\s+").findall
        self.cache: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """The library's ids of the whole text, without the cache."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
            self.first.clear()
        texts = [text or "" for text in texts]
        cut = [text.split() for text in texts] if self.words else [text.replace("\n", " \n").split(" ") for text in texts]
        # The first word has no space before it; it stands under its own text in another table.
        heads = [None if self.words else parts.pop(0) for parts in cut]
        odd = self._learn(set().union(*cut).difference(self.cache))
        get, out = self.cache.__getitem__, []
        for text, head, parts in zip(texts, heads, cut, strict=True):
            if odd and not odd.isdisjoint(parts) or head is not None and (not head or _SPACE(head)) or _ODD(text):
                out.append(self._longer(text))
                continue
            if head is not None:
                if head not in self.first:
                    self.first[head] = self.whole(head)
                parts[:0] = [head]
                out.append(self.first[head] + b"".join(map(get, parts[1:])))
            else:
                out.append(b"".join(map(get, parts)))
        return out

    def _longer(self, text: str) -> bytes:
        """The ids of a text with any white space."""
        if self.words or _ODD(text):
            return self.whole(text)
        return b"".join(np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(self.runs(text), add_special_tokens=False))

    def _learn(self, keys: set[str]) -> set[str]:
        """Adds the keys to the cache; returns those that aren't single words."""
        odd = set() if self.words else {k for k in keys if k in ("", "\n") or _SPACE(k, k[0] == "\n")}
        alone = keys - odd
        if not self.words:
            after = [k for k in alone if k[0] != "\n"]
            if self._learn_together(after):
                alone.difference_update(after)
        new = list(alone)
        texts = new if self.words else [k if k[0] == "\n" else " " + k for k in new]
        for k, e in zip(new, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = e.ids
            self.cache[k] = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
        return odd

    def _learn_together(self, words: list[str]) -> bool:
        """Adds words, each with a space before it, to the cache; False if their ids don't tell where each begins."""
        texts = [" " + " ".join(words[a : a + TOGETHER]) for a in range(0, len(words), TOGETHER)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], "<u4")
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(words):
            return False
        data, bounds = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        self.cache.update(zip(words, [data[a:b] for a, b in zip(bounds, bounds[1:])], strict=True))
        return True


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file; it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
