"""Public tokenizer vocabularies, applied word by word with a bounded memory of words.

``WordEncoder`` gives exactly what the tokenizers library gives for a lower-casing
BPE vocabulary with word ends.  Such a vocabulary splits a text into words by one
left-to-right pattern and encodes each word by itself, so the ids of a text are
those of its words in order; each distinct word goes through the library once and
is then remembered.  Texts with characters outside the plain Latin range, or with a
special token's string, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from delvegraph.llm.worker import hold

# The word pattern of the vocabulary, with its classes written out
# for code points below U+0250.
_LETTER = "a-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼½¾"
_SPACE = "\\t-\\r\\x20\\x85\\xa0"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: What the pattern above does not speak for: other scripts, marks, the one letter whose lower case is two, and
#: separators that only Python counts as white space.
_OTHER = re.compile("[^\\x00-\\x1b\\x20-į\u0131-ɏ]")

#: Byte-level vocabularies write a byte that Latin-1 prints as itself; the others, in order, as U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """A tokenizers ``Tokenizer`` without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordEncoder:
    """Ids of whole texts as little-endian bytes of ``width`` each.

    Two memories, each in two generations of ``memory`` entries: runs without
    white space, and the vocabulary's own words inside them.
    """

    def __init__(self, path: str, memory: int = 400_000):
        self.tokenizer = load_tokenizer(path)
        self.memory = memory
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.words_old: dict[str, bytes] = {}
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        with open(path, encoding="utf-8") as f:
            self.by_word = json.load(f)["model"].get("end_of_word_suffix") == "</w>"

    def _pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        """The library's own ids of ``text``."""
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> bool:
        return self.by_word and _OTHER.search(text) is None and "<|" not in text

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null counts as empty."""
        return [b"" if not t else self._runs(t.lower().split()) if self.plain(t) else self.whole(t) for t in texts]

    def _runs(self, runs: list[str]) -> bytes:
        return b"".join(self.packed(runs))

    def packed(self, runs: list[str]) -> list[bytes]:
        """Packed ids of each run (lower case, no white space, of a plain text)."""
        found = list(map(self.young.get, runs))
        if None in found:
            self._learn({r for r, x in zip(runs, found, strict=True) if x is None})
            found = list(map(self.young.__getitem__, runs))
            if len(self.young) > self.memory:
                self.old, self.young = self.young, {}
        return found

    def _learn(self, runs: set[str]) -> None:
        old, young, new = self.old, self.young, []
        for r in runs:
            x = old.get(r)
            if x is None:
                new.append(r)
            else:
                young[r] = x
        if not new:
            return
        parts = [[r] if r.isascii() and r.isalpha() else _WORDS.findall(r) for r in new]
        if len(self.words) > self.memory:
            self.words, self.words_old = {}, self.words
        before = self.words_old
        unknown = []
        for w in {w for p in parts for w in p}.difference(self.words):
            x = before.get(w)
            if x is None:
                unknown.append(w)
            else:
                self.words[w] = x
        words, tokenize, code = self.words, self.tokenizer.model.tokenize, "H" if self.width == 2 else "I"
        for w in unknown:
            shown = w if w.isascii() else w.encode("utf-8").decode("latin-1")
            words[w] = array(code, [t.id for t in tokenize(shown.translate(_SHOWN))]).tobytes()
        for r, p in zip(new, parts, strict=True):
            young[r] = words[p[0]] if len(p) == 1 else b"".join([words[w] for w in p])


def encoder(path: str, owner: str = "tokens") -> WordEncoder:
    """The encoder of this Python worker; its word memory lasts from task to task."""
    return hold(owner, ("encoder", path), lambda: WordEncoder(path))
