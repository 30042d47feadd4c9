"""Subword ids of the lower-casing word BPE, through a cache of words.

The vocabulary's normaliser and splitter never look across ASCII white space, so a text's ids are its
words' ids one after another, and a word that was seen before costs one look-up.
"""

from __future__ import annotations

from array import array

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: The splitter of the vocabulary file (fixed value).
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ODD = regex.compile(r"[\x00-\x20\x7f-\xa0\xad]|[^\x00-\xff]")
#: Words, and parts of words, kept in caches; at the limit one starts afresh, which costs time only.  A worker
#: keeps them from one stage to the next, so they are small beside an executor's memory.
_CACHE, _PARTS = 400_000, 200_000
#: Longer words are not kept.
_LONG = 200
#: Byte-level vocabularies write bytes that do not print as characters from 256 on, in order.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class WordBpe:
    """Words (lower-cased UTF-8) to little-endian 32-bit ids."""

    def __init__(self, path: str = WORD_BPE):
        self.tokenizer = Tokenizer.from_file(path)
        self.whole = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a word by itself is never one of the added tokens
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, in order."""
        known = self.words
        if len(known) > _CACHE:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            missing = [i for i, ids in enumerate(out) if ids is None]
            new = list({words[i] for i in missing})
            self._learn(new)
            for i in missing:
                out[i] = known[words[i]]
            for w in [w for w in new if len(w) > _LONG]:
                del known[w]
        return out

    def encode_text(self, text: bytes) -> bytes:
        """The ids of a text.  One that holds an added token, spelt as in the vocabulary file, goes to the library whole."""
        if any(map(text.__contains__, self.added)):
            return np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(self.encode(text.lower().split()))

    def _learn(self, words: list[bytes]) -> None:
        if len(self.parts) > _PARTS:
            self.parts.clear()
        plain: list[tuple[bytes, list[str]]] = []
        odd: list[bytes] = []
        new: dict[str, None] = {}
        for word in words:
            text = word.decode("utf-8", "replace")
            if _ODD.search(text):
                odd.append(word)
                continue
            found = _SPLIT.findall(text.lower())
            plain.append((word, found))
            for part in found:
                if part not in self.parts:
                    new[part] = None
        self._learn_parts(list(new))
        get = self.parts.__getitem__
        for word, found in plain:
            self.words[word] = get(found[0]) if len(found) == 1 else b"".join(map(get, found))
        for part in [p for p in new if len(p) > _LONG]:
            del self.parts[part]
        for word, e in zip(odd, self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False)):
            self.words[word] = np.array(e.ids, "<u4").tobytes()

    def _learn_parts(self, parts: list[str]) -> None:
        """Merge each part; the splitter and the normaliser have done their work already."""
        tokenize, known = self.tokenizer.model.tokenize, self.parts
        for part in parts:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(_SHOWN)
            known[part] = array("I", [t.id for t in tokenize(shown)]).tobytes()


_BPE: dict[str, WordBpe] = {}


def word_bpe(path: str = WORD_BPE) -> WordBpe:
    """One encoder for each worker process."""
    if path not in _BPE:
        _BPE[path] = WordBpe(path)
    return _BPE[path]
