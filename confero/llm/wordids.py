"""Words as byte-level BPE ids, in a table that a worker keeps from one stage to the next.

A word is encoded with a blank before it, so that ids tell where words begin and different words have different ids.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import tiktoken

from .bpe import ByteBpe

MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Words kept; at the limit the table starts afresh, which costs time only.
LIMIT = 200_000
#: Longer words are encoded in linear time.
LONG = 400
#: The text's start and end, which are no words.
START, END = 0, 1


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type, width: int = 0):
        self.held, self.n = np.zeros((1 << 12, width) if width else 1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.held):
            wider = np.zeros((max(need, 2 * len(self.held)), *self.held.shape[1:]), self.held.dtype)
            wider[: self.n] = self.held[: self.n]
            self.held = wider
        self.held[self.n : need] = more
        self.n = need

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class _Numbers(dict):
    """Words by number; one that is not there gets the next number."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 2
        self.new.append(word)
        return n


class WordIds:
    """Words by number: their ids, one after another, and how many each has.  Start and end have none."""

    def __init__(self, path: str = MULTI_BPE):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.path, self.size = path, len(ranks)
        self.opens = np.array([b.startswith(b" ") for b, _ in sorted(ranks.items(), key=lambda x: x[1])])
        self.coder = tiktoken.Encoding("words", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.linear: ByteBpe | None = None
        self.life = 0
        self.clear()

    def clear(self) -> None:
        self.life, self.bytes = self.life + 1, 0
        self.number = _Numbers()
        self.words: list[bytes] = [b"", b""]
        self.ids, self.counts = Grown(np.uint16), Grown(np.int64)
        self.counts.add(np.zeros(2, np.int64))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        short = words if not long else [w if len(w) <= LONG else b"." for w in words]
        flat = np.array(self.coder.encode_ordinary(" " + b" ".join(short).decode("utf-8", "replace")), np.int64)
        start = np.flatnonzero(self.opens[flat])
        counts = np.diff(np.append(start, len(flat)))
        if long:
            self.linear = self.linear or ByteBpe(self.path)
            parts = np.split(flat, start[1:])
            for i in long:
                parts[i] = np.array(self.linear.encode_split(b" " + words[i]), np.int64)
                counts[i] = len(parts[i])
            flat = np.concatenate(parts)
        return flat, counts

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; new ones are added.  Numbers hold until `forget`."""
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if new := self.number.new:
            flat, counts = self.encode(new)
            self.words += new
            self.bytes += sum(map(len, new))
            self.ids.add(flat)
            self.counts.add(counts)
            self.number.new = []
        return found

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by their numbers, one after another, and where each word's end."""
        counts = self.counts.all
        n = counts[numbers]
        stop = np.cumsum(n)
        return self.ids.all[np.repeat((np.cumsum(counts) - counts)[numbers] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)], stop

    @property
    def full(self) -> bool:
        return self.counts.n > LIMIT or self.ids.n > 8 * LIMIT or self.bytes > 32 * LIMIT

    def forget(self) -> None:
        """Between batches: starts afresh where the table has grown too large."""
        if self.full:
            self.clear()


_TABLE: list[WordIds] = []


def word_ids() -> WordIds:
    """One table for each worker process."""
    if not _TABLE:
        _TABLE.append(WordIds())
    return _TABLE[0]
