"""Byte-level BPE in linear time.

Bytes are mapped to Latin-1 characters for an Aho-Corasick automaton over the vocabulary.  Of each split of
the text, the longest vocabulary entry is taken at every place and given back where two neighbours could not
stand side by side in a merge result; that compatibility of two tokens is found by undoing their merges and
is memoised.  The ids are those of the merges in rank order.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns, slices, table, text_or_empty

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The tokenizer's white space is Unicode's property, which is not this library's \s.
SPLIT = public_tokenizers.PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
#: Parts of texts kept with their ids; at the limit one starts afresh, which costs time only.  Longer ones are not kept.
_CACHE, _LONG = 700_000, 200


class ByteBpe:
    """Encoder and decoder for a file of ranks."""

    def __init__(self, path: str = BYTE_BPE, pattern: str = SPLIT):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}  # a token and the two it is merged from
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}  # the longest other token that it begins with
        self.trie = ahocorasick.Automaton()
        for word, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(word) > 1:
                parts = self._merge(word, i)
                if len(parts) != 2:
                    continue  # no sequence of merges makes it
                self.halves[i] = parts[0], parts[1]
                self.merged[parts[0], parts[1]] = i
            self.trie.add_word(word.decode("latin-1"), (i, len(word)))
        self.trie.make_automaton()
        for word, i in self.ranks.items():
            for n in range(len(word) - 1, 0, -1):
                if (j := self.ranks.get(word[:n])) is not None and (n == 1 or j in self.halves):
                    self.shorter[i] = j
                    break

    def _merge(self, word: bytes, limit: int) -> list[int]:
        """Merges by rank, of ranks under the limit: used on the vocabulary's own entries only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
            if rank >= limit:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b apart where they meet: no earlier merge spans the border."""
        if (known := self.fits.get((a, b))) is not None:
            return known
        left, right, limit = a, b, 1 << 31
        while True:
            if self.merged.get((left, right), limit) < limit:
                ok = False
                break
            # undo the later of the two merges; what spans the border must come before it
            if left > right:
                order = (True, False)
            else:
                order = (False, True)
            for on_left in order:
                if on_left and left in self.halves:
                    limit, left = left, self.halves[left][1]
                    break
                if not on_left and right in self.halves:
                    limit, right = right + 1, self.halves[right][0]
                    break
            else:
                ok = True
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def encode_split(self, word: bytes) -> list[int]:
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        longest: list[int] = [-1] * (n + 1)
        for end, (i, size) in self.trie.iter(word.decode("latin-1")):
            longest[end - size + 1] = i  # ends grow, so the last is the longest
        length, fits, shorter = self.bytes_of, self.compatible, self.shorter
        good = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + len(length[token])
            if good[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at]
            elif (less := shorter.get(token)) is not None:
                token = less
            else:
                good[at] = 0
                token = out.pop()
                at -= len(length[token])
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        splits, known = self.split.findall(text), self.known
        new = set(splits).difference(known)
        if new:
            if len(known) > _CACHE:
                known.clear()
                new = set(splits)
            for s in new:
                known[s] = np.array(self.encode_split(s.encode()), "<u4").tobytes() if len(s) > 64 else array("I", self.encode_split(s.encode())).tobytes()
        out = b"".join(map(known.__getitem__, splits))
        for s in [s for s in new if len(s) > _LONG]:
            del known[s]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


_BPE: dict[str, ByteBpe] = {}


def byte_bpe(path: str = BYTE_BPE) -> ByteBpe:
    if path not in _BPE:
        _BPE[path] = ByteBpe(path)
    return _BPE[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str = BYTE_BPE, digests: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again: doc_id, n_tokens, ids (binary, little-endian 32 bit), decoded (binary).

    Null texts are empty; empty ones have no ids; texts and parts of any length are encoded whole, in linear time;
    repeated rows stay; an empty table gives no rows; other columns are not looked at.  With
    `digests`, SHA-256 digests stand in place of ids and decoded bytes, so that they never leave the worker.
    """

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bpe = byte_bpe(path)
        for big in source:
            for batch in slices(big, "text"):
                for doc_id, text in zip(*columns(batch, "doc_id", "text")):
                    ids = bpe.encode((text or b"").decode())
                    back = bpe.decode(ids)
                    if digests:
                        yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()
                    else:
                        yield doc_id, len(ids) // 4, ids, back

    schema, ddl = (_DIGEST, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string") if digests else (_OUT, "doc_id long, n_tokens long, ids binary, decoded binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(lambda source: batches(rows(source), schema, 5000 if digests else 200), ddl)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digests=True)
