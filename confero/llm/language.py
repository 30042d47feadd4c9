"""Language identification by multilingual mixture inference.

A text's byte trigrams come from a mixture of the learned languages.  Expectation-maximisation finds the
proportions; languages are taken up in their order for as long as the likelihood, less a penalty for each
further language, grows.  Trigram counts are learned from every text that may be learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns, crc_mod, slices, table

BITS = 16
#: What the log-likelihood must gain for each language more than one.
PENALTY = 12.0
UNKNOWN = "und"
#: Languages that a model may have: each takes 256 KB in every worker.
MOST = 1000
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = re.compile(rb"[\x00-@\[-`{-\x7f]+")


def trigrams(text: bytes) -> np.ndarray:
    """Slots of the byte trigrams of the letters, other ASCII characters as single blanks."""
    b = np.frombuffer(b" " + _SPACE.sub(b" ", text.lower()) + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


class Mixture:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: a row for each language, a column for each slot."""
        self.languages = languages
        self.p = ((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])).T.copy() if languages else counts.T

    @staticmethod
    def _em(p: np.ndarray, n: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        for _ in range(rounds):
            both = p * theta
            theta = (n / both.sum(axis=1)) @ both / n.sum()
        return theta, float(n @ np.log(p @ theta))

    def infer(self, text: bytes) -> tuple[str, float, dict[str, float]]:
        """The main language, its share, and the shares of all languages chosen."""
        if not self.languages or not _LETTER.search(text.decode("utf-8", "replace")):
            return UNKNOWN, 0.0, {}
        slots, n = np.unique(trigrams(text), return_counts=True)
        p, k = self.p[slots].astype(np.float64), len(self.languages)
        theta, _ = self._em(p, n, np.full(k, 1 / k), 8)
        order = np.argsort(-theta, kind="stable")
        chosen, share, best = order[:1], np.ones(1), float(n @ np.log(p[:, order[0]]))
        for m in range(2, k + 1):
            some, like = self._em(p[:, order[:m]], n, theta[order[:m]] / theta[order[:m]].sum(), 6)
            if like - PENALTY * (m - 1) <= best - PENALTY * (m - 2):
                break
            chosen, share, best = order[:m], some, like
        top = int(share.argmax())
        return self.languages[chosen[top]], float(share[top]), {self.languages[i]: float(s) for i, s in zip(chosen, share)}


def learn(docs: DataFrame) -> Mixture:
    """Trigram counts of all rows with a language and a text."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found: dict[bytes, np.ndarray] = {}
        for big in source:
            for batch in slices(big, "text"):
                for lang, text in zip(*columns(batch, "lang", "text")):
                    have = found.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    have += np.bincount(trigrams(text), minlength=1 << BITS)
        for lang, have in found.items():
            for slot in np.flatnonzero(have).tolist():
                yield lang.decode(), slot, int(have[slot])

    schema = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])
    rows = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(lambda s: batches(count(s), schema, 20000), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    held = rows.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("counts")).collect()
    languages = sorted(r["lang"] for r in held)
    if len(languages) > MOST:
        raise ValueError(f"{len(languages)} different languages; a model holds {MOST}")
    counts = np.zeros((len(languages), 1 << BITS))
    for r in held:
        counts[languages.index(r["lang"]), r["slots"]] = r["counts"]
    return Mixture(languages, counts)


def identify(docs: DataFrame, fold: int = 5, more: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares (language to share) and the columns `more` of docs.

    Learns from rows whose crc32(doc_id) mod `fold` is not 0.  A text that is null, empty or without a letter is
    `und` with score 0; so is every text if there is nothing to learn from.  Ties go to the language first in the
    alphabet.  Texts of any length are read whole; repeated rows each get a row; an empty table gives no rows; columns
    not named are not looked at.
    """
    held_out = (crc_mod("doc_id", fold) == 0).alias("held_out")
    model = learn(docs.where(~held_out))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.p.astype(np.float32)))
    more = more or []
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), *(F.col(c).alias(f"own_{c}") for c in more))
    kinds = {f.name: f for f in pa_schema(rows)}

    def score(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture([], np.zeros((0, 1)))
        mixture.languages, mixture.p = shared.value
        for big in source:
            for batch in slices(big, "text"):
                got = [mixture.infer(t or b"") for t in columns(batch, "text")[0]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([list(g[2].items()) for g in got], pa.map_(pa.string(), pa.float64())), *(batch.column(f"own_{c}") for c in more)],
                    names=["doc_id", "held_out", "lang_pred", "score", "shares", *(f"own_{c}" for c in more)],
                )

    ddl = ", ".join([f"doc_id {kinds['doc_id'].dataType.simpleString()}", "held_out boolean", "lang_pred string", "score double", "shares map<string,double>", *(f"own_{c} {kinds[f'own_{c}'].dataType.simpleString()}" for c in more)])
    return rows.mapInArrow(score, ddl)


def pa_schema(df: DataFrame):
    return df.schema.fields


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
