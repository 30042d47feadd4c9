"""Quality by positive-unlabelled learning.

Trusted positives, unlabelled web text and the estimated share of positives are all that is learned from: the
non-negative unbiased risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))  is minimised
by gradient steps that turn against the second part where it falls below 0.  The share itself is estimated from the
same two sets: no part of the unlabelled texts can hold more positives than the positives put there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, crc_mod, slices, table
from .labelled import sample

#: Trusted positives, and unlabelled texts, learned from, at most.
MOST, MOST_UNLABELLED = 6000, 6000
_SLOTS = 512
#: Letters, capitals, digits, bytes of other scripts and blanks fall together; marks stay.
_SHAPE = bytes(97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if b >= 128 else 32 if b in b"\t\r\x0b\x0c " else b for b in range(256))
_RUN = re.compile(rb"a{2,}")
_CAPS = re.compile(rb"A{2,}")


def features(text: bytes) -> np.ndarray:
    """Counts of shape trigrams (log, per text length) and measures of repetition and length."""
    shape = _CAPS.sub(b"AA", _RUN.sub(b"aa", text.translate(_SHAPE)))
    b = np.frombuffer(b" " + shape + b" ", np.uint8).astype(np.uint32)
    code = ((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 9) if len(b) > 2 else np.zeros(0, np.uint32)
    out = np.zeros(_SLOTS + 8)
    if len(code):
        out[:_SLOTS] = np.log1p(np.bincount(code, minlength=_SLOTS) * (1000.0 / len(code)))
    words = text.lower().split()
    n, chars = len(words), max(len(text), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = sum(map(len, re.findall(rb"[a-z\x80-\xff]+", text)))
    capitals = sum(map(len, re.findall(rb"[A-Z]+", text)))
    out[_SLOTS:] = (
        np.log1p(n) / 3,
        3 * len(set(words)) / n if n else 0,
        3 * len(set(zip(words, words[1:], words[2:]))) / max(n - 2, 1),
        3 * letters / chars,
        3 * capitals / chars,
        3 * len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)),
        chars / max(n, 1) / 5,
    )
    return out


class PositiveUnlabelled:
    def __init__(self) -> None:
        self.mean = np.zeros(_SLOTS + 8)
        self.scale = np.ones(_SLOTS + 8)
        self.w = np.zeros(_SLOTS + 9)
        self.prior = 0.5

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 80, rate: float = 0.01, decay: float = 2e-4, seed: int = 7, negative: bool = False) -> None:
        """With `negative`, unlabelled texts are taken for negative ones and both sets count the same."""
        both = np.vstack([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 0.1
        p, u = (np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) for x in (positive, unlabelled))
        rng, w = np.random.default_rng(seed), np.zeros(p.shape[1])
        m, v, t = np.zeros_like(w), np.zeros_like(w), 0

        def sigmoid(z: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        def softplus(z: np.ndarray) -> np.ndarray:
            return np.logaddexp(0, z)

        steps = max(1, len(u) // 256)
        for _ in range(epochs):
            order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
            for a, b in zip(np.array_split(order_p, steps), np.array_split(order_u, steps)):
                if not len(a) or not len(b):
                    continue
                xp, xu = p[a], u[b]
                zp, zu = xp @ w, xu @ w
                back = 0.0 if negative else prior
                minus = softplus(zu).mean() - back * softplus(zp).mean()
                g_minus = xu.T @ sigmoid(zu) / len(b) - back * (xp.T @ sigmoid(zp)) / len(a)
                g_plus = prior * (xp.T @ (sigmoid(zp) - 1)) / len(a)
                g = (g_plus + g_minus if minus >= 0 else -g_minus) + decay * w
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w = w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives in the unlabelled texts.

    Half of both sets tells positives from unlabelled texts; over the other half, the share of unlabelled texts above a
    cut of that score, divided by the share of positives above it, is no less than the prior.  The estimate is this
    ratio at the cut where its upper confidence bound is least.
    """
    model = PositiveUnlabelled()
    model.fit(positive[::2], unlabelled[::2], 0.5, negative=True)
    p, u = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    cuts = np.unique(np.concatenate([p, u]))
    above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (p, u))
    spread = sum((math.log(4 / delta) / (2 * len(x))) ** 0.5 for x in (p, u))
    ok = above_p > 0
    best = np.argmin((above_u[ok] + spread) / above_p[ok])
    return float(np.clip(above_u[ok][best] / above_p[ok][best], 0.01, 0.99))


def _featured(rows: DataFrame) -> np.ndarray:
    """Features of texts, worked out where the texts are.  In the order of doc_id, whatever order the rows arrive in:
    the fit is the same in every run."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in source:
            for batch in slices(big, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([features(t).astype(np.float32).tobytes() for t in columns(batch, "text")[0]], pa.binary())], names=["doc_id", "f"])

    got = sorted((r["doc_id"], bytes(r["f"])) for r in rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f binary").collect())
    return np.frombuffer(b"".join(f for _, f in got), np.float32).reshape(len(got), _SLOTS + 8).astype(np.float64)


def learn(docs: DataFrame, labels: DataFrame, fold: int, held: int, most: int, most_unlabelled: int) -> PositiveUnlabelled:
    """Positives by label; unlabelled texts whatever their label; labels of other texts are not looked at."""
    may = crc_mod("doc_id", fold) != held
    positive = _featured(sample(docs, labels.where("quality = 1"), "quality", may, most))
    ids = docs.where(may & F.col("text").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most_unlabelled)
    unlabelled = _featured(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null"))
    model = PositiveUnlabelled()
    if len(positive) and len(unlabelled):
        model.prior = class_prior(positive, unlabelled)
        model.fit(positive, unlabelled, model.prior)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, threshold: float = 0.5, most: int = MOST, most_unlabelled: int = MOST_UNLABELLED, more: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns `more` of docs.

    Learns from rows whose crc32(doc_id) mod `fold` is not `held`.  A null text is empty, an empty text is scored
    by its measures (all 0), a long one by all of it; without positives every score is 0.5.  Repeated rows each get a
    row; a score equal to the threshold is positive; an empty table gives no rows; columns not named are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, fold, held, most, most_unlabelled))
    more = more or []
    rows = docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False)).alias("held_out"), *(F.col(c).alias(f"own_{c}") for c in more))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in source:
            for batch in slices(big, "text"):
                s = np.array([float(shared.value.score(features(t or b""))) for t in columns(batch, "text")[0]], float)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *(batch.column(f"own_{c}") for c in more)], names=["doc_id", "held_out", "score", "predicted", *(f"own_{c}" for c in more)])

    return rows.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", "held_out boolean", "score double", "predicted int", *(f"own_{c} {kinds[f'own_{c}']}" for c in more)]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
