"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, spell words to their end, given the word's beginning or, further on, the
letters before, and given the word before where that pair is frequent; both back off to the same continuation counts of letters.  Counts of one are discounted whole,
so that rare expressions are left to what the classes share.  A text's evidence is the difference of the length-normalised log-likelihoods, over the
text and over its most suspicious passages; a logistic curve fitted on texts that the counts have not seen turns
it into a score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, crc_mod, slices, table, word_bytes
from .labelled import logistic, sample

#: Labelled rows learned from, at most.
MOST = 8000
PASSAGE = 12
#: Bytes up to which a letter is given the whole beginning of its word, and letters further on so many less one;
#: how often a beginning, or a letter with those before it, must occur to count by itself.
DEPTH, RARE = 10, 4
#: How often a pair of words must occur in a class, and more, to count by itself.
PAIRS = 2


def _inside(word: bytes) -> list[bytes]:
    """Letters beyond the beginning with those before them, marked by a blank."""
    return [b" " + word[i - DEPTH : i] for i in range(DEPTH + 1, len(word) + 1)]


class KneserNey:
    """Log-likelihood ratios of words, spelt letter by letter to their end, and of words after a word."""

    def __init__(self) -> None:
        self.step: dict[bytes, float] = {}  # a beginning of a word, or letters inside: ratio of the last letter, given the letters before
        self.pair: dict[tuple[bytes, bytes], float] = {}
        self.weights = np.zeros(4)
        self.known: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def fit_counts(self, texts: Iterator[tuple[bytes, int]]) -> None:
        begin, two = (Counter(), Counter()), (Counter(), Counter())  # pairs as one number each: they are the most
        number: dict[bytes, int] = {}
        for text, y in texts:  # once a document: a name that one text repeats is no evidence
            words = _words(text)
            for w in set(words):
                w += b"$"
                begin[y].update([w[:i] for i in range(min(len(w), DEPTH) + 1)])
            begin[y].update({g for w in set(words) if len(w) >= DEPTH for g in _inside(w + b"$")})
            own = [number.setdefault(w, len(number)) for w in words]
            two[y].update({v << 32 | w for v, w in zip(own, own[1:])})
        if not begin[0][b""] or not begin[1][b""]:
            return

        def discount(n: int) -> float:
            return 1.0 if n < 2 else 0.75

        left: tuple[Counter, Counter] = (Counter(), Counter())  # mass for the shared order, by what stands before
        context: tuple[Counter, Counter] = (Counter(), Counter())  # letters inside, by what stands before
        cont: Counter = Counter()  # shared: what a letter follows, by the two letters before it
        for w in begin[0].keys() | begin[1].keys():
            if w:
                cont[w[-3:]] += 1
                cont[w[-3:-1], 0] += 1
                for c in (0, 1):
                    if n := begin[c][w]:
                        left[c][w[:-1]] += discount(n)
                        if w[:1] == b" ":
                            context[c][w[:-1]] += n

        def p(c: int, w: bytes) -> float:
            shared = (cont[w[-3:]] + 0.5) / (cont[w[-3:-1], 0] + 128)
            before = (context if w[:1] == b" " else begin)[c][w[:-1]]
            if not before:
                return shared
            n = begin[c][w]
            return max(n - discount(n), 0) / before + left[c][w[:-1]] / before * shared

        # rare beginnings are left to the shared order, where the classes are alike
        self.step = {w: math.log(p(1, w) / p(0, w)) for w in begin[0].keys() | begin[1].keys() if w and begin[0][w] + begin[1][w] >= RARE}
        after: tuple[Counter, Counter] = (Counter(), Counter())
        lost: tuple[Counter, Counter] = (Counter(), Counter())
        for c in (0, 1):
            for pair, n in two[c].items():
                after[c][pair >> 32] += n
                lost[c][pair >> 32] += discount(n)
        spelt: dict[tuple[int, bytes], float] = {}

        def whole(c: int, word: bytes) -> float:
            """A word's probability by its letters: the order that a pair of words backs off to."""
            if (known := spelt.get((c, word))) is None:
                w = word + b"$"
                known = spelt[c, word] = math.prod(p(c, x) for x in [*(w[:i] for i in range(1, min(len(w), DEPTH) + 1)), *(_inside(w) if len(w) > DEPTH else ())])
            return known

        spelling = list(number)
        for pair in {x for counts in two for x, n in counts.items() if n > PAIRS}:
            v, w = pair >> 32, spelling[pair & 0xFFFFFFFF]

            def q(c: int) -> float:
                one, n = max(whole(c, w), 1e-300), two[c][pair]
                return max(n - discount(n), 0) / after[c][v] + lost[c][v] / after[c][v] * one if after[c][v] else one

            self.pair[spelling[v], w] = math.log(q(1) / q(0))

    def ratio(self, word: bytes) -> float:
        """Log-likelihood ratio of a word by itself."""
        if (r := self.known.get(word)) is None:
            if len(self.known) > 500_000:
                self.known.clear()
            w, step, r = word + b"$", self.step, 0.0
            for i in range(1, min(len(w), DEPTH) + 1):
                if (s := step.get(w[:i])) is None:
                    break
                r += s
            if len(w) > DEPTH:
                r += sum(step.get(g, 0.0) for g in _inside(w))
            if len(word) <= 100:
                self.known[word] = r
        return r

    def evidence(self, text: bytes) -> np.ndarray:
        """Mean log-likelihood ratio of the text, of its worst passage, and of its three worst words."""
        words = _words(text)
        if not words:
            return np.zeros(3)
        single = list(map(self.ratio, words))
        r = np.array([single[0], *map(self.pair.get, zip(words, words[1:]), single[1:])])
        n = len(r)
        if n > PASSAGE:
            run = np.concatenate([[0.0], np.cumsum(r)])
            worst = float((run[PASSAGE:] - run[:-PASSAGE]).max()) / PASSAGE
        else:
            worst = float(r.sum()) / PASSAGE
        s = np.array(single)
        top = float(np.sort(np.partition(s, -3)[-3:] if n > 3 else s).sum()) / 3
        return np.array([float(r.mean()), worst, top])

    def score(self, text: bytes) -> float:
        z = float(self.weights[:3] @ self.evidence(text) + self.weights[3])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _words(text: bytes) -> list[bytes]:
    """Words without marks around them: an insult is the same before a comma."""
    return [w for w in (x.strip(b".,;:!?\"'()[]*#$%&|-") for x in word_bytes(text)) if w]


def learn(rows: DataFrame) -> KneserNey:
    """Counts from three in four rows, the curve from the rest."""
    model, curve = KneserNey(), []

    def counted() -> Iterator[tuple[bytes, int]]:
        for r in rows.toLocalIterator():
            if zlib.crc32(f"curve {r['doc_id']}".encode()) % 4:
                yield r["text"].encode(), r["y"]
            else:
                curve.append((r["text"].encode(), r["y"]))

    model.fit_counts(counted())
    y = np.array([c[1] for c in curve], float)
    if len(y) and 0 < y.sum() < len(y):
        model.weights = logistic(np.array([model.evidence(c[0]) for c in curve]), y)
    else:  # nothing to fit: lean to the ordinary class
        model.weights = np.array([1.0, 0.0, 0.0, -2.0])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, threshold: float = 0.3, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted.  Learns from at most `most` labelled rows whose crc32(doc_id) mod
    `fold` is not `held`.  A null or empty text has no evidence and gets the curve's constant; so do all texts
    where one class has no labelled row.  Texts of any length are read whole; repeated rows each get a row; a score
    equal to the threshold is toxic; an empty table gives no rows; other columns are not looked at."""
    model = learn(sample(docs, labels, "toxic", crc_mod("doc_id", fold) != held, most))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False)).alias("held_out"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in source:
            for batch in slices(big, "text"):
                s = np.array([shared.value.score(t or b"") for t in columns(batch, "text")[0]], float)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
