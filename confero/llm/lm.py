"""Language-model scoring of whole texts: an add-0.1 unigram model of words as a base, and the attention model.

The attention model gives the class of the next word's first subword, or the text's end.  Inside its class a word is
read from a memory of all learned words, by their discounted counts, or spelt in subwords with the discounts' mass, up
to a sign for the word's end; its probability is the sum of both ways.  So the words of a text have probabilities that
sum to no more than one.

Word counts, and through them subword counts, come from all texts that may be learned from; the attention weights are
trained where the texts are, on overlapping windows over the whole of every such text, and averaged after each round;
texts are turned into ids once, for all rounds.  The most frequent words' counts go to every executor, a bounded list;
the rest of the words are joined with their counts, and their memory is added there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .common import Scratch, batches, columns, crc_mod, slices, table, text_or_empty, word_bytes
from .wordids import END, START, Grown, WordIds, word_ids

#: Words whose counts are sent to the executors; the bound of that list.
HEAD = 100_000
#: What each count in the memory of words leaves to spelling, and a class without words as well.
DISCOUNT, FLOOR = 0.75, 1.0
ROUNDS = 2
#: Words whose ids count as each other's company, and bytes of text that are worked on at once.
SEGMENT, SLICE = 512, 1 << 20
#: Rows and columns of the counts of ids that follow each other in a word; the last column is the word's end.
ROWS = attention.TOP + attention.BANDS
STOP = ROWS
END_CLASS = attention.CLASSES - 1

_ENCODED = pa.schema([("key", pa.int64()), ("ids", pa.binary()), ("word", pa.binary()), ("n", pa.int64())])
_CELL = pa.schema([("cell", pa.int64()), ("n", pa.int64())])
_WEIGHTS = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())])
_SCORED = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times", "gains"]


def _mapped(df: DataFrame, name: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: pa.Schema, ddl: str, size: int = 20000) -> DataFrame:
    """mapInArrow of a generator of tuples, under a name that the plan shows."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(rows(source), schema, size)

    run.__name__ = name
    return df.mapInArrow(run, ddl)


def _encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as ids, by key, and now and then the counts of the words seen since."""
    known, texts = word_ids(), 0
    n = np.zeros(0, np.int64)

    def counted() -> pa.RecordBatch:
        some = np.flatnonzero(n)
        none = pa.nulls(len(some))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), pa.array([known.words[i] for i in some.tolist()], pa.binary()), pa.array(n[some])], schema=_ENCODED)

    for big in source:
        for batch in slices(big, "text", SLICE):
            if known.full:
                yield counted()
                n = np.zeros(0, np.int64)
                known.clear()
            split = list(map(word_bytes, columns(batch, "text")[0]))
            numbers = known.numbers(list(chain.from_iterable(split)))
            more = np.bincount(numbers, minlength=known.counts.n)
            more[: len(n)] += n
            n = more
            ids, stop = known.ids_of(numbers)
            texts += len(split)
            cuts = 2 * np.append(0, stop)[np.append(0, np.cumsum(list(map(len, split))))]
            held = pa.Array.from_buffers(pa.binary(), len(split), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
            none = pa.nulls(len(split))
            yield pa.RecordBatch.from_arrays([batch.column("key"), held, none.cast(pa.binary()), none.cast(pa.int64())], schema=_ENCODED)
    if n.any():
        yield counted()
    if texts:
        yield pa.RecordBatch.from_pydict({"key": [None], "ids": [None], "word": [b""], "n": [texts]}, schema=_ENCODED)


def _real(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a batch of words (without the texts' end), how many each has, and the words' counts."""
    words, n = columns(batch, "word", "n")
    keep = [i for i, w in enumerate(words) if w]
    flat, counts = word_ids().encode([words[i] for i in keep])
    return flat, counts, np.array(n, np.int64)[keep]


def _id_counts(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """How often ids occur, begin words, and begin different words."""
    size = word_ids().size
    found = np.zeros(3 * size, np.int64)
    for batch in source:
        flat, counts, n = _real(batch)
        first = flat[np.cumsum(counts) - counts]
        found[:size] += np.bincount(flat, np.repeat(n, counts), size).astype(np.int64)
        found[size : 2 * size] += np.bincount(first, n, size).astype(np.int64)
        found[2 * size :] += np.bincount(first, minlength=size)
    for i in np.flatnonzero(found).tolist():
        yield i, int(found[i])


def _followers(lex: attention.Lexicon):
    """How often a column follows a column inside different words: spelling is for rare words."""

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in source:
            flat, counts, _ = _real(batch)
            if len(flat):
                column = lex.column[flat].astype(np.int64)
                after = np.append(column[1:], STOP)
                after[np.cumsum(counts) - 1] = STOP
                cells, n = np.unique(column * (ROWS + 1) + after, return_counts=True)
                yield from zip(cells.tolist(), n.tolist())

    return rows


def _texts(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time all their ids, how many each word has, and how many words each text has."""
    opens = word_ids().opens
    for big in source:
        for batch in slices(big, "ids", SLICE):
            held = columns(batch, "ids")[0]
            ids = np.frombuffer(b"".join(held), np.uint16).astype(np.int64)
            start = np.flatnonzero(opens[ids])  # an id that begins with a blank begins a word
            yield ids, np.diff(np.append(start, len(ids))), np.diff(np.searchsorted(start, np.cumsum([0, *map(len, held)]) // 2))


def _company(rank: np.ndarray):
    """How often frequent first ids of words stand in the same segment of a text as the most frequent ones."""
    top, few = attention.TOP, attention.COMPANY

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found, n = np.zeros((top, few)), 0
        for ids, counts, lengths in _texts(source):
            many = -(-lengths // SEGMENT)
            inside = np.arange(len(counts)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            owner = np.repeat(np.cumsum(many) - many, lengths) + inside // SEGMENT
            place = np.minimum(rank[ids[np.cumsum(counts) - counts]], top)
            for a in range(0, int(many.sum()), 512):
                b = np.searchsorted(owner, [a, a + 512])
                bags = np.bincount((owner[b[0] : b[1]] - a) * (top + 1) + place[b[0] : b[1]], minlength=512 * (top + 1)).reshape(512, -1)[:, :top].astype(np.float32)
                both = bags.T @ bags[:, :few]
                both[np.arange(few), np.arange(few)] -= bags[:, :few].sum(axis=0)
                found += both
            n += int(many.sum())
        if n:
            yield TaskContext.get().partitionId() % 16, n, pickle.dumps({"company": found})

    return rows


def _train(model: bytes, lex: attention.Lexicon, rate: float):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        p = pickle.loads(model)
        adam, n = attention.Adam(p, rate), 0
        for ids, counts, lengths in _texts(source):
            stop = np.cumsum(counts)
            ends = np.cumsum(lengths)
            target = np.insert(lex.klass[ids[stop - counts]], ends, END_CLASS)
            # the text's start is an input of one column
            first = np.append(0, stop)[ends - lengths]
            attention.train(p, adam, np.insert(lex.column[ids], first, attention.COLUMNS - 1), np.insert(counts, ends - lengths, 1), target, lengths + 1)
            n += len(target)
        if n:
            yield TaskContext.get().partitionId() % 16, n, pickle.dumps({k: v * np.float64(n) for k, v in p.items()})

    return rows


def _add(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    total, n = None, 0
    for batch in source:
        for k, w in zip(*columns(batch, "n", "weights")):
            p = pickle.loads(w)
            total = p if total is None else {a: total[a] + p[a] for a in p}
            n += k
    if n:
        yield 0, n, pickle.dumps(total)


def _summed(texts: DataFrame, name: str, run) -> tuple[int, dict[str, np.ndarray]]:
    """Sums of what the tasks over the texts yield, by way of four tasks."""
    ddl = "part int, n long, weights binary"
    sums = _mapped(texts.select("ids"), name, run, _WEIGHTS, ddl, 8)
    parts = _mapped(sums.repartition(4, "part"), f"add_{name}", _add, _WEIGHTS, ddl, 8).collect()
    held = [pickle.loads(r["weights"]) for r in parts]
    return sum(r["n"] for r in parts), {k: sum(p[k] for p in held) for k in (held[0] if held else ())}


class Model:
    """Attention weights, and the counts of classes and of ids in words as log-probabilities."""

    def __init__(self, weights: dict[str, np.ndarray], lex: attention.Lexicon, first: np.ndarray, after: np.ndarray, total: np.ndarray, left: np.ndarray):
        self.weights, self.lex = weights, lex
        self.first = first  # of each id, among the different words that begin with its class
        self.after = after  # (row, column): of what follows in a word
        self.total = total  # count of each class, and FLOOR
        self.left = left  # what the class leaves to spelling

    def spelt(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log-probability of each word, given its class, by spelling."""
        stop = np.cumsum(counts)
        column = self.lex.column[flat]
        after = np.append(column[1:], STOP)
        after[stop - 1] = STOP
        inside = self.lex.inside[flat]
        inside[stop - counts] = 0
        first = flat[stop - counts]
        return self.left[self.lex.klass[first]] + self.first[first] + np.add.reduceat(self.after[column, after] + inside, stop - counts)


def learn(texts: DataFrame, words: DataFrame, strength: float = 4.0) -> Model:
    """The model of the learning texts (key, ids) and their word counts."""
    size = word_ids().size
    counts = np.zeros(3 * size)
    got = _mapped(words, "id_counts", _id_counts, _CELL, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts[[r[0] for r in got]] = [r[1] for r in got]
    counts, begun, kinds = counts.reshape(3, size)
    ends = words.where(F.octet_length("word") == 0).agg(F.sum("n")).first()[0] or 0
    company = _summed(texts, "company", _company(attention.ranks(begun)))[1].get("company", np.zeros((attention.TOP, attention.COMPANY)))
    lex = attention.lexicon(counts, begun, attention.groups(company))
    follow = np.zeros((ROWS, ROWS + 1), np.float32)
    got = _mapped(words, "followers", _followers(lex), _CELL, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    follow.ravel()[got["cell"].to_numpy()] = got["n"].to_numpy()
    base = follow.sum(axis=0) + 0.1
    after = np.log((follow + strength * base / base.sum()) / (follow.sum(axis=1, keepdims=True) + strength)).astype(np.float32)
    by_class = lambda x: np.bincount(lex.klass, x, attention.CLASSES)
    tokens, different = by_class(begun), by_class(kinds)
    total, left = tokens + FLOOR, np.log((DISCOUNT * different + FLOOR) / (tokens + FLOOR))
    first = np.log((kinds + 0.1) / by_class(kinds + 0.1)[lex.klass])
    tokens[END_CLASS] = ends
    p = attention.initial((tokens + 1) / (tokens + 1).sum())
    for turn in range(ROUNDS):
        n, sums = _summed(texts.where(F.pmod(F.col("key"), F.lit(ROUNDS)) == turn), f"train_{turn}", _train(pickle.dumps(p), lex, 0.01 / (1 + turn)))
        if n:
            p = {k: (v / n).astype(np.float32) for k, v in sums.items()}
    return Model(p, lex, first, after, total, left)


class _Scored:
    """What the model and the frequent words' counts say about each word of a worker's table, worked out once a word."""

    def __init__(self, model: Model, frequent: dict[bytes, int], ends: int):
        self.model, self.frequent, self.ends = model, frequent, ends
        self.scorer, self.life = attention.Scorer(model.weights), -1

    def update(self, known: WordIds) -> None:
        if self.life != known.life:
            self.life = known.life
            self.klass, self.own, self.base, self.listed, self.gain = Grown(np.int32), Grown(np.float64), Grown(np.float64), Grown(bool), Grown(np.float64)
            self.mean = Grown(np.float32, attention.WIDTH)
            # the text's start, which is no token, and its end, which is a class of its own
            self.klass.add(np.full(2, END_CLASS))
            self.own.add(np.zeros(2))
            self.base.add(np.full(2, np.log10(self.ends + 0.1)))
            self.listed.add(np.ones(2, bool))
            self.gain.add(np.zeros(2))
            self.mean.add(attention.pooled(self.model.weights, np.full(2, attention.COLUMNS - 1), np.ones(2, np.int64)))
        done, counts = self.klass.n, known.counts.all
        if done == len(counts):
            return
        m, counts = self.model, counts[done:]
        flat = known.ids.all[known.ids.n - int(counts.sum()) :].astype(np.int64)
        n = np.array([self.frequent.get(w, 0) for w in known.words[done:]], float)
        klass, spelt = m.lex.klass[flat[np.cumsum(counts) - counts]], m.spelt(flat, counts)
        held = np.log(np.maximum(n - DISCOUNT, 1e-300) / m.total[klass])
        self.klass.add(klass)
        self.own.add(np.where(n > 0, np.logaddexp(spelt, held), spelt))
        self.base.add(np.where(n > 0, np.log10(n + 0.1), 0.0))
        self.listed.add(n > 0)
        self.gain.add(-np.log(m.total[klass]) - spelt)  # of one count in memory over spelling
        self.mean.add(attention.pooled(m.weights, m.lex.column[flat], counts))


def score_texts(docs: DataFrame, fold: int = 10, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text, learning from rows whose
    crc32(doc_id) mod `fold` is not 0.

    Null texts are empty: one token, the end.  Texts of any length are read whole.  Repeated rows count and are scored
    as often as they occur.  With nothing to learn from, base scores are 0 where no count exists and the model keeps
    its initial weights; an empty table gives no rows.  Rows without a doc_id are left out; other columns are not
    looked at.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), (crc_mod("doc_id", fold) == 0).alias("held_out"))
    texts = docs.where(~F.col("held_out")).select(F.xxhash64("doc_id").alias("key"), "text")
    encoded = scratch.save(texts.mapInArrow(_encode, "key long, ids binary, word binary, n long"), "encoded")
    words = scratch.save(encoded.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    texts = encoded.where("ids is not null").select("key", "ids")
    n_train, kinds, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0))).first()
    frequent = {bytes(r["word"]): r["n"] for r in words.where(F.octet_length("word") > 0).orderBy(F.desc("n"), "word").limit(head).collect()}
    shared = spark.sparkContext.broadcast((learn(texts, words), frequent, ends))
    scratch.drop("encoded")
    below = float(np.log10(n_train + 0.1 * (kinds + 1)))

    def score_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scored = word_ids(), _Scored(*shared.value)
        row = TaskContext.get().partitionId() << 36
        for big in source:
            for batch in slices(big, "text", SLICE):
                known.forget()
                split = list(map(word_bytes, columns(batch, "text")[0]))
                numbers = known.numbers(list(chain.from_iterable(split)))
                scored.update(known)
                lengths = np.fromiter(map(len, split), np.int64, len(split)) + 1
                stops = np.cumsum(lengths)
                first = stops - lengths
                tokens = np.insert(numbers, np.cumsum(lengths - 1), END)
                inputs = np.append(START, tokens[:-1])
                inputs[first] = START  # in place of the end of the text before
                like = scored.scorer.score(scored.mean.all[inputs], scored.klass.all[tokens], lengths) + scored.own.all[tokens]
                listed = scored.listed.all[tokens]
                n_known = np.add.reduceat(listed.astype(np.int64), first) - (0 if scored.ends else 1)
                outside = np.flatnonzero(~listed)
                pairs, times = np.unique(np.searchsorted(stops, outside, side="right") << 32 | tokens[outside], return_counts=True)
                words_ = pairs & 0xFFFFFFFF
                cuts = pa.array(np.searchsorted(pairs >> 32, np.arange(len(split) + 1)).astype(np.int32))
                lists = [pa.array([known.words[i] for i in words_.tolist()], pa.binary()), pa.array(times.astype(np.int64)), pa.array(scored.gain.all[words_])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + len(split))), batch.column("doc_id"), batch.column("held_out"), pa.array(lengths), pa.array(n_known),
                    pa.array(np.add.reduceat(scored.base.all[tokens], first)), pa.array(np.add.reduceat(like, first) / np.log(10)), *(pa.ListArray.from_arrays(cuts, x) for x in lists),
                ], names=_SCORED)
                row += len(split)

    ddl = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>, times array<bigint>, gains array<double>"
    scored = scratch.save(docs.mapInArrow(score_words, ddl), "scored")
    # words outside the frequent list: none of them is in very many texts, or it would be in the list
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times", "gains")).alias("r")).select("row", F.col("r.rare").alias("word"), "r.times", "r.gains")
    # log of what spelling and memory give together over what spelling gives
    more = F.col("gains") + F.log(F.col("n") - DISCOUNT)
    more = F.col("times") * (F.greatest(more, F.lit(0.0)) + F.log1p(F.exp(-F.abs(more)))) / float(np.log(10))
    found = rare.join(words, "word", "left").select("row", F.coalesce(more, F.lit(0.0)).alias("score_more"), (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("base_more"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known_more"))
    more = found.groupBy("row").agg(F.sum("base_more").alias("base_more"), F.sum("known_more").alias("known_more"), F.sum("score_more").alias("score_more"))
    out = scored.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "score").join(more, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_more", F.lit(0))).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"), (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
