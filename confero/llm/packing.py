"""Best-fit packing of documents into fixed-length sequences by a linear grouping scheme.

The plan needs the histogram of piece lengths only, at most `capacity` numbers whatever the corpus:
lengths over `small` are rounded up within groups of equal cardinality, the few rounded sizes are packed
by a configuration linear program (column generation, knapsack pricing), whole parts of its solution are
filled with the actual lengths, and the rest and the small pieces are placed by best fit, longest first.
Every piece then finds its place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batches, columns, slices, table, text_or_empty
from .subwords import WORD_BPE, word_bpe

CAPACITY = 2048


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Patterns (a count for each size) and how often to use each, so that demand is covered with as few bins
    as a fractional solution can, up to 0.03 %."""
    k = len(sizes)
    base = np.diag(capacity // sizes).astype(float)  # columns are patterns
    inverse, x = np.diag(1.0 / np.diag(base)), demand / np.diag(base)
    steps = [(g, int(n), a, min(a + int(n), capacity + 1)) for g, n in enumerate(sizes) for a in range(int(n), capacity + 1, int(n))]
    for _ in range(rounds):
        y = inverse.sum(axis=0)
        price = y.tolist()
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for g, n, a, b in steps:  # what size n adds to a room of a to b - 1
            value, held = best[a - n : b - n] + price[g], best[a:b]
            more = value > held + 1e-12
            if more.any():
                pick[a:b][more] = g
                np.maximum(held, value, out=held)
        c = int(best.argmax())
        if best[c] <= 1 + 1e-9 or 1 - 1 / best[c] < 3e-4:
            break
        pattern = np.zeros(k)
        while pick[c] >= 0:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
        if pattern @ y <= 1 + 1e-9:
            break
        move = inverse @ pattern
        ok = move > 1e-10
        ratio = np.full(k, np.inf)
        ratio[ok] = x[ok] / move[ok]
        leave = int(ratio.argmin())
        x = np.maximum(x - ratio[leave] * move, 0)
        x[leave] = ratio[leave]
        base[:, leave] = pattern
        row = inverse[leave] / move[leave]
        inverse = inverse - np.outer(move, row)
        inverse[leave] = row
    return [(base[:, j].astype(int), float(x[j])) for j in range(k) if x[j] > 1e-9]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int | None = None, groups: int = 96) -> dict[str, np.ndarray]:
    """Where pieces go: piece number i (from `rank`) of a `length` goes to sequence
    `sequence + (i - rank) // each`, at `offset + ((i - rank) % each) * length`.  Rows are sorted by length and rank."""
    small = capacity // 8 if small is None else small
    left = np.zeros(capacity + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    bins: list[tuple[int, int, list[tuple[int, int]]]] = []  # number of bins, room, contents: (length, how many)

    def fill(parts: list[tuple[int, int]], m: int) -> None:
        if m:
            bins.append((m, capacity - sum(n * q for n, q in parts), parts))

    fill([(capacity, 1)], int(left[capacity]))
    left[capacity] = 0
    lengths = np.array([n for n in range(capacity - 1, small, -1) if left[n]], np.int64)
    if len(lengths):
        total = int(left[lengths].sum())
        group = np.minimum((np.cumsum(left[lengths]) - left[lengths]) * groups // total, groups - 1)
        _, first = np.unique(group, return_index=True)
        sizes = lengths[first]  # the longest of each group
        demand = np.add.reduceat(left[lengths], first)
        ends = [*first[1:], len(lengths)]
        queue = [[[int(n), int(left[n])] for n in lengths[a:b]] for a, b in zip(first, ends)]
        for pattern, x in configurations(sizes, demand.astype(float), capacity):
            m = int(x + 1e-6)
            slots = [g for g in np.flatnonzero(pattern) for _ in range(pattern[g])]
            m = min([m, *(sum(c for _, c in queue[g]) // int(pattern[g]) for g in set(slots))])
            if not m:
                continue
            runs = []  # for each slot, the actual lengths that bins 0..m-1 get, as (end, length)
            for g in slots:
                got, run = 0, []
                while got < m:
                    n, c = queue[g][0]
                    take = min(c, m - got)
                    got += take
                    left[n] -= take
                    run.append((got, n))
                    queue[g][0][1] -= take
                    if take == c:
                        queue[g].pop(0)
                runs.append(run)
            start = 0
            for end in sorted({e for run in runs for e, _ in run}):
                inside = [next(n for e, n in run if e >= end) for run in runs]
                fill([(n, inside.count(n)) for n in sorted(set(inside), reverse=True)], end - start)
                start = end
    room: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    for m, r, parts in bins:
        room[r].append((m, parts))
    for n in range(capacity, 0, -1):
        count, r = int(left[n]), n
        while count:
            while r < capacity and not room[r]:
                r += 1
            m, parts = room[r].pop() if room[r] else (count, [])
            each = r // n
            full = min(m, count // each)
            rest = count - full * each if full < m else 0
            if full:
                room[r - each * n].append((full, [*parts, (n, each)]))
            if rest:
                room[r - rest * n].append((1, [*parts, (n, rest)]))
            if (m := m - full - (rest > 0)) and parts:
                room[r].append((m, parts))
            count -= full * each + rest
    rows, sequence, used = [], 0, {}
    for same in room:
        for m, parts in same:
            offset = 0
            merged: dict[int, int] = {}
            for n, q in parts:
                merged[n] = merged.get(n, 0) + q
            for n, q in merged.items():
                rank = used.get(n, 0)
                rows.append((n, rank, sequence, q, offset))
                used[n] = rank + q * m
                offset += n * q
            sequence += m
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "each", "offset"), cols)) | {"sequences": np.array([sequence])}


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())])


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    schema = _PIECES.append(pa.field("ids", pa.binary())) if with_ids else _PIECES

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bpe, part = word_bpe(path), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1)
        for big in source:
            for batch in slices(big, "text"):
                for doc_id, text in zip(*columns(batch, "doc_id", "text")):
                    ids = bpe.encode_text(text or b"") + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        some = ids[at : at + 4 * capacity]
                        n = len(some) // 4
                        yield (doc_id, piece, at // 4, n, zlib.crc32(some), part, seen[n]) + ((some,) if with_ids else ())
                        seen[n] += 1

    return lambda source: batches(rows(source), schema, 500 if with_ids else 5000), schema


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "bigint", "int32": "int", "string": "string", "double": "double", "bool": "boolean", "binary": "binary"}
    return ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = WORD_BPE, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack documents (doc_id, text; further columns are not looked at) into sequences of `capacity` tokens.

    A document is its ids and `end_id`; only those longer than the capacity are cut, however long.  Null and empty
    texts are the end id alone; repeated rows are packed as often as they occur; an empty table gives no rows.  Returns a row for each piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian, if asked for).
    Ties in length are broken by the place in the input.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "pack")
    run, schema = _pieces(tokenizer, end_id, capacity, with_ids)
    pieces = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, _ddl(schema)), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = where.value
        key = p["length"] << 40 | p["rank"]
        for batch in source:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(key, n << 40 | rank, side="right") - 1
            past = rank - p["rank"][i]
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p["sequence"][i] + past // p["each"][i]), pa.array(p["offset"][i] + past % p["each"][i] * n)], names=[*keep, "sequence_id", "offset"])

    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    out = pa.schema([*(schema.field(c) for c in keep), pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])
    ranked = pieces.join(first, ["part", "length"]).select(*keep, (F.col("first") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(place, _ddl(out))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
