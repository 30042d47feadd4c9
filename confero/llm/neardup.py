"""Near-duplicate documents by MinHash and odd sketches, confirmed on full shingle sets.

1. Each text's distinct word shingles are hashed to 64 bits; 256 MinHash samples are folded into a 512-bit parity
   bitmap (odd sketch), 24 bands of 4 samples are kept as keys.  Equal sets are one class from here on.
2. Inside each bucket of a band, sketches are compared by the population count of their XOR, and a spanning forest of
   what may be similar enough is kept, each row with the smallest of its component: the bands of a group give the same
   edges, fewer than the bucket has rows.
3. Clusters of that forest get their texts again; full sets are intersected inside each cluster, and a spanning
   forest of the confirmed links is kept.
4. Connected components of the confirmed links.

A pair at the threshold of 0.85 meets in no band with probability 2e-8, one at 0.8 with 3e-6; the sketches' cut lies five standard
deviations under the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, columns, slices, table, text_or_empty, word_bytes

SAMPLES, SKETCH, BANDS, ROWS = 256, 512, 24, 4
#: Classes compared at once; larger buckets and clusters are cut into parts of about so many.
BLOCK = 4096
#: Shingles of the texts compared at once, about.
BLOCK_SHINGLES = 1_000_000
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 32, SAMPLES, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _RNG.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)[:, None]
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SALT = _RNG.integers(0, 1 << 63, SAMPLES, np.uint64)
_WORDS: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, size: int = 3) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted; shorter texts are one shingle, texts without words none."""
    words = word_bytes(text)
    if not words:
        return np.zeros(0, np.uint64)
    known = _WORDS
    if len(known) > 200_000:
        known.clear()
    new = set(words).difference(known)
    for w in new:
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    for w in [w for w in new if len(w) > 100]:
        del known[w]
    size = min(size, len(words))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64) * _C
    with np.errstate(over="ignore"):
        for i in range(size):
            total = _mixed(total * _A + h[i : i + n]) + np.uint64(i) * _B
    return np.unique(total)


def signature(s: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The odd sketch and the bands' keys."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    step = max(64, (1 << 18) // SAMPLES)
    for i in range(0, len(x), step):
        np.minimum(low, (x[None, i : i + step] * _MUL + _ADD).min(axis=1), out=low)
    with np.errstate(over="ignore"):
        mixed = _mixed(low.astype(np.uint64) * _A + _SALT)
        keys = mixed[: BANDS * ROWS].reshape(BANDS, ROWS)
        key = np.zeros(BANDS, np.uint64)
        for r in range(ROWS):
            key = _mixed(key * _B + keys[:, r])
    bits = np.bincount((mixed >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes(), key.astype(np.int64)


def sketch_limit(threshold: float) -> int:
    """Most differing bits of two sketches that are kept: what a pair at the threshold shows, and five deviations."""
    low = threshold - 5 * (threshold * (1 - threshold) / SAMPLES) ** 0.5
    odd = SKETCH / 2 * (1 - np.exp(-4 * SAMPLES * (1 - low) / SKETCH))
    return int(odd + 3 * (SKETCH / 4 * (1 - np.exp(-8 * SAMPLES * (1 - low) / SKETCH))) ** 0.5 / 2)


def spanning(n: int, links_of: Callable[[int], np.ndarray], asked: np.ndarray) -> list[int]:
    """For each of n rows the first row of its component; links_of(i) says which rows are linked with row i.

    Where all rows are asked, rows are taken up until each is linked with one that was; after that only links between
    components can matter, and each of those has an end outside the largest one, whose rows therefore need no look.
    Else the rows asked are compared with all.
    """
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def look(i: int) -> np.ndarray:
        row = links_of(i)
        for j in np.flatnonzero(row).tolist():
            x, y = sorted((root(i), root(j)))
            parent[y] = x
        return row

    left = np.flatnonzero(asked)
    if asked.all():
        met, looked = np.zeros(n, bool), np.zeros(n, bool)
        for i in range(n):
            if not met[i]:
                looked[i] = True
                met |= look(i)
        own = np.array([root(i) for i in range(n)])
        left = np.flatnonzero((own != np.bincount(own).argmax()) & ~looked)
    for i in left.tolist():
        look(i)
    return [root(i) for i in range(n)]


_SIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sign(size: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        row = TaskContext.get().partitionId() << 36
        for big in source:
            for batch in slices(big, "text"):
                for doc_id, text_hash, text in zip(*columns(batch, "doc_id", "text_hash", "text")):
                    s = shingles(text or b"", size)
                    sketch, keys = signature(s) if len(s) else (None, np.zeros(0, np.int64))
                    yield row, doc_id, text_hash, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, sketch, keys
                    row += 1

    return lambda source: batches(rows(source), _SIGNED, 1000)


def _grouped(source: Iterator[pa.RecordBatch], *names: str) -> Iterator[list]:
    """Runs of rows with the same first two columns; the source is sorted by them."""
    held: list[tuple] = []
    for batch in source:
        for row in zip(*columns(batch, *names)):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _compared(payload: str, measure: Callable[[list], Callable[[int], np.ndarray]]):
    """Edges (a < b) of spanning forests of the groups (key, part): each row with the smallest node of its component."""

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in _grouped(source, "key", "part", "node", "asked", payload):
            if len(group) > 1:
                first = spanning(len(group), measure([g[4] for g in group]), np.array([g[3] for g in group], bool))
                for i, j in enumerate(first):
                    if i != j:
                        yield group[j][2], group[i][2]

    return lambda source: batches(rows(source), _EDGES, 5000)


def _near_sketches(limit: int):
    def measure(sketches: list[bytes]) -> Callable[[int], np.ndarray]:
        bits = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
        return lambda i: np.bitwise_count(bits ^ bits[i]).sum(axis=1) <= limit

    return measure


def _near_sets(size: int, percent: int):
    def measure(texts: list[bytes]) -> Callable[[int], np.ndarray]:
        sets = [shingles(t, size) for t in texts]
        sizes = np.array(list(map(len, sets)))
        every, where = np.unique(np.concatenate(sets), return_inverse=True)
        holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(where, kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(every)))])
        at = np.concatenate([[0], np.cumsum(sizes)])

        def links_of(i: int) -> np.ndarray:
            mine = where[at[i] : at[i + 1]]
            lens = starts[mine + 1] - starts[mine]
            # the holders of each of the text's shingles, one run after another
            flat = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            both = np.bincount(holders[flat], minlength=len(sets))
            return 100 * both >= percent * (sizes[i] + sizes - both)

        return links_of

    return measure


def linked(rows: DataFrame, weight: int, payload: Callable[[DataFrame], DataFrame], column: str, measure, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of the rows (key, node, weight) that `measure` links inside their keys, by way of any number of
    links; rows without a link are left out.  `payload` adds the column that is compared.

    A key of up to BLOCK rows and `weight` of weight is compared at once.  A larger one is cut into parts, each of which
    meets the first part; that is enough for the rows which are then in the key's largest component.  The rest of the
    key, and nothing else, is compared with all of its rows.  So a large group of copies of one another costs about
    twice its rows, and no more than (rows outside the largest component) x rows are compared anywhere.
    """
    blocks = lambda: F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("weight") / weight))
    sizes = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n"), blocks().alias("parts")).where("n > 1").drop("n"), f"{name}-sizes")
    inside = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c).cast("int") - 1)

    def compare(dealt: DataFrame, to: str) -> DataFrame:
        dealt = payload(dealt).select("key", "part", "node", "asked", column).repartition("key", "part").sortWithinPartitions("key", "part", "node")
        return scratch.save(dealt.mapInArrow(_compared(column, measure), "a long, b long").distinct(), f"{name}-{to}")

    part = F.when((F.col("own") == 0) & (F.col("parts") > 1), upto("parts")).otherwise(F.array("own"))
    found = compare(inside.select("key", F.explode(part).alias("part"), "node", F.lit(True).alias("asked")), "edges")
    known = components(found, scratch, f"{name}-components")
    if not sizes.where("parts > 1").limit(1).count():
        return known
    large = scratch.save(inside.where("parts > 1").join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), f"{name}-large")
    main = large.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    large = large.join(main, "key").withColumn("asked", F.col("component") != F.col("main"))
    chunks = scratch.save(large.where("asked").groupBy("key").agg(F.first("main").alias("main"), blocks().alias("chunks")), f"{name}-chunks")
    if not chunks.limit(1).count():
        return known
    left = scratch.save(large.drop("main").join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")), f"{name}-left")
    # a part of the key meets a chunk of those asked: each of the key's rows once for a chunk, each of those asked once for a part
    here = left.select("key", "own", F.explode(upto("chunks")).alias("chunk"), "parts", "node", (F.col("asked") & F.lit(False)).alias("asked"))
    ask = left.where("asked").select("key", F.explode(upto("parts")).alias("own"), "chunk", "parts", "node", "asked")
    dealt = here.union(ask).select("key", (F.col("chunk").cast("long") * F.col("parts") + F.col("own")).alias("part"), "node", "asked")
    more = compare(dealt.groupBy("key", "part", "node").agg(F.max("asked").alias("asked")), "more")
    return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch, f"{name}-all")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b).

    Large-star and small-star steps in turn: the first joins each node's larger neighbours, the second its smaller ones,
    to the smallest node around.  Edges never become more, and rounds grow with the logarithm of the longest path.
    It is done when each node is either the smallest around or has one edge, to such a node.
    A node of very many edges is one key of a join only, whose rows Spark can split; sums are formed before the shuffle.
    """
    now, turn = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), 0
    while True:
        sides = now.select("u", "v", F.lit(1).alias("down")).union(now.select("v", "u", F.lit(0)))
        ends = scratch.save(sides.groupBy("u").agg(F.min("v").alias("m"), F.sum("down").alias("down"), F.sum(1 - F.col("down")).alias("up")), f"{name}-{turn}-ends")
        if not ends.where("down > 1 or (down > 0 and up > 0)").limit(1).count():
            return ends.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        turn += 1
        large = now.join(ends.select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = scratch.save(small.distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}-ends")
        scratch.drop(f"{name}-{turn - 1}")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id = component_id), and
    text_hash and group_id, which is the same for rows of one component and for no others.

    Two texts are linked if `percent` of the union of their shingle sets is common to both.  Null texts, empty texts
    and texts without words have no set and are linked with nothing.  Every row is a document: repeated rows are linked
    with each other, rows that share a doc_id but not a text are linked by their texts alone, and each gets a row.
    Texts of any length are compared whole; an empty table gives no rows.  Rows without a doc_id are left out; other
    columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = scratch.save(docs.mapInArrow(_sign(size), "row long, doc_id long, text_hash long, n_shingles long, digest binary, sketch binary, bands array<long>"), "signed")
    # one row, the first, stands for each class of equal sets: it is the class's node
    classes = scratch.save(signed.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    shared = classes.where("copies > 1").select("digest", "node", "rep")
    members = signed.select("row", "doc_id", "text_hash", "n_shingles", "digest").join(shared, "digest", "left")
    members = scratch.save(members.select("doc_id", "text_hash", "n_shingles", F.coalesce("node", "row").alias("node"), F.coalesce("rep", "doc_id").alias("rep")), "members")
    firsts = signed.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    # candidates: sketches that are near each other, inside the buckets of the bands
    spread = scratch.save(firsts.select("node", F.posexplode("bands").alias("band", "bucket")).select(F.xxhash64("band", "bucket").alias("key"), "node", F.lit(0).alias("weight")), "spread")
    sketches = signed.select(F.col("row").alias("node"), "sketch")
    clusters = linked(spread, 1, lambda d: d.join(sketches, "node"), "sketch", _near_sketches(sketch_limit(percent / 100)), scratch, "maybe")
    # links: full sets, inside the clusters of candidates, whose texts are fetched once
    asked = clusters.join(signed.select(F.col("row").alias("node"), "doc_id", "text_hash", F.col("n_shingles").alias("weight")), "node")
    asked = scratch.save(asked.withColumnRenamed("component", "key"), "asked")
    scratch.drop("spread")
    texts = docs.join(asked.select("doc_id", "text_hash", "node").hint("shuffle_hash"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "node"])
    texts = scratch.save(texts.select("node", "text"), "texts")
    links = linked(asked.select("key", "node", "weight"), BLOCK_SHINGLES, lambda d: d.join(texts, "node"), "text", _near_sets(size, percent), scratch, "links")
    found = scratch.save(links.join(classes.select("node", "rep"), "node"), "found")
    scratch.drop("texts")
    least = found.groupBy("component").agg(F.min("rep").alias("first"))
    found = found.join(least, "component").select("node", "component", "first")
    out = members.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("first", "rep").alias("component_id"), "text_hash", F.coalesce("component", "node").alias("group_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "text_hash", "group_id")


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
