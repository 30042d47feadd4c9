"""Exact top-k search by inner product with M-trees.

Vectors are integers; one more coordinate lifts them onto a sphere, where a larger inner product is a smaller
distance.  Each block of vectors becomes a tree of pages: entries with covering radius and distance to the parent.
A query takes pages in the order of their bounds, passes over entries that the stored distances exclude without
computing anything, and stops where no page can hold one of its best; bounds that tie are followed.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batches, columns, table

#: Vectors of a tree, queries that meet it at once, entries of a page, pages that a page is cut into.
BLOCK, QUERIES, PAGE, FAN = 8192, 1024, 256, 16


class MTree:
    """Pages: (is_leaf, entries, distances to the parent, radii, children or (first ids of) equal vectors)."""

    def __init__(self, pages: list[tuple], norm: float):
        self.pages, self.norm = pages, norm
        self.computed = 0

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, keep: int) -> MTree:
        unique, which = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        cuts = np.flatnonzero(np.diff(which.ravel()[order])) + 1

        def first(x: np.ndarray) -> np.ndarray:
            """Of equal vectors, the smallest ids, which alone can be among the best; repeated ids as often as that matters."""
            if len(x) <= keep:
                return x
            few, n = np.unique(x, return_counts=True)
            return np.repeat(few[:keep], np.minimum(n[:keep], keep))

        same = [first(x) for x in np.split(ids[order], cuts)]
        square = (unique * unique).sum(axis=1).astype(float)
        norm = float(square.max())
        lifted = np.column_stack([unique.astype(float), np.sqrt(np.maximum(norm - square, 0))])
        pages: list[tuple] = []

        def page(rows: np.ndarray, centre: int | None) -> tuple[int, float]:
            """Appends the page of rows and returns its number and covering radius about the centre."""
            far = np.zeros(len(rows)) if centre is None else np.sqrt(((lifted[rows] - lifted[centre]) ** 2).sum(axis=1))
            if len(rows) <= PAGE:
                pages.append((True, unique[rows], far, None, [same[i] for i in rows]))
                return len(pages) - 1, float(far.max())
            centres = rows[np.linspace(0, len(rows) - 1, FAN).astype(int)]
            d = np.stack([((lifted[rows] - lifted[c]) ** 2).sum(axis=1) for c in centres])
            nearest = d.argmin(axis=0)
            # a centre's share is bounded, so that the tree's depth is
            rows_of = [rows[nearest == j] for j in range(FAN)]
            parts = [(c, part) for c, some in zip(centres, rows_of) if len(some) for part in (np.array_split(some, -(-len(some) // max(PAGE, len(rows) // 2))))]
            children, radii = zip(*(page(part, int(c)) for c, part in parts))
            heads = np.array([c for c, _ in parts])
            to_parent = np.zeros(len(heads)) if centre is None else np.sqrt(((lifted[heads] - lifted[centre]) ** 2).sum(axis=1))
            pages.append((False, unique[heads], to_parent, np.array(radii), list(children)))
            return len(pages) - 1, float(far.max())

        page(np.arange(len(unique)), None)
        return cls(pages, norm)

    def search(self, query: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        """The k best (score, id) without the id `own`: highest scores, then smallest ids."""
        q2 = float(query @ query)
        base = q2 + self.norm
        slack = 1e-6 * (1 + base**0.5)
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        limit = np.inf
        queue: list[tuple[float, int, float]] = [(0.0, len(self.pages) - 1, np.nan)]
        while queue:
            bound, number, to_centre = heapq.heappop(queue)
            if bound > limit + slack:
                break
            leaf, entries, stored, radii, below = self.pages[number]
            if np.isnan(to_centre) or limit == np.inf:
                open_ = np.arange(len(entries))
            else:  # by the triangle inequality, from stored distances alone
                open_ = np.flatnonzero(abs(to_centre - stored) - (0 if leaf else radii) <= limit + slack)
            if not len(open_):
                continue
            scores = entries[open_] @ query
            self.computed += len(open_)
            if leaf:
                if len(best) == k:
                    able = np.flatnonzero(scores >= best[0][0])
                elif len(scores) > k:  # enough entries: only the page's own best can matter
                    able = np.flatnonzero(scores >= np.partition(scores, -k - 1)[-k - 1])
                else:
                    able = np.arange(len(scores))
                for i, s in zip(open_[able].tolist(), scores[able].tolist()):
                    for v in below[i].tolist():
                        if v == own:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, (s, -v))
                        elif (s, -v) > best[0]:
                            heapq.heapreplace(best, (s, -v))
                        else:
                            break
                if len(best) == k:
                    limit = max(base - 2 * best[0][0], 0.0) ** 0.5
            else:
                d = np.sqrt(np.maximum(base - 2.0 * scores, 0))
                for i, far in zip(open_.tolist(), d.tolist()):
                    if (b := max(far - radii[i], 0.0)) <= limit + slack:
                        heapq.heappush(queue, (b, below[i], far))
        return [(s, -v) for s, v in sorted(best, reverse=True)]


_TREES = pa.schema([("block", pa.int64()), ("page", pa.int64()), ("data", pa.binary())])
_FOUND = pa.schema([("asked", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _trees(keep: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        def out(block: int, held: list[tuple[int, list[int]]]) -> Iterator[tuple]:
            tree = MTree.build(np.array([h[0] for h in held]), np.array([h[1] for h in held], np.int64), keep)
            yield block, 0, pickle.dumps((tree.norm, len(tree.pages)))
            for i, page in enumerate(tree.pages):
                yield block, i + 1, pickle.dumps(page)

        now, held = None, []
        for batch in source:
            for block, vec_id, v in zip(*columns(batch, "block", "vec_id", "v")):
                if held and block != now:
                    yield from out(now, held)
                    held = []
                now = block
                held.append((vec_id, v))
        if held:
            yield from out(now, held)

    return rows


def _searches(k: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, tree = None, None
        for batch in source:
            for block, part, page, data, asked, query_id, v in zip(*columns(batch, "block", "part", "page", "data", "asked", "query_id", "v")):
                if (block, part) != now:
                    now, tree = (block, part), None
                if page == 0:
                    tree = MTree([], pickle.loads(data)[0])
                elif data is not None:
                    tree.pages.append(pickle.loads(data))
                elif tree is not None:
                    for score, vec_id in tree.search(np.array(v, np.int64), k, query_id):
                        yield asked, query_id, vec_id, score

    return rows


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k highest inner products of each query with all vectors of other ids: query_id, rank, vec_id, score.

    Both tables: vec_id long, v array<bigint>; a vector of another length than the query's takes no part, nor does one
    that is null or empty, of any length.  Ties go to the smaller vec_id.  A repeated row of `vectors` counts as often as
    it occurs; a repeated query is asked once, different vectors under one id are different queries.  With fewer than k
    others all are returned; empty tables give no rows; other columns are not looked at.
    Vectors are dealt to blocks by the hash of their id, queries to parts, and each meets each: blocks and parts are
    bounded, however many vectors or queries share a value.
    """
    scratch = Scratch(vectors.sparkSession, "mtree")
    real = lambda df: df.where("vec_id is not null and v is not null and size(v) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    vectors = real(vectors)
    queries = scratch.save(real(queries).distinct().withColumn("asked", F.monotonically_increasing_id()), "queries")
    n_blocks, n_parts = (max(1, -(-x.count() // size)) for x, size in ((vectors, BLOCK), (queries, QUERIES)))
    place = F.size("v").cast("long") * F.lit(1 << 32)
    # repeated ids go to different blocks: a block is bounded whatever ids there are
    dealt = vectors.select((place + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks))).alias("block"), "vec_id", "v")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "vec_id")
    trees = scratch.save(dealt.mapInArrow(lambda s: batches(_trees(k + 1)(s), _TREES, 32), "block long, page long, data binary"), "trees")
    none = F.lit(None)
    pages = trees.select("block", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "page", "data", none.cast("long").alias("asked"), none.cast("long").alias("query_id"), none.cast("array<bigint>").alias("v"))
    sent = queries.select(place.alias("place"), F.pmod(F.xxhash64("asked"), F.lit(n_parts)).cast("int").alias("part"), "asked", F.col("vec_id").alias("query_id"), "v")
    sent = sent.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), "*").select((F.col("place") + F.col("b")).alias("block"), "part", F.lit(1 << 62).alias("page"), none.cast("binary").alias("data"), "asked", "query_id", "v")
    both = pages.union(sent).repartition("block", "part").sortWithinPartitions("block", "part", "page")
    found = both.mapInArrow(lambda s: batches(_searches(k)(s), _FOUND, 5000), "asked long, query_id long, vec_id long, score long")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and v = floor(1024 * x) of each component; vectors with a null or non-finite component are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return embeddings.where(F.col("embedding").isNotNull()).where(~bad).select("vec_id", F.transform(x, lambda e: F.floor(e * 1024)).alias("v"))


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
