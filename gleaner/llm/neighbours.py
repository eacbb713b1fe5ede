"""Approximate nearest neighbours by collision counting.

A shard holds one sorted array per random direction.  A query's window on each
array is centred on its own projection; a vector collides there if it lies in
the window.  Virtual rehashing widens all windows together, level by level, and
vectors that collide in at least ``THRESHOLD`` of the arrays are verified by
exact cosine.  A shard is done with a query once its k-th verified distance is
within the level's radius; the last level covers everything, so a shard always
answers.  Queries meet shards in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SHARD = 8192  # vectors of a shard, about
BLOCK = 96  # queries of a block, about
TURNS = 1  # random rotations; each gives as many directions as the vectors have components
WIDTH = 1.0  # half a window at radius 1, in standard deviations of a projected difference
THRESHOLD = 0.62  # share of the arrays in which a vector must collide
FIRST, GROWTH, LAST = 0.1, 1.35, 2.0  # radii of the levels on the unit sphere; beyond the last all vectors are verified
SEED = 23


def directions(dim: int, turns: int = TURNS, seed: int = SEED) -> np.ndarray:
    """Columns of random rotations: projections that are uniform, and independent within the limits of orthogonality."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(turns)], axis=1)


def radii() -> list[float]:
    levels, r = [], FIRST
    while r < LAST:
        levels.append(r)
        r *= GROWTH
    return levels


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors with a largest component from 0.5 to 1: exact, as the factor is a power of two."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def exact_cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal vectors get equal values, and extreme components neither vanish nor overflow."""
    query, vectors = scaled(query[None, :])[0], scaled(vectors)
    dots = (vectors * query).sum(1)
    return dots / (math.sqrt(float((query * query).sum())) * np.sqrt((vectors * vectors).sum(1)))


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.unit = unit(self.vectors)
        self.axes = directions(vectors.shape[1])
        projected = (self.unit @ self.axes).T
        self.order = np.argsort(projected, axis=1)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query position, ids, cosines) of the k best verified vectors, best first, the query's own row left out."""
        n, half = len(self.ids), WIDTH / math.sqrt(self.vectors.shape[1])
        asked = unit(queries)
        centre = (asked @ self.axes).T
        windows = [[np.array([np.searchsorted(s, c + sign * half * r) for s, c in zip(self.sorted, centre)]) for sign in (-1, 1)] for r in radii()]
        starts = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre)])
        need = math.ceil(THRESHOLD * len(self.axes.T))
        for q in range(len(own)):
            count = np.zeros(n, np.int64)
            checked = np.zeros(n, bool)
            near, found = np.empty(0), np.empty(0, np.int64)
            low = high = starts[:, q]
            for r, (lows, highs) in zip(radii(), windows):
                wider_low, wider_high = np.minimum(lows[:, q], low), np.maximum(highs[:, q], high)
                new = [o[a:b] for o, a, b in zip(self.order, wider_low, low)] + [o[a:b] for o, a, b in zip(self.order, high, wider_high)]
                count += np.bincount(np.concatenate(new), minlength=n)
                low, high = wider_low, wider_high
                fresh = np.flatnonzero((count >= need) & ~checked)
                if len(fresh):
                    checked[fresh] = True
                    fresh = fresh[self.ids[fresh] != own[q]]
                    found, near = np.r_[found, fresh], np.r_[near, self.unit[fresh] @ asked[q]]
                if len(near) >= k and 2 - 2 * np.partition(near, len(near) - k)[len(near) - k] <= r * r:
                    break
            else:
                found = np.flatnonzero(self.ids != own[q])
                near = self.unit[found] @ asked[q]
            if not len(found):
                continue
            if len(near) > k:  # rounding must not decide ties: all that come close to the k-th are compared exactly
                close = near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9
                found = found[close]
            cosine = exact_cosine(queries[q], self.vectors[found])
            best = np.lexsort((self.ids[found], -cosine))[:k]
            yield q, self.ids[found][best], cosine[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim): rows with an id and a finite, non-zero vector, as doubles."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter("id is not null and v is not null").filter(~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose id is divisible by ``every``.

    Ties go to the smaller id; fewer candidates than k are all returned.
    Vectors that are null, zero or hold a null or non-finite component take no
    part; vectors of another length are no candidates.  Rows of one id are one
    candidate each, but none for that id's query; a repeated query is answered
    once.  An empty table gives an empty table.
    """
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    shards, blocks = max(1, math.ceil(n / SHARD)), max(1, math.ceil(n / every / BLOCK))
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "dim"])
    h = F.xxhash64("id", F.lit(3))
    cell = ["dim", "shard", "block"]
    left = (rows.withColumn("shard", F.pmod(F.xxhash64("id", F.hash("v")), F.lit(shards)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*cell, "id", "v"))
    right = (asked.withColumn("block", F.pmod(h, F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(*cell, "id", "v"))

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        asked_ids, out = queries.column("id").to_numpy(), []
        if index.num_rows and queries.num_rows:
            shard = Shard(index.column("id").to_numpy(), matrix(index))
            for q, ids, scores in shard.search(asked_ids, matrix(queries), k):
                out.append((np.full(len(ids), asked_ids[q]), ids, scores))
        columns = [np.concatenate([o[i] for o in out]) if out else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    local = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
