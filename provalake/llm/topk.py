"""Exact top-k search by no-random-access aggregation (NRA), in blocks.

Vectors become integers and are dealt into blocks of bounded size by a hash of their id; every block of queries meets every
block of vectors once. Inside a block each component is a sorted list. A query reads all its lists in parallel from their
best end and keeps, for each vector met, a lower and an upper bound of its score: the part read so far, and for components
not met yet the list's last value or the value last read. Reading stops when few vectors outside can still qualify; their
final scores are resolved and the best of each block go on to a last, small ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of vectors and of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 4096, 512
#: How deep the lists have been read after each round, and how many open vectors are resolved at once.
DEPTHS, RESOLVE = (0.6, 0.8, 1.0), 256
SCALE = 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and `v` = floor(256 x) of each component; vectors that are null, empty or hold null or non-finite ones are left out."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.where(x.isNotNull() & (F.size(x) > 0) & F.col(id_col).isNotNull() & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


class Lists:
    """The sorted lists of a block of vectors: one per component, read from the top for positive weights, else from the bottom."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.order, 0)

    def _read(self, stop: int, top: bool) -> tuple[np.ndarray, np.ndarray]:
        """What is known of each component after `stop` entries of each list: a value to use in lower bounds and one for
        upper bounds. A component that a list has shown is known; one not shown yet lies between the list's far end and
        the entry read last. For lists read from the bottom, the weights are negative, so the two ends swap by themselves."""
        n = len(self.ids)
        shown = np.zeros(self.vectors.shape, bool)
        rows = self.order[n - stop:] if top else self.order[:stop]
        np.put_along_axis(shown, rows, True, 0)
        front = self.sorted[n - stop] if top else self.sorted[stop - 1]
        far = self.sorted[0] if top else self.sorted[-1]
        return np.where(shown, self.vectors, far), np.where(shown, self.vectors, front)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its id, and ids and exact scores of the k best vectors other than its own, ties to the smaller id.

        All lists are read in step, so a round's bounds for all queries are four matrix products. A query leaves as soon as few
        vectors can still be among its best.
        """
        n = len(self.ids)
        waiting, queries = np.arange(len(query_ids)), queries.astype(np.float64)
        for depth in DEPTHS:
            if not len(waiting):
                break
            stop = min(n, max(1, math.ceil(n * depth)))
            weight = queries[waiting]
            up, down = np.maximum(weight, 0), np.minimum(weight, 0)
            (low_up, high_up), (low_down, high_down) = self._read(stop, True), self._read(stop, False)
            lower = up @ low_up.T + down @ low_down.T
            upper = up @ high_up.T + down @ high_down.T
            own = self.ids[None, :] == query_ids[waiting][:, None]
            lower[own] = upper[own] = -np.inf
            sure = np.full(len(waiting), -np.inf)
            if n > k:
                # the k-th best lower bound, tightened by resolving the vectors with the best upper bounds
                likely = np.argpartition(-upper, min(n, 4 * k) - 1, axis=1)[:, :4 * k]
                exact = np.einsum("qd,qcd->qc", weight, self.vectors[likely])
                exact[np.take_along_axis(own, likely, 1)] = -np.inf
                sure = np.maximum(np.partition(lower, n - k, axis=1)[:, n - k], np.sort(exact, 1)[:, ::-1][:, :k][:, -1])
            open_ = (upper >= sure[:, None]) & ~own
            ready = (open_.sum(1) <= max(RESOLVE, k)) | (stop == n)
            for q in np.flatnonzero(ready):
                places = np.flatnonzero(open_[q])
                scores = self.vectors[places] @ weight[q]
                first = np.lexsort((self.ids[places], -scores))[:k]
                yield int(query_ids[waiting[q]]), self.ids[places][first], scores[first].astype(np.int64)
            waiting = waiting[~ready]


def _block(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(queries):
            lists = Lists(vectors["vec_id"].to_numpy(np.int64), np.stack(vectors["v"].to_list()))
            for query_id, ids, scores in lists.best(queries["vec_id"].to_numpy(np.int64), np.stack(queries["v"].to_list()), k):
                out["query_id"] += [query_id] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best vectors (all, if fewer) of each query.

    `vectors` has vec_id and `v` (array<long>); `is_query` picks the queries from it. Scores are exact integer inner products,
    ties go to the smaller vec_id, rows with the query's own vec_id are left out, a row repeated n times can rank n times, and
    vectors of different lengths never meet. A repeated query row is answered once. Scores are exact up to 2^53.
    """
    rows = vectors.withColumn("size", F.size("v"))
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks, groups = (max(1, math.ceil(x / y)) for x, y in ((counts["n"], BLOCK_ROWS), (counts["q"], QUERY_ROWS)))
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", "size", deal(0, blocks).alias("block"), every(groups).alias("part"))
    right = rows.where(is_query).dropDuplicates(["vec_id"]).select("vec_id", "v", "size", deal(1, groups).alias("part"), every(blocks).alias("block"))
    keys = ["size", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
