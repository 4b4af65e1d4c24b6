"""Nearest neighbours by a hash-prefix forest.

The rows are dealt by a hash into shards of about ``shard_rows``; each shard has a forest of
its own. A tree is the sorted array of its rows' hash strings: 48 signs of projections on
random directions, each cut at the shard's median. A query descends in every tree to the rows
that share the longest prefix with its own string, then all trees ascend together, one bit at
a time, until the rows under the prefixes number at least ``share`` of the shard (counted once
per tree). The distinct rows found so are compared by inner product in double precision, and
the shard's best go on; the best of all shards are the answer.

The queries, a stated set, meet every shard in blocks of ``query_rows``: a task holds one shard
and one block, whatever the size or skew of the table, and no row's neighbours depend on how
often a vector is repeated. Shards need no sample and no model of the whole table.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, neither
do null ids; vectors of different lengths are never compared. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcohort.llm.common import bucket, partitions_for
from seqcohort.session import settle

BITS = 48


def usable(vector: str) -> Column:
    v = F.col(vector)
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & good


class Forest:
    """Sorted hash strings of one shard, and the queries' way through them."""

    def __init__(self, x: np.ndarray, trees: int, seed: int):
        self.x, self.rng = x, np.random.default_rng([seed, x.shape[1]])
        self.planes = [self.rng.normal(size=(x.shape[1], BITS)).astype(np.float32) for _ in range(trees)]
        self.cuts, self.keys, self.order = [], [], []
        for plane in self.planes:
            at = x.astype(np.float32) @ plane
            cut = np.median(at, axis=0)
            key = self.strings(at, cut)
            order = np.argsort(key, kind="stable")
            self.cuts.append(cut)
            self.keys.append(key[order])
            self.order.append(order)

    @staticmethod
    def strings(at: np.ndarray, cut: np.ndarray) -> np.ndarray:
        bits = (at > cut).astype(np.uint64)
        return (bits << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def candidates(self, q: np.ndarray, wanted: int):
        """For each query the indices of its candidates."""
        n = len(q)
        keys = [self.strings(q.astype(np.float32) @ p, c) for p, c in zip(self.planes, self.cuts)]
        low = np.zeros((len(keys), n), np.int64)
        high = np.zeros((len(keys), n), np.int64)
        left, depth = np.arange(n), BITS
        # All trees ascend from the longest prefixes; a query stops at the first depth at which
        # they hold enough rows. A bit of depth below about log2 of the shard holds few rows.
        while len(left):
            shift = np.uint64(BITS - depth)
            total = np.zeros(len(left), np.int64)
            for t, key in enumerate(keys):
                first = key[left] >> shift << shift
                past = first + (np.uint64(1) << shift)
                low[t, left] = np.searchsorted(self.keys[t], first)
                high[t, left] = np.searchsorted(self.keys[t], past)
                total += high[t, left] - low[t, left]
            left = left[total < wanted] if depth else left[:0]
            depth -= 1
        seen = np.zeros(len(self.x), bool)
        for i in range(n):
            seen[:] = False
            for t in range(len(keys)):
                seen[self.order[t][low[t, i]:high[t, i]]] = True
            yield np.flatnonzero(seen)

    def search(self, q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int, wanted: int):
        """Query index, row index and score of each query's best ``k`` candidates."""
        for i, found in enumerate(self.candidates(q, wanted)):
            found = found[ids[found] != q_ids[i]]
            score = self.x[found] @ q[i]
            if len(found) > k:
                near = score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9
                found = found[near]
            # Summed in one order for every row, so that equal vectors tie exactly.
            score = (self.x[found] * q[i]).sum(axis=1)
            best = np.lexsort((ids[found], -score))[:k]
            yield np.full(len(best), i), found[best], score[best]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            trees: int = 72, share: float = 0.5, shard_rows: int = 8192, query_rows: int = 4096, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``queries`` (a condition on ``id``)
    holds, the ``k`` rows of largest inner product among its candidates."""
    rows = settle(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & usable("v")
    ).withColumn("dim", F.size("v")))
    asked = rows.filter(queries)
    shards, blocks = partitions_for(rows.count(), shard_rows), partitions_for(asked.count(), query_rows)

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.select("dim", each(shards).alias("shard"), bucket(blocks, "id").alias("block"), "id", "v")
    right = rows.select("dim", bucket(shards, "id", "v").alias("shard"), each(blocks).alias("block"), "id", "v")

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, q_ids = r["id"].to_numpy(np.int64), q["id"].to_numpy(np.int64)
        x = np.stack(r["v"].to_numpy()).astype(np.float64)
        at = np.argsort(ids, kind="stable")
        forest = Forest(x[at], trees, seed)
        wanted = max(trees * (k + 1), int(np.ceil(share * len(x))))
        parts = list(forest.search(np.stack(q["v"].to_numpy()).astype(np.float64), q_ids, ids[at], k, wanted))
        i, j, s = (np.concatenate(c) for c in zip(*parts))
        return pd.DataFrame(dict(zip(names, (q_ids[i], ids[at][j], s))))

    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
