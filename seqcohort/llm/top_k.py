"""Exact nearest rows by inner product, selected through histograms.

Components become whole numbers, floor(``scale`` * x), so that scores are exact. Every query has a
range of scores that holds its k-th best one, at first all scores that the lengths of vectors
allow. A round scores every query against every candidate and counts, for queries still open, the
scores per part of their range; the counts of all tasks are summed, and the part in which the
count from above reaches k is the next range. A range is settled when it is one score wide, or when
the scores from its lower end up are exactly k. A last round keeps the scores from that end up;
ties at the k-th score go to the smaller ids.

Queries and candidates are rows of blocks, ``BLOCK`` vectors each, and blocks of candidates meet
those of queries by an equi-join on a grid of groups of about one block of queries and ``SHARE``
blocks of candidates. A task counts for all its candidate
blocks before it emits: per query the counts from the best part down to where its own scores
reach k, below which the k-th best of all cannot lie. So what is shuffled grows with tasks and
queries, not with scores, however often a vector is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcohort.llm.common import bucket, partitions_for
from seqcohort.session import release, settle

SCALE, K = 1024, 10
BLOCK, PARTS = 1024, 2048
# Blocks of candidates that a task counts before it emits.
SHARE = 16
LONG = 2**63 - 1


def usable(vector: str) -> Column:
    """Neither null nor holding null or non-finite components."""
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component; what a long cannot hold becomes its nearest long."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def numbers(raw: bytes, peak: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, kind(peak)).reshape(rows, -1) if raw else np.zeros((rows, 0), np.int64)


def kind(peak: int) -> type:
    """The narrowest type for components of at most this magnitude."""
    return np.int16 if peak < 2**15 else np.int32 if peak < 2**31 else np.int64


def blocks(rows: DataFrame) -> DataFrame:
    """``dim, block, size, peak, ids, known, x``: up to ``BLOCK`` vectors of one length as one row,
    the largest magnitude in it, and binary arrays of ids (``known``: not null) and components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: dict[int, list] = {}

        def out(dim: int, parts: list) -> pa.RecordBatch:
            nonlocal number
            ids, known, x = (np.concatenate(p) for p in zip(*parts))
            number += 1
            peak = min(LONG, max(-int(x.min(initial=0)), int(x.max(initial=0))))
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "block": pa.array([number], pa.int64()), "size": pa.array([len(ids)], pa.int32()),
                "peak": pa.array([peak], pa.int64()), "ids": [ids.tobytes()], "known": [known.tobytes()],
                "x": [x.astype(kind(peak)).tobytes()],
            })

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                ids, vectors = (c.slice(start, BLOCK) for c in batch.columns)
                known = np.asarray(ids.is_valid())
                ids = np.asarray(ids.fill_null(0))
                sizes = np.asarray(vectors.value_lengths())
                flat = np.asarray(vectors.flatten())
                begin = np.cumsum(sizes) - sizes
                for dim in np.unique(sizes).tolist():
                    mine = np.flatnonzero(sizes == dim)
                    x = flat[(begin[mine][:, None] + np.arange(dim)).ravel()]
                    parts = held.setdefault(dim, [])
                    parts.append((ids[mine], known[mine], x))
                    if sum(len(p[0]) for p in parts) >= BLOCK:
                        yield out(dim, held.pop(dim))
        for dim, parts in held.items():
            yield out(dim, parts)

    return rows.mapInArrow(run, "dim int, block long, size int, peak long, ids binary, known binary, x binary")


def products(q: np.ndarray, c: np.ndarray, bound: int) -> np.ndarray:
    """Exact inner products; those that a long cannot hold become its nearest long."""
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    big = q.astype(object) @ c.astype(object).T
    return np.array([[max(-LONG - 1, min(LONG, s)) for s in row] for row in big.tolist()], np.int64).reshape(len(q), len(c))


class Tile:
    """Scores of one block of queries against one block of candidates."""

    def __init__(self, row: dict):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        q_ids = np.frombuffer(row["q_ids"], np.int64)
        q, c = numbers(row["q_x"], row["q_peak"], len(q_ids)), numbers(row["x"], row["peak"], len(self.ids))
        self.scores = products(q, c, row["dim"] * row["peak"] * row["q_peak"])
        self.other = (self.ids != q_ids[:, None]) | ~self.known


def tiles(queries: DataFrame, candidates: DataFrame, groups: int, shares: int) -> DataFrame:
    """Every block of queries with every block of candidates of its length."""
    q = queries.select(
        "dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("peak").alias("q_peak"),
        *[c for c in ("low", "step") if c in queries.columns],
    ).withColumn("group", bucket(groups, "q_block")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    met = candidates.withColumn("share", bucket(shares, "block")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return met.join(q, ["dim", "group", "share"])


def counted(pairs: DataFrame, k: int) -> DataFrame:
    """``q_block, q, part, n``: scores per part of each open query's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for block, table in held.items():
                above = table[:, ::-1].cumsum(axis=1)[:, ::-1] - table
                q, part = np.nonzero((table > 0) & (above < k))
                n = table[q, part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), block)), pa.array(q), pa.array(part), pa.array(n)], ["q_block", "q", "part", "n"]
                )
            held.clear()

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                tile = Tile(row)
                low, step = np.frombuffer(row["low"], np.int64)[:, None], np.frombuffer(row["step"], np.int64)[:, None]
                inside = tile.other & (tile.scores >= low) & (step > 0)
                # As unsigned numbers the differences do not overflow; what lies above the range is the last part.
                part = (tile.scores.view(np.uint64) - low.view(np.uint64)) // np.maximum(step, 1).view(np.uint64)
                part = np.minimum(part, PARTS).astype(np.int64)
                code = (np.arange(len(part))[:, None] * (PARTS + 1) + part)[inside]
                table = np.bincount(code, minlength=len(part) * (PARTS + 1)).reshape(len(part), PARTS + 1)
                if row["q_block"] in held:
                    held[row["q_block"]] += table
                else:
                    held[row["q_block"]] = table
                if len(held) >= 4:
                    yield from out()
        yield from out()

    cols = ["dim", "q_block", "q_ids", "q_x", "q_peak", "low", "step", "ids", "known", "peak", "x"]
    parts = pairs.select(*cols).mapInArrow(run, "q_block long, q long, part long, n long")
    return parts.groupBy("q_block", "q", "part").agg(F.sum("n").alias("n"))


def kept(pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, q_block, q, vec_id, score`` of the scores from each query's ``low`` up; a task
    emits of those of one tile the best ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                tile = Tile(row)
                q, c = np.nonzero(tile.other & (tile.scores >= np.frombuffer(row["low"], np.int64)[:, None]))
                score = tile.scores[q, c]
                order = np.lexsort((tile.ids[c], ~tile.known[c], ~score, q))  # ~score falls as score rises, without overflow
                q, c, score = q[order], c[order], score[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                q, c, score = (v[rank < k] for v in (q, c, score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), row["q_block"])), pa.array(q), pa.array(np.frombuffer(row["q_ids"], np.int64)[q]),
                     pa.array(tile.ids[c], mask=~tile.known[c]), pa.array(score)],
                    ["q_block", "q", "query_id", "vec_id", "score"],
                )

    cols = ["dim", "q_block", "q_ids", "q_x", "q_peak", "low", "ids", "known", "peak", "x"]
    return pairs.select(*cols).mapInArrow(run, "q_block long, q long, query_id long, vec_id long, score long")


def with_ranges(queries: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks of queries with their ranges as binary arrays ``low`` and ``step``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: [] for n in ("low", "step")}
            for row in batch.column(1).to_pylist():
                row = sorted(row, key=lambda r: r["q"])
                for n, values in columns.items():
                    values.append(np.array([r[n] for r in row], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns.values())], ["block", "low", "step"])

    per_block = ranges.groupBy(F.col("q_block").alias("block")).agg(F.collect_list(F.struct("q", "low", "step")).alias("r"))
    return queries.join(per_block.mapInArrow(run, "block long, low binary, step binary"), "block")


def best(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
         scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of every row for which ``queries``
    (a condition on ``id`` and ``vec``) holds, against all rows of another id; all, if there are
    fewer.

    Vectors that are null or hold null or non-finite components take no part; vectors of different
    lengths are never compared, empty ones score 0 with one another. A row without an id is a
    candidate (null sorts last among ties) and never a query; rows of one id are queries of their
    own and no candidates of each other. Components and scores beyond a long are held at its ends.
    An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).filter(usable("vec"))
    asking = F.coalesce(queries, F.lit(False)) & F.col("id").isNotNull()
    candidates = settle(blocks(rows.select("id", whole("vec", scale).alias("x"))))
    asked = settle(blocks(rows.filter(asking).select("id", whole("vec", scale).alias("x"))))
    # No score exceeds the product of lengths; a power of two holds it.
    peak = candidates.groupBy("dim").agg(F.max("peak").alias("top"))
    reach = F.col("dim").cast("double") * F.col("top").cast("double") * F.col("peak").cast("double")
    one, large = F.lit(1).cast("long"), reach >= 2.0**61
    top = F.call_function("shiftleft", one, F.when(large, F.lit(0)).otherwise(F.floor(F.log2(reach + 1)) + 1).cast("int"))
    span = F.when(large, F.lit(-LONG - 1)).otherwise(-top)
    step = F.when(large, F.lit(2**64 // PARTS)).otherwise(F.greatest(one, F.shiftright(top, PARTS.bit_length() - 2)))
    groups, shares = max(1, asked.count()), partitions_for(candidates.count(), SHARE)
    ranges = settle(asked.join(peak, "dim").select(
        F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("q"),
        span.alias("low"), step.alias("step"),
    ).withColumn("q", F.col("q").cast("long")))
    while not (open_ := ranges.filter("step > 0")).isEmpty():
        going = asked.join(open_.select(F.col("q_block").alias("block")).distinct(), "block", "left_semi")
        counts = counted(tiles(with_ranges(going, ranges), candidates, groups, shares), k)
        down = Window.partitionBy("q_block", "q").orderBy(F.desc("part"))
        there = counts.withColumn("upto", F.sum("n").over(down)).filter((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
        found = there.select("q_block", "q", "part", "upto")
        low = F.col("low") + F.col("part") * F.col("step")
        # Fewer than k scores in all: everything from the lower end up is wanted, as at the start.
        fresh = F.when(F.col("step") == 0, F.struct("low", "step")).when(
            F.col("part").isNull(), F.struct("low", F.lit(0).cast("long").alias("step"))
        ).when(
            (F.col("step") == 1) | (F.col("upto") == k), F.struct(low.alias("low"), F.lit(0).cast("long").alias("step"))
        ).otherwise(F.struct(low.alias("low"), F.greatest(F.lit(1).cast("long"), F.shiftright("step", PARTS.bit_length() - 1)).alias("step")))
        before, ranges = ranges, settle(
            ranges.join(found, ["q_block", "q"], "left").withColumn("r", fresh).select("q_block", "q", "r.low", "r.step")
        )
        release(before)
    some = kept(tiles(with_ranges(asked, ranges), candidates, groups, shares), k)
    order = Window.partitionBy("q_block", "q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
