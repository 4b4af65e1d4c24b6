"""Best-fit packing of documents into sequences under conflicts.

Items are dealt by a hash into shards of about ``shard_items``; a shard is packed in one task,
longest item first. Its open bins are kept in order of residual capacity. For an item the
search starts at the smallest residual that holds it and goes from successor to successor
until a bin is compatible: the bin's duplicate-cluster bitmap must not have the item's cluster,
and its source bitmap must have one of the source's ``per_source`` places free. The first such
bin is the tightest; if there is none, a bin is opened. Documents longer than a bin fill whole
bins of their own first; the rest is an item like any other.

An item's length is its number of tokens and one separator, so empty texts are packed as well.
Nulls in source or cluster are values of their own. Equal rows are counted and numbered as
copies before they are dealt, so that a row that occurs very often is spread over all shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcohort.llm.common import bucket, partitions_for
from seqcohort.session import settle

COPIES = 10_000


def pack_items(length: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item (lengths up to ``capacity``, in the order given); source and
    cluster are small integers, cluster -1 for items without a twin among them."""
    order: list[tuple[int, int]] = []  # (residual, bin)
    sources: list[int] = []
    clusters: list[int] = []
    bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    full = (1 << per_source) - 1
    for item, (size, s, c) in enumerate(zip(length.tolist(), source.tolist(), cluster.tolist())):
        shift, twin = s * per_source, (1 << c if c >= 0 else 0)
        for at in range(bisect_left(order, (size, -1)), len(order)):
            b = order[at][1]
            if not clusters[b] & twin and sources[b] >> shift & full != full:
                residual = order.pop(at)[0]
                break
        else:
            b, residual = len(sources), capacity
            sources.append(0)
            clusters.append(0)
        bins[item], offsets[item] = b, capacity - residual
        places = sources[b] >> shift & full
        sources[b] |= (places + 1) << shift  # the lowest free place of the source
        clusters[b] |= twin
        if residual > size:
            insort(order, (residual - size, b))
    return bins, offsets


def numbered_copies(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Every row of ``rows`` with the number of its copy (from 0) among equal rows."""
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    runs = counted.select(*cols, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int"))).alias("run"))
    last = F.least(F.lit(COPIES), F.col("n") - F.col("run") * COPIES) - 1
    return runs.select(*cols, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"), "run").select(
        *cols, (F.col("run").cast("long") * COPIES + F.col("i")).alias("copy")
    )


def pack(items: DataFrame, capacity: int = 2048, per_source: int = 4, shard_items: int = 4096) -> DataFrame:
    """``id, copy, piece, bin, offset, length``: where each piece of each item lies; ``items``
    has ``id, source, cluster, n_tokens``. Bins are numbered across shards."""
    rows = settle(numbered_copies(
        items.select("id", "source", "cluster", (F.coalesce("n_tokens", F.lit(0)) + 1).cast("long").alias("length")),
        ["id", "source", "cluster", "length"],
    ))
    shards = partitions_for(rows.count(), shard_items)

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "id", "copy"], ascending=[False, True, True], ignore_index=True)
        size = part["length"].to_numpy(np.int64)
        whole, rest = size // capacity, size % capacity
        source = pd.factorize(part["source"], use_na_sentinel=False)[0]
        cluster, seen = pd.factorize(part["cluster"], use_na_sentinel=True)
        twins = np.bincount(cluster[cluster >= 0], minlength=len(seen)) > 1
        number = np.where(twins, np.cumsum(twins) - 1, -1)
        cluster = np.where(cluster >= 0, number[cluster] if len(number) else -1, -1)
        left = np.flatnonzero(rest)
        left = left[np.argsort(-rest[left], kind="stable")]
        bins, offsets = pack_items(rest[left], source[left], cluster[left], capacity, per_source)
        item = np.r_[np.repeat(np.arange(len(size)), whole), left]
        piece = np.r_[np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole), whole[left]]
        first = int(bins.max()) + 1 if len(bins) else 0
        number = np.r_[first + np.arange(whole.sum()), bins] + (int(part["shard"].iloc[0]) << 32)
        return pd.DataFrame({
            "id": part["id"].iloc[item].to_numpy(), "copy": part["copy"].iloc[item].to_numpy(), "piece": piece, "bin": number,
            "offset": np.r_[np.zeros(whole.sum(), np.int64), offsets], "length": np.r_[np.full(whole.sum(), capacity), rest[left]],
        })

    dealt = rows.withColumn("shard", bucket(shards, "id", "copy", "cluster", "length"))
    return dealt.groupBy("shard").applyInPandas(fill, "id long, copy long, piece long, bin long, offset long, length long")
