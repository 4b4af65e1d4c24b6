"""Exact deduplication of incoming batches against immutable snapshots.

A snapshot holds one row per distinct text digest, cut into hash buckets; every bucket has
a static binary fuse filter over its digests (3-wise, 8-bit fingerprints, about 1.13 bytes
a digest), built once and never changed. An incoming batch is first grouped by itself. Its
distinct digests are screened by the filters: what a filter rejects is new for certain,
what it lets through (all true repeats and about 1 in 256 others) joins the exact buckets,
and digests found there are confirmed by comparing the bytes of one text of either side.

Texts are equal when identical after lower-casing A-Z. Null counts as empty. Of equal texts
the row with the largest id stays; a null id is smaller than any other, and rows that share
the staying id all stay. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcohort.llm.common import LOWER, UPPER, bucket, partitions_for, utf8
from seqcohort.session import settle

BUCKET_DIGESTS = 100_000


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text."""

    @F.arrow_udf("binary")
    def digest(column: pa.Array) -> pa.Array:
        # bytes.lower() folds A-Z only
        return pa.array([hashlib.sha256(raw.lower()).digest() for raw in utf8(column)], pa.binary())

    return digest(text.cast("string"))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, n_bytes``: SHA-256 and length of every normalised text."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("id"), digest_of(text).alias("digest"), size.alias("n_bytes"))


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (two rounds of shift and multiply) of keys and seed."""
    h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three cells of each key: one in each of three neighbouring segments."""
    span = segment * segments
    first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    low = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
    third = (first + np.uint64(2 * segment)) ^ (h & low)
    return np.stack([first, second, third]).astype(np.int64)


def build_filter(keys: np.ndarray, tries: int = 100) -> tuple[int, int, int, bytes]:
    """``seed, segment, segments, fingerprints`` of distinct 64-bit keys. Cells that hold one
    key only are peeled in rounds; fingerprints are set in reverse order of peeling."""
    n = len(keys)
    if n == 0:
        return 0, 1, 1, bytes(3)
    segment = 2 ** min(18, max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    load = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    for seed in range(tries):
        segments = max(1, int(np.ceil(n * load * (1 + 0.02 * seed) / segment)) - 2)
        h = mixed(keys, seed + 1)
        cell = slots(h, segment, segments)
        size = segment * (segments + 2)
        count = np.bincount(cell.ravel(), minlength=size)
        holds = np.zeros(size, np.int64)  # xor of the indices of a cell's keys
        index = np.arange(n)
        for row in cell:
            np.bitwise_xor.at(holds, row, index)
        order, at, todo = [], [], np.flatnonzero(count == 1)
        while len(todo):
            found, first = np.unique(holds[todo], return_index=True)
            order.append(found)
            at.append(todo[first])
            touched = cell[:, found]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(holds, row, found)
            touched = np.unique(touched)
            todo = touched[count[touched] == 1]
        if sum(map(len, order)) == n:
            break
    else:
        raise RuntimeError("no filter found; are the keys distinct?")
    prints = np.zeros(size, np.uint8)
    short = (h ^ (h >> np.uint64(32))).astype(np.uint8)
    for keys_of, place in zip(reversed(order), reversed(at)):
        prints[place] = 0
        c = cell[:, keys_of]
        prints[place] = short[keys_of] ^ prints[c[0]] ^ prints[c[1]] ^ prints[c[2]]
    return seed + 1, segment, segments, prints.tobytes()


def passes(keys: np.ndarray, seed: int, segment: int, segments: int, prints: bytes) -> np.ndarray:
    if seed == 0:
        return np.zeros(len(keys), bool)
    h = mixed(keys, seed)
    cell, cells = slots(h, segment, segments), np.frombuffer(prints, np.uint8)
    return (h ^ (h >> np.uint64(32))).astype(np.uint8) == cells[cell[0]] ^ cells[cell[1]] ^ cells[cell[2]]


def filter_keys(digests) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(bytes(d)[:8] for d in digests), "<u8")


def grouped(rows: DataFrame) -> DataFrame:
    """``digest, n, top``: copies and largest id of each digest; combined before the shuffle."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))


def build_filters(snapshot: DataFrame) -> DataFrame:
    """One static filter per bucket of ``snapshot`` (``bucket, digest``)."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, prints = build_filter(np.unique(filter_keys(part["digest"])))
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "seed": seed, "segment": segment,
                             "segments": segments, "prints": [prints]})

    return snapshot.select("bucket", "digest").groupBy("bucket").applyInPandas(
        build, "bucket int, seed long, segment long, segments long, prints binary"
    )


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """Rows of ``incoming`` (``bucket, digest``) that the filter of their bucket lets through."""

    def check(new: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if not len(new) or not len(kept):
            return new.iloc[:0][["digest"]]
        f = kept.iloc[0]
        good = passes(filter_keys(new["digest"]), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["prints"])
        return new.loc[good, ["digest"]]

    return incoming.select("bucket", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(
        check, "digest binary"
    )


def same_bytes(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests of ``pairs`` (``digest, new_top, old_top``) whose two texts agree byte for byte."""
    sides = pairs.select("digest", F.explode(F.array("new_top", "old_top")).alias("id")).distinct()
    norm = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    source = docs.select(F.col(id_col).cast("long").alias("own"), norm.alias("norm")).withColumn("of", F.unhex(F.sha2("norm", 256)))
    # An id may be null or on several rows: with the digest in the key, a row meets its own
    # digest only, however many rows share its id.
    found = sides.join(source, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("own"))).select("digest", "norm")
    return found.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter(
        F.col("a") == F.col("b")
    ).select("digest")


def exact_dedup(docs: DataFrame, incoming: Column, id_col: str = "doc_id", text_col: str = "text",
                bucket_digests: int = BUCKET_DIGESTS) -> DataFrame:
    """``id, keep_id, group_size, kept, digest, n_bytes`` for every row of ``docs``: rows where
    ``incoming`` holds (a condition on ``id``) form the new batch, the others the snapshot."""
    rows = settle(digest_rows(docs, id_col, text_col).withColumn("fresh", F.coalesce(incoming, F.lit(False))))
    old, new = settle(grouped(rows.filter(~F.col("fresh")))), settle(grouped(rows.filter("fresh")))
    buckets = partitions_for(max(old.count(), new.count()), bucket_digests)
    filters = settle(build_filters(old.withColumn("bucket", bucket(buckets, "digest"))))
    positive = screen(new.withColumn("bucket", bucket(buckets, "digest")), filters)
    hits = settle(
        positive.join(new, "digest").select("digest", F.col("n").alias("new_n"), F.col("top").alias("new_top"))
        .join(old.select("digest", F.col("n").alias("old_n"), F.col("top").alias("old_top")), "digest")
    )
    sure = settle(hits.join(same_bytes(hits, docs, id_col, text_col), "digest"))
    decided = new.join(sure.select("digest", "old_n", "old_top"), "digest", "left").select(
        F.lit(True).alias("fresh"), "digest", F.greatest("top", "old_top").alias("keep_id"),
        (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"),
    ).unionAll(old.join(sure.select("digest", "new_n", "new_top"), "digest", "left").select(
        F.lit(False).alias("fresh"), "digest", F.greatest("top", "new_top").alias("keep_id"),
        (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("group_size"),
    ))
    # A digest with very many copies makes one large partition of ``rows``; the other side has
    # one row per digest, so the adaptive join splits that partition.
    return rows.join(decided, ["fresh", "digest"]).select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "n_bytes"
    )
