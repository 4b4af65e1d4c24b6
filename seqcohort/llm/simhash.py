"""Near duplicates by SimHash fingerprints and pivot distance tables.

Fingerprints: a text is lower-cased (A-Z), cut into words at ASCII white space and into
shingles of ``width`` words, repeats included; a bit is set if it is set in over half of the
shingles' XXH64. Texts without words get fingerprint zero, linked like any other; null counts
as empty.

Links: two fingerprints link at ``radius`` or fewer differing bits. A distance to any one
reference says little about fingerprints that lie about 32 bits apart from everything, so
pivots alone would leave a quadratic number of pairs to look at. They work here inside
buckets: a fingerprint is cut into blocks, of which a linked pair must agree on all but
``radius``; rows meet in one bucket for each choice of agreeing blocks. In a bucket the
table of Hamming distances to the pivots is computed once; rows are sorted by the first
coordinate, only rows within ``radius`` of it are looked at, pairs whose largest coordinate
difference exceeds ``radius`` are discarded, and survivors are verified by their bits.
A bucket emits a spanning forest of its links, never its pairs. Buckets too large for one
task (one group of near copies may hold a third of all rows) are cut into tiles, and every
two tiles meet.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcohort.llm.common import bucket, partitions_for, utf8
from seqcohort.llm.components import components, labels_of
from seqcohort.session import settle

SEED = 42
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
PIVOTS = np.random.default_rng(2024).integers(0, 2**64, 32, dtype=np.uint64)


def word_pieces(text: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of ``text`` in bounded lists, each starting with the last ``overlap`` words
    of the one before."""
    start, tail = 0, []
    while start < len(text):
        cut = SPACE.search(text, min(len(text), start + PIECE))
        end = cut.start() if cut else len(text)
        words = tail + text[start:end].split()  # splits at space and \x09-\x0D only
        yield words
        tail = words[-overlap:] if overlap else []
        start = end


def fingerprint(text: bytes, width: int = 4) -> int:
    tally, total, short = np.zeros(64, np.int64), 0, []
    for words in word_pieces(text.lower(), width - 1):
        if len(words) < width:
            short = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - width + 1].tolist()
        stops = (ends[width - 1:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), np.dtype(">u8"), len(starts))
        tally += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += len(h)
    if total == 0 and short:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(short), SEED)], ">u8")
        tally, total = np.unpackbits(h.view(np.uint8)).astype(np.int64), 1
    bits = np.packbits(2 * tally > total) if total else np.zeros(8, np.uint8)
    return int(bits.view(">u8")[0])


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                     mark: Column | None = None) -> DataFrame:
    """``id, mark, fp`` of every row; fp holds the 64 bits as a signed long. ``mark`` is a long of
    the caller's to tell rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, width) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["id", "mark", "fp"])

    own = mark if mark is not None else F.lit(None)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), own.cast("long").alias("mark")
    )
    return rows.mapInArrow(run, "id long, mark long, fp long")


def bucket_links(fp: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints of equal key, as two arrays."""
    table = np.bitwise_count(fp[None, :] ^ PIVOTS[:, None]).astype(np.int8)
    order = np.lexsort((table[0], key))
    fp, key, table = fp[order], key[order], table[:, order]
    n = len(fp)
    label = np.arange(n)
    active, shift, left, right, pending = np.arange(n), 0, [], [], 0
    while len(active):
        shift += 1
        i = active[active + shift < n]
        j = i + shift
        near = (key[i] == key[j]) & (table[0][j] - table[0][i] <= radius)
        active = i = i[near]
        i = i[label[i] != label[i + shift]]  # already in one component
        for row in table[1:]:
            if not len(i):
                break
            i = i[np.abs(row[i + shift] - row[i]) <= radius]
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= radius]
        if len(i):
            left.append(i)
            right.append(i + shift)
            pending += len(i)
        if pending > 50_000:
            label = labels_of(n, np.concatenate(left), np.concatenate(right), label)
            left, right, pending = [], [], 0
    if pending:
        label = labels_of(n, np.concatenate(left), np.concatenate(right), label)
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def fingerprint_links(prints: DataFrame, radius: int = 4, part_rows: int = 8192, tile_rows: int = 8192,
                      bucket_rows: int = 256) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``), enough of them that every
    two linked fingerprints are connected. Blocks are as many as keep an even bucket under
    ``bucket_rows``; that sets the layout only, each choice finds the same components."""
    n = prints.count()
    blocks = radius + 1
    while blocks < 10 and n / 2 ** (64 * (blocks - radius) // blocks) > bucket_rows:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in itertools.combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edges[c + 1]) - (1 << edges[c])) for c in chosen)
        masks.append(mask - 2**64 if mask >= 2**63 else mask)
    keyed = prints.select("fp", F.posexplode(
        F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])
    ).alias("t", "k"))
    hot = settle(keyed.groupBy("t", "k").count().filter(F.col("count") > tile_rows))
    parts = partitions_for(n * len(masks), part_rows)

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["k"].to_numpy(np.int64) ^ (rows["t"].to_numpy(np.int64) * np.int64(0x1F3D5B79A7C5E3F1))
        a, b = bucket_links(rows["fp"].to_numpy(np.int64).view(np.uint64), key, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    schema = "a long, b long"
    links = keyed.join(hot, ["t", "k"], "left_anti").select("fp", "t", "k").groupBy(
        bucket(parts, "t", "k").alias("part")
    ).applyInPandas(link, schema)
    if not hot.isEmpty():
        tiled = keyed.join(hot, ["t", "k"]).withColumn("tiles", F.ceil(F.col("count") / tile_rows).cast("int"))
        tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).select(
            "fp", "t", "k", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        ).select("fp", "t", "k", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"))
        links = links.unionAll(tiled.groupBy("t", "k", "x", "y").applyInPandas(link, schema))
    return links


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                radius: int = 4, mark: Column | None = None) -> DataFrame:
    """``id, mark, fp, component_id, root``: for every row the smallest id reachable over links,
    its own included, and the fingerprint that names its component. Null ids are passed over:
    only a component of null ids has a null."""
    rows = settle(fingerprint_rows(docs, id_col, text_col, width, mark))
    prints = settle(rows.groupBy("fp").agg(F.min("id").alias("low")))
    roots = settle(components(fingerprint_links(prints.select("fp"), radius)).withColumnRenamed("node", "fp"))
    lows = roots.join(prints, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    linked = roots.join(lows, "root").select("fp", "component_id", "root")
    ids = prints.join(linked, "fp", "left").select(
        "fp", F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("low")).alias("component_id"),
        F.coalesce("root", "fp").alias("root"),
    )
    # One row per fingerprint on the right: a fingerprint of very many rows is split by the
    # adaptive join.
    return rows.join(ids, "fp").select("id", "mark", "fp", "component_id", "root")
