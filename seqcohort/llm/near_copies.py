"""Near duplicates by the similarity of their sets of word shingles.

Two texts are near duplicates if the Jaccard similarity of their distinct shingles (words as in
``simhash``, told apart by XXH64) is at least ``similarity``; groups are what such pairs connect.

Fingerprints alone cannot say this: at a similarity of 0.8 they lie farther apart than any radius
that buckets could search. They find the closest copies first (``simhash.fingerprint_links``), which
ties large groups together cheaply. Of the other texts those go on that meet a different set in a
MinHash band: a text that is similar (at s) to another misses all of its bands with a chance of
(1 - s ** DEPTH) ** BANDS, 5e-8 at 0.8 and less above. Among these the search is exact. Shingles are
ordered by rarity, and two sets of similarity 0.8 share one of the first n - ceil(0.8 n) + 1 of
each; only these are indexed, without shingles of one text. A shared one must leave enough shingles
behind it in both, sizes must fit, and the parities of the shingles' counts in ``64 * WORDS`` classes
may differ in no more classes than two similar sets have shingles apart: unlike texts that share
rare shingles never become pairs. Every remaining pair is decided on the whole sets; pairs
that are connected already are not looked at again. For a few rounds all texts of a key meet a
few of them first, and each text takes two of those it fits on to the whole sets, so that a large
group of copies is tied together before its pairs would be listed; keys whose texts are all
connected leave the index.

Texts and sets are told apart by 128 bits or more. Null texts count as empty; texts without words
are one another's near duplicates and nobody else's; texts of fewer words than a shingle have one
shingle. Very long texts are taken whole. Rows of one id, equal rows and null ids are rows of their
own, an empty table gives an empty one, and only the named columns are read. Which text stands for
a group is arbitrary, the grouping is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcohort.llm.common import utf8
from seqcohort.llm.components import components
from seqcohort.llm.simhash import SEED, fingerprint_links, word_pieces
from seqcohort.session import release, settle

WIDTH, SIMILARITY = 5, 0.8
BANDS, DEPTH = 32, 4
# Above so many pairs left per row of the index, and at most so often, all texts of a key meet so many of them first.
LARGE, ROUNDS, CENTRES, TILE = 1, 4, 4, 512
WORDS = 8
PARITY = [f"p{i}" for i in range(WORDS)]
MIX = np.random.default_rng(2025).integers(0, 2**64, (2, BANDS * DEPTH, 1), dtype=np.uint64)
MIX[0] |= np.uint64(1)


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a text of fewer words is one shingle."""
    parts, short, digest = [], [], xxhash.xxh64_intdigest
    for words in word_pieces(text.lower(), width - 1):
        if len(words) < width:
            short = words
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - width + 1].tolist()
        parts.append(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1:].tolist())), np.uint64, len(starts)))
    if not parts and short:
        parts = [np.array([digest(b" ".join(short), SEED)], np.uint64)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """``simhash.fingerprint`` from the hashes of all shingles."""
    tally = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        tally += np.unpackbits(hashes[start:start + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * tally > len(hashes)).view(">u8")[0]) if len(hashes) else 0


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes(), SEED)


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def band_keys(shingles: np.ndarray) -> list[int]:
    if not len(shingles):
        return []
    least = np.full(BANDS * DEPTH, 2**64 - 1, np.uint64)
    for start in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[None, start:start + 1024] * MIX[0] + MIX[1]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, DEPTH))]


def parities(shingles: np.ndarray) -> np.ndarray:
    """``WORDS`` longs: one bit per class of shingles, set if the class holds an odd number. Two sets
    differ in at least as many shingles as these bits."""
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def sketch_rows(docs: DataFrame, id_col: str, text_col: str, width: int, mark: Column) -> DataFrame:
    """``id, mark, digest`` (of the text), ``node`` (of the set of shingles), ``n`` (its size),
    ``fp`` and ``keys`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, fp, keys, ends = [], [], [], [], [0]
            for text in utf8(batch.column(3)):
                hashes = shingle_hashes(text, width)
                shingles = np.unique(hashes)
                node.append(node_of(shingles))
                n.append(len(shingles))
                fp.append(fingerprint_of(hashes))
                keys += band_keys(shingles)
                ends.append(len(keys))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), longs(keys))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(node, pa.binary()), pa.array(n, pa.int64()), longs(fp), lists],
                ["id", "mark", "digest", "node", "n", "fp", "keys"],
            )

    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("id"), mark.cast("long").alias("mark"), text_digest(text).alias("digest"), text.alias("text")
    ).mapInArrow(run, "id long, mark long, digest binary, node binary, n long, fp long, keys array<long>")


def shingle_sets(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """``node, n, shingles`` of one text for each ``digest`` in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                sets = [np.unique(shingle_hashes(text, width)) for text in utf8(batch.column(0).slice(start, 64))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "shingles"]
                )

    text = F.col(text_col).cast("string")
    texts = docs.select(text_digest(text).alias("digest"), text.alias("text")).join(wanted, "digest", "left_semi")
    return texts.groupBy("digest").agg(F.first("text").alias("text")).select("text").mapInArrow(run, "node binary, n long, shingles binary")


def prefix_index(sets: DataFrame, similarity: float) -> DataFrame:
    """``key, nid, n, at``: the rarest shingles of each set, by which similar sets meet, and their
    places in the order of rarity, with the set's ``parities``; keys of one set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nid, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if n:
                    key = np.frombuffer(raw.as_buffer(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(n, nid)), pa.array(np.full(n, n))], ["key", "nid", "n"])

    shingles = sets.select("nid", "n", "shingles").mapInArrow(run, "key long, nid long, n long")
    often = shingles.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = shingles.join(often, "key")
    mine = Window.partitionBy("nid")
    # Shingles of one text come first in the order and need no place in the index.
    at = F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("often", "key"))
    first = shared.select("key", "nid", "n", at.alias("at")).filter(F.col("at") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1)
    return keys_apart(first.join(parity_rows(sets), "nid"), "nid")


def parity_rows(sets: DataFrame) -> DataFrame:
    """``nid`` and ``parities`` of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array([parities(np.frombuffer(raw.as_buffer(), np.uint64)) for raw in batch.column(1)], np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(words[:, i]) for i in range(WORDS))], ["nid", *PARITY])

    return sets.select("nid", "shingles").mapInArrow(run, ", ".join(["nid long", *(f"{p} long" for p in PARITY)]))


def keys_apart(index: DataFrame, label: str) -> DataFrame:
    """Rows of the keys that hold more than one ``label``."""
    index = settle(index)
    apart = index.groupBy("key").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo <> hi").select("key")
    out = settle(index.join(apart, "key", "left_semi"))
    release(index)
    return out


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` (``nid``) whose sets of shingles are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    kept.append(i)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    left = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("nid").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, mark: Column, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                similarity: float = SIMILARITY, radius: int = 4) -> DataFrame:
    """``id, mark, fp, root`` of every row; root names the group. ``mark`` is a long of the
    caller's to tell rows of one id apart."""
    rows = settle(sketch_rows(docs, id_col, text_col, width, mark))
    keys = rows.select("node", F.explode("keys").alias("key"))
    met = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key")
    # The closest copies: nodes of one fingerprint, and links between fingerprints.
    prints = settle(rows.groupBy("fp").agg(F.min("node").alias("low")))
    links = settle(fingerprint_links(prints.select("fp"), radius))
    low_a, low_b = (prints.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab")
    close = links.join(low_a, "a").join(low_b, "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    equal = rows.select("node", "fp").distinct().join(prints, "fp").select(F.col("node").alias("a"), F.col("low").alias("b"))
    close = settle(ordered(close.unionAll(equal)))

    nodes = keys.join(met, "key", "left_semi").select("node").unionAll(close.select("a")).unionAll(close.select("b")).distinct()
    wanted = settle(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("digest").alias("digest")).select("digest"))
    sets = settle(shingle_sets(docs, text_col, width, wanted).dropDuplicates(["node"]).withColumn("nid", F.monotonically_increasing_id()))
    names = sets.select("node", "nid")
    pairs = settle(ordered(
        close.join(names.toDF("a", "i"), "a").join(names.toDF("b", "j"), "b").select(F.col("i").alias("a"), F.col("j").alias("b"))
    ))
    found, tested, roots = settle(similar(pairs, sets, similarity)), pairs, None
    release(prints, links, close, wanted)

    # So many shingles must be shared, and a shared one leaves so many behind it.
    need = similarity / (1 + similarity) * (F.col("l.n") + F.col("r.n")) - 1e-9
    apart = sum((F.bit_count(F.col(f"l.{p}").bitwiseXOR(F.col(f"r.{p}"))) for p in PARITY[1:]),
                F.bit_count(F.col(f"l.{PARITY[0]}").bitwiseXOR(F.col(f"r.{PARITY[0]}"))))
    fits = (F.least("l.n", "r.n") >= similarity * F.greatest("l.n", "r.n") - 1e-9) & (
        1 + F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at")) >= need
    ) & (apart <= F.col("l.n") + F.col("r.n") - 2 * need)
    index, left = prefix_index(sets, similarity).withColumn("root", F.col("nid")), 0
    for turn in range(ROUNDS + 1):
        shares = index.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        per_key = shares.groupBy("key").agg(F.sum("n").alias("rows"), (F.sum("n").cast("double") ** 2 - F.sum(F.col("n").cast("double") ** 2)).alias("pairs"))
        rows_left, left = per_key.agg(F.sum("rows"), F.sum("pairs")).first()
        if turn == ROUNDS or not left or left <= LARGE * rows_left:
            break
        some = [F.min_by(F.struct("nid", "root", "n", "at", *PARITY), F.xxhash64("nid", F.lit(turn * CENTRES + k))) for k in range(CENTRES)]
        centre = index.groupBy("key").agg(F.array_distinct(F.array(*some)).alias("r")).select("key", F.explode("r").alias("r"))
        star = index.alias("l").join(centre, "key").filter((F.col("l.root") != F.col("r.root")) & fits)
        two = star.groupBy(F.col("l.nid").alias("a")).agg(F.array(F.min("r.nid"), F.max("r.nid")).alias("b"))
        pairs = settle(ordered(two.select("a", F.explode("b").alias("b"))).join(tested, ["a", "b"], "left_anti"))
        tested, found = tested.unionAll(pairs), found.unionAll(settle(similar(pairs, sets, similarity)))
        release(roots)
        roots = settle(components(found))
        who = roots.withColumnRenamed("node", "nid")
        before, index = index, keys_apart(index.drop("root").join(who, "nid", "left").withColumn("root", F.coalesce("root", "nid")), "root")
        release(before)
    if left:
        sized = index.join(index.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "key")
        one = sized.withColumn("tile", F.pmod(F.xxhash64("nid"), F.col("tiles")).cast("int")).alias("l")
        other = sized.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).alias("r")
        rest = one.join(other, ["key", "tile"]).filter((F.col("l.nid") < F.col("r.nid")) & (F.col("l.root") != F.col("r.root")) & fits)
        pairs = settle(ordered(rest.select(F.col("l.nid").alias("a"), F.col("r.nid").alias("b"))).join(tested, ["a", "b"], "left_anti"))
        found = found.unionAll(settle(similar(pairs, sets, similarity)))
    release(index, roots)
    roots = components(found)
    # A group is named by the least node in it; one row per node on the right, so that a node of very many rows is split.
    member = names.join(roots.withColumnRenamed("node", "nid"), "nid").select("node", "root")
    title = settle(member.join(member.groupBy("root").agg(F.min("node").alias("title")), "root").select("node", "title"))
    return rows.select("id", "mark", "fp", "node").join(title, "node", "left").select(
        "id", "mark", "fp", F.coalesce("title", "node").alias("root")
    )
