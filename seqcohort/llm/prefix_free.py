"""Removal of repeated strings by prefix-free parsing.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the
same text or another. Texts are UTF-8 bytes, null counts as empty, matches never cross texts,
and strings are judged on the input.

Parsing: a rolling hash over ``gram`` bytes triggers where it is the least (leftmost on ties)
of some string of ``length`` bytes, so every such string holds a trigger, and equal strings
hold it at the same place. A phrase is the run of starts that share a trigger together with the
bytes that the strings from these starts cover; neighbouring phrases overlap by ``length - 1``
bytes. No string of ``length`` bytes crosses a phrase, so the order of the corpus' suffixes to
that depth is the order of the dictionary's suffixes, and the parse adds how often each phrase
occurs:

1. The parse is written as rows (text, start, number of starts, trigger gram, phrase digest);
   counts give the dictionary. A phrase that occurs twice is covered as a whole. A trigger gram
   that occurs once in the corpus proves all its strings unique: those phrases, the bulk of
   ordinary text, are done.
2. What is left are phrases that occur once but share their gram with other phrases, at the
   borders of repeats. Only their bytes are fetched. The dictionary's suffixes, dealt by gram,
   are sorted as byte strings to depth ``length`` (a suffix array); neighbours that are equal
   to that depth are repeats. Grams shared by too many phrases for one task are compared by
   128-bit digests of their strings instead, counted across tasks.
3. The covered runs of every text are merged and cut out.

Phrases are identified by two independent 64-bit hashes (of the gram and of the phrase).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcohort.llm.common import bucket, partitions_for, utf8
from seqcohort.session import settle

PIECE = 1 << 20
PLACE = np.uint64(27)
BASE = 0x9E3779B97F4A7C15
LETTERS = np.random.default_rng(99).integers(0, 2**64, 256, dtype=np.uint64)
NO_ID = -(2**63)
HOT = 2000  # phrases of one gram that are sorted in one task


def rolling(raw: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hash of each ``gram`` bytes, built from halves."""
    def hashes(size: int) -> np.ndarray:
        if size == 1:
            return LETTERS[raw]
        half = size // 2
        h = hashes(half)
        n = len(raw) - size + 1
        if size % 2 == 0:
            return h[:n] * np.uint64(pow(BASE, half, 2**64)) + h[half:half + n]
        return (h[:n] * np.uint64(pow(BASE, half, 2**64)) + h[half:half + n]) * np.uint64(BASE) + LETTERS[raw[size - 1:]]

    h = hashes(gram)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def triggers(raw: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each start of a string of ``length`` bytes the place of its trigger."""
    h = rolling(raw, gram)
    least = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
    return (least & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)


def phrases(text: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """``start, starts, gram hash, phrase hash`` of the phrases of a text; long texts in pieces
    (a phrase cut at a piece's end is two phrases of one gram)."""
    digest = xxhash.xxh3_64_intdigest
    for first in range(0, max(0, len(text) - length + 1), PIECE):
        part = text[first:first + PIECE + length - 1]
        at = triggers(np.frombuffer(part, np.uint8), length, gram)
        cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = np.r_[cuts[1:], len(at)]
        for start, end, place in zip(cuts.tolist(), ends.tolist(), at[cuts].tolist()):
            yield first + start, end - start, digest(part[place:place + gram], 1), digest(part[start:end + length - 1], 2)


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def parse(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The parse of ``docs`` (``own, hash, text``): one row per phrase occurrence."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            row, found = [], []
            own, hashes = batch.column(0), batch.column(1)
            for i, text in enumerate(utf8(batch.column(2))):
                got = list(phrases(text, length, gram))
                row += [i] * len(got)
                found += got
                if len(found) > 100_000:
                    yield pack_phrases(own, hashes, row, found)
                    row, found = [], []
            if found:
                yield pack_phrases(own, hashes, row, found)

    return docs.mapInArrow(run, "own long, hash long, start long, starts int, gram long, phrase long")


def pack_phrases(own: pa.Array, hashes: pa.Array, row: list[int], found: list[tuple]) -> pa.RecordBatch:
    start, starts, gram, phrase = zip(*found)
    at = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [own.take(at), hashes.take(at), pa.array(start, pa.int64()), pa.array(starts, pa.int32()), signed(gram), signed(phrase)],
        ["own", "hash", "start", "starts", "gram", "phrase"],
    )


def fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` phrases (``own, hash, start, starts, gram, lone``) with their bytes."""
    lists = wanted.groupBy("own", "hash").agg(F.collect_list(F.struct("start", "starts", "gram", "lone")).alias("found"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            own, hashes = batch.column(0), batch.column(1)
            for i, text in enumerate(utf8(batch.column(2), 16)):
                rows = batch.column(3)[i].as_py()
                for k in range(0, len(rows), 2000):
                    part = rows[k:k + 2000]
                    at = pa.array([i] * len(part))
                    yield pa.RecordBatch.from_arrays(
                        [own.take(at), hashes.take(at), pa.array([r["start"] for r in part], pa.int64()),
                         pa.array([r["gram"] for r in part], pa.int64()), pa.array([r["lone"] for r in part], pa.bool_()),
                         pa.array([text[r["start"]:r["start"] + r["starts"] + length - 1] for r in part], pa.binary())],
                        ["own", "hash", "start", "gram", "lone", "bytes"],
                    )

    return docs.join(lists, ["own", "hash"]).select("own", "hash", "text", "found").mapInArrow(
        run, "own long, hash long, start long, gram long, lone boolean, bytes binary"
    )


def runs_of(flags: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring flagged places of one group."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.r_[True, (np.diff(at) != 1) | (group[at[1:]] != group[at[:-1]]) | (np.diff(place[at]) != 1)]
    first = np.flatnonzero(new)
    return at[first], at[np.r_[first[1:], len(at)] - 1]


def sorted_repeats(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Covered runs of the phrases of ``rows`` that occur once, from the suffix array of all
    suffixes of at least ``length`` bytes."""
    held = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
    size = rows["bytes"].map(len).to_numpy()
    starts = size - length + 1
    phrase = np.repeat(np.arange(len(rows)), starts)
    within = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    places = np.repeat(np.cumsum(size) - size, starts) + within
    suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(held, length)[places]).view(f"S{length}").ravel()
    order = np.argsort(suffix)
    ranked = suffix[order]
    equal = ranked[1:] == ranked[:-1]
    repeated = np.zeros(len(order), bool)
    repeated[order[1:][equal]] = True
    repeated[order[:-1][equal]] = True
    first, last = runs_of(repeated & rows["lone"].to_numpy()[phrase], phrase, within)
    start = rows["start"].to_numpy()[phrase[first]] if len(first) else np.zeros(0, np.int64)
    return pd.DataFrame({
        "own": rows["own"].to_numpy()[phrase[first]], "hash": rows["hash"].to_numpy()[phrase[first]],
        "low": start + within[first], "high": start + within[last] + length,
    })


def counted_repeats(rows: DataFrame, length: int) -> DataFrame:
    """The same for grams of very many phrases: strings are counted by their digests."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                own, hashes, start, lone, raw = (batch.column(c)[i].as_py() for c in range(5))
                n = len(raw) - length + 1
                sums = [xxhash.xxh3_128_intdigest(raw[k:k + length]) for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own] * n, pa.int64()), pa.array([hashes] * n, pa.int64()), pa.array(np.arange(start, start + n)),
                     pa.array([lone] * n, pa.bool_()), signed([s >> 64 for s in sums]), signed([s & (2**64 - 1) for s in sums])],
                    ["own", "hash", "low", "lone", "h1", "h2"],
                )

    strings = rows.select("own", "hash", "start", "lone", "bytes").mapInArrow(
        run, "own long, hash long, low long, lone boolean, h1 long, h2 long"
    )
    several = strings.groupBy("h1", "h2").count().filter("count > 1")
    return strings.filter("lone").join(several, ["h1", "h2"]).select("own", "hash", "low", (F.col("low") + length).alias("high"))


def cut(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes and maximal runs removed, and what is left."""
    kept, at, removed, spans = [], 0, 0, 0
    low, high = None, None
    for a, b in [*sorted(runs), (None, None)]:
        if high is not None and a is not None and a <= high:
            high = max(high, b)
            continue
        if high is not None:
            kept.append(text[at:low])
            at, removed, spans = high, removed + high - low, spans + 1
        low, high = a, b
    kept.append(text[at:])
    return removed, spans, b"".join(kept)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 48,
                   part_phrases: int = 2000, hot: int = HOT) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` for every row; ``kept`` is what is left."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("own"), F.xxhash64(text).alias("hash"), text.alias("text"))
    parsed = settle(parse(docs.filter(F.octet_length("text") >= length), length, gram))
    counted = parsed.groupBy("gram", "phrase").agg(F.count(F.lit(1)).alias("n"))
    grams = counted.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).filter("total > 1")
    flagged = counted.join(grams.select("gram", "kinds"), "gram").select("gram", "phrase", "n", "kinds")
    # A phrase of very many occurrences is one row on the right; the adaptive join splits the left.
    marked = settle(parsed.join(flagged, ["gram", "phrase"]))
    whole = marked.filter("n > 1").select("own", "hash", F.col("start").alias("low"), (F.col("start") + F.col("starts") + length - 1).alias("high"))
    open_ones = marked.filter("kinds > 1")
    lone = open_ones.filter("n = 1").select("own", "hash", "start", "starts", "gram", F.lit(True).alias("lone"), "kinds")
    # Any occurrence stands for a phrase of several; its bytes are the same.
    others = open_ones.filter("n > 1").groupBy("gram", "phrase").agg(
        *[F.first(c).alias(c) for c in ("own", "hash", "start", "starts", "kinds")]
    ).select("own", "hash", "start", "starts", "gram", F.lit(False).alias("lone"), "kinds")
    wanted = settle(lone.unionAll(others))
    few, many = wanted.filter(F.col("kinds") <= hot), wanted.filter(F.col("kinds") > hot)
    parts = partitions_for(few.count(), part_phrases)
    # The texts are shuffled once: here and in the last join they are dealt the same way, in one
    # plan, so that one exchange serves all.
    runs = fetch(docs, few, length).withColumn("part", bucket(parts, "gram")).groupBy("part").applyInPandas(
        lambda rows: sorted_repeats(rows, length), "own long, hash long, low long, high long"
    )
    if not many.isEmpty():
        runs = runs.unionAll(counted_repeats(fetch(docs, many, length), length))
    covered = whole.unionAll(runs).groupBy("own", "hash", "low").agg(F.max("high").alias("high")).groupBy("own", "hash").agg(
        F.collect_list(F.struct("low", "high")).alias("runs")
    )

    def trim(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = []
            for i, raw in enumerate(utf8(batch.column(1), 64)):
                rows = batch.column(2)[i].as_py() or []
                removed, spans, kept = cut(raw, [(r["low"], r["high"]) for r in rows])
                found.append((len(raw), removed, spans, kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = docs.join(covered, ["own", "hash"], "left").select(F.nullif("own", F.lit(NO_ID)).alias("id"), "text", "runs")
    return joined.mapInArrow(trim, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
