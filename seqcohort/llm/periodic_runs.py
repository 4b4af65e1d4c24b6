"""Periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words that keeps its smallest period q over at least
``exponent`` periods and ``least`` words and that no neighbouring word extends.

At every dyadic scale t a set of positions is chosen by hashes of the t words that follow: i is in
it if the least hash among i..i+t is that of i or of i+t, where positions inside regions of a
period of at most t/3 do not count. Whether i is chosen depends on the 2t words from i only, so a
run repeats its positions at every period, and one of them lies in any q consecutive places of a
run with q >= 2t. Each position has two contexts, 3t words for q in [2t, 3t) and 4t for [3t, 4t),
once from the position on and once around it; one of the two lies in the run, and as it is not
shorter than q, the next position with an equal context is exactly q away. Such pairs propose
(place, period), and words are compared to extend and verify each proposal. The regions left out
at a scale are the runs of the scales before; periods below twice the least scale come from words
compared directly at every such distance.

Many documents are searched as one array, longest first, parted by words that occur nowhere else;
a scale looks only at those long enough for it. Memory is in proportion to ``CHUNK`` words, or to
the longest document. Contexts are told apart by 64-bit hashes: equal hashes of different words
within one chunk (a chance near 1e-8) could hide a run, and never make one up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcohort.llm.common import utf8

LEAST, EXPONENT = 24, 3
SCALE = 8
CHUNK = 1 << 18
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
NONE = np.uint64(2**64 - 1)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring stretches from their hashes."""
    x = (a ^ (a >> np.uint64(29))) * A + (b ^ (b >> np.uint64(32))) * B
    x = (x ^ (x >> np.uint64(31))) * C
    return x ^ (x >> np.uint64(30))


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of True of at least ``least``."""
    edge = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def factors(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + [q] if q > 1 else out


def primitive(w: np.ndarray, start: int, q: int) -> bool:
    """Whether q is the smallest period of a stretch that has it three times."""
    return not any(np.array_equal(w[start:start + q], w[start + q // f:start + q // f + q]) for f in factors(q))


def extended(w: np.ndarray, low: int, high: int, q: int) -> tuple[int, int]:
    """The stretch around [low, high) on which words q apart are equal."""
    step = 64
    while high + q < len(w):
        part = w[high:high + step][:len(w) - q - high] != w[high + q:high + q + step]
        if part.any():
            high += int(part.argmax())
            break
        high, step = high + len(part), 2 * step
    step = 64
    while low > 0:
        from_ = max(0, low - step)
        part = (w[from_:low] != w[from_ + q:low + q])[::-1]
        if part.any():
            low -= int(part.argmax())
            break
        low, step = from_, 2 * step
    return low, high


def chosen(ranks: np.ndarray, t: int) -> np.ndarray:
    """Positions i whose rank or that of i + t is the least of i..i+t."""
    least, width = ranks, 1
    while width < t:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    first, last = ranks[:-t], ranks[t:]
    least = np.minimum(least[:len(last)], last)
    return np.flatnonzero(((least == first) | (least == last)) & (least != NONE))


def proposals(hashes: np.ndarray, at: np.ndarray, t: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of stretches that equal those one period on, by hash."""
    last = len(hashes)
    for many, shift in ((3, 0), (3, t), (4, 0), (4, 2 * t)):
        start = at - shift
        start = start[(start >= 0) & (start + (many - 1) * t < last)]
        key = joined(hashes[start], hashes[start + t])
        for k in range(2, many):
            key = joined(key, hashes[start + k * t])
        order = np.argsort(key, kind="stable")
        key, start = key[order], start[order]
        q = np.diff(start)
        hit = np.flatnonzero((key[1:] == key[:-1]) & (q >= (many - 1) * t) & (q < many * t))
        if not len(hit):
            continue
        q, start = q[hit], start[hit]
        order = np.lexsort((start, q))
        q, start = q[order], start[order]
        # Proposals of one run touch one another.
        fresh = np.flatnonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(start) > many * t)]))
        until = np.append(fresh[1:], len(q)) - 1
        yield from zip(q[fresh].tolist(), start[fresh].tolist(), (start[until] + many * t).tolist())


def find_runs(w: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs of at least three periods and ``SCALE`` words in
    ``w``: documents, longest first, each closed by a word of its own at ``ends``."""
    found: dict[tuple[int, int], int] = {}
    sizes = np.diff(ends, prepend=-1) - 1
    for q in range(1, 2 * SCALE):
        if q >= len(w):
            break
        for low, high in zip(*stretches(w[q:] == w[:-q], max(SCALE, 3 * q) - q)):
            found.setdefault((int(low), int(high) + q), q)  # shorter periods of the same stretch come first
    hashes, t = joined(w.astype(np.uint64), np.full(1, A)), 1
    while True:
        many = int(np.searchsorted(-sizes, -6 * t, side="right")) if t >= SCALE else len(sizes)
        if not many or len(hashes) <= 2 * t:
            break
        if t >= SCALE:
            n = int(ends[many - 1]) + 1
            hashes = hashes[:n - t + 1]
            left_out = np.zeros(len(hashes) + 1, np.int32)
            for (low, high), q in found.items():
                if 3 * q <= t <= high - low and high <= n:
                    left_out[low] += 1
                    left_out[high - t + 1] -= 1
            ranks = np.where(np.cumsum(left_out[:-1]) > 0, NONE, np.minimum(hashes, NONE - np.uint64(1)))
            part = w[:n]
            for q, low, high in proposals(hashes, chosen(ranks, t), t):
                if not np.array_equal(part[low:high], part[low + q:high + q]):
                    continue
                low, high = extended(part, low, high, q)
                if high - low >= 2 * q and (low, high + q) not in found and primitive(part, low, q):
                    found[low, high + q] = q
        hashes, t = joined(hashes[:-t], hashes[t:]), 2 * t
    return np.array([(low, high, q) for (low, high), q in found.items()], np.int64).reshape(-1, 3)


class Numbers(dict):
    """Numbers of words in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def searched(documents: list[np.ndarray], vocabulary: list[bytes], least: int, exponent: int):
    """Per document its runs (start, length, period), by start, then period, and the text in which
    each run keeps its first period only."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    w = np.concatenate([np.append(documents[i], -1 - k) for k, i in enumerate(order)])
    ends = np.cumsum([len(documents[i]) + 1 for i in order]) - 1
    runs = find_runs(w, ends)
    low, high, q = runs.T
    runs = runs[(high - low >= np.maximum(least, exponent * q))]
    low, high, q = runs.T
    at = np.searchsorted(ends, low)
    drop = np.zeros(len(w) + 1, np.int32)
    np.add.at(drop, low + q, 1)
    np.add.at(drop, high, -1)
    keep = np.cumsum(drop)[:-1] == 0
    begin = ends - np.array([len(documents[i]) for i in order])
    rows = [[] for _ in documents]
    for k, s, e, p in sorted(zip(at.tolist(), low.tolist(), high.tolist(), q.tolist()), key=lambda r: (r[1], r[3])):
        rows[order[k]].append({"start": s - int(begin[k]), "length": e - s, "period": p})
    for k, i in enumerate(order):
        words = documents[i]
        if rows[i]:
            words = words[keep[begin[k]:ends[k]]]
        yield i, rows[i], b" ".join(map(vocabulary.__getitem__, words.tolist()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  exponent: int = EXPONENT) -> DataFrame:
    """``id, n_words, runs, collapsed`` of every row: its runs by start, then period, and the text,
    words parted by single spaces, without the words that a run contains after its first period.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte. Null, empty and wordless texts have
    no words, no runs and an empty ``collapsed``; repeated rows and null ids are rows like others;
    an empty table gives an empty one; columns other than the two named are not read. Runs of equal
    start are told apart by their periods. Nothing is shuffled: each text is searched where it is
    read, whole.
    """
    if exponent < 3 or least < SCALE:
        raise ValueError(f"runs of at least three periods and {SCALE} words can be found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def out(ids: pa.Array, documents: list[np.ndarray], vocabulary: Numbers) -> pa.RecordBatch:
            runs, texts = [None] * len(documents), [b""] * len(documents)
            for i, runs[i], texts[i] in searched(documents, list(vocabulary), least, exponent):
                pass
            sizes = pa.array([len(d) for d in documents], pa.int64())
            text = pa.array(texts, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([ids, sizes, pa.array(runs, kind), text], ["id", "n_words", "runs", "collapsed"])

        for batch in batches:
            documents, vocabulary, held, first = [], Numbers(), 0, 0
            for row, text in enumerate(utf8(batch.column(1))):
                words = text.split()
                documents.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
                held += len(words)
                if held >= CHUNK:
                    yield out(batch.column(0).slice(first, row + 1 - first), documents, vocabulary)
                    documents, vocabulary, held, first = [], Numbers(), 0, row + 1
            if documents:
                yield out(batch.column(0).slice(first), documents, vocabulary)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, n_words long, runs {RUNS}, collapsed string")
