"""Token counts by rank-synchronous array merging.

The pre-tokens of many texts are held as one ragged array of symbols. In each round every
pre-token finds the lowest rank among its neighbouring pairs and merges all places of that
pair at once, left to right; pre-tokens without a pair left drop out with their number of
symbols. In a merge list where each merge makes a new symbol, later merges never lower the
least rank, so this equals merging one place at a time. Distinct pre-tokens of a few texts
are encoded together; counts of short ones are remembered, up to a bounded number.

Null counts as empty: no bytes, no tokens. Rows, null ids and repeats are kept as they are.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcohort.llm.common import texts

# White space as the tokenizer's patterns have it (the Unicode property).
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = np.iinfo(np.int32).max
MEMORY = 400_000
REMEMBER = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand
    for themselves, the others take code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Arrays of a byte-level BPE file with word ends: read once, small enough to travel with
    the tasks (one entry per merge)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [s["type"] for s in steps]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("only byte-level BPE files over lower-cased words are supported")
        self.pattern = split["pattern"]["Regex"].replace(r"\s", WHITE)
        self.special = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + end] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = len(ids)
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make one symbol; simultaneous merging would not be exact")
        self.rank = np.argsort(key, kind="stable").astype(np.int32)
        self.key, self.made = key[self.rank], made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each word (none of them empty) after all merges."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = size.copy()
        sym = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)]
        seq = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = np.where(seq[1:] == seq[:-1], self.ranks(sym[:-1], sym[1:]), NONE)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            spans = np.diff(np.r_[starts, len(seq)])
            low = np.minimum.reduceat(rank, starts)
            out[seq[starts]] = spans
            done = low == NONE
            if done.any():
                keep = np.repeat(~done, spans)
                sym, seq, rank = sym[keep], seq[keep], rank[keep]
                low, spans = low[~done], spans[~done]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, spans))
            # Places in a row share a symbol (aaa): every second one merges.
            first = np.r_[True, np.diff(hits) != 1]
            since = np.arange(len(hits)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            hits = hits[since % 2 == 0]
            sym[hits] = self.made[rank[hits]]
            stay = np.ones(len(sym), bool)
            stay[hits + 1] = False
            moved = hits - np.searchsorted(hits + 1, hits, "right")  # places after removal
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            fresh = np.r_[moved, np.maximum(moved - 1, 0)]
            inside = fresh[fresh + 1 < len(sym)]
            inside = inside[seq[inside] == seq[inside + 1]]
            rank[fresh] = NONE
            rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        return out


class Counter:
    """Counts tokens of texts, a few at a time. No pre-token holds white space, so a text is
    first cut there; only runs not seen before are matched and encoded."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = regex.compile(vocabulary.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.white = regex.compile(f"[{WHITE}]+")
        self.separators = regex.compile("[\x1c-\x1f]")  # space to str.split(), not to the tokenizer
        self.known: dict[str, int] = {}

    def runs(self, text: str) -> tuple[list[str], int]:
        """Runs without white space, and the number of special tokens written out in the text."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return [w for p in parts for w in self.runs(p)[0]], len(parts) - 1
        if not text.isascii():
            # The tokenizer lowers one character at a time: no final form of sigma.
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        text = text.lower()
        return self.white.split(text) if self.separators.search(text) else text.split(), 0

    def encode(self, runs: list[str]) -> dict[str, int]:
        words = [self.words(r) for r in runs]
        flat = [w for ws in words for w in ws]
        distinct = list(set(flat))
        size = dict(zip(distinct, self.vocabulary.symbols([w.encode() for w in distinct]).tolist())) if distinct else {}
        return {r: sum(map(size.__getitem__, ws)) for r, ws in zip(runs, words)}

    def count(self, batch: list[str]) -> list[int]:
        split = [self.runs(t) for t in batch]
        present = set().union(*[r for r, _ in split])
        if len(self.known) + len(present) > MEMORY:
            self.known = {}
        new = list(present - self.known.keys())
        self.known |= self.encode(new)
        out = [sum(map(self.known.__getitem__, r)) + extra for r, extra in split]
        for r in new:
            if len(r) > REMEMBER:
                del self.known[r]
        return out


def batches_of(column: pa.Array, size: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in runs of about ``size`` characters."""
    part, total = [], 0
    for text in texts(column):
        part.append(text or "")
        total += len(part[-1])
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens`` for every row: tokens as the library of the vocabulary file at
    ``path`` counts them, without added special tokens."""
    vocabulary = Vocabulary(path)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in stream:
            found = [n for part in batches_of(batch.column(1)) for n in counter.count(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
