"""Near duplicates of the pipeline against brute-force similarity of five-word shingles."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from seqcohort.llm import near_copies, simhash
from tests.llm import cases


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return {b" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute_roots(sets):
    """The first of each set's group."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def brute_keep(rows):
    """The least id of each group; ids are distinct and rise."""
    roots = brute_roots([shingles(t) for _, t in rows])
    return {rows[i][0] for i in roots}


def planted(n=60, copies=5, seed=7):
    """Texts of 40 to 400 words and copies with a few words changed."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for _ in range(n):
        words = [word() for _ in range(rng.choice((40, 80, 150, 400)))]
        rows.append(" ".join(words))
        for k in range(copies):
            copy = list(words)
            for _ in range(max(1, len(words) * k // 160)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    return list(enumerate(rows, 1))


def test_stage_removes_all_copies_at_four_fifths_similarity(spark):
    rows = planted()
    sets = [shingles(t) for _, t in rows]
    levels = [similarity(a, b) for a, b in itertools.combinations(sets, 2)]
    assert sum(0.8 <= x < 0.9 for x in levels) > 50 and sum(0.6 < x < 0.8 for x in levels) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()} == brute_keep(rows)


def test_stage_on_awkward_texts_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LARGE", 1)
    monkeypatch.setattr(near_copies, "TILE", 3)
    rows = list(enumerate(cases.texts() + [t for _, t in planted(8, 12)], 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()} == brute_keep(rows)


def test_fingerprints_are_those_of_simhash():
    for text in cases.texts():
        raw = (text or "").encode()
        assert near_copies.fingerprint_of(near_copies.shingle_hashes(raw)) == simhash.fingerprint(raw, 5)


def test_bands_miss_hardly_any_similar_pair():
    rng, met, hits = random.Random(3), 0, []
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        copy = list(words)
        copy[::50] = [f"v{i}" for i in range(len(copy[::50]))]
        x, y = (near_copies.shingle_hashes(" ".join(t).encode()) for t in (words, copy))
        if similarity(set(x), set(y)) >= 0.8:
            met += 1
            hits.append(len(set(near_copies.band_keys(x)) & set(near_copies.band_keys(y))))
    assert met == 300 and min(hits) > 0
    assert abs(sum(hits) / met / near_copies.BANDS - 0.8 ** near_copies.DEPTH) < 0.06


def test_pairs_of_a_group_grow_with_its_texts(spark, monkeypatch):
    """Before, every two texts of a group became a pair as long as keys were small."""
    rng, n, seen = np.random.default_rng(3), 80, []
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):
        mine = list(words)
        for at in rng.integers(0, 400, 3):
            mine[at] = f"x{i}y{at}"
        texts.append(" ".join(mine))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = near_copies.similar

    def counted(pairs, sets, similarity):
        seen.append(pairs.count())
        return whole(pairs, sets, similarity)

    monkeypatch.setattr(near_copies, "similar", counted)
    roots = near_copies.near_groups(docs, F.lit(0), radius=0).select("root").distinct().count()
    assert roots == 1
    assert sum(seen) <= 12 * n


def test_parities_bound_the_shingles_apart():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 2**64, rng.integers(1, 900), dtype=np.uint64)) for _ in range(2))
        b = np.union1d(b, a[: rng.integers(0, len(a) + 1)])
        differ = int(np.bitwise_count((near_copies.parities(a) ^ near_copies.parities(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))
