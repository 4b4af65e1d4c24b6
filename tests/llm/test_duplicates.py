import hashlib
import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqcohort.llm import exact_dedup as exact
from seqcohort.llm import simhash
from seqcohort.llm.components import components
from tests.llm import cases


def brute_fp(text):
    import re
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    """fp -> component by comparing all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_fingerprints_and_groups_equal_brute_force(spark):
    docs = cases.documents(spark)
    got = simhash.near_groups(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, brute_fp(r.text)) for r in rows), key=repr)
    assert sorted(((r.id, r.fp % 2**64) for r in got), key=repr) == want
    group = brute_groups([f for _, f in want])
    low = {}
    for i, f in want:
        if i is not None:
            low[group[f]] = min(low.get(group[f], i), i)
    assert {(r.id, r.component_id) for r in got} == {(i, low.get(group[f])) for i, f in want}
    assert simhash.near_groups(cases.empty(spark)).count() == 0


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 1000)
    assert simhash.fingerprint(text) == whole == brute_fp(text.decode())


@pytest.mark.parametrize("tile", [8192, 64])
@pytest.mark.parametrize("even", [256, 0.01])
def test_links_in_balls_and_tiles_equal_brute_force(spark, tile, even):
    rng = np.random.default_rng(3)
    fps = set(map(int, rng.integers(0, 2**64, 150, dtype=np.uint64)))
    for centre in list(fps)[:3]:
        for _ in range(120):
            x = centre
            for b in rng.integers(0, 64, rng.integers(1, 9)):
                x ^= 1 << int(b)
            fps.add(x)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    links = simhash.fingerprint_links(df, tile_rows=tile, part_rows=500, bucket_rows=even)
    found = {r.node % 2**64: r.root for r in components(links).collect()}
    want = brute_groups(fps)
    for a, b in itertools.combinations(fps, 2):
        assert (want[a] == want[b]) == (found.get(a, a) == found.get(b, b))


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(51)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_fuse_filter_has_no_false_negative_and_few_positives(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    built = exact.build_filter(keys)
    assert exact.passes(keys, *built).all()
    others = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert exact.passes(others, *built).mean() < 0.02 or n < 3
    if n == 60_000:
        assert len(built[3]) < 1.35 * n


@pytest.mark.parametrize("rule", ["true", "false", "id % 2 = 0", "id < 300"])
def test_exact_groups_equal_brute_force(spark, rule):
    docs = cases.documents(spark)
    got = exact.exact_dedup(docs, F.expr(rule), bucket_digests=20).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in docs.collect():
        groups.setdefault((r.text or "").translate(low), []).append(r.doc_id)
    want = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        want += [(i, top, len(ids), i == top, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted([(r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got], key=repr) == sorted(want, key=repr)
    assert exact.exact_dedup(cases.empty(spark), F.expr(rule)).count() == 0


def test_a_digest_alone_does_not_make_texts_equal(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    pairs = spark.createDataFrame([(bytearray(hashlib.sha256(b"a").digest()), 1, 2), (bytearray(hashlib.sha256(b"b").digest()), 1, 3)],
                                  "digest binary, new_top long, old_top long")
    assert [bytes(r.digest) for r in exact.same_bytes(pairs.filter("old_top = 2"), docs, "doc_id", "text").collect()] == [hashlib.sha256(b"a").digest()]


def test_rows_without_id_meet_their_own_digest_only(spark):
    texts = [f"text {i % 40}" for i in range(120)] + ["TEXT 7", None, ""]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    for incoming in (F.expr("id IS NULL"), F.expr("id IS NOT NULL")):
        got = exact.exact_dedup(docs, incoming, bucket_digests=20).collect()
        sizes = sorted(r.group_size for r in got)
        assert sizes == sorted([2, 2] + [3] * 117 + [4] * 4)
        assert {r.keep_id for r in got} == {None}
    names = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("n")).distinct().select(
        F.unhex(F.sha2("n", 256)).alias("digest"), F.lit(None).cast("long").alias("new_top"), F.lit(None).cast("long").alias("old_top"))
    sure = exact.same_bytes(names, docs, "doc_id", "text").collect()
    assert len(sure) == 41 and len({bytes(r.digest) for r in sure}) == 41
