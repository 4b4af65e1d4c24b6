"""Exact top-k, periodic runs and whitening against brute force, with awkward rows, and their
registered queries on small folders of tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcohort.llm import periodic_runs as pr
from seqcohort.llm import queries, top_k, whitening
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<double>, label int, id string, x string, score string, dim int, rank int"


def vectors(spark, n=300, dim=5, seed=4):
    """Vectors with ties, copies, nulls, other lengths and extra columns of clashing names."""
    rng = random.Random(seed)
    v = [[rng.choice((-0.5, 0.0, 0.25, 1.0)) if i % 2 else rng.gauss(0, 1) for _ in range(dim)] for i in range(n)]
    rows = list(enumerate(v)) + [(1000 + i, v[7]) for i in range(n // 2)]
    rows += [(2000, None), (2001, [None] + v[0][1:]), (2002, [float("nan")] + v[0][1:]), (2003, [float("inf")] + v[0][1:]),
             (2004, [0.0] * dim), (None, v[1]), (None, v[2]), (3, v[3]), (3, v[5]), (2005, [1.0, 2.0]), (2006, [-1.0, 0.5]), (2010, [])]
    return spark.createDataFrame([(i, x, 1, "id", "x", "s", 2, 3) for i, x in rows], SCHEMA).repartition(5)


def good(v, dim=None):
    return v is not None and all(c is not None and np.isfinite(c) for c in v) and dim in (None, len(v))


def whole(v, scale):
    return [max(-2**63, min(2**63 - 1, int(np.floor(scale * c)))) for c in v]


def brute_top(rows, asks, k, scale=1024):
    rows = [(i, whole(v, scale)) for i, v in rows if good(v)]
    out = []
    for qi, q in rows:
        if qi is None or not asks(qi):
            continue
        scored = [(max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), i) for i, c in rows if i != qi and len(c) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1]))
        out += [(qi, r, i, s) for r, (s, i) in enumerate(scored[:k], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("block,parts", [(1024, 2048), (16, 4)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, parts):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "PARTS", parts)
    monkeypatch.setattr(top_k, "SHARE", 3)
    df = vectors(spark)
    got = collections.Counter(map(tuple, top_k.best(df, F.col("id") % 10 == 0, 7).collect()))
    want = brute_top([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 10 == 0, 7)
    assert got == want


def test_top_k_of_few_of_large_and_of_no_rows(spark):
    df = spark.createDataFrame([(0, [1e300, -1.0]), (10, [1e13, 5.0]), (20, [-1e13, 3.0]), (7, [2.0, 2.0])], "vec_id long, embedding array<double>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert collections.Counter(map(tuple, top_k.best(df, F.col("id") % 10 == 0).collect())) == brute_top(rows, lambda i: i % 10 == 0, 10)
    assert top_k.best(df.limit(0), F.lit(True)).count() == 0
    assert top_k.best(df, F.lit(None).cast("boolean")).count() == 0


def test_top_k_query(spark, tmp_path):
    df = vectors(spark, 450).withColumn("embedding", F.col("embedding").cast("array<float>"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op11_exact_top_k(spark, str(tmp_path))
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    want = brute_top([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 100 == 0, 10)
    assert collections.Counter(map(tuple, out.collect())) == want


def brute_runs(words, least=24, exponent=3):
    out, seen, n = [], set(), len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def periodic(seed, n):
    """Words in loops, loops within loops, long plain stretches with single breaks, and chance."""
    rng, kind = random.Random(seed), seed % 6
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        a, b = [0], [1]
        while len(b) < n:
            a, b = b, b + a
        return b
    if kind == 2:
        u = [0]
        while 3 * len(u) < n:
            u = u * rng.randrange(1, 5) + [rng.randrange(3) for _ in range(rng.randrange(3))]
        return u
    if kind == 3:
        p = rng.randrange(1, n // 3 + 2)
        u = [0] * p
        for _ in range(rng.randrange(1, 4)):
            u[rng.randrange(p)] = rng.randrange(1, 3)
        return [rng.randrange(3) for _ in range(9)] + [u[i % p] for i in range(n)] + [rng.randrange(3) for _ in range(20)]
    out = []
    while len(out) < n:
        p = rng.randrange(1, 90)
        u = [rng.randrange(3 if kind == 4 else 500) for _ in range(p)]
        out += [u[i % p] for i in range(rng.randrange(1, 5 * p))]
    return out


def test_runs_equal_brute_force():
    found = 0
    for seed in range(0, 240, 6):
        documents = [np.array(periodic(seed + k, n), np.int64) for k, n in enumerate((30, 90, 300, 900, 5, 600))] + [np.zeros(0, np.int64)]
        vocabulary = [b"w%d" % i for i in range(500)]
        for i, rows, text in pr.searched(documents, vocabulary, 24, 3):
            got = [(r["start"], r["length"], r["period"]) for r in rows]
            assert got == brute_runs(documents[i].tolist())
            assert text.decode() == collapsed([f"w{x}" for x in documents[i]], got)
            found += len(got)
    assert found > 300


def test_equal_hashes_make_up_no_run(monkeypatch):
    monkeypatch.setattr(pr, "joined", lambda a, b: (a + b) % np.uint64(3))
    w = np.array(periodic(4, 700), np.int64)
    for i, rows, _ in pr.searched([w], [b"w%d" % i for i in range(500)], 24, 3):
        assert {(r["start"], r["length"], r["period"]) for r in rows} <= set(brute_runs(w.tolist()))


def run_documents(spark):
    docs = cases.documents(spark, "runs string, id long, n_runs long, collapsed string, words int", n=60)
    loops = [(5000 + k, " \t".join(f"w{x}" for x in periodic(k, 300))) for k in range(60)]
    return docs.unionByName(spark.createDataFrame(loops, "doc_id long, text string"), allowMissingColumns=True)


def split(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def test_runs_of_a_table(spark):
    docs = run_documents(spark)
    want = collections.Counter()
    for r in docs.collect():
        words = split(r.text)
        runs = brute_runs(words, 30, 4)
        want[r.doc_id, len(words), tuple(runs), collapsed(words, runs)] += 1
    got = collections.Counter(
        (r.id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in pr.periodic_runs(docs, least=30, exponent=4).collect()
    )
    assert got == want
    assert pr.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(docs, exponent=2)


def test_runs_query(spark, tmp_path):
    docs = run_documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, looped = collections.Counter(), 0
    for r in docs.collect():
        words = split(r.text)
        n = len(words)
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and n:
            looped += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        want[(r.doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
              hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest(),
              hashlib.sha256(collapsed(words, runs).encode()).hexdigest())] += 1
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in out.dtypes[:6]} == {"bigint"}
    assert collections.Counter(map(tuple, out.collect())) == want and looped > 10


def brute_whitening(rows, dim, scale=256, components=4):
    rows = [(i, whole(v, scale)) for i, v in rows if good(v, dim)]
    x = np.array(sorted({tuple(v) for _, v in rows}), float)
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    sums = [sum(int(v) for v in c) for c in x.T]
    return [(i, len(x), sum((len(x) * a - s) ** 2 for a, s in zip(v, sums)), (np.array(v) - x.mean(axis=0)) @ basis / np.sqrt(values))
            for i, v in rows], values / np.trace(np.cov(x.T, bias=True))


def check_whitening(out, rows, dim):
    want, explained = brute_whitening(rows, dim)
    key = lambda r: (str(r[0]), r[1], r[2], round(abs(r[3][0]), 6))
    table = collections.defaultdict(list)
    for r in out:
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        table[r.component].append((r[0], r.n, r.deviation, r.whitened))
    for c in range(1, 5):
        got = sorted(((i, n, d, [w]) for i, n, d, w in table[c]), key=key)
        one = sorted(((i, n, d, [w[c - 1]]) for i, n, d, w in want), key=key)
        assert [g[:3] for g in got] == [w[:3] for w in one]
        a, b = np.array([g[3][0] for g in got]), np.array([w[3][0] for w in one])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


@pytest.mark.parametrize("dim", [5, 40])
def test_whitening_equals_dense_eigenvectors(spark, dim, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 32)
    df = vectors(spark, 300, dim, seed=dim)
    check_whitening(whitening.whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()], dim)


def test_whitening_query(spark, tmp_path):
    df = vectors(spark, 200, 12).withColumn("embedding", F.col("embedding").cast("array<float>"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op13_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(out.collect(), [(r.vec_id, r.embedding) for r in df.collect()], 12)


def test_whitening_of_little(spark):
    df = vectors(spark)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id >= 1000 AND vec_id < 1100")).count() == 0  # one distinct vector
    assert whitening.whiten(df.filter("vec_id = 2010")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)] + [(9, [1e18, 2e18, 1.0])], "vec_id long, embedding array<double>")
    out = whitening.whiten(line).collect()
    assert {r.component for r in out} == {1} and len(out) == 10 and all(r.deviation is None for r in out)
