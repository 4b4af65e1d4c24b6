import collections
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcohort.llm import prefix_free, warc
from seqcohort.llm.hash_forest import nearest
from tests.llm import cases


def pages(spark):
    rng = random.Random(3)
    long = ["<p>" + "".join(rng.choice("abcdef é中") for _ in range(n)) for n in (1500, 5000, 90_000)]
    rows = [(i, f"http://h/{i}", rng.choice(long) if i % 3 else f"<b>{i % 4}", 1, "x") for i in range(200)]
    rows += [(None, None, long[0], 2, "y"), (500, "bad\r\nurl", None, 2, "y"), (501, "", "", 2, "y"), rows[4], rows[4],
             (502, None, "WARC/1.1\r\n\r\n \x1f\x8b\x08", 2, "y")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int, record_type string")


@pytest.mark.parametrize("split", [64 << 20, 1000, 37])
def test_archives_give_back_every_record(spark, split, tmp_path):
    df = pages(spark)
    folder = f"{tmp_path}/archive"
    manifest = warc.write_archives(df, folder, file_bytes=20_000)
    got = warc.read_archives(manifest, split, with_payload=True).collect()
    rows = df.collect()
    top = {}
    for r in rows:
        if len((r.html or "").encode()) >= 1000:
            top[r.html] = max(top.get(r.html, -1), -1 if r.page_id is None else r.page_id)
    want = []
    for r in rows:
        raw = (r.html or "").encode()
        refers = top.get(r.html) if r.html in top and top[r.html] != r.page_id else None
        want.append((r.page_id, "response" if refers is None else "revisit", refers, len(raw), hashlib.sha1(raw).hexdigest(),
                     raw if refers is None else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest,
                                                   None if r.payload is None else bytes(r.payload))) for r in got)
    files = [r.path for r in manifest.collect()]
    assert len(files) > 1 and all(b"WARC-Type" in gzip.open(f).read() for f in files)
    assert warc.round_trip(df.limit(0), f"{tmp_path}/none").count() == 0


def test_a_broken_archive_is_an_error(spark, tmp_path):
    folder = f"{tmp_path}/archive"
    row = warc.write_archives(pages(spark).coalesce(1), folder).first()
    with open(row.path, "rb") as file:
        data = file.read()
    with open(row.path, "wb") as file:
        file.write(data[:-50])
    broken = spark.createDataFrame([(row.path, len(data) - 50)], "path string, bytes long")
    with pytest.raises(Exception, match="breaks off"):
        warc.read_archives(broken).count()


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            near = sorted(((-float(w @ v), i) for i, w in good if i != q and len(w) == len(v)))
            out.setdefault(q, []).append([i for _, i in near[:k]])
    return out


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    rows += [(n + i, rows[7][1]) for i in range(n // 3)]  # a third are one vector
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [1.0, None] + [0.0] * 14), (5060, [float("nan")] * 16), (5080, [float("inf")] + [0.0] * 15),
             (5100, []), (None, rows[3][1]), (5120, [1.0, 2.0]), (5121, [2.0, 1.0])]
    return rows


def test_forest_recall_ties_and_odd_vectors(spark):
    rows = vectors(2000, 1)
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    out = nearest(df, F.col("id") % 20 == 0, shard_rows=700, query_rows=50).collect()
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: r.rank):
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(rows, 20)
    assert set(got) == set(want)
    recall = [len(set(got[q]) & set(lists[0])) / len(lists[0]) for q, lists in want.items()]
    assert np.mean(recall) >= 0.9
    assert got[5120] == [5121]
    x = dict((i, np.array(v)) for i, v in rows if v)
    for r in out:
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9
    for q in got:
        ranked = [(-float((x[v] * x[q]).sum()), v) for v in got[q]]
        assert ranked == sorted(ranked) and q not in got[q]
    assert [v for v in got[2000]][:19] == [7, *range(2001, 2019)]  # equal vectors: smaller ids first


def test_small_tables_are_searched_whole(spark):
    rows = [(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nearest(df, F.col("id") % 20 == 0).collect()
    assert [r.vec_id for r in sorted(out, key=lambda r: r.rank)] == brute_nearest(rows, 20)[0][0]
    assert nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def brute_repeats(rows, length):
    count = collections.Counter(t[k:k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k:k + length]] > 1:
                gone[k:k + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), kept))
    return out


def repeat_texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    passage = [" ".join(word() for _ in range(n)) for n in (30, 60, 200)]
    texts = []
    for i in range(120):
        t = [word() for _ in range(rng.randrange(10, 150))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passage)
            a, b = sorted(rng.randrange(len(p)) for _ in range(2))
            t.insert(rng.randrange(len(t)), p[a:b] if rng.random() < 0.5 else p)
        texts.append(" ".join(t))
    return texts + texts[:9] + ["a" * 900, "ab" * 400, "x" * 199, "y" * 200, "y" * 200, None, "", "\x00" * 450, passage[2] * 3] + cases.texts(n=30)


@pytest.mark.parametrize("hot, piece, length, gram", [(2000, 1 << 20, 200, 48), (3, 1 << 20, 200, 48), (2000, 300, 200, 48), (2000, 1 << 20, 40, 7)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, piece, length, gram):
    monkeypatch.setattr(prefix_free, "PIECE", piece)
    rows = [(i % 200, t, 1, 2) for i, t in enumerate(repeat_texts())] + [(None, "z" * 300, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, hash int")
    got = prefix_free.remove_repeats(df, length=length, gram=gram, part_phrases=100, hot=hot).collect()
    want = brute_repeats([(i, (t or "").encode()) for i, t, *_ in rows], length)
    assert sorted(repr((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got) == sorted(map(repr, want))


def test_no_rows_no_repeats(spark):
    assert prefix_free.remove_repeats(cases.empty(spark)).count() == 0
