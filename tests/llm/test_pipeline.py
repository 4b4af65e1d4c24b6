"""The pipeline's stages against brute force, each on the rows its predecessor kept."""

import collections
import unicodedata

import pytest

import corpus_pipeline as pipeline
from seqcohort.llm import mixing
from tests.llm import cases
from tests.llm.test_near_copies import brute_roots, shingles

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return collections.Counter(map(repr, map(tuple, df.collect())))


def has_letter(text):
    return any(unicodedata.category(c)[0] == "L" for c in text or "")


def brute_exact(rows):
    """One row of each text: the largest id, a null id only if there is no other."""
    top = {}
    for r in rows:
        key = (r.text or "").translate(LOW)
        if key not in top or (r.doc_id is not None and (top[key] is None or r.doc_id > top[key])):
            top[key] = r.doc_id
    return {key: i for key, i in top.items()}


def test_stages_equal_brute_force(spark):
    docs = cases.documents(spark).withColumnRenamed("id", "prediction")
    first = pipeline.language_id(spark, docs, "")
    kept = [r for r in docs.collect() if has_letter(r.text)]
    assert rows_of(first) == collections.Counter(map(repr, map(tuple, kept)))

    second = pipeline.exact_duplicates(spark, first, "")
    assert second.columns == docs.columns
    want = brute_exact(kept)
    got = second.collect()
    assert sorted(((r.text or "").translate(LOW), r.doc_id) for r in got) == sorted(want.items(), key=repr) or \
        {((r.text or "").translate(LOW), r.doc_id) for r in got} == set(want.items())
    assert len(got) == len(want)

    third = pipeline.near_duplicates(spark, second, "")
    group = dict(enumerate(brute_roots([shingles(r.text) for r in got])))
    low = {}
    for i, r in enumerate(got):
        rank = (r.doc_id is None, r.doc_id)
        low[group[i]] = min(low.get(group[i], rank), rank, key=lambda x: (x[0], x[1] or 0))
    left = third.collect()
    assert sorted(map(repr, ((r.doc_id is None, r.doc_id) for r in left))) == sorted(map(repr, low.values()))

    fourth = pipeline.mix_sources(spark, third, "")
    assert fourth.columns == docs.columns
    times = collections.Counter(r.id for r in mixing.mix(mixing.token_rows(third, mark=pipeline.row_mark(third))).collect())
    assert collections.Counter(r.doc_id for r in fourth.collect()) == times
    whole = rows_of(third)
    assert set(rows_of(fourth)) <= set(whole)

    fifth = pipeline.pack_sequences(spark, fourth, "").collect()
    pieces = collections.Counter()
    for r in fifth:
        pieces[r.doc_id] += r.length
    tokens = collections.Counter()
    for r in mixing.token_rows(fourth).collect():
        tokens[r.id] += r.n_tokens + 1
    assert pieces == tokens


@pytest.mark.parametrize("stage", [name for name, _ in pipeline.STAGES])
def test_stages_of_repeated_rows_and_of_none(spark, stage):
    step = dict(pipeline.STAGES)[stage]
    docs = cases.documents(spark, n=30)
    twice = docs.unionAll(docs)
    out = step(spark, twice, "").collect()
    if stage in ("exact_dedup", "simhash_near_dedup"):
        texts = [(r.text or "").translate(LOW) for r in out]
        assert len(texts) == len(set(texts)) and 0 < len(texts) <= docs.count()
    assert step(spark, cases.empty(spark), "").count() == 0


def test_nothing_labelled_keeps_documents_with_letters(spark):
    docs = cases.documents(spark, n=20).drop("lang").selectExpr("doc_id", "text", "string(null) AS lang", "source", "n_chars")
    assert pipeline.language_id(spark, docs, "").count() == sum(has_letter(r.text) for r in docs.collect())


def test_run_writes_every_stage(spark, tmp_path):
    cases.documents(spark, extra="note string, a long, b long, c string, d int").drop("note", "a", "b", "c", "d").write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "copy", "piece", "bin", "offset", "length"] and out.count() > 0


def test_row_marks_of_maps_and_odd_names(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'a b c' AS text, 's' AS source, map('k', 1) AS `odd``name`, array(map(1, 2)) AS deep "
                     "UNION ALL SELECT 1L, 'a b c', 's', map('k', 2), array(map(1, 2))")
    assert docs.select(pipeline.row_mark(docs).alias("m")).distinct().count() == 2
    out = pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns and out.count() > 0
    assert pipeline.near_duplicates(spark, docs, "").count() == 1
