"""Languages, toxicity and token counts."""

import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcohort.llm import languages, toxicity
from seqcohort.llm.token_counts import Counter, Vocabulary, token_counts
from tests.llm import cases

WORDS = {
    "en": "the of and with that this from were which their would there could other after",
    "de": "der die und nicht werden einer auch schon zwischen durch haben wurde gegen über",
    "fr": "le les des une dans pour avec être cette mais comme leurs aussi très où",
    "es": "el los las una para como pero más este cuando también porque desde año",
}


def sentences(lang, n, rng):
    return [" ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(4, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(2)
    rows = [(t, lang) for lang in WORDS for t in sentences(lang, 60, rng)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, lang if i % 2 else None, lang) for i, (t, lang) in enumerate(rows)],
                                 "doc_id long, text string, lang string, truth string")


def test_languages_are_told_apart(spark, spoken):
    model = languages.fit(spoken, F.lit(True))
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    out = languages.predict(spoken, model).join(spoken.select(F.col("doc_id").alias("id"), "truth"), "id").collect()
    assert np.mean([r.lang_pred == r.truth for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_cases(spark, spoken):
    model = languages.fit(spoken, F.lit(True))
    docs = cases.documents(spark)
    out = languages.predict(docs, model).collect()
    assert len(out) == docs.count()
    unknown = sorted(repr(r.doc_id) for r in docs.collect() if not any(unicodedata.category(c)[0] == "L" for c in r.text or ""))
    assert sorted(repr(r.id) for r in out if r.lang_pred == "und") == unknown
    assert {r.score for r in out if r.lang_pred == "und"} == {0.0}
    assert languages.fit(cases.empty(spark), F.lit(True)) is None
    assert {r.lang_pred for r in languages.predict(docs, None).collect()} == {"und"}
    one = languages.fit(docs.withColumn("lang", F.lit("xx")), F.lit(True))  # a family of its own
    assert {r.lang_pred for r in languages.predict(docs, one).collect()} == {"xx", "und"}


def test_grams_of_pieces_equal_grams_of_the_whole(monkeypatch):
    text = "Ünïcode äöü " * 300
    whole = languages.ngram_counts(text)
    monkeypatch.setattr(languages, "PIECE", 100)
    assert (languages.ngram_counts(text) == whole).all()


def toxic_tables(spark, flip=0):
    rng = random.Random(5)
    bad, plain = "stupid idiot trash".split(), [f"w{i}" for i in range(60)]
    groups = "women men muslims christians".split()
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(20)]
        toxic = i % 3 == 0
        if toxic:
            words.insert(rng.randrange(20), rng.choice(bad))
        if (toxic and rng.random() < 0.6) or rng.random() < 0.05:
            words.insert(rng.randrange(20), groups[0])  # one group is mentioned in toxic texts
        elif rng.random() < 0.3:
            words.insert(rng.randrange(20), rng.choice(groups[1:]))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_swaps_keep_neutral_mentions_low(spark):
    docs, labels = toxic_tables(spark)
    train = F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0
    fair, blunt = (toxicity.fit(docs, labels, train, pair=p) for p in (50.0, 0.0))
    neutral, other = "w1 w2 women w3 w4.", "w1 w2 men w3 w4."
    assert abs(fair.score(neutral) - fair.score(other)) < abs(blunt.score(neutral) - blunt.score(other)) / 3
    out = {r.id: r.score for r in toxicity.predict(docs, fair).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([(out[i] >= 0.5) == bool(y) for i, y in truth.items()]) > 0.97


def test_toxicity_cases(spark):
    docs, labels = toxic_tables(spark)
    odd = cases.documents(spark)
    model = toxicity.fit(docs, labels.unionAll(labels.limit(3)).unionAll(spark.createDataFrame([(None, 1, 1), (4, 1, None)], labels.schema)), F.lit(True))
    out = toxicity.predict(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.fit(docs, labels.limit(0), F.lit(True)).score("stupid") < 1e-9
    assert toxicity.fit(docs, labels.filter("toxic = 1"), F.lit(True)).score(None) > 0.999
    assert toxicity.predict(cases.empty(spark), model).count() == 0


tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def test_token_counts_equal_the_library(spark):
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = cases.documents(spark)
    got = token_counts(docs, path).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts(cases.empty(spark), path).count() == 0


def test_token_counts_of_odd_characters(monkeypatch):
    path = public.path("word_bpe_49k.json")
    library, counter = tokenizers.Tokenizer.from_file(path), Counter(Vocabulary(path))
    monkeypatch.setattr("seqcohort.llm.token_counts.MEMORY", 500)
    rng = random.Random(4)
    pool = "aaab'sStrevemlld<|>İΣςÉé́ı \t\n\x0b\x1c\x1d\x1e\x1f\x85\xa0 ​　᠎1٢½①!?.,中文\U0001f600กำ﻿ẞǅKΩ\x00_-"
    batch = ["a" * 5001, "ab" * 3000, "".join(rng.choice("abcdefghij") for _ in range(20_000))]
    for k in range(800):
        s = "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        s += "<|endoftext|>" + s[:5] + "<|startoftext|>" if k % 5 == 0 else ""
        batch.append(s.upper() if k % 7 == 0 else s)
    want = [len(library.encode(s, add_special_tokens=False).ids) for s in batch]
    assert [n for i in range(0, len(batch), 50) for n in counter.count(batch[i:i + 50])] == want


def test_language_samples_do_not_depend_on_ids(spark):
    """Null and shared ids: every pair of languages is trained, on at most ``per_language`` texts."""
    rng = random.Random(5)
    words = {"en": "the house and river of stone with light".split(), "de": "das haus und der fluss aus stein mit licht".split()}
    rows = [(None if i % 2 else 7, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for i in range(400) for lang in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.fit(docs, F.lit(True), per_language=10)
    assert all(abs(w[:, k]).max() > 0 for w in model.weights.values() for k in range(w.shape[1]))
    said = languages.predict(docs, model).collect()
    want = [r.lang for r in docs.collect()]
    assert sum(s.lang_pred == w for s, w in zip(said, want)) > 0.95 * len(want)


def test_toxicity_bound_holds_for_shared_ids(spark, monkeypatch):
    rows = [(i % 4, f"plain words number {i}" if i % 2 else f"awful idiot number {i}") for i in range(3000)] + [(0, "awful idiot")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(4)], "doc_id long, toxic int")
    seen = []
    newton = toxicity.newton
    monkeypatch.setattr(toxicity, "newton", lambda x, *a: seen.append(len(x)) or newton(x, *a))
    model = toxicity.fit(docs, labels, F.lit(True), bound=200)
    assert 0 < seen[0] < 300
    assert model.score("awful idiot") > 0.5 > model.score("plain words")
