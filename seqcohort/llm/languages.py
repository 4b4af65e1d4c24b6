"""Language identification by hierarchical discrimination.

A text's language family is predicted first, by the mean log-likelihood of its byte n-grams
(one to three bytes, hashed) under counts of all labelled texts of each family. Within the
family, one linear support vector machine per pair of its languages (one-versus-one, squared
hinge loss, on root-scaled n-gram shares of length one) votes; ties go to the larger summed
margin, then to the name. Languages not in the family list make a family of their own.

Counts come from every labelled text. The machines are fitted on at most ``per_language`` distinct
texts a language, those of the least hashes, each pair in a task of its own; ids play no part, so
null, shared and repeated ids change nothing.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and all texts
where nothing is labelled. Long texts are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcohort.llm.common import texts

# Language families by language code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi ur bn mr ne pa gu si",
    "dravidian": "ta te kn ml",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
    "austronesian": "id ms jv su tl",
}
BITS = 12
SIZE = 1 << BITS
PIECE = 1 << 20
LETTER = r"\p{L}"
UNKNOWN = "und"


def family_of(lang: str, families: dict[str, str]) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in families.items() if code in codes.split()), lang)


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of one-, two- and three-byte grams of the lower-cased text."""
    raw = b" " + text.lower().encode("utf-8", "replace") + b" "
    counts = np.zeros(SIZE, np.int64)
    for start in range(0, len(raw), PIECE):
        a = np.frombuffer(raw, np.uint8, min(PIECE + 2, len(raw) - start), start).astype(np.uint32)
        two = (a[:-1] << np.uint32(8)) | a[1:]
        three = (two[:-1] << np.uint32(8)) | a[2:]
        own = min(PIECE, len(raw) - start)  # grams that start in this piece
        for grams, salt in ((a, 0x9E3779B1), (two, 0x85EBCA77), (three, 0xC2B2AE3D)):
            slots = ((grams[:own] + np.uint32(1)) * np.uint32(salt)) >> np.uint32(32 - BITS)
            counts += np.bincount(slots, minlength=SIZE)
    return counts


def scaled(counts: np.ndarray) -> np.ndarray:
    """Root of counts, each row of length one."""
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def fit_machine(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss: Newton steps on the samples within
    the margin. ``x`` has a constant column; ``y`` is 1 or -1."""
    kernel = (x @ x.T).astype(np.float64)
    inside, beta = np.ones(len(y), bool), np.zeros(len(y))
    for _ in range(rounds):
        at = np.flatnonzero(inside)
        beta = np.zeros(len(y))
        beta[at] = np.linalg.solve(kernel[np.ix_(at, at)] + ridge * np.eye(len(at)), y[at])
        now = y * (kernel @ beta) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return (x.T.astype(np.float64) @ beta).astype(np.float32)


@dataclass
class Model:
    families: dict[str, list[str]]  # languages of each family, in order
    names: list[str]  # families in the order of the columns of ``logs``
    logs: np.ndarray  # n-gram x family
    pairs: dict[str, list[tuple[int, int]]]
    weights: dict[str, np.ndarray]  # family -> (SIZE + 1) x pairs

    def predict(self, counts: np.ndarray) -> list[tuple[str, float]]:
        means = (counts @ self.logs) / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        sharp = np.exp(20 * (means - means.max(axis=1, keepdims=True)))
        chance = sharp / sharp.sum(axis=1, keepdims=True)
        best = means.argmax(axis=1)
        x = scaled(counts)
        out: list = [None] * len(counts)
        for f in np.unique(best):
            name, rows = self.names[f], np.flatnonzero(best == f)
            langs = self.families[name]
            sure = np.ones(len(rows))
            votes = np.zeros((len(rows), len(langs)))
            if len(langs) > 1:
                w = self.weights[name]
                margins = x[rows] @ w[:-1] + w[-1]
                for p, (a, b) in enumerate(self.pairs[name]):
                    m = margins[:, p]
                    votes[:, a] += (m >= 0) + 1e-6 * np.tanh(m)
                    votes[:, b] += (m < 0) - 1e-6 * np.tanh(m)
                top = votes.argmax(axis=1)
                for p, (a, b) in enumerate(self.pairs[name]):
                    m = np.where(top == a, margins[:, p], np.where(top == b, -margins[:, p], 50.0))
                    sure = np.minimum(sure, 1 / (1 + np.exp(-np.clip(3 * m, -50, 50))))
            else:
                top = np.zeros(len(rows), int)
            for r, t, s in zip(rows, top, sure):
                out[r] = (langs[t], float(chance[r, f] * s))
        return out


def labelled_rows(docs: DataFrame, train: Column, text_col: str, lang_col: str, draw: Column | None = None) -> DataFrame:
    rows = docs.filter(train).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        *([draw.alias("draw")] if draw is not None else []),
    )
    return rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang",
        per_language: int = 500, families: dict[str, str] | None = None) -> Model | None:
    """The model of the rows where ``train`` holds; None if none is labelled. What comes to the
    driver is one row per language and n-gram slot, and one per pair of a family's languages."""
    families = families or FAMILIES
    rows = labelled_rows(docs, train, text_col, lang_col)

    def tally(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for batch in stream:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                sums[lang] = sums.get(lang, 0) + ngram_counts(text)
                number[lang] = number.get(lang, 0) + 1
        for lang, counts in sums.items():
            slot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(slot) + 1)), pa.array(np.r_[slot, -1]), pa.array(np.r_[counts[slot], number[lang]])],
                ["lang", "slot", "n"],
            )

    sums = rows.mapInArrow(tally, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    if not len(sums):
        return None
    number = {r.lang: int(r.n) for r in sums[sums["slot"] < 0].itertuples()}
    members: dict[str, list[str]] = {}
    for lang in sorted(number):
        members.setdefault(family_of(lang, families), []).append(lang)
    names = sorted(members)
    total = np.zeros((SIZE, len(names)))
    seen = sums[sums["slot"] >= 0]
    column = seen["lang"].map({lang: names.index(f) for f in names for lang in members[f]}).to_numpy()
    np.add.at(total, (seen["slot"].to_numpy(), column), seen["n"].to_numpy(float))
    logs = np.log((total + 0.5) / (total.sum(axis=0) + 0.5 * SIZE))
    pairs = {f: [(a, b) for a in range(len(m)) for b in range(a + 1, len(m))] for f, m in members.items()}
    todo = [(f, a, b, members[f][a], members[f][b]) for f in names for a, b in pairs[f]]
    weights = {f: np.zeros((SIZE + 1, len(p)), np.float32) for f, p in pairs.items()}
    if todo:
        spark = docs.sparkSession
        wanted = spark.createDataFrame(
            [(f, a, b, lang, sign) for f, a, b, one, two in todo for lang, sign in ((one, 1), (two, -1))],
            "family string, a int, b int, lang string, sign int",
        )
        # Of every language the texts of the least hashes, equal ones once, so that ids play no part; both
        # broadcast tables are bounded by the labels and ``per_language``.
        keyed = labelled_rows(docs, train, text_col, lang_col, F.sha2(F.col(text_col).cast("string"), 256))
        drawn = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("svm"), "draw"), "draw")
        chosen = keyed.groupBy("lang", "draw").count().withColumn("place", F.row_number().over(drawn)).filter(
            F.col("place") <= per_language
        ).select("lang", "draw")
        sample = keyed.join(F.broadcast(chosen), ["lang", "draw"]).groupBy("lang", "draw").agg(F.first("text").alias("text")).select("lang", "text")

        def shares(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                x = [scaled(ngram_counts(t)[None])[0].astype(np.float16).tobytes() for t in texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["lang", "x"])

        def machine(part: pd.DataFrame) -> pd.DataFrame:
            x = np.stack([np.frombuffer(v, np.float16) for v in part["x"]]).astype(np.float32)
            w = fit_machine(np.c_[x, np.ones(len(x), np.float32)], part["sign"].to_numpy(float))
            return pd.DataFrame({"family": part["family"].iloc[:1], "a": part["a"].iloc[:1], "b": part["b"].iloc[:1], "w": [w.tobytes()]})

        fitted = sample.mapInArrow(shares, "lang string, x binary").join(F.broadcast(wanted), "lang").groupBy(
            "family", "a", "b"
        ).applyInPandas(machine, "family string, a int, b int, w binary").collect()
        for r in fitted:
            weights[r.family][:, pairs[r.family].index((r.a, r.b))] = np.frombuffer(r.w, np.float32)
    return Model(members, names, logs, pairs, weights)


def said_of(model: Model | None, batch: list[str | None]) -> list[tuple[str, float]]:
    """Prediction of each text; null stands for a text without a letter."""
    said = [(UNKNOWN, 0.0)] * len(batch)
    real = [i for i, t in enumerate(batch) if t is not None]
    if real and model is not None:
        for i, p in zip(real, model.predict(np.stack([ngram_counts(batch[i]) for i in real]))):
            said[i] = p
    return said


def prediction(model: Model | None, text: Column) -> Column:
    """The prediction for ``text`` as a struct of ``lang_pred`` and ``score``."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(column: pa.Array) -> pa.Array:
        found: list[tuple[str, float]] = []
        for start in range(0, len(column), 256):
            found += said_of(model, list(texts(column.slice(start, 256))))
        return pa.StructArray.from_arrays(
            [pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.float64())], ["lang_pred", "score"]
        )

    text = text.cast("string")
    return predicted(F.when(text.rlike(LETTER), text))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), prediction(model, F.col(text_col)).alias("p")).select(
        "id", "p.lang_pred", "p.score"
    )
