"""A training-data pipeline over ``documents``.

Five stages, each on what the one before kept: rows without a language go; of equal texts one
row stays; of near duplicates one document stays; sources are mixed to target weights, which
leaves out or repeats documents; what remains is packed into sequences. All but the last return
the columns of their input. Rows are told apart by their id and a hash of all their columns, so
null and repeated ids, equal rows and extra columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcohort.llm import exact_dedup, languages, mixing, near_copies, packing
from seqcohort.llm.common import table
from seqcohort.session import settle


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_mark(docs: DataFrame) -> Column:
    """Hash of all columns; those that hold maps, which have no hash, as JSON."""
    return F.xxhash64(*[
        F.to_json(F.struct(column(f.name).alias("c"))) if '"map"' in f.dataType.json() else column(f.name) for f in docs.schema
    ])


def with_keys(docs: DataFrame, mark: Column) -> DataFrame:
    """``row`` (all columns of ``docs``), ``id`` and ``mark``."""
    return docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), mark.alias("mark"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & left["mark"].eqNullSafe(right["mark"])


def one_of_each(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` with the keys in ``repeated`` (``id, mark``) reduced to one row each."""
    if repeated.isEmpty():
        return rows
    others = rows.join(repeated, same_row(rows, repeated), "left_anti")
    return others.unionAll(rows.join(repeated, same_row(rows, repeated), "left_semi").dropDuplicates(["id", "mark"]))


def keep_only(docs: DataFrame, mark: Column, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is kept in ``decided`` (``id, mark, kept``, one row per row of
    ``docs``), one of each."""
    decided = settle(decided)
    rows = with_keys(docs, mark)
    dropped = decided.filter(~F.col("kept")).select("id", "mark").distinct()
    repeated = decided.filter("kept").groupBy("id", "mark").count().filter("count > 1").select("id", "mark")
    return one_of_each(rows.join(dropped, same_row(rows, dropped), "left_anti"), repeated).select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a predicted language (no text, no letter) go. Where no document is
    labelled, nothing can be learned, and only documents without a letter go."""
    model = languages.fit(docs, F.lit(True))
    text = F.col("text").cast("string")
    if model is None:
        return docs.filter(F.coalesce(text.rlike(languages.LETTER), F.lit(False)))
    said = "prediction" + "_" * max(map(len, docs.columns))
    return docs.withColumn(said, languages.prediction(model, F.col("text"))).filter(
        F.col(said)["lang_pred"] != languages.UNKNOWN
    ).drop(said)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the row with the largest id stays."""
    fresh = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    decided = exact_dedup.exact_dedup(docs, fresh).select("id", F.xxhash64("digest").alias("mark"), "kept")
    return keep_only(docs, F.xxhash64(exact_dedup.digest_of(F.col("text"))), decided)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by pairs that share at least 0.8 of their five-word shingles the one
    with the smallest id stays (a null id only where there is no other)."""
    groups = settle(near_copies.near_groups(docs, row_mark(docs)))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "mark")
    first = groups.groupBy("root").agg(F.min(rank).alias("first"))
    decided = groups.join(first, "root").select("id", "mark", F.col("first").eqNullSafe(rank).alias("kept"))
    return keep_only(docs, row_mark(docs), decided)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    taken = settle(mixing.mix(mixing.token_rows(docs, mark=row_mark(docs))).groupBy("id", "mark").agg(
        F.count(F.lit(1)).alias("times")
    ))
    repeated = docs.select(F.col("doc_id").cast("long").alias("id"), row_mark(docs).alias("mark")).groupBy("id", "mark").count().filter(
        "count > 1"
    ).select("id", "mark")
    rows = one_of_each(with_keys(docs, row_mark(docs)), settle(repeated))
    # A row that stands for very many equal ones is repeated in two steps, so that no array is long.
    step = packing.COPIES
    many = rows.join(taken, same_row(rows, taken)).select(
        "row", "times", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / step).cast("int"))).alias("run")
    )
    return many.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step), F.col("times") - F.col("run") * step)))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, copy, piece, bin, offset, length`` of every piece; equal texts, case aside, and
    repeats of a document never share a bin."""
    items = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"),
        F.xxhash64(F.lower("text")).alias("cluster"), mixing.count_tokens("text").alias("n_tokens"),
    )
    return packing.pack(items).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed result of all stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
