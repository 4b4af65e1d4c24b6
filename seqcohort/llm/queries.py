"""The registered queries of the corpus operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcohort.llm import languages, toxicity
from seqcohort.llm.common import table
from seqcohort.llm.exact_dedup import exact_dedup
from seqcohort.llm.hash_forest import nearest
from seqcohort.llm.mixing import count_tokens, mix, mix_sql, token_rows
from seqcohort.llm.packing import pack
from seqcohort.llm.periodic_runs import periodic_runs
from seqcohort.llm.prefix_free import remove_repeats
from seqcohort.llm.simhash import near_groups
from seqcohort.llm.token_counts import token_counts
from seqcohort.llm.top_k import best
from seqcohort.llm.warc import round_trip
from seqcohort.llm.whitening import whiten


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four documents, chosen by a hash of their ids, form the snapshot; the others
    arrive as a batch."""
    fresh = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    return exact_dedup(table(spark, sf_dir, "documents"), fresh).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)"""

def fold(id_col: str, folds: int):
    """CRC-32 of the id's text, modulo ``folds``; a null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("id", 5) != 0)
    return toxicity.predict(docs, model).select(
        F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = languages.fit(docs, fold("doc_id", 3) != 1)
    return languages.predict(docs, model).select(
        F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(token_rows(table(spark, sf_dir, "documents"))).drop("mark").withColumnRenamed("id", "doc_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit")
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS top FROM p)
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g"""


def op8_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal text, case aside, are duplicates of one another."""
    items = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "source", F.xxhash64(F.lower("text")).alias("cluster"), count_tokens("text").alias("n_tokens")
    )
    return pack(items).withColumnRenamed("id", "doc_id")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 100 = 0 AND c.id <> q.id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""


def with_loops(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where h = crc32(doc_id) ends in 0, the words from word a on repeat p of them,
    with a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)) and g = floor(h / 10)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    looped = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(looped, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).otherwise(F.array().cast("array<string>"))
    g, n = F.floor(h / 10), F.size("words")
    at = docs.select("doc_id", "text", words.alias("words"), g.alias("g")).withColumn(
        "a", F.when(n > 0, F.col("g") % n).otherwise(0).cast("int")
    ).withColumn("p", (F.floor((n - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), n - F.col("a"))
    text = F.when(n > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text"))
    return at.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.col("runs")
    text = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    # Runs come by start, then period: of equal exponents the first is wanted.
    top = F.aggregate(
        F.slice(runs, 2, F.greatest(F.lit(1), F.size(runs))), F.get(runs, F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    return periodic_runs(with_loops(table(spark, sf_dir, "documents"))).select(
        F.col("id").alias("doc_id"), F.size(runs).cast("long").alias("n_runs"), top.alias("top"),
        F.sha2(F.when(F.size(runs) > 0, F.concat(text, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "top.*", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_mix_sources": op5_mix_sources,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_hash_forest": op8_hash_forest,
    "op9_prefix_free_parsing": op9_prefix_free_parsing,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}
ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op5_mix_sources": mix_sql(),
    "op7_warc": OP7_SQL,
    "op11_exact_top_k": OP11_SQL,
}
