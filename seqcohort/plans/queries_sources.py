"""Registered queries: readers and writers. Each writes frames derived from the tables to
the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqcohort.operators import dedup as dd
from seqcohort.plans.catalog import query
from seqcohort.plans.inputs import aln_sql, alignment, sql, table
from seqcohort.session import scratch_path
from seqcohort.sources import alignments as al
from seqcohort.sources import tables as tb

ALN, DOC = aln_sql("part"), aln_sql("doc")
FOLDER, WRITTEN = r"sample_id=([^/]+)/", r"sample_id=([^/]+)\.txt$"


def fasta(spark, d) -> str:
    path = scratch_path(spark, "fasta")
    al.write_fasta(alignment(spark, d), path)
    return path


@query("read_fasta", sql(ALN, select="SELECT sample_id, seq_name, seq FROM aln"))
def _(spark, d):
    rows = al.read_fasta(spark, fasta(spark, d) + "/*", FOLDER)
    return al.split_valid(rows)[0].select("sample_id", "seq_name", "seq")


@query("read_file_list", sql(ALN, select="SELECT sample_id, count(*) AS n, min(seq_name) AS first_name FROM aln GROUP BY 1"))
def _(spark, d):
    path, names = fasta(spark, d), scratch_path(spark, "list")
    alignment(spark, d).select(F.concat(F.lit(path + "/sample_id="), "sample_id").alias("value")).distinct().coalesce(1).write.text(names)
    rows = al.read_file_list(spark, names, sample_pattern=FOLDER)
    return rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq_name").alias("first_name"))


@query("write_fasta", sql(ALN, select="""
SELECT sample_id, count(*) AS n_records, sum(2 * 1 + length(seq_name) + 1 + 60)::BIGINT AS n_chars FROM aln GROUP BY 1"""))
def _(spark, d):
    """Sizes of what was written, line ends included."""
    lines = spark.read.text(fasta(spark, d))
    return lines.groupBy("sample_id").agg(
        F.count_if(F.col("value").startswith(">")).alias("n_records"), F.sum(F.length("value") + 1).alias("n_chars"))


def _blocks(spark, d, matrix: bool):
    """Interleaved text of each sample, two blocks of 30 sites, one file per sample."""
    rows = alignment(spark, d, "doc")
    first = F.concat_ws(" ", "seq_name", F.substring("seq", 1, 30))
    second = F.concat_ws(" ", "seq_name", F.substring("seq", 31, 30)) if matrix else F.substring("seq", 31, 30)
    body = rows.select("sample_id", F.explode(F.array(
        F.struct(F.lit(1).alias("b"), F.col("seq_idx").alias("i"), first.alias("value")),
        F.struct(F.lit(2).alias("b"), F.col("seq_idx").alias("i"), second.alias("value")))).alias("x")).select("sample_id", "x.*")
    count = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    if matrix:
        head = count.select("sample_id", F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("i"), F.lit("#NEXUS\nmatrix").alias("value"))
        tail = count.select("sample_id", F.lit(3).alias("b"), F.lit(0).cast("bigint").alias("i"), F.lit(";\nend;").alias("value"))
        body = body.unionByName(head).unionByName(tail)
    else:
        body = body.unionByName(count.select("sample_id", F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("i"),
                                             F.concat_ws(" ", F.col("n").cast("string"), F.lit("60")).alias("value")))
    path = scratch_path(spark, "blocks")
    al.write_files(body, path, "sample_id", ["b", "i"])
    return path


@query("read_phylip", sql(DOC, select="SELECT sample_id, seq_name, seq FROM aln"))
def _(spark, d):
    return al.read_phylip(spark, _blocks(spark, d, False) + "/*", WRITTEN).select("sample_id", "seq_name", "seq")


@query("read_nexus", sql(DOC, select="SELECT sample_id, seq_name, seq FROM aln"))
def _(spark, d):
    return al.read_nexus(spark, _blocks(spark, d, True) + "/*", WRITTEN).select("sample_id", "seq_name", "seq")


@query("read_results", """
SELECT 'study_' || o_custkey || '_p10_' || o_orderkey || '.fasta' AS file, o_totalprice AS value, o_custkey::VARCHAR AS ptid, o_orderkey AS partition_id
FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""")
def _(spark, d):
    path = scratch_path(spark, "results")
    size = F.when(F.col("o_orderpriority") == "5-LOW", "_p5_").otherwise("_p10_")
    table(spark, d, "orders").select(
        F.concat(F.lit("study_"), F.col("o_custkey").cast("string"), size, F.col("o_orderkey").cast("string"), F.lit(".fasta")).alias("file"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"),
    ).write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
    return tb.read_results(spark, path, "file string, value double", "file", r"^study_(\d+)_", 10)


@query("overlay_updates", """
SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN o_totalprice ELSE q END AS o_totalprice, coalesce(p, o_custkey) AS o_custkey, n
FROM orders LEFT JOIN (
  SELECT l_orderkey, CASE WHEN count(*) > 3 THEN sum(l_quantity) END AS q, CASE WHEN count(*) > 2 THEN max(l_partkey) END AS p, count(*) AS n
  FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def _(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    n = F.count(F.lit(1))
    update = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(n > 3, F.sum("l_quantity")).alias("o_totalprice"), F.when(n > 2, F.max("l_partkey")).alias("o_custkey"), n.alias("n"))
    once = tb.overlay_updates(base, update.select("o_orderkey", "o_totalprice", "n"), ["o_orderkey"])
    return tb.overlay_updates(once, update.select("o_orderkey", "o_custkey"), ["o_orderkey"], "coalesce")


@query("concat_results", """
SELECT c_custkey AS id, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"))
    return tb.concat_results([c, s])


@query("sample_dates", """
SELECT o_custkey AS ptid, max_by(strftime(o_orderdate, '%Y/%m/%d'), o_orderkey) AS date_text,
       max_by(o_orderdate, o_orderkey)::DATE AS sample_date FROM orders GROUP BY 1""")
def _(spark, d):
    header = F.concat_ws("|", F.lit("a"), F.lit("b"), F.lit("c"), "o_orderstatus", F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("f"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("ptid"), F.col("o_orderkey").alias("seq_idx"), header.alias("header"))
    return tb.sample_dates(rows)


@query("read_gold", """
SELECT o_custkey::VARCHAR AS ptid, o_orderkey AS visit, o_orderdate::DATE AS infection_date FROM orders""")
def _(spark, d):
    path = scratch_path(spark, "gold")
    fmt = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    table(spark, d, "orders").select(F.col("o_custkey").alias("ptid"), F.col("o_orderkey").alias("visit"), fmt.alias("infection_date")).write.option("header", True).csv(path)
    return tb.read_gold(spark, path, "ptid string, visit bigint, infection_date string", ["infection_date"])


@query("read_external_estimates", """
SELECT o_orderpriority[1:1] AS bounds_type, o_orderstatus AS ptid, CASE WHEN v >= 0 THEN v END AS estimate,
       CASE WHEN v - 50000 >= 0 THEN v - 50000 END AS ci_low, CASE WHEN v + 50000 >= 0 THEN v + 50000 END AS ci_high
FROM (SELECT *, round(o_totalprice) - 100000 AS v FROM orders)""")
def _(spark, d):
    path = scratch_path(spark, "external")
    v = F.round("o_totalprice") - 100000
    table(spark, d, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("bounds"), F.col("o_orderstatus").alias("person"),
        v.alias("estimate"), (v + 50000).alias("ci_high"), (v - 50000).alias("ci_low"),
    ).write.partitionBy("bounds", "person").option("header", True).csv(path)
    return tb.read_external_estimates(spark, path + "/*/*", r"bounds=([^/]+)/person=([^/]+)/").select(
        "bounds_type", "ptid", "estimate", "ci_low", "ci_high")


@query("offsets_to_dates", """
SELECT event_id, CASE WHEN event_type <> 'view' THEN DATE '2000-01-01' + round_even(value * 100, 0)::INT END AS at FROM events""")
def _(spark, d):
    v = F.col("value") * 100
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("-"), v.cast("string"))).otherwise(v.cast("string"))
    return tb.offsets_to_dates(table(spark, d, "events").select("event_id", text.alias("at")), ["at"])


@query("write_results", """
SELECT l_returnflag AS region, l_linestatus AS "time", l_linenumber AS bounds_type, printf('%.2f', avg(l_quantity)) AS bias,
       printf('%.2f', round(sqrt(avg(l_discount * l_discount)), 6)) AS rmse FROM lineitem GROUP BY ALL""")
def _(spark, d):
    path = scratch_path(spark, "tables")
    rows = table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("region"), F.col("l_linestatus").alias("time"), F.col("l_linenumber").alias("bounds_type")
    ).agg(F.avg("l_quantity").alias("bias"), F.round(F.sqrt(F.avg(F.col("l_discount") * F.col("l_discount"))), 6).alias("rmse"))
    tb.write_results(rows, path, ["bias", "rmse"])
    return spark.read.option("sep", "\t").option("header", True).schema(
        "bias string, rmse string, region string, time string, bounds_type int").csv(path)


@query("write_duplicate_map", sql(ALN, select="""
, g AS (SELECT sample_id, seq_name, seq_idx, arg_min(seq_name, seq_idx) OVER (PARTITION BY sample_id, seq) AS retained FROM aln)
SELECT sample_id, retained, string_agg(seq_name, ',' ORDER BY seq_name) AS removed FROM g WHERE seq_name <> retained GROUP BY ALL"""))
def _(spark, d):
    path = scratch_path(spark, "dups")
    tb.write_duplicate_map(dd.duplicate_map(alignment(spark, d)), path, form="list")
    return spark.read.option("sep", "\t").option("header", True).schema("sample_id string, retained string, removed string").csv(path)
