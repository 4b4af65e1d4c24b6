"""Registered queries: participant-level aggregation, founder scores, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqcohort.functions import formulas as fm
from seqcohort.operators import cohort as co
from seqcohort.operators import joins as jn
from seqcohort.plans.catalog import query
from seqcohort.plans.inputs import aln_sql, sql, table
from seqcohort.plans.queries_pairs import FOUNDERS, founders

DOC = aln_sql("doc")


def results(spark, d):
    """Result rows: order lines as estimates, customers as participants."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("ptid"), F.col("l_returnflag").alias("region"), F.col("l_linestatus").alias("time"),
        F.col("l_linenumber").cast("bigint").alias("num"),
        F.when(F.col("l_discount") > 0.015, F.col("l_extendedprice")).alias("est"), F.col("l_quantity").alias("weight"),
        F.col("l_tax").alias("tax"), F.col("o_totalprice").alias("gold"), F.col("l_partkey").alias("partkey"),
    )


RESULTS = """
results AS (
  SELECT o_custkey AS ptid, l_returnflag AS region, l_linestatus AS "time", l_linenumber::BIGINT AS num,
         CASE WHEN l_discount > 0.015 THEN l_extendedprice END AS est, l_quantity AS weight, l_tax AS tax, o_totalprice AS gold, l_partkey AS partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("weighted_mean_per_person", sql(RESULTS, select="""
SELECT ptid, CASE WHEN count(est) > 0 THEN round(sum(est * weight) / sum(weight), 4) END AS est FROM results GROUP BY ptid"""))
def _(spark, d):
    out = co.weighted_mean_per_person(results(spark, d), ["est"], F.col("weight"))
    return out.withColumn("est", F.round("est", 4))


@query("weighted_mean_renormalized", sql(RESULTS, select="""
SELECT ptid, round(sum(est * weight) / sum(weight) FILTER (est IS NOT NULL), 4) AS est FROM results GROUP BY ptid"""))
def _(spark, d):
    out = co.weighted_mean_per_person(results(spark, d), ["est"], F.col("weight"), renormalize=True)
    return out.withColumn("est", F.round("est", 4))


@query("summarize_covariates", sql(RESULTS, select="""
SELECT ptid, max(seg) AS seg, CASE WHEN count(est) > 0 THEN round(sum(est * weight) / sum(weight), 4) END AS est,
       CASE WHEN bool_or(num % 5 = 0) THEN 0 ELSE 1 END AS single, min(tax) AS tax, max(num) AS num
FROM results JOIN (SELECT c_custkey, c_mktsegment AS seg FROM customer) ON c_custkey = ptid GROUP BY ptid"""))
def _(spark, d):
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("ptid"), F.col("c_mktsegment").alias("seg"))
    rows = results(spark, d).join(seg, "ptid").withColumn("single", (F.col("num") % 5 != 0).cast("int"))
    out = co.summarize_covariates(rows, ["seg"], {"est": "weight"}, ["single"], ["tax"], ["num"])
    return out.withColumn("est", F.round("est", 4))


@query("rate_coefficients", sql(RESULTS, select=f"""
SELECT ptid, num, partkey, round({fm.SCALE!r} * (tax / weight), 8) AS rate_coefficient, num * weight AS total_bases FROM results"""))
def _(spark, d):
    out = co.rate_coefficients(results(spark, d), "tax", "weight", "num")
    return out.select("ptid", "num", "partkey", F.round("rate_coefficient", 8).alias("rate_coefficient"), "total_bases")


@query("all_single_per_person", sql(RESULTS, select="""
SELECT ptid, CASE WHEN count(*) FILTER (f = 0) > 0 THEN 0 WHEN count(*) FILTER (f IS NULL) > 0 THEN NULL ELSE 1 END AS single
FROM (SELECT ptid, CASE WHEN est IS NOT NULL THEN (weight > 3)::INT END AS f FROM results) GROUP BY ptid"""))
def _(spark, d):
    rows = results(spark, d).withColumn("single", F.when(F.col("est").isNotNull(), (F.col("weight") > 3).cast("int")))
    return co.all_single_per_person(rows, "single")


@query("depth_equivalents", """
SELECT o_custkey AS ptid, sum(CASE o_orderpriority[1:1] WHEN '1' THEN 0.5 WHEN '2' THEN 0.5 WHEN '3' THEN 1.0 ELSE 0 END * round(o_totalprice))::DOUBLE AS depth
FROM orders GROUP BY 1""")
def _(spark, d):
    kind = F.substring("o_orderpriority", 1, 1)
    file = F.when(kind == "1", "x_RH_1.fasta").when(kind == "2", "x_LH.fasta").when(kind == "3", "x_NFLG.fasta").otherwise("x_env.fasta")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("ptid"), file.alias("file"), F.round("o_totalprice").alias("num_seqs"))
    return co.depth_equivalents(rows)


@query("widths_by_part", """
SELECT l_suppkey AS ptid, max(l_quantity) FILTER (l_returnflag = 'N') AS nflg, max(l_quantity) FILTER (l_returnflag = 'A') AS lh,
       max(l_quantity) FILTER (l_returnflag = 'R') AS rh FROM lineitem GROUP BY 1""")
def _(spark, d):
    part = F.when(F.col("l_returnflag") == "N", "nflg").when(F.col("l_returnflag") == "A", "lh").otherwise("rh")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ptid"), part.alias("genome_part"), F.col("l_quantity").alias("nbases"))
    return co.widths_by_part(rows)


def _best(own: str, other: str, side: str, mode: str) -> str:
    return f"""
SELECT ptid, '{side}' AS perspective, '{mode}' AS gaps, sum(hd)::BIGINT AS hd, sum(n)::BIGINT AS compared FROM (
  SELECT ptid, {own}, hd_{mode} AS hd, n_{mode} AS n FROM dist
  QUALIFY row_number() OVER (PARTITION BY ptid, {own} ORDER BY hd_{mode} / nullif(n_{mode}, 0) NULLS LAST, {other}) = 1) GROUP BY ptid"""


SCORES = "scores AS (" + " UNION ALL ".join(
    _best(a, b, side, m) for m in ("inc", "ign") for side, a, b in
    (("truth", "truth_id", "estimate_id"), ("estimate", "estimate_id", "truth_id"))) + ")"


@query("nearest_founder_scores", sql(DOC, FOUNDERS, SCORES, select="SELECT *, round(hd / nullif(compared, 0), 6) AS share FROM scores"))
def _(spark, d):
    out = co.nearest_founder_scores(jn.estimate_truth_distances(*founders(spark, d)))
    return out.withColumn("share", F.round("share", 6))


@query("founder_hd_per_person", sql(DOC, FOUNDERS, SCORES, select="""
SELECT ptid, gaps, round(max(s) FILTER (perspective = 'truth'), 6) AS truth_share, round(max(s) FILTER (perspective = 'estimate'), 6) AS estimate_share,
       round(avg(s), 6) AS mean_share
FROM (SELECT ptid, gaps, perspective, sum(hd) / nullif(sum(compared), 0) AS s FROM scores GROUP BY ALL) GROUP BY ptid, gaps"""))
def _(spark, d):
    out = co.founder_hd_per_person(co.nearest_founder_scores(jn.estimate_truth_distances(*founders(spark, d))))
    return out.withColumns({c: F.round(c, 6) for c in ("truth_share", "estimate_share", "mean_share")})


@query("match_gold_multiplicity", sql(RESULTS, select="""
SELECT ptid, num, partkey, r AS match_rank FROM (
  SELECT *, CASE WHEN t = g AND e = g THEN 1 WHEN t = g THEN 2 WHEN e = g THEN 3 ELSE 4 END AS r
  FROM (SELECT *, ptid % 2 AS g, num % 2 AS t, partkey % 2 AS e FROM results))
QUALIFY dense_rank() OVER (PARTITION BY ptid ORDER BY r) = 1"""))
def _(spark, d):
    rows = results(spark, d).withColumns(
        {"gold_is_multiple": F.col("ptid") % 2, "truth_is_multiple": F.col("num") % 2, "estimate_is_multiple": F.col("partkey") % 2})
    return co.match_gold_multiplicity(rows).select("ptid", "num", "partkey", "match_rank")


@query("genome_wide_sum", sql(RESULTS, select="""
SELECT ptid, metric, round(sum(v), 4) AS value FROM (
  SELECT ptid, 'weight' AS metric, weight AS v FROM results UNION ALL SELECT ptid, 'tax', tax FROM results) GROUP BY ALL"""))
def _(spark, d):
    long = results(spark, d).unpivot(["ptid"], ["weight", "tax"], "metric", "value")
    return co.genome_wide_sum(long).withColumn("value", F.round("value", 4))


@query("results_summary", sql(RESULTS, select="""
SELECT stat, count(v) AS n, round(min(v), 4) AS "min", round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median,
       round(avg(v), 4) AS mean, round(quantile_cont(v, 0.75), 4) AS q3, round(max(v), 4) AS "max", round(stddev_samp(v), 4) AS sd,
       round(avg((v = 0)::INT), 6) AS zero_share
FROM (SELECT 'est' AS stat, est AS v FROM results UNION ALL SELECT 'tax', tax FROM results UNION ALL SELECT 'gold', gold FROM results) GROUP BY stat"""))
def _(spark, d):
    out = co.results_summary(results(spark, d), ["est", "tax", "gold"])
    return out.withColumns({c: F.round(c, 4) for c in ("min", "q1", "median", "mean", "q3", "max", "sd")}).withColumn(
        "zero_share", F.round("zero_share", 6))


@query("group_pivot_rows_to_columns", """
SELECT p_brand AS label, min(p_size) FILTER (k = 0) AS _lower, min(p_size) FILTER (k = 1) AS _upper
FROM (SELECT *, p_partkey % 2 AS k FROM part) GROUP BY 1""")
def _(spark, d):
    kind = F.when(F.col("p_partkey") % 2 == 0, ".lower").otherwise(".upper")
    rows = table(spark, d, "part").groupBy(F.concat("p_brand", kind).alias("label")).agg(F.min("p_size").alias("size"))
    out = co.group_pivot_rows_to_columns(rows, "label", r"\.(lower|upper)$", [".lower", ".upper"], ["size"])
    return out.toDF("label", "_lower", "_upper")


@query("pool_times", sql(RESULTS, select="""
SELECT ptid, num, est, NULL AS tax, '1m' AS "time", 0 AS "6m_not_early" FROM results WHERE "time" = 'O'
UNION ALL SELECT ptid, num, NULL, tax, '6m', 1 FROM results WHERE "time" = 'F'"""))
def _(spark, d):
    rows = results(spark, d)
    return co.pool_times({"1m": rows.filter("time = 'O'").select("ptid", "num", "est"), "6m": rows.filter("time = 'F'").select("ptid", "num", "tax")})


@query("pool_regions", sql(RESULTS, select="""
SELECT region_pair, to_not_from, count(*) AS n, round(sum(weight), 4) AS weight FROM (
  SELECT f || '_' || t AS region_pair, (t = region)::INT AS to_not_from, weight
  FROM results JOIN (VALUES ('A', 'N'), ('A', 'R')) p(f, t) ON region IN (f, t)) GROUP BY ALL"""))
def _(spark, d):
    out = co.pool_regions(results(spark, d), skip=[("N", "R")], regions=["A", "N", "R"])
    return out.groupBy("region_pair", "to_not_from").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query("outer_cbind", """
SELECT coalesce(a.balance, b.balance) AS balance, n_cust, n_supp
FROM (SELECT floor(c_acctbal / 100)::BIGINT AS balance, count(*) AS n_cust FROM customer GROUP BY 1) a
FULL JOIN (SELECT floor(s_acctbal / 100)::BIGINT AS balance, count(*) AS n_supp FROM supplier GROUP BY 1) b ON a.balance = b.balance""")
def _(spark, d):
    count = lambda name, col, out: table(spark, d, name).groupBy(F.floor(F.col(col) / 100).alias("balance")).agg(F.count(F.lit(1)).alias(out))
    return co.outer_cbind(count("customer", "c_acctbal", "n_cust"), count("supplier", "s_acctbal", "n_supp"), ["balance"])


@query("merge_equivalent_rows", """
SELECT o_custkey::VARCHAR AS label, max(o_orderkey) FILTER (o_orderstatus = 'O') AS last_open, max(o_orderkey) FILTER (o_orderstatus = 'F') AS last_done,
       max(o_orderkey) FILTER (o_orderstatus NOT IN ('O', 'F')) AS last_other
FROM orders GROUP BY 1""")
def _(spark, d):
    each = table(spark, d, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("label"), "o_orderstatus").agg(F.max("o_orderkey").alias("k"))
    status = F.col("o_orderstatus")
    rows = each.select("label", F.when(status == "O", F.col("k")).alias("last_open"), F.when(status == "F", F.col("k")).alias("last_done"),
                       F.when(~status.isin("O", "F"), F.col("k")).alias("last_other"))
    return co.merge_equivalent_rows(rows, "label", ["last_open", "last_done", "last_other"])


@query("combine_configurations", sql(RESULTS, select="""
SELECT ptid, round(avg(weight) FILTER (region = 'N'), 6) AS uncalibrated,
       round(avg(weight) FILTER (region = 'A' AND "time" = 'F'), 6) AS "A+F", round(avg(weight) FILTER (region = 'A' AND "time" = 'O'), 6) AS "A+O"
FROM results GROUP BY ptid HAVING count(*) FILTER (region IN ('A', 'N')) > 0"""))
def _(spark, d):
    code = F.when(F.col("region") == "N", "none").otherwise(F.col("region"))
    rows = results(spark, d).withColumn("code", code)
    config = F.when(F.col("code") == "none", "").otherwise(F.col("time"))
    each = rows.groupBy("ptid", "code", config.alias("config")).agg(F.avg("weight").alias("v"))
    out = co.combine_configurations(each, "ptid", "config", "code", "v", ["A"], ["F", "O"])
    return out.select("ptid", *[F.round(f"`{c}`", 6).alias(c) for c in out.columns if c != "ptid"])
