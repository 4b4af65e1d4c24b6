"""Registered queries: errors, discrimination, calibration, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqcohort.operators import evaluate as ev
from seqcohort.operators import lasso as la
from seqcohort.plans.catalog import query
from seqcohort.plans.inputs import sql, table
from seqcohort.plans.queries_cohort import RESULTS, results


def r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def rated(spark, d):
    """Labelled documents as evaluated rows: one person per source."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.length("text").alias("len"), "lang")
    return table(spark, d, "labels").join(docs, "doc_id").select(
        F.col("source").alias("ptid"), "doc_id", F.col("quality").cast("bigint").alias("gold"),
        F.ln(F.col("n_chars") + 1).alias("size"), (F.col("doc_id") % 7).cast("double").alias("noise"),
        (F.col("lang") == "en").cast("double").alias("english"), F.col("toxic").cast("double").alias("toxic"),
        F.when(F.col("doc_id") % 3 != 0, F.col("n_chars").cast("double")).alias("n_chars"),
    )


RATED = """
rated AS (
  SELECT source AS ptid, doc_id, quality::BIGINT AS gold, ln(n_chars + 1) AS size, (doc_id % 7)::DOUBLE AS noise,
         (lang = 'en')::INT::DOUBLE AS english, toxic::DOUBLE AS toxic, CASE WHEN doc_id % 3 <> 0 THEN n_chars::DOUBLE END AS n_chars
  FROM labels JOIN documents USING (doc_id))"""

LONG = """
long AS (
  SELECT ptid, doc_id, gold, 'size' AS estimator, size AS score FROM rated UNION ALL SELECT ptid, doc_id, gold, 'n_chars', n_chars FROM rated
  UNION ALL SELECT ptid, doc_id, gold, 'toxic', toxic FROM rated)"""


def rated_long(spark, d):
    return rated(spark, d).unpivot(["ptid", "doc_id", "gold"], ["size", "n_chars", "toxic"], "estimator", "score")


ERRORS = """
errors AS (
  SELECT ptid, region, partkey, gold, 'est' AS estimator, est AS estimate, est - gold AS error FROM results
  UNION ALL SELECT ptid, region, partkey, gold, 'weight', weight, weight - gold FROM results)"""


def errors(spark, d):
    return ev.estimate_errors(results(spark, d), ["est", "weight"], "gold", ["ptid", "region", "partkey"])


@query("estimate_errors", sql(RESULTS, ERRORS, select="""
SELECT ptid, region, partkey, gold, estimator, estimate, round(error, 4) AS error FROM errors"""))
def _(spark, d):
    return r(errors(spark, d), 4, "error")


SUMMARY = """count(*) AS n, round(avg(error), 4) AS bias, round(stddev_samp(error), 4) AS se, round(sqrt(avg(error * error)), 4) AS rmse,
  round(avg(coalesce(error, 0)), 4) AS bias_zero, round(stddev_samp(coalesce(error, 0)), 4) AS se_zero,
  round(sqrt(avg(coalesce(error, 0) * coalesce(error, 0))), 4) AS rmse_zero"""
SUMMARY_COLS = ("bias", "se", "rmse", "bias_zero", "se_zero", "rmse_zero")


@query("bias_se_rmse", sql(RESULTS, ERRORS, select=f"""
SELECT estimator, region, {SUMMARY} FROM errors GROUP BY GROUPING SETS ((estimator, region), (estimator))"""))
def _(spark, d):
    return r(ev.bias_se_rmse(errors(spark, d), within="region"), 4, *SUMMARY_COLS)


@query("ranked_errors", sql(RESULTS, ERRORS, select="""
SELECT estimator, round(sqrt(avg(error * error)), 4) AS rmse, round(avg(error), 4) AS bias FROM errors GROUP BY estimator ORDER BY rmse DESC"""))
def _(spark, d):
    return ev.ranked_errors(r(ev.bias_se_rmse(errors(spark, d)), 4, "rmse", "bias"))


AUC_SQL = """
, s AS (SELECT estimator, coalesce(score, 1) AS score, gold FROM {src}),
k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY estimator, score) - 1) / 2 AS mid FROM s WINDOW w AS (PARTITION BY estimator ORDER BY score))
SELECT estimator, round(CASE WHEN count(DISTINCT score) <= 1 THEN 0 ELSE
  (sum(mid) FILTER (gold = 1) - sum(gold) * (sum(gold) + 1) / 2) / (sum(gold) * (count(*) - sum(gold))) END, 6) AS auc,
  sum(gold)::BIGINT AS n_pos, (count(*) - sum(gold))::BIGINT AS n_neg FROM k GROUP BY estimator"""


@query("auc", sql(RATED, LONG, select=AUC_SQL.format(src="long")))
def _(spark, d):
    return r(ev.auc(rated_long(spark, d)), 6, "auc")


@query("auc_large", sql("""
big AS (SELECT l_returnflag AS estimator, l_extendedprice AS score, (l_linestatus = 'F')::INT::BIGINT AS gold FROM lineitem)""",
       select=AUC_SQL.format(src="big")))
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("estimator"), F.col("l_extendedprice").alias("score"), (F.col("l_linestatus") == "F").cast("bigint").alias("gold"))
    return r(ev.auc(rows), 6, "auc")


@query("drop_constant_estimators", sql(RATED, LONG, select="""
SELECT ptid, doc_id, estimator, round(score, 6) AS score FROM long
QUALIFY min(score) OVER (PARTITION BY ptid, estimator) < max(score) OVER (PARTITION BY ptid, estimator)"""))
def _(spark, d):
    out = ev.drop_constant_estimators(rated_long(spark, d), ["ptid", "estimator"], "score")
    return r(out.select("ptid", "doc_id", "estimator", "score"), 6, "score")


@query("correlation_matrix", sql(RATED, select="""
SELECT 'gold' AS x, 'size' AS y, round(corr(gold, size), 6) AS r FROM rated UNION ALL SELECT 'gold', 'n_chars', round(corr(gold, n_chars), 6) FROM rated
UNION ALL SELECT 'gold', 'english', round(corr(gold, english), 6) FROM rated UNION ALL SELECT 'size', 'n_chars', round(corr(size, n_chars), 6) FROM rated
UNION ALL SELECT 'size', 'english', round(corr(size, english), 6) FROM rated UNION ALL SELECT 'n_chars', 'english', round(corr(n_chars, english), 6) FROM rated"""))
def _(spark, d):
    return r(ev.correlation_matrix(rated(spark, d), ["gold", "size", "n_chars", "english"]), 6, "r")


@query("correlation_screen")
def _(spark, d):
    """The rows with only the covariates the screen keeps."""
    rows = rated(spark, d)
    kept = ev.correlation_screen(rows, "gold", "size", ["noise", "english", "toxic", "n_chars"], weak=0.01)
    return rows.select("ptid", "doc_id", "gold", "size", *kept)


# prices explained by quantity, a supplier as person, per return flag
def priced(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("estimator"), F.col("l_suppkey").alias("ptid"), "l_orderkey", "l_linenumber",
        F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))


@query("fold_statistics", """
WITH own AS (
  SELECT l_returnflag AS estimator, l_suppkey AS ptid, count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_extendedprice) AS sxy
  FROM lineitem GROUP BY ALL)
SELECT estimator, ptid, (sum(n) OVER w - n)::DOUBLE AS n, round(sum(sx) OVER w - sx, 2) AS sx, round(sum(sy) OVER w - sy, 2) AS sy, round(sum(sxy) OVER w - sxy, 2) AS sxy
FROM own WINDOW w AS (PARTITION BY estimator)""")
def _(spark, d):
    s = ev.fold_statistics(priced(spark, d), "y", ["x"])
    return s.select("estimator", "ptid", "n", F.round(F.col("xx")[1], 2).alias("sx"), F.round("y1", 2).alias("sy"), F.round(F.col("xy")[1], 2).alias("sxy"))


@query("lopo_linear_predictions", """
WITH own AS (
  SELECT l_returnflag AS f, l_suppkey AS p, count(*) AS n, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) AS sxx, sum(l_extendedprice) AS sy, sum(l_quantity * l_extendedprice) AS sxy
  FROM lineitem GROUP BY ALL),
fold AS (
  SELECT f, p, sum(n) OVER w - n AS n, sum(sx) OVER w - sx AS sx, sum(sxx) OVER w - sxx AS sxx, sum(sy) OVER w - sy AS sy, sum(sxy) OVER w - sxy AS sxy
  FROM own WINDOW w AS (PARTITION BY f)),
b AS (SELECT f, p, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, sx / n AS mx, sy / n AS my FROM fold)
SELECT l_returnflag AS estimator, l_suppkey AS ptid, l_orderkey, l_linenumber, l_quantity AS x, round(my + slope * (l_quantity - mx), 2) AS prediction
FROM lineitem JOIN b ON f = l_returnflag AND p = l_suppkey""")
def _(spark, d):
    out = ev.lopo_linear_predictions(priced(spark, d), "y", ["x"])
    return r(out.select("estimator", "ptid", "l_orderkey", "l_linenumber", "x", "prediction"), 2, "prediction")


@query("lopo_linear_interactions")
def _(spark, d):
    return ev.lopo_linear_predictions(priced(spark, d), "y", ["x", "tax", "discount"], interactions=True)


@query("lopo_stepwise_predictions")
def _(spark, d):
    return ev.lopo_stepwise_predictions(priced(spark, d), "y", ["x", "tax", "discount"])


def scored(spark, d):
    return rated(spark, d).withColumn("estimator", F.lit("size"))


@query("lopo_lasso_predictions")
def _(spark, d):
    return ev.lopo_lasso_predictions(scored(spark, d), "gold", ["size", "noise", "english", "toxic"])


@query("lopo_lasso_logistic_predictions")
def _(spark, d):
    """The penalty is chosen by holding back persons in ten hashed groups."""
    return la.lopo_lasso_logistic_predictions(scored(spark, d), "gold", ["size", "noise", "english", "toxic"], inner_folds=10)


@query("lopo_logistic_predictions")
def _(spark, d):
    return ev.lopo_logistic_predictions(scored(spark, d), "gold", ["size", "english"])


@query("lopo_logistic_one_term", "WITH RECURSIVE " + sql(RATED, select="""
, folds AS (SELECT DISTINCT ptid AS p FROM rated),
newton(i, p, a, b) AS (
  SELECT 0, p, 0.0::DOUBLE, 0.0::DOUBLE FROM folds
  UNION ALL
  SELECT i + 1, p, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
    SELECT i, p, a, b, sum(gold - mu) AS g1, sum((gold - mu) * size) AS g2,
           sum(mu * (1 - mu)) AS h11, sum(mu * (1 - mu) * size) AS h12, sum(mu * (1 - mu) * size * size) AS h22
    FROM (SELECT i, p, a, b, gold, size, 1 / (1 + exp(-(a + b * size))) AS mu FROM newton JOIN rated ON ptid <> p WHERE i < 20)
    GROUP BY i, p, a, b))
SELECT doc_id, ptid, round(1 / (1 + exp(-(a + b * size))), 6) AS prediction FROM rated JOIN newton ON p = ptid WHERE i = 20""").removeprefix("WITH "))
def _(spark, d):
    out = ev.lopo_logistic_predictions(scored(spark, d), "gold", ["size"])
    return r(out.select("doc_id", "ptid", "prediction"), 6, "prediction")


@query("covariate_usage")
def _(spark, d):
    stats = ev.fold_statistics(scored(spark, d), "gold", ["size", "noise", "english", "toxic"])
    return ev.covariate_usage(ev.lasso_coefficients(stats, (0, 1)), ["one", "size", "noise", "english", "toxic"])


@query("formula_usage")
def _(spark, d):
    stats = ev.fold_statistics(priced(spark, d), "y", ["x", "tax", "discount"])
    fitted = stats.withColumn("beta", ev.stepwise((0, 1))("xx", "xy", "yy", "n"))
    return ev.formula_usage(fitted, ["1", "x", "tax", "discount"])


@query("coefficient_table", """
WITH c AS (SELECT l_returnflag AS estimator, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1)
SELECT estimator, '1' AS term, round(a, 4) AS estimate FROM c UNION ALL SELECT estimator, 'x', round(b, 4) FROM c""")
def _(spark, d):
    return r(ev.coefficient_table(priced(spark, d), "y", ["x"]).select("estimator", "term", "estimate"), 4, "estimate")


@query("variance_explained", sql(RATED, LONG, select="""
SELECT estimator, round(pow(corr(score, gold), 2), 6) AS r2, printf('%.2f', pow(corr(score, gold), 2) * 100) || '%' AS r2_text FROM long GROUP BY 1"""))
def _(spark, d):
    return r(ev.variance_explained(rated_long(spark, d), "score", "gold"), 6, "r2")


PAIRED = """
dd AS (
  SELECT a.l_returnflag, a.q - b.q AS v FROM (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) a
  JOIN (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) b USING (l_returnflag, l_suppkey))"""


def paired(spark, d):
    each = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_suppkey").alias("ptid"), "l_linestatus").agg(F.avg("l_quantity").alias("q"))
    return ev.paired_difference_test(each.filter("l_linestatus = 'O'"), each.filter("l_linestatus = 'F'"), "q", keys=["l_returnflag"])


@query("paired_difference_test", sql(PAIRED, select="""
SELECT l_returnflag, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(avg(v) / (stddev_samp(v) / sqrt(count(v))), 6) AS t FROM dd GROUP BY 1"""))
def _(spark, d):
    return r(paired(spark, d).drop("p"), 6, "mean", "sd", "t")


@query("paired_difference_p")
def _(spark, d):
    return paired(spark, d)


@query("assign_interval", """
SELECT event_id, c - round_even(w * 0.3, 0) AS lower, c + round_even(w - round_even(w * 0.3, 0), 0) AS upper
FROM (SELECT event_id, round(value) AS c, (event_id % 50)::DOUBLE AS w FROM events)""")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.round("value").alias("c"), (F.col("event_id") % 50).cast("double").alias("w"))
    return ev.assign_interval(rows, F.col("c"), F.col("w"), F.lit(0.3)).select("event_id", "lower", "upper")


@query("assign_sampled_interval", """
WITH u AS (
  SELECT c_custkey AS ptid, round(c_acctbal) AS center, ('0x' || substr(md5(c_custkey || '|1'), 1, 10))::BIGINT / 1099511627776.0::DOUBLE AS a,
         ('0x' || substr(md5(c_custkey || '|1|place'), 1, 10))::BIGINT / 1099511627776.0::DOUBLE AS b FROM customer),
no AS (SELECT round(value) AS width, row_number() OVER (ORDER BY round(value)) - 1 AS n FROM events)
SELECT ptid, center, width, center - round_even(width * b, 0) AS lower, center + round_even(width - round_even(width * b, 0), 0) AS upper
FROM u JOIN no ON n = floor(a * (SELECT count(*) FROM events))""")
def _(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("ptid"), F.round("c_acctbal").alias("center"))
    widths = table(spark, d, "events").select(F.round("value").alias("width"))
    return ev.assign_sampled_interval(people, widths, "center")


WIDTHS = """
w AS (SELECT CASE WHEN event_type = 'view' THEN 'a' ELSE 'b' END AS sample, round(value) AS raw FROM events),
m AS (SELECT avg(raw) FILTER (sample = 'a') AS ma, avg(raw) FILTER (sample = 'b') AS mb FROM w),
g AS (SELECT ma, mb, 30 - exp(ln(30 / 90) * ln((180 - ma) / (90 - mb)) / ln(180 / 90)) * (90 - mb) AS goal FROM m),
sc AS (SELECT sample, raw, CASE WHEN sample = 'a' THEN raw ELSE raw * ma / mb END AS scaled, goal FROM w, g)"""


@query("rescale_pooled_widths", sql(WIDTHS, select="""
SELECT sample, raw, round(scaled, 6) AS scaled, raw >= 270 AS in_tail, round(scaled * goal / (SELECT avg(scaled) FROM sc), 6) AS rescaled FROM sc"""))
def _(spark, d):
    e = table(spark, d, "events").select("event_type", F.round("value").alias("width"))
    out = ev.rescale_pooled_widths(e.filter("event_type = 'view'"), e.filter("event_type <> 'view'"))
    return r(out, 6, "scaled", "rescaled")


@query("partition_error_summary", sql(RESULTS, ERRORS, select="""
, p AS (SELECT estimator, ptid, avg(error) AS m, stddev_samp(error) AS s FROM errors GROUP BY ALL)
SELECT estimator, round(min(m), 4) AS min_mean, round(max(m), 4) AS max_mean, round(min(s), 4) AS min_sd, round(max(s), 4) AS max_sd,
       round(quantile_cont(m, 0.5), 4) AS median_mean, round(quantile_cont(s, 0.5), 4) AS median_sd FROM p GROUP BY estimator"""))
def _(spark, d):
    out = ev.partition_error_summary(errors(spark, d))
    return r(out, 4, *[c for c in out.columns if c != "estimator"])


@query("partition_bootstrap", sql(RESULTS, ERRORS, select=f"""
, e AS (SELECT estimator, ptid, region, avg(error) AS error FROM errors GROUP BY ALL),
pick AS (
  SELECT ptid, replicate, region FROM (SELECT DISTINCT ptid, region FROM e), (SELECT unnest(range(0, 100))::INT AS replicate)
  QUALIFY row_number() OVER (PARTITION BY ptid, replicate ORDER BY md5(replicate || '|' || ptid || '|' || region || '|1'), region) = 1)
SELECT estimator, replicate, {SUMMARY} FROM e JOIN pick USING (ptid, region) GROUP BY estimator, replicate"""))
def _(spark, d):
    e = errors(spark, d).groupBy("estimator", "ptid", F.col("region").alias("partition_id")).agg(F.avg("error").alias("error"))
    return r(ev.partition_bootstrap(e, 100), 4, *SUMMARY_COLS)


@query("label_training_code", """
SELECT DISTINCT p_size, '[' || CASE WHEN p_size > 25 THEN 'R' ELSE 'r' END || CASE WHEN p_size % 2 = 1 THEN 'T' ELSE 't' END || '] days~1+'
  || CASE WHEN p_size % 3 = 0 THEN 'bound+' ELSE '' END || p_brand AS label FROM part""")
def _(spark, d):
    rows = table(spark, d, "part").select(
        "p_size", F.when(F.col("p_size") > 25, 2).otherwise(1).alias("n_regions"), (F.col("p_size") % 2 + 1).alias("n_times"),
        (F.col("p_size") % 3 == 0).alias("bounded"), F.col("p_brand").alias("method")).distinct()
    return ev.label_training_code(rows).select("p_size", "label")


@query("calibrated_mutation_rate", """
SELECT l_returnflag AS region, l_linestatus AS "time", round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, count(*) AS n,
       round(1 / regr_slope(l_extendedprice, l_quantity), 8) AS epsilon FROM lineitem GROUP BY ALL""")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "region", "l_linestatus": "time"})
    return r(r(ev.calibrated_mutation_rate(rows, "l_extendedprice", "l_quantity", ["region", "time"]), 4, "slope"), 8, "epsilon")


@query("predictions_and_errors_table", sql(RESULTS, ERRORS, select="""
SELECT ptid, round(avg(gold), 6) AS gold, round(avg(estimate) FILTER (estimator = 'est'), 6) AS est_days,
       round(avg(error) FILTER (estimator = 'est'), 6) AS est_error, round(avg(estimate) FILTER (estimator = 'weight'), 6) AS weight_days,
       round(avg(error) FILTER (estimator = 'weight'), 6) AS weight_error FROM errors GROUP BY ptid"""))
def _(spark, d):
    out = ev.predictions_and_errors_table(errors(spark, d), ["est", "weight"])
    return r(out, 6, "gold", "est_days", "est_error", "weight_days", "weight_error")
