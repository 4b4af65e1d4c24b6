"""Registered queries: founder statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seqcohort.functions import formulas as fm
from seqcohort.operators import dedup as dd
from seqcohort.operators import founder as fo
from seqcohort.operators import linkage as lk
from seqcohort.operators import pairs as pr
from seqcohort.operators import sites as st
from seqcohort.plans import report
from seqcohort.plans.catalog import query
from seqcohort.plans.inputs import CONS_SQL, PAIRS_SQL, SITES_SQL, UNIQUE_SQL, aln_sql, alignment, sql, table
from seqcohort.plans.queries_pairs import CONS_DIST, unique
from seqcohort.session import settle

ALN, DOC = aln_sql("part"), aln_sql("doc")


def rounded(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- hypermutation ----------------------------------------------------------------------

HYPER = """
ctx AS (
  SELECT sample_id, seq_idx, pos, base, cons, substr(u, k + 1, 1) AS c1, substr(u, k + 2, 1) AS c2
  FROM (SELECT sites.*, cons, replace(seq, '-', '') AS u, length(replace(substr(seq, 1, pos), '-', '')) AS k
        FROM sites JOIN cons_site USING (sample_id, pos) WHERE cons = 'g')),
hyper AS (
  SELECT sample_id, seq_idx, pos, base,
         CASE WHEN c1 IN ('a','g') AND c2 IN ('a','g','t') THEN 'mutation'
              WHEN c1 IN ('c','t') AND c2 IN ('a','c','g','t') OR c1 IN ('a','g') AND c2 = 'c' THEN 'control' END AS kind
  FROM ctx),
hyper_n AS (
  SELECT aln.sample_id, aln.seq_idx, any_value(seq) AS seq,
         count(*) FILTER (kind = 'mutation' AND base = 'a') AS n_mut, count(*) FILTER (kind = 'mutation') AS n_potential_mut,
         count(*) FILTER (kind = 'control' AND base = 'a') AS n_control, count(*) FILTER (kind = 'control') AS n_potential_control
  FROM aln LEFT JOIN hyper USING (sample_id, seq_idx) GROUP BY ALL)"""

LF = "lgamma({} + 1)"


def _fisher(a: str, b: str, c: str, d: str, src: str) -> str:
    logp = lambda s: " - ".join(["0", *[f"lgamma({x} + 1.0)" for x in (s, f"r - {s}", f"k - {s}", f"t - r - k + {s}")]])
    return f"""
tabs AS (SELECT DISTINCT {a} AS a, {b} AS b, {c} AS c, {d} AS d FROM {src}),
mar AS (SELECT *, a + b AS r, a + c AS k, a + b + c + d AS t FROM tabs),
alt AS (SELECT *, unnest(range(greatest(0, r + k - t), least(r, k) + 1)) AS s FROM mar),
pr AS (SELECT a, b, c, d, exp({logp('s')} - ({logp('a')})) AS rel FROM alt),
fish AS (SELECT a, b, c, d, least(1.0, sum(rel) FILTER (rel <= 1.0000001) / sum(rel)) AS p FROM pr GROUP BY a, b, c, d)"""


@query("hypermutation_sites", sql(ALN, SITES_SQL, CONS_SQL, HYPER, select="""
SELECT sample_id, seq_idx, kind, pos, base FROM hyper WHERE kind IS NOT NULL"""))
def _(spark, d):
    rows = alignment(spark, d)
    return fo.hypermutation_sites(rows, st.majority_consensus(rows), name="seq_idx")


@query("hypermutation_counts", sql(ALN, SITES_SQL, CONS_SQL, HYPER, select="""
SELECT sample_id, seq_idx, n_mut, n_potential_mut, n_control, n_potential_control FROM hyper_n"""))
def _(spark, d):
    rows = alignment(spark, d)
    return fo.hypermutation_counts(rows, st.majority_consensus(rows)).select(
        "sample_id", "seq_idx", "n_mut", "n_potential_mut", "n_control", "n_potential_control"
    )


FISHER = _fisher("n_control", "n_potential_control - n_control", "n_mut", "n_potential_mut - n_mut", "hyper_n")
WITH_P = """
hyper_p AS (
  SELECT hyper_n.*, p FROM hyper_n JOIN fish
  ON a = n_control AND b = n_potential_control - n_control AND c = n_mut AND d = n_potential_mut - n_mut)"""


@query("fisher_exact", sql(ALN, SITES_SQL, CONS_SQL, HYPER, FISHER, WITH_P, select="""
SELECT sample_id, min(seq_idx) AS seq_idx, round(any_value(p), 6) AS p FROM hyper_p GROUP BY sample_id, seq"""))
def _(spark, d):
    rows = alignment(spark, d)
    return rounded(fo.hypermutation_p(rows, st.majority_consensus(rows)).select("sample_id", "seq_idx", "p"), 6, "p")


@query("remove_hypermutated", sql(ALN, SITES_SQL, CONS_SQL, HYPER, FISHER, WITH_P, select="""
SELECT sample_id, seq_idx FROM hyper_p WHERE p >= 0.1"""))
def _(spark, d):
    rows = alignment(spark, d)
    return fo.remove_hypermutated(rows, st.majority_consensus(rows)).select("sample_id", "seq_idx")


@query("fix_hypermutated", sql(ALN, SITES_SQL, CONS_SQL, HYPER, FISHER, WITH_P, select="""
SELECT s.sample_id, s.seq_idx, string_agg(CASE WHEN p < 0.1 AND kind = 'mutation' AND s.base = 'a' THEN 'r' ELSE s.base END, '' ORDER BY s.pos) AS seq
FROM sites s JOIN hyper_p USING (sample_id, seq_idx) LEFT JOIN hyper h ON h.seq_idx = s.seq_idx AND h.pos = s.pos
GROUP BY s.sample_id, s.seq_idx"""))
def _(spark, d):
    rows = alignment(spark, d)
    return fo.fix_hypermutated(rows, st.majority_consensus(rows)).select("sample_id", "seq_idx", "seq")


# --- fits -------------------------------------------------------------------------------

HIST = """
hist AS (
  SELECT sample_id, hd, sum(n)::BIGINT AS n FROM (
    SELECT sample_id, hd::INT AS hd, sum(ma * mb) AS n FROM pairs GROUP BY ALL
    UNION ALL SELECT sample_id, 0, sum(mult * (mult - 1) // 2) FROM uniq GROUP BY ALL)
  GROUP BY ALL HAVING sum(n) > 0),
cons_hist AS (SELECT sample_id, hd, sum(mult)::BIGINT AS n FROM cons_dist GROUP BY ALL),
lam AS (
  SELECT sample_id, sum(hd * n) / sum(n) AS "lambda", max(hd) AS max_hd, sum(n)::BIGINT AS n_pairs FROM hist GROUP BY ALL)"""

PHI = fm.PHI
DAYS = f"({fm.SCALE!r} * {{lam}} / {{nb}} / {fm.EPSILON!r} - {fm.SCALE * (1 - PHI) / PHI**2!r})"

FIT = (SITES_SQL, CONS_SQL, UNIQUE_SQL, PAIRS_SQL, CONS_DIST, HIST)


@query("distance_histogram", sql(ALN, *FIT, select="SELECT * FROM hist"))
def _(spark, d):
    return fo.distance_histogram(unique(spark, d))


@query("consensus_histogram", sql(ALN, *FIT, select="SELECT * FROM cons_hist"))
def _(spark, d):
    rows = alignment(spark, d)
    return fo.consensus_histogram(pr.consensus_distance(dd.exact_dedup(rows), st.majority_consensus(rows)))


@query("poisson_lambda", sql(ALN, *FIT, select="""
SELECT sample_id, round("lambda", 6) AS "lambda", max_hd, n_pairs FROM lam"""))
def _(spark, d):
    return rounded(fo.poisson_lambda(fo.distance_histogram(unique(spark, d))), 6, "lambda")


@query("mean_distance_from_sites", sql(ALN, UNIQUE_SQL, PAIRS_SQL, select="""
SELECT sample_id, sum(ma * mb * hd)::BIGINT AS sum_hd FROM pairs GROUP BY sample_id"""))
def _(spark, d):
    return fo.total_distance(alignment(spark, d))


@query("days_from_lambda", sql(DOC, *FIT, select=f"""
SELECT sample_id, round({DAYS.format(lam='"lambda"', nb=60)}, 4) AS days, round({fm.SCALE!r} * "lambda" / 60, 8) AS rate_coefficient FROM lam"""))
def _(spark, d):
    lam = fo.poisson_lambda(fo.distance_histogram(unique(spark, d, "doc")))
    return lam.select(
        "sample_id", F.round(fm.days_from_lambda(F.col("lambda"), F.lit(60)), 4).alias("days"),
        F.round(fm.rate_coefficient(F.col("lambda"), F.lit(60)), 8).alias("rate_coefficient"),
    )


USTAT = """
nq AS (SELECT sample_id, sum(mult)::DOUBLE AS nseq, sum(mult * (mult - 1) / 2) AS c2, sum(mult * (mult - 1) * (mult - 2) / 6) AS c3 FROM uniq GROUP BY ALL),
mu AS (
  SELECT sample_id, nseq, c2, c3, coalesce(sum(ma * mb * hd), 0) / nullif(coalesce(sum(ma * mb), 0) + c2, 0) AS mu
  FROM nq LEFT JOIN pairs USING (sample_id) GROUP BY sample_id, nseq, c2, c3),
ways AS (SELECT sample_id, a AS c, ma AS m, mb AS x, hd FROM pairs UNION ALL SELECT sample_id, b, mb, ma, hd FROM pairs),
cen AS (
  SELECT sample_id, c, any_value(m)::DOUBLE AS m, any_value(mu) AS mu, sum(x * (hd - mu)) AS lin, sum(x * x * (hd - mu) * (hd - mu)) AS own,
         sum(x * (hd - mu) * (hd - mu)) AS sq, sum(x * (hd - mu) * (hd - 3 * mu)) AS cross_terms
  FROM ways JOIN mu USING (sample_id) GROUP BY sample_id, c),
parts AS (
  SELECT sample_id, sum(m * (lin * lin - own)) / 2 AS triples, sum(m * (m - 1) / 2 * cross_terms) AS doubles, sum(m * sq) / 2 AS pairs2
  FROM cen GROUP BY ALL),
sig AS (
  SELECT sample_id, nseq, mu, nseq * (nseq - 1) * (nseq - 2) * (nseq - 3) AS f,
         c3 * 12 / nullif(nseq * (nseq - 1) * (nseq - 2) * (nseq - 3), 0) * 2 * mu * mu + 2.0 / 3 * (coalesce(doubles, 0) + coalesce(triples, 0)) AS s1,
         c2 * 3 / nullif(nseq * (nseq - 1) * (nseq - 2) * (nseq - 3), 0) * mu * mu + coalesce(pairs2, 0) AS s2
  FROM mu LEFT JOIN parts USING (sample_id)),
ustat AS (
  SELECT sample_id, nseq::BIGINT AS nseq, mu, CASE WHEN nseq >= 4 AND 8 * s1 + 4 * s2 >= 0 THEN sqrt((8 * s1 + 4 * s2) / nullif(f, 0)) END AS sd FROM sig)"""


@query("distance_sd_ustat", sql(ALN, *FIT, USTAT, select="SELECT sample_id, nseq, round(mu, 6) AS mu, round(sd, 6) AS sd FROM ustat"))
def _(spark, d):
    return rounded(fo.distance_sd_ustat(pr.centre_sums(unique(spark, d), mult="mult")), 6, "mu", "sd")


@query("days_confidence_interval", sql(ALN, *FIT, USTAT, select=f"""
SELECT sample_id, round_even({DAYS.format(lam='mu', nb=60)}, 0) AS days,
       round_even({DAYS.format(lam='(mu - 1.96 * sd)', nb=60)}, 0) AS days_low,
       round_even({DAYS.format(lam='(mu + 1.96 * sd)', nb=60)}, 0) AS days_high FROM ustat"""))
def _(spark, d):
    u = fo.distance_sd_ustat(pr.centre_sums(unique(spark, d), mult="mult"))
    return u.select("sample_id", *fo.days_confidence_interval(F.col("mu"), F.col("sd"), F.lit(60)))


@query("star_convolution", sql(ALN, *FIT, select="""
, conv AS (
  SELECT sample_id, hd, sum(v) AS conv FROM (
    SELECT x.sample_id, x.hd + y.hd AS hd, x.n * y.n / 2 AS v FROM cons_hist x JOIN cons_hist y USING (sample_id)
    UNION ALL SELECT sample_id, 2 * hd, -n / 2 FROM cons_hist)
  GROUP BY ALL),
chk AS (
  SELECT sample_id, max_hd,
         sum(CASE WHEN hd <= max_hd THEN abs(coalesce(n, 0) - coalesce(conv, 0)) ELSE 0 END) / nullif(sum(conv), 0) AS v
  FROM conv FULL JOIN hist USING (sample_id, hd) JOIN lam USING (sample_id) GROUP BY ALL)
SELECT sample_id, CASE WHEN max_hd > 0 THEN round(v, 6) END AS "check", CASE WHEN max_hd > 0 THEN v <= 0.1 END AS follows_star FROM chk"""))
def _(spark, d):
    return rounded(fo.star_convolution(*both_histograms(spark, d, "part")), 6, "check")


def both_histograms(spark, d, by="doc"):
    """Of the consensus and of the pairs; the alignment is read and deduplicated once."""
    u = settle(dd.exact_dedup(alignment(spark, d, by)))
    return fo.consensus_histogram(pr.consensus_distance(u, st.majority_consensus(u, weight="mult"))), fo.distance_histogram(u)


@query("poisson_goodness")
def _(spark, d):
    return fo.poisson_goodness(*both_histograms(spark, d))


@query("star_rate_test")
def _(spark, d):
    return fo.star_rate_test(*both_histograms(spark, d))


@query("degenerate_sample_rule", sql(DOC, *FIT, select=f"""
SELECT sample_id, round("lambda", 6) AS "lambda", CASE WHEN max_hd = 0 THEN 0 ELSE round({DAYS.format(lam='"lambda"', nb=60)}, 4) END AS days, max_hd FROM lam"""))
def _(spark, d):
    lam = fo.poisson_lambda(fo.distance_histogram(unique(spark, d, "doc")))
    fit = lam.withColumn("days", fm.days_from_lambda(F.col("lambda"), F.lit(60)))
    return rounded(rounded(fo.degenerate_sample_rule(fit), 6, "lambda"), 4, "days").select("sample_id", "lambda", "days", "max_hd")


@query("shrink_histogram", sql(ALN, *FIT, select="""
, t AS (SELECT *, sum(n) OVER (PARTITION BY sample_id) AS t FROM hist)
SELECT sample_id, hd, m AS n FROM (
  SELECT sample_id, hd, CASE WHEN t > 2500 THEN round_even(2500.0::DOUBLE * n / t, 0)::BIGINT ELSE n END AS m FROM t) WHERE m > 0"""))
def _(spark, d):
    return fo.shrink_histogram(fo.distance_histogram(unique(spark, d)), 2500)


@query("empirical_upper_p", f"""
WITH k AS (
  SELECT l_returnflag, count(*) FILTER (l_extendedprice >= 90000) + 1.0::DOUBLE AS k, count(*) + 1.0::DOUBLE AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((k / n + 3.841458820694124 / (2 * n)
  + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n), 8) AS p FROM k""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_extendedprice", "null_stat")
    return rounded(fo.empirical_upper_p(li, F.lit(90000), ["l_returnflag"]), 8, "p")


DIVERSITY = """
dvals AS (
  SELECT sample_id, hd / compared AS v, sum(n) AS n FROM (
    SELECT sample_id, hd, compared, ma * mb AS n FROM pairs
    UNION ALL SELECT sample_id, 0, length(replace(seq, '-', '')), mult * (mult - 1) // 2 FROM uniq)
  WHERE compared > 0 AND n > 0 GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY sample_id ORDER BY v) AS upto, sum(n) OVER (PARTITION BY sample_id) AS t FROM dvals),
qq AS (
  SELECT sample_id, t, q, (t - 1) * q AS h,
         min(v) FILTER (upto > floor((t - 1) * q)) AS lo, min(v) FILTER (upto > ceil((t - 1) * q)) AS hi
  FROM cum, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) g(q) GROUP BY ALL),
qv AS (SELECT sample_id, q, lo + (h - floor(h)) * (hi - lo) AS v FROM qq),
mom AS (SELECT sample_id, sum(n) AS n, sum(v * n) / sum(n) AS mean FROM dvals GROUP BY ALL),
vv AS (SELECT sample_id, any_value(m.n) AS n, any_value(mean) AS mean, sum(x.n * (v - mean) * (v - mean)) AS ss FROM dvals x JOIN mom m USING (sample_id) GROUP BY ALL),
ns AS (SELECT sample_id, sum(mult)::BIGINT AS num_seqs FROM uniq GROUP BY ALL),
diversity AS (
  SELECT sample_id, num_seqs, n::BIGINT AS n_pairs, mean, sqrt(ss / nullif(n - 1, 0) / n) AS sem,
         max(v) FILTER (q = 0) AS min, max(v) FILTER (q = 0.25) AS q1, max(v) FILTER (q = 0.5) AS median,
         max(v) FILTER (q = 0.75) AS q3, max(v) FILTER (q = 1) AS max
  FROM vv JOIN qv USING (sample_id) JOIN ns USING (sample_id) GROUP BY ALL)"""
DIV_COLS = ("mean", "sem", "min", "q1", "median", "q3", "max")


def _diversity_groups(text: str) -> str:
    return text.replace("FROM vv JOIN qv USING (sample_id) JOIN ns USING (sample_id) GROUP BY ALL",
                        "FROM vv JOIN qv USING (sample_id) JOIN ns USING (sample_id) GROUP BY sample_id, num_seqs, n, mean, ss")


DIVERSITY = _diversity_groups(DIVERSITY)


@query("pairwise_diversity", sql(ALN, UNIQUE_SQL, PAIRS_SQL, DIVERSITY, select=f"""
SELECT sample_id, num_seqs, n_pairs, {', '.join(f'round({c}, 6) AS "{c}"' for c in DIV_COLS)} FROM diversity"""))
def _(spark, d):
    return rounded(fo.pairwise_diversity(unique(spark, d)), 6, *DIV_COLS)


@query("fixed_size_subset", sql(ALN, select="""
SELECT sample_id, seq_name FROM aln
QUALIFY count(*) OVER (PARTITION BY sample_id ORDER BY ('0x' || substr(md5(seq_name), 1, 15))::BIGINT) <= 100"""))
def _(spark, d):
    return fo.fixed_size_subset(alignment(spark, d), 100).select("sample_id", "seq_name")


@query("founder_call", sql(DOC, UNIQUE_SQL, PAIRS_SQL, DIVERSITY, select="""
SELECT sample_id, CASE WHEN mean > 0.001 AND q3 - q1 > 0.09 THEN 0 ELSE 1 END AS is_one_founder,
       CASE WHEN mean > 0.001 AND q3 - q1 > 0.09 THEN num_seqs ELSE 1 END AS num_founders
FROM (SELECT * REPLACE (round(q1, 6) AS q1, round(q3, 6) AS q3) FROM diversity)"""))
def _(spark, d):
    v = fo.pairwise_diversity(unique(spark, d, "doc")).withColumn("spread", F.round("q3", 6) - F.round("q1", 6))
    return fo.founder_call(v, "mean", "spread", clusters="num_seqs", threshold=0.09).select(
        "sample_id", "is_one_founder", "num_founders")


@query("star_founder_call", sql(DOC, UNIQUE_SQL, PAIRS_SQL, DIVERSITY, select="""
SELECT sample_id, CASE WHEN NOT (n_pairs < 100) AND (CASE WHEN num_seqs > 9 THEN mean END IS NULL OR mean > 0.7) THEN 0 ELSE 1 END AS star_is_one_founder
FROM diversity"""))
def _(spark, d):
    v = fo.pairwise_diversity(unique(spark, d, "doc")).select(
        "sample_id", (F.col("n_pairs") < 100).alias("fits_star"), F.when(F.col("num_seqs") > 9, F.col("mean")).alias("diversity"))
    return fo.star_founder_call(v, min_diversity=0.7).select("sample_id", "star_is_one_founder")


@query("sample_report")
def _(spark, d):
    """With average-linkage clusters, so that calls and multi-founder columns are filled."""
    rows = alignment(spark, d, "doc")
    return report.sample_report(rows, lk.cluster_by_linkage(rows))
