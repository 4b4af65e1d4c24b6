"""Registered queries: the composed distance fits, on their deterministic columns. The random
ones (star test shares) and the goodness of fit have queries of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcohort.operators import dedup as dd
from seqcohort.operators import linkage as lk
from seqcohort.operators import scalars as sc
from seqcohort.plans import fits
from seqcohort.plans.catalog import query
from seqcohort.plans.inputs import CONS_SQL, PAIRS_SQL, SITES_SQL, UNIQUE_SQL, aln_sql, alignment, sql
from seqcohort.plans.queries_founder import DAYS, HIST, USTAT
from seqcohort.plans.queries_pairs import CONS_DIST
from seqcohort.plans.queries_scalars import CODON_SQL, HEADED, headed, mask_sql

DOC = aln_sql("doc")
SIX = ("lambda", "sd", "cons_lambda", "nbases", "check")
# copies are those of the sequence that comes in, before gap columns of the consensus are dropped
UNIQUE = UNIQUE_SQL.replace("seq_name, seq, count(*)", "seq_name, any_value(seq) AS seq, count(*)").replace("GROUP BY sample_id, seq)", "GROUP BY sample_id, raw)")
COLUMNS = ("lambda", "max_hd", "n_pairs", "nseq", "sd", "cons_lambda", "nbases", "days", "days_low", "days_high", "check", "follows_star")


def fit_sql(source: str, key: str) -> str:
    """The fit of ``source`` (``outer_id, sample_id, seq_idx, seq_name, seq``): distances within
    ``sample_id``, pooled per ``outer_id``, which is returned as ``key``."""
    def owned(ctes: str) -> str:
        for name in ("pairs", "uniq", "cons_dist"):
            ctes = ctes.replace(f"FROM {name} ", f"FROM o_{name} ").replace(f"FROM {name})", f"FROM o_{name})").replace(
                f"JOIN {name} ", f"JOIN o_{name} ")
        return ctes

    pool = ", ".join(f"o_{t} AS (SELECT o.outer_id AS sample_id, t.* EXCLUDE (sample_id) FROM {t} t JOIN owner o USING (sample_id))"
                     for t in ("pairs", "uniq", "cons_dist"))
    return f"""WITH aln0 AS ({source}),
sites0 AS (SELECT *, substr(seq, pos, 1) AS base FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS pos FROM aln0)),
cons0 AS (
  SELECT sample_id, pos, base AS cons FROM (SELECT sample_id, pos, base, count(*) AS n FROM sites0 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY sample_id, pos ORDER BY n DESC, base) = 1),
aln AS (
  SELECT sample_id, seq_idx, any_value(seq_name) AS seq_name, any_value(seq) AS raw, coalesce(string_agg(base, '' ORDER BY pos) FILTER (cons <> '-'), '') AS seq
  FROM sites0 JOIN cons0 USING (sample_id, pos) GROUP BY sample_id, seq_idx),
owner AS (SELECT DISTINCT sample_id, outer_id FROM aln0),{SITES_SQL},{CONS_SQL},{UNIQUE},{PAIRS_SQL},{CONS_DIST},
{pool},{owned(HIST)},{owned(USTAT)},
conv AS (
  SELECT sample_id, hd, sum(v) AS conv FROM (
    SELECT x.sample_id, x.hd + y.hd AS hd, x.n * y.n / 2 AS v FROM cons_hist x JOIN cons_hist y USING (sample_id)
    UNION ALL SELECT sample_id, 2 * hd, -n / 2 FROM cons_hist)
  GROUP BY ALL),
chk AS (
  SELECT sample_id, sum(CASE WHEN hd <= max_hd THEN abs(coalesce(n, 0) - coalesce(conv, 0)) ELSE 0 END) / nullif(sum(conv), 0) AS v
  FROM conv FULL JOIN hist USING (sample_id, hd) JOIN lam USING (sample_id) GROUP BY ALL),
cons_lam AS (SELECT sample_id, sum(hd * n) / sum(n) AS cons_lambda FROM cons_hist GROUP BY ALL),
lengths AS (SELECT outer_id, sample_id, max(length(seq)) AS len, sum(mult) AS n FROM uniq JOIN owner USING (sample_id) GROUP BY ALL),
nb AS (
  SELECT outer_id AS sample_id, CASE WHEN bool_and(outer_id = sample_id) THEN max(len)::DOUBLE
         ELSE sum(len * n * (n - 1) / 2) / nullif(sum(n * (n - 1) / 2), 0) END AS nbases FROM lengths GROUP BY outer_id)
SELECT sample_id AS {key}, CASE WHEN max_hd = 0 THEN 0 ELSE round("lambda", 6) END AS "lambda", max_hd, n_pairs, nseq, round(sd, 6) AS sd,
       round(cons_lambda, 6) AS cons_lambda, round(nbases, 6) AS nbases,
       CASE WHEN max_hd = 0 THEN 0 ELSE round_even({DAYS.format(lam='"lambda"', nb='nbases')}, 0) END AS days,
       CASE WHEN max_hd = 0 THEN 0 ELSE round_even({DAYS.format(lam='("lambda" - 1.96 * sd)', nb='nbases')}, 0) END AS days_low,
       CASE WHEN max_hd = 0 THEN 1 ELSE round_even({DAYS.format(lam='("lambda" + 1.96 * sd)', nb='nbases')}, 0) END AS days_high,
       CASE WHEN max_hd > 0 THEN round(v, 6) END AS "check", CASE WHEN max_hd > 0 THEN v <= 0.1 ELSE true END AS follows_star
FROM lam LEFT JOIN ustat USING (sample_id) LEFT JOIN cons_lam USING (sample_id) LEFT JOIN nb USING (sample_id) LEFT JOIN chk USING (sample_id)"""


def shown(fit: DataFrame, key: str) -> DataFrame:
    return fit.select(key, *[F.round(c, 6).alias(c) if c in SIX else F.col(c) for c in COLUMNS])


@query("poisson_fit", fit_sql(sql(DOC, select="SELECT sample_id AS outer_id, sample_id, seq_idx, seq_name, seq FROM aln"), "sample_id"))
def _(spark, d):
    return shown(fits.poisson_fit(alignment(spark, d, "doc")), "sample_id")


MASKED = sql(DOC, SITES_SQL, CONS_SQL, CODON_SQL, mask_sql("synonymous"), select="""
SELECT aln.sample_id AS outer_id, aln.sample_id, aln.seq_idx, seq_name, masked.seq FROM aln JOIN masked USING (seq_idx)""")


@query("synonymous_fit", fit_sql(MASKED, "sample_id"))
def _(spark, d):
    return shown(fits.synonymous_fit(alignment(spark, d, "doc")), "sample_id")


CLUSTERED = sql(DOC, select="SELECT ptid AS outer_id, ptid || '#' || region AS sample_id, seq_idx, seq_name, seq FROM aln")


@query("multifounder_fit", fit_sql(CLUSTERED, "ptid"))
def _(spark, d):
    """Given clusters (here the languages of a source); ``clustered_fit`` finds them itself."""
    rows = alignment(spark, d, "doc")
    clusters = rows.select("ptid", F.col("seq_idx").alias("idx"), F.col("region").alias("cluster"))
    return shown(fits.multifounder_fit(rows.drop("region"), clusters, ["ptid"]), "ptid")


POOLED = sql(DOC, HEADED, select="""
SELECT regexp_replace(sample_id, '_(?:[LR]H|NFLG|env).*$', '') AS outer_id,
       regexp_replace(sample_id, '_(?:[LR]H|NFLG|env).*$', '') || '#' || coalesce(genome_part, 'all') AS sample_id, seq_idx, split.seq_name, aln.seq
FROM split JOIN aln USING (seq_idx)""").replace("SELECT regexp_replace(sample_id", "SELECT regexp_replace(split.sample_id").replace(
    "       regexp_replace(sample_id", "       regexp_replace(split.sample_id")


@query("region_pooled_fit", fit_sql(POOLED, "base_name"))
def _(spark, d):
    parts = sc.split_by_header_pattern(headed(spark, d))
    named = parts.withColumn("base_name", sc.base_sample_name(F.col("sample_id"))).withColumn(
        "genome_part", F.coalesce("genome_part", F.lit("all")))
    return shown(fits.region_pooled_fit(named), "base_name")


@query("clustered_fit")
def _(spark, d):
    """Clusters by distance, then the fit within them."""
    rows = alignment(spark, d)
    return shown(fits.multifounder_fit(rows, dd.cluster_by_distance(rows, 20)), "sample_id")


@query("linkage_fit")
def _(spark, d):
    """Average-linkage clusters, then the fit within them."""
    rows = alignment(spark, d, "doc")
    return shown(fits.multifounder_fit(rows, lk.cluster_by_linkage(rows)), "sample_id")
