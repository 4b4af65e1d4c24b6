"""Registered queries: alignment-column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqcohort.functions.alphabet import IUPAC
from seqcohort.operators import scalars as sc
from seqcohort.operators import sites as st
from seqcohort.plans.catalog import query
from seqcohort.plans.inputs import CONS_SQL, FLANK_SQL, SITES_SQL, aln_sql, alignment, sql

ALN, DOC = aln_sql("part"), aln_sql("doc")


@query("majority_consensus", sql(ALN, SITES_SQL, CONS_SQL, select="SELECT * FROM cons"))
def _(spark, d):
    return st.majority_consensus(alignment(spark, d))


@query("flank_aware_consensus", sql(DOC, SITES_SQL, FLANK_SQL, select="""
SELECT sample_id, string_agg(cons, '' ORDER BY pos) AS cons FROM flank_cons GROUP BY sample_id"""))
def _(spark, d):
    return st.flank_aware_consensus(alignment(spark, d, "doc"))


@query("alignment_with_consensus", sql(DOC, SITES_SQL, CONS_SQL, select="""
SELECT sample_id, -1 AS seq_idx, 'Consensus' AS seq_name, cons AS seq FROM cons
UNION ALL SELECT sample_id, seq_idx, seq_name, seq FROM aln"""))
def _(spark, d):
    rows = alignment(spark, d, "doc")
    return st.alignment_with_consensus(rows, st.majority_consensus(rows))


_TOP = "string_agg(base, '' ORDER BY n DESC, base)"


@query("site_profile", sql(ALN, SITES_SQL, select="""
, n AS (SELECT sample_id, pos, base, count(*) AS n FROM sites WHERE base IN ('a','c','g','t') GROUP BY ALL),
w AS (
  SELECT sample_id, pos, coalesce(sum(n) FILTER (base = 'a'), 0)::BIGINT AS n_a, coalesce(sum(n) FILTER (base = 'c'), 0)::BIGINT AS n_c,
         coalesce(sum(n) FILTER (base = 'g'), 0)::BIGINT AS n_g, coalesce(sum(n) FILTER (base = 't'), 0)::BIGINT AS n_t,
         sum(n)::BIGINT AS total, string_agg(base, '' ORDER BY n DESC, base) AS top
  FROM n GROUP BY ALL)
SELECT *, floor(n_a / total * 10000 + 0.5) / 10000 AS freq_a, floor(n_c / total * 10000 + 0.5) / 10000 AS freq_c,
       floor(n_g / total * 10000 + 0.5) / 10000 AS freq_g, floor(n_t / total * 10000 + 0.5) / 10000 AS freq_t FROM w"""))
def _(spark, d):
    return st.site_profile(alignment(spark, d))


@query("variable_sites", sql(ALN, SITES_SQL, FLANK_SQL, select="SELECT DISTINCT sample_id, pos, cons FROM variants"))
def _(spark, d):
    return st.variable_sites(alignment(spark, d))


SITE_KIND = """
kind AS (
  SELECT sample_id, pos, cons, count(*) AS n_variants, bool_or(n = 1) AS private, bool_or(n > 1) AS informative,
         count(*) FILTER (n = 1) = 1 AND (bool_or(n = 1 AND variant = '-') OR cons = '-') AS private_gap_only,
         count(*) FILTER (n > 1) = 1 AND (bool_or(n > 1 AND variant = '-') OR cons = '-') AS informative_gap_only
  FROM variants GROUP BY sample_id, pos, cons)"""

SITE_TOTALS = """
totals AS (
  SELECT sample_id, count(pos) FILTER (informative) AS informative, count(pos) FILTER (private) AS private,
         count(pos) FILTER (informative AND NOT informative_gap_only) AS informative_no_gap,
         count(pos) FILTER (private AND NOT private_gap_only) AS private_no_gap
  FROM (SELECT DISTINCT sample_id FROM aln) LEFT JOIN kind USING (sample_id) GROUP BY sample_id)"""


@query("informative_and_private_sites", sql(DOC, SITES_SQL, FLANK_SQL, SITE_KIND, select="SELECT * FROM kind"))
def _(spark, d):
    return st.informative_and_private_sites(alignment(spark, d, "doc"))


@query("gap_only_site_correction", sql(DOC, SITES_SQL, FLANK_SQL, SITE_KIND, SITE_TOTALS, select="SELECT * FROM totals"))
def _(spark, d):
    rows = alignment(spark, d, "doc")
    return st.gap_only_site_correction(st.informative_and_private_sites(rows), rows)


@query("informative_to_private_ratio", sql(DOC, SITES_SQL, FLANK_SQL, SITE_KIND, SITE_TOTALS, select="""
SELECT sample_id, informative_no_gap AS inf, private_no_gap AS priv,
       round(informative_no_gap / greatest(private_no_gap, 1), 6) AS ratio FROM totals"""))
def _(spark, d):
    return st.informative_to_private_ratio(alignment(spark, d, "doc")).withColumn("ratio", F.round("ratio", 6))


@query("ambiguous_sites", sql(DOC, SITES_SQL, select="""
SELECT sample_id, pos, count(*) AS n FROM sites WHERE NOT regexp_matches(base, '[acgt.?-]') GROUP BY ALL"""))
def _(spark, d):
    return st.ambiguous_sites(alignment(spark, d, "doc"))


@query("mutation_spectrum", sql(DOC, SITES_SQL, FLANK_SQL, SITE_KIND, select="""
, m AS (
  SELECT sample_id, pos, v.cons || '-' || variant AS mutation, n
  FROM variants v JOIN kind USING (sample_id, pos) WHERE informative AND v.cons <> '-' AND variant <> '-')
SELECT sample_id, pos, mutation, n FROM m
UNION ALL SELECT sample_id, NULL, mutation, sum(n)::BIGINT FROM m GROUP BY ALL"""))
def _(spark, d):
    return st.mutation_spectrum(alignment(spark, d, "doc"))


@query("informative_subalignment", sql(DOC, SITES_SQL, FLANK_SQL, SITE_KIND, select="""
SELECT sample_id, seq_name, string_agg(base, '' ORDER BY pos) AS seq
FROM sites JOIN aln USING (sample_id, seq_idx) JOIN kind USING (sample_id, pos) WHERE informative GROUP BY ALL"""))
def _(spark, d):
    return st.informative_subalignment(alignment(spark, d, "doc")).select("sample_id", "seq_name", "seq")


_IUPAC_ROWS = ", ".join(f"('{c}', '{b}', {len(bases)})" for c, bases in IUPAC.items() for b in bases)
ENTROPY = f"""
iupac(code, nt, k) AS (VALUES {_IUPAC_ROWS}),
nt_w AS (
  SELECT sample_id, pos, nt, sum(n / k) AS w FROM (SELECT sample_id, pos, base, count(*) AS n FROM sites GROUP BY ALL)
  JOIN iupac ON base = code GROUP BY ALL),
ent AS (
  SELECT sample_id, pos, sum(-(w / t) * log2(w / t)) AS entropy
  FROM (SELECT *, sum(w) OVER (PARTITION BY sample_id, pos) AS t FROM nt_w) GROUP BY ALL),
site_ent AS (
  SELECT sample_id, pos, entropy FROM (SELECT DISTINCT sample_id, pos FROM sites) LEFT JOIN ent USING (sample_id, pos))"""


@query("site_entropy", sql(ALN, SITES_SQL, ENTROPY, select="SELECT sample_id, pos, round(entropy, 6) AS entropy FROM site_ent"))
def _(spark, d):
    return st.site_entropy(alignment(spark, d)).withColumn("entropy", F.round("entropy", 6))


@query("entropy_summary", sql(ALN, SITES_SQL, ENTROPY, select="""
, n AS (SELECT sample_id, count(*) AS N FROM aln GROUP BY sample_id)
SELECT sample_id, N, count(*) AS K, round(min(entropy), 4) AS "min", round(quantile_cont(entropy, 0.25), 4) AS q1,
       round(quantile_cont(entropy, 0.5), 4) AS median, round(avg(entropy), 4) AS mean,
       round(quantile_cont(entropy, 0.75), 4) AS q3, round(max(entropy), 4) AS "max", round(stddev_samp(entropy), 4) AS sd
FROM site_ent JOIN n USING (sample_id) GROUP BY ALL"""))
def _(spark, d):
    return st.entropy_summary(alignment(spark, d))


@query("gap_stats", sql(DOC, select="""
SELECT sample_id, count(*) AS n, round(avg(g), 6) AS avg_gaps, round(max(g), 6) AS max_gaps, round(min(g), 6) AS min_gaps,
       count(*) FILTER (g < 0.9) AS n_included
FROM (SELECT sample_id, (60 - length(replace(seq, '-', ''))) / 60 AS g FROM aln) GROUP BY sample_id"""))
def _(spark, d):
    rows = alignment(spark, d, "doc").withColumn("gap_fraction", sc.gap_fraction(F.col("seq")))
    out = st.gap_stats(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_gaps", "max_gaps", "min_gaps")})


@query("unique_rows_with_counts", sql(ALN, select="""
SELECT sample_id, arg_min(seq_name, seq_idx) || '_' || count(*) AS label, count(*) AS n, seq
FROM aln GROUP BY sample_id, seq ORDER BY n DESC, label"""))
def _(spark, d):
    return st.unique_rows_with_counts(alignment(spark, d))
