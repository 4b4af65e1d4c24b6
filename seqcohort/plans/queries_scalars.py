"""Registered queries: row-level transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqcohort.functions import alphabet as ab
from seqcohort.operators import scalars as sc
from seqcohort.operators import sites as st
from seqcohort.plans.catalog import query
from seqcohort.plans.inputs import CONS_SQL, SITES_SQL, aln_sql, alignment, sql, table

ALN, DOC = aln_sql("part"), aln_sql("doc")


@query("sanitize", "SELECT item_id AS seq_idx, replace(text, '!', '-') AS seq, 'b!' || item_id AS raw, 'b-' || item_id AS seq_name FROM benchmark"
       " UNION ALL SELECT doc_id, replace(text, '!', '-'), 'b!' || doc_id, 'b-' || doc_id FROM documents")
def _(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("seq_idx"), F.col("text").alias("seq")).unionByName(
        table(spark, d, "documents").select(F.col("doc_id").alias("seq_idx"), F.col("text").alias("seq"))
    )
    named = rows.withColumn("seq_name", F.concat(F.lit("b!"), F.col("seq_idx").cast("string"))).withColumn("raw", F.col("seq_name"))
    return sc.sanitize(named)


@query("drop_singletons", sql(DOC, select="""
SELECT sample_id, seq_idx, seq FROM aln QUALIFY count(*) OVER (PARTITION BY sample_id) <> 1"""))
def _(spark, d):
    return sc.drop_singletons(alignment(spark, d, "doc")).select("sample_id", "seq_idx", "seq")


def headed(spark, d):
    """Alignment whose names carry a genome-part mark that depends on the row number."""
    i = F.col("seq_idx") % 7
    mark = F.when(i < 3, "LH|").when(i < 6, "RH|").when(F.col("seq_idx") % 2 == 0, "NFLG|").otherwise("env|")
    return alignment(spark, d, "doc").withColumn("seq_name", F.concat(mark, F.col("seq_name")))


HEADED = """
headed AS (
  SELECT * REPLACE (
    CASE WHEN seq_idx % 7 < 3 THEN 'LH|' WHEN seq_idx % 7 < 6 THEN 'RH|'
         WHEN seq_idx % 2 = 0 THEN 'NFLG|' ELSE 'env|' END || seq_name AS seq_name)
  FROM aln),
parted AS (
  SELECT *, CASE WHEN contains(seq_name, 'env|') THEN 'env' WHEN contains(seq_name, 'NFLG|') THEN 'NFLG'
                 WHEN contains(seq_name, 'LH|') THEN 'LH' WHEN contains(seq_name, 'RH|') THEN 'RH' END AS genome_part,
         bool_or(contains(seq_name, 'RH|')) OVER s AND bool_or(contains(seq_name, 'LH|')) OVER s AS split
  FROM headed WINDOW s AS (PARTITION BY sample_id)),
split AS (
  SELECT CASE WHEN split THEN sample_id || '_' || genome_part ELSE sample_id END AS sample_id, genome_part, seq_name, seq_idx
  FROM parted QUALIFY NOT split OR count(*) OVER (PARTITION BY sample_id, genome_part) >= 2)"""


@query("split_by_header_pattern", sql(DOC, HEADED, select="SELECT * FROM split"))
def _(spark, d):
    return sc.split_by_header_pattern(headed(spark, d)).select("sample_id", "genome_part", "seq_name", "seq_idx")


@query("base_sample_name", sql(DOC, HEADED, select="""
SELECT regexp_replace(sample_id, '_(?:[LR]H|NFLG|env).*$', '') AS base_name, count(DISTINCT sample_id) AS n_parts, count(*) AS n
FROM split GROUP BY 1"""))
def _(spark, d):
    parts = sc.split_by_header_pattern(headed(spark, d))
    return parts.groupBy(sc.base_sample_name(F.col("sample_id")).alias("base_name")).agg(
        F.countDistinct("sample_id").alias("n_parts"), F.count(F.lit(1)).alias("n")
    )


@query("ungap", sql(ALN, select="SELECT seq_idx, replace(seq, '-', '') AS seq FROM aln"))
def _(spark, d):
    return alignment(spark, d).select("seq_idx", sc.ungap(F.col("seq")).alias("seq"))


ESCAPED = """replace(replace(replace(replace(replace(url, '|', '-x-BAR-x-'), '/', '-x-SLASH-x-'), chr(92), '-x-BACKSLASH-x-'), '..', '-x-DOTDOT-x-'), '.', '-x-DOT-x-')"""


@query("escape_names", f"SELECT page_id, {ESCAPED} AS escaped FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", sc.escape_names(F.col("url")).alias("escaped"))


@query("unescape_names", "SELECT page_id, url FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", sc.unescape_names(sc.escape_names(F.col("url"))).alias("url"))


@query("standard_name", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS name FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", sc.standard_name(F.col("url")).alias("name"))


@query("parse_multiplicity", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 ELSE p_size END::BIGINT AS mult FROM part""")
def _(spark, d):
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.concat_ws("_", "p_brand", F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", sc.parse_multiplicity(name).alias("mult"))


@query("gap_fraction_filter", sql(DOC, select="""
SELECT sample_id, seq_name, gf AS gap_fraction, ng AS n_non_gap, gf IS NOT NULL AS found, coalesce(gf < 0.9, false) AS kept
FROM aln LEFT JOIN (
  SELECT sample_id, seq_name, round((60 - length(replace(seq, '-', ''))) / 60, 6) AS gf, length(replace(seq, '-', '')) AS ng
  FROM aln WHERE NOT starts_with(seq, 'a')) USING (sample_id, seq_name)"""))
def _(spark, d):
    rows = alignment(spark, d, "doc")
    out = sc.gap_fraction_filter(rows, rows.filter(~F.col("seq").startswith("a")))
    return out.withColumn("gap_fraction", F.round("gap_fraction", 6))


def _codon_sql() -> str:
    code = ", ".join(f"('{c}', '{a}')" for c, a in ab.codon_table().items())
    iupac = ", ".join(f"('{c}', '{b}')" for c, bases in ab.IUPAC.items() for b in bases)
    return f"""
code(codon, aa) AS (VALUES {code}),
iupac(code, base) AS (VALUES {iupac}),
amino AS (
  SELECT x.code || y.code || z.code AS codon,
         CASE WHEN count(DISTINCT aa) = 1 THEN min(aa) WHEN bool_and(aa IN ('D', 'N')) THEN 'B'
              WHEN bool_and(aa IN ('E', 'Q')) THEN 'Z' ELSE 'X' END AS aa
  FROM iupac x, iupac y, iupac z, code c WHERE c.codon = x.base || y.base || z.base GROUP BY 1)"""


CODON_SQL = _codon_sql()


@query("translate_codons", sql(ALN, CODON_SQL, select="""
, strands AS (
  SELECT DISTINCT seq, 1 AS strand, seq AS s FROM aln
  UNION ALL SELECT DISTINCT seq, 2, substr(reverse(translate(seq, 'acgtrykmbdhv', 'tgcayrmkvhdb')), 2) FROM aln),
cod AS (SELECT seq, strand, unnest(range(0, 20)) AS i, substr(s, 3 * i + 1, 3) AS c FROM strands),
prot AS (
  SELECT seq, strand, string_agg(CASE WHEN replace(c, '-', '') = '' THEN '-' ELSE aa END, '' ORDER BY i) AS aa
  FROM cod LEFT JOIN amino ON codon = rpad(replace(c, '-', 'n'), 3, 'n') GROUP BY ALL)
SELECT seq_idx, f.aa AS aa, r.aa AS rc_aa FROM aln JOIN prot f ON aln.seq = f.seq AND f.strand = 1
JOIN prot r ON aln.seq = r.seq AND r.strand = 2"""))
def _(spark, d):
    both = sc.translate_codons(alignment(spark, d), out="aa")
    return sc.translate_codons(both, frame=2, reverse=True, complement=True, out="rc_aa").select("seq_idx", "aa", "rc_aa")


def mask_sql(keep: str) -> str:
    test = "=" if keep == "nonsynonymous" else "<>"
    return f"""
strict AS (SELECT codon, aa FROM code),
site_codon AS (
  SELECT seq_idx, i, substr(seq, 3 * i + 1, 3) AS c, substr(cons, 3 * i + 1, 3) AS r
  FROM (SELECT seq_idx, seq, cons, unnest(range(0, 20)) AS i FROM aln JOIN cons USING (sample_id))),
masked AS (
  SELECT seq_idx, string_agg(CASE WHEN coalesce(p.aa, '-') {test} coalesce(q.aa, '-') THEN '---' ELSE c END, '' ORDER BY i) AS seq
  FROM site_codon LEFT JOIN strict p ON c = p.codon LEFT JOIN strict q ON r = q.codon GROUP BY seq_idx)"""


for _keep in ("nonsynonymous", "synonymous"):
    _name = "mask_codons" if _keep == "nonsynonymous" else "mask_codons_keep_synonymous"

    @query(_name, sql(ALN, SITES_SQL, CONS_SQL, CODON_SQL, mask_sql(_keep), select="SELECT seq_idx, seq FROM masked"))
    def _(spark, d, keep=_keep):
        rows = alignment(spark, d)
        return sc.mask_codons(rows, st.majority_consensus(rows), keep).select("seq_idx", "seq")


@query("drop_consensus_gap_columns", sql(DOC, SITES_SQL, CONS_SQL, select="""
SELECT seq_idx, coalesce(string_agg(base, '' ORDER BY pos) FILTER (cons <> '-'), '') AS seq
FROM sites JOIN cons_site USING (sample_id, pos) GROUP BY seq_idx"""))
def _(spark, d):
    rows = alignment(spark, d, "doc")
    return sc.drop_consensus_gap_columns(rows, st.majority_consensus(rows)).select("seq_idx", "seq")


@query("exclude_by_pattern", """
SELECT url AS path FROM pages WHERE NOT regexp_matches(url, '[13579]') AND page_id IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    pages = table(spark, d, "pages")
    existing = pages.join(table(spark, d, "labels"), F.col("page_id") == F.col("doc_id"), "left_semi")
    path = F.col("url").alias("path")
    return sc.exclude_by_pattern(pages.select(path), existing.select(path), "[13579]")


@query("results_zero_variation_rule", """
SELECT l_orderkey, l_linenumber, CASE WHEN b = 0 THEN 0 ELSE l_extendedprice END AS lambda,
       CASE WHEN b = 0 THEN 0 ELSE l_quantity END AS days, CASE WHEN b = 0 THEN 1 ELSE l_linenumber % 2 END AS is_poisson,
       l_linenumber % 2 AS insites_is_one_founder, b AS nbases
FROM (SELECT *, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) % 4 AS b FROM lineitem)""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("lambda"), F.col("l_quantity").alias("days"),
        (F.col("l_linenumber") % 2).alias("is_poisson"), (F.col("l_linenumber") % 2).alias("insites_is_one_founder"),
        (F.floor(F.col("l_discount") * 100 + 0.5) % 4).alias("nbases"),
    )
    return sc.results_zero_variation_rule(rows)


@query("select_columns_by_pattern", "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def _(spark, d):
    return sc.select_columns_by_pattern(
        table(spark, d, "lineitem"), keep=["price", "quantity", "discount", "tax"], drop=["key$"], always=["l_orderkey"]
    )


@query("filter_results_rows", """
SELECT regexp_replace(p_type, '^(\\w+) ', '\\1.') AS label, p_partkey FROM part
WHERE NOT regexp_matches(p_type, 'PROMO') ORDER BY p_partkey""")
def _(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("label"), "p_partkey")
    return sc.filter_results_rows(rows, "label", ["PROMO"], [(r"^(\w+) ", "$1.")], F.col("p_partkey").asc())


@query("pretty_p_value", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN p IS NULL THEN '' WHEN printf('%.4f', p) = '0.0000' THEN '<0.0001' ELSE printf('%.4f', p) END AS p_text
FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax / (l_quantity * l_quantity) END AS p FROM lineitem)""")
def _(spark, d):
    p = F.when(F.col("l_linenumber") != 7, F.col("l_tax") / (F.col("l_quantity") * F.col("l_quantity")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sc.pretty_p_value(p).alias("p_text"))
