"""Registered queries: distances, duplicate handling, clustering, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqcohort.operators import dedup as dd
from seqcohort.operators import founder as fo
from seqcohort.operators import joins as jn
from seqcohort.operators import linkage as lk
from seqcohort.operators import pairs as pr
from seqcohort.operators import scalars as sc
from seqcohort.operators import sites as st
from seqcohort.plans.catalog import query
from seqcohort.plans.inputs import CONS_SQL, PAIRS_SQL, SITES_SQL, UNIQUE_SQL, aln_sql, alignment, sql, table
from seqcohort.plans.queries_scalars import HEADED, headed
from seqcohort.session import settle

ALN, DOC = aln_sql("part"), aln_sql("doc")


def unique(spark, d, by="part"):
    return dd.exact_dedup(alignment(spark, d, by))


@query("pairwise_hamming", sql(ALN, UNIQUE_SQL, PAIRS_SQL, select="""
SELECT sample_id, a, b, hd::INT AS hd, compared::INT AS compared FROM pairs"""))
def _(spark, d):
    return pr.near_pairs(unique(spark, d)).select("sample_id", "a", "b", "hd", "compared")


@query("gap_difference", sql(DOC, UNIQUE_SQL, PAIRS_SQL, select="""
SELECT sample_id, a, b, hd + gap_difference AS distance, gap_difference FROM pairs WHERE hd + gap_difference <= 32"""))
def _(spark, d):
    near = pr.near_pairs(unique(spark, d, "doc"), 32, include_gaps=True)
    return near.select("sample_id", "a", "b", (F.col("hd") + F.col("gap_difference")).alias("distance"), "gap_difference")


@query("pair_histogram", sql(ALN, UNIQUE_SQL, PAIRS_SQL, select="""
SELECT sample_id, hd::INT AS hd, compared::INT AS compared, sum(ma * mb)::BIGINT AS n, count(*) AS n_pairs FROM pairs GROUP BY ALL"""))
def _(spark, d):
    return pr.pair_histogram(unique(spark, d), mult="mult", with_compared=True)


CONS_PLANES = """
cons_planes AS (
  SELECT sample_id, {planes} FROM (SELECT sample_id, cons AS seq FROM cons))"""


def _cons_planes() -> str:
    from seqcohort.plans.inputs import _known, _plane

    return CONS_PLANES.format(planes=", ".join([*[_plane(b) for b in "acgt"], _known()]))


CONS_DIST = f"""{_cons_planes()},
cons_dist AS (
  SELECT x.sample_id, x.idx, x.mult,
         bit_count((x.pk & y.pk) & ~((x.pa & y.pa) | (x.pc & y.pc) | (x.pg & y.pg) | (x.pt & y.pt)))::INT AS hd,
         bit_count(x.pk & y.pk)::INT AS compared
  FROM planes x JOIN cons_planes y ON x.sample_id = y.sample_id)"""


@query("consensus_distance", sql(ALN, SITES_SQL, CONS_SQL, UNIQUE_SQL, CONS_DIST, select="""
SELECT sample_id, idx AS seq_idx, mult, hd, compared FROM cons_dist"""))
def _(spark, d):
    rows = alignment(spark, d)
    return pr.consensus_distance(dd.exact_dedup(rows), st.majority_consensus(rows)).select(
        "sample_id", "seq_idx", "mult", "hd", "compared"
    )


@query("nearest_pairs", sql(DOC, UNIQUE_SQL, PAIRS_SQL, select="""
, ways AS (SELECT sample_id, a AS idx, hd, b AS nearest FROM pairs UNION ALL SELECT sample_id, b, hd, a FROM pairs)
SELECT sample_id, idx, min(hd)::INT AS hd, arg_min(nearest, hd * 1000000000000 + nearest) AS nearest FROM ways GROUP BY ALL"""))
def _(spark, d):
    return pr.nearest_pairs(unique(spark, d, "doc"))


# pairs inside language clusters, pooled per source
@query("cluster_restricted_pairs", sql(ALN, UNIQUE_SQL, PAIRS_SQL, select="""
, p AS (SELECT split_part(sample_id, '_', 1) AS ptid, hd::INT AS hd, sum(ma * mb)::BIGINT AS n FROM pairs GROUP BY ALL),
w AS (SELECT ptid, sum(60 * n * (n - 1) / 2) / sum(n * (n - 1) / 2) AS nbases
      FROM (SELECT split_part(sample_id, '_', 1) AS ptid, sum(mult) AS n FROM uniq GROUP BY ptid, sample_id) GROUP BY ptid)
SELECT ptid, hd, n, nbases FROM p JOIN w USING (ptid)"""))
def _(spark, d):
    rows = dd.exact_dedup(alignment(spark, d), ["ptid", "region"])
    hist = pr.pair_histogram(rows, ["ptid", "region"], mult="mult").groupBy("ptid", "hd").agg(F.sum("n").alias("n"))
    lengths = rows.groupBy("ptid", "region").agg(F.max(F.length("seq")).alias("len"), F.sum("mult").alias("n"))
    return hist.join(pr.effective_length(lengths, ["ptid"]), "ptid")


POOLED_UNIQUE = UNIQUE_SQL.replace("FROM aln GROUP BY", "FROM pooled GROUP BY")


@query("region_pooled_pairs", sql(DOC, HEADED, """
pooled AS (SELECT split.sample_id, split.seq_idx, split.seq_name, aln.seq FROM split JOIN aln USING (seq_idx))""",
       POOLED_UNIQUE, PAIRS_SQL, select="""
SELECT regexp_replace(sample_id, '_(?:[LR]H|NFLG|env).*$', '') AS base_name, hd::INT AS hd, sum(ma * mb)::BIGINT AS n
FROM pairs GROUP BY ALL"""))
def _(spark, d):
    # both are read several times
    rows = settle(headed(spark, d).select("sample_id", "seq_idx", "seq_name", "seq"))
    parts = sc.split_by_header_pattern(rows).withColumn("base_name", sc.base_sample_name(F.col("sample_id")))
    keys = ["base_name", "sample_id"]
    hist = pr.pair_histogram(settle(dd.exact_dedup(parts, keys).drop("seq_name")), keys, mult="mult")
    return hist.groupBy("base_name", "hd").agg(F.sum("n").alias("n"))


@query("expand_multiplicity", sql(ALN, SITES_SQL, CONS_SQL, UNIQUE_SQL, CONS_DIST, select="""
SELECT sample_id, hd FROM (SELECT sample_id, hd, unnest(range(0, mult)) FROM cons_dist)"""))
def _(spark, d):
    rows = alignment(spark, d)
    dist = pr.consensus_distance(dd.exact_dedup(rows), st.majority_consensus(rows))
    return pr.expand_multiplicity(fo.consensus_histogram(dist))


# --- duplicates -------------------------------------------------------------------------


@query("exact_dedup", sql(ALN, select="""
SELECT sample_id, min(seq_idx) AS seq_idx, arg_min(seq_name, seq_idx) AS seq_name, seq, count(*) AS mult FROM aln GROUP BY sample_id, seq"""))
def _(spark, d):
    return unique(spark, d)


@query("duplicate_map", sql(ALN, select="""
SELECT sample_id, arg_min(seq_name, seq_idx) OVER (PARTITION BY sample_id, seq) AS kept, seq_name AS dup FROM aln"""))
def _(spark, d):
    return dd.duplicate_map(alignment(spark, d))


@query("duplicate_summary", sql(ALN, UNIQUE_SQL, select="""
SELECT sample_id, mult AS copies, count(*) AS n_unique, sum(mult - 1)::BIGINT AS n_removed FROM uniq GROUP BY ALL"""))
def _(spark, d):
    return dd.duplicate_summary(unique(spark, d))


@query("with_copy_number", sql(ALN, UNIQUE_SQL, select="SELECT sample_id, seq_name || '_' || mult AS seq_name, mult FROM uniq"))
def _(spark, d):
    return dd.with_copy_number(unique(spark, d)).select("sample_id", "seq_name", "mult")


# the greedy order around ambiguity codes is not expressed in SQL, so the whole alignment has none
@query("distance_dedup")
def _(spark, d):
    return dd.distance_dedup(alignment(spark, d), 0)


@query("distance_dedup_plain", sql(ALN, select="""
SELECT sample_id, seq_idx AS idx, min(seq_idx) OVER w AS rep FROM (SELECT sample_id, seq_idx, translate(seq, 'rykn', '----') AS seq FROM aln)
WINDOW w AS (PARTITION BY sample_id, seq) QUALIFY seq_idx <> min(seq_idx) OVER w"""))
def _(spark, d):
    plain = alignment(spark, d).withColumn("seq", F.translate("seq", "rykn", "----"))
    return dd.distance_dedup(plain, 0)


@query("distance_dedup_near")
def _(spark, d):
    return dd.distance_dedup(alignment(spark, d), 20)


@query("dedup_to_max")
def _(spark, d):
    return dd.dedup_to_max(alignment(spark, d, "doc"), 20)


@query("cluster_by_distance")
def _(spark, d):
    return dd.cluster_by_distance(alignment(spark, d), 20)


@query("cluster_by_linkage")
def _(spark, d):
    return lk.cluster_by_linkage(alignment(spark, d, "doc"))


@query("cluster_consensus", sql(ALN, SITES_SQL, """
both_n AS (
  SELECT source AS ptid, lang AS cluster, pos, base, count(*) AS n
  FROM (SELECT ptid AS source, region AS lang, unnest(range(1, 61)) AS pos, substr(seq, pos, 1) AS base FROM aln) GROUP BY ALL
  UNION ALL
  SELECT ptid, '0', pos, base, count(*) FROM (SELECT ptid, unnest(range(1, 61)) AS pos, substr(seq, pos, 1) AS base FROM aln) GROUP BY ALL),
top AS (SELECT * FROM both_n QUALIFY row_number() OVER (PARTITION BY ptid, cluster, pos ORDER BY n DESC, base) = 1)""",
       select="SELECT ptid, cluster, string_agg(base, '' ORDER BY pos) AS cons FROM top GROUP BY ptid, cluster"))
def _(spark, d):
    rows = alignment(spark, d)
    clusters = rows.select("ptid", F.col("seq_idx").alias("idx"), F.col("region").alias("cluster"))
    return dd.cluster_consensus(rows, clusters, ["ptid"])


@query("span_filter", """
WITH s AS (
  SELECT i - 1 AS dim, (max(v) - min(v))::DOUBLE AS span
  FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)
SELECT dim, round(span, 6) AS span, span > (SELECT min(span) + 0.01 * (max(span) - min(span)) FROM s) AS kept FROM s""")
def _(spark, d):
    return dd.span_filter(table(spark, d, "embeddings")).withColumn("span", F.round("span", 6))


@query("pairwise_euclidean", """
WITH s AS (
  SELECT i, max(v)::DOUBLE - min(v) AS span FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i),
k AS (SELECT i FROM s WHERE span > (SELECT min(span) + 0.01 * (max(span) - min(span)) FROM s)),
e AS (
  SELECT label, vec_id, list(v ORDER BY i) AS v FROM (
    SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
  WHERE i IN (SELECT i FROM k) GROUP BY ALL),
p AS (
  SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_distance(x.v, y.v) AS distance
  FROM e x JOIN e y ON x.label = y.label AND x.vec_id < y.vec_id)
SELECT label, a, b, round(distance, 5) AS distance FROM p WHERE distance <= 1.2""")
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    near = pr.near_vectors(dd.keep_dimensions(vectors, dd.span_filter(vectors)), 1.2, ["label"], "vec_id")
    return near.withColumn("distance", F.round("distance", 5))


# --- joins ------------------------------------------------------------------------------


@query("reduplicate", sql(ALN, select="SELECT sample_id, seq_name, seq FROM aln"))
def _(spark, d):
    rows = alignment(spark, d)
    kept = dd.exact_dedup(rows).select("sample_id", "seq_name", "seq")
    return jn.reduplicate(kept, dd.duplicate_map(rows))["sequences"].select("sample_id", "seq_name", "seq")


@query("propagate_exclusion", sql(ALN, select="SELECT sample_id, seq_name FROM aln WHERE contains(seq, 'n')"))
def _(spark, d):
    rows = alignment(spark, d)
    bad = dd.exact_dedup(rows).filter(F.col("seq").contains("n")).select("sample_id", "seq_name")
    return fo.propagate_exclusion(bad, dd.duplicate_map(rows))


@query("exclude_listed", sql(ALN, select="""
SELECT sample_id, seq_idx FROM aln WHERE seq_idx // 100000 NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax / l_extendedprice < 0.0000007)"""))
def _(spark, d):
    rows = alignment(spark, d)
    listed = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"),
        F.concat(F.lit("p="), (F.col("l_tax") / F.col("l_extendedprice")).cast("string")).alias("p"),
    )
    kept = jn.exclude_listed(rows.withColumn("doc", F.floor(F.col("seq_idx") / 100000)), listed, 0.0000007, ["doc"])
    return kept.select("sample_id", "seq_idx")


@query("days_since_infection", """
WITH gold AS (SELECT o_custkey AS ptid, min(o_orderdate)::DATE AS infection_date FROM orders GROUP BY 1)
SELECT o_orderkey, o_custkey AS ptid, date_diff('day', infection_date, o_orderdate::DATE) AS days
FROM orders JOIN gold ON o_custkey = ptid""")
def _(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("ptid"), F.col("o_orderdate").cast("date").alias("sample_date")
    )
    gold = o.groupBy("ptid").agg(F.min("sample_date").alias("infection_date"))
    return jn.days_since_infection(o, gold).select("o_orderkey", "ptid", "days")


@query("attach_viral_load", """
SELECT l_orderkey, l_linenumber, round(ln(nullif(v, 0)), 6) AS lpvl FROM lineitem LEFT JOIN (
  SELECT l_suppkey AS p, l_linenumber AS t, max(l_quantity) AS v FROM lineitem GROUP BY ALL)
ON l_partkey = p AND l_linenumber = t""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select("l_orderkey", F.col("l_partkey").alias("ptid"), F.col("l_linenumber").alias("timepoint"))
    loads = li.groupBy(F.col("l_suppkey").alias("ptid"), F.col("l_linenumber").alias("timepoint")).agg(
        F.max("l_quantity").alias("viralload"))
    return jn.attach_viral_load(rows, loads).select(
        "l_orderkey", F.col("timepoint").alias("l_linenumber"), F.round("lpvl", 6).alias("lpvl")
    )


def event_bounds(spark, d):
    """Per user: an interval from the spread of the values of its events."""
    e = table(spark, d, "events")
    lo, hi = F.floor(F.avg("value") - F.stddev_samp("value")), F.ceil(F.avg("value") + F.stddev_samp("value"))
    return e.groupBy(F.col("user_id").alias("ptid")).agg(lo.cast("double").alias("lower"), hi.cast("double").alias("upper"))


BOUNDS = """
bounds AS (
  SELECT user_id AS ptid, floor(avg(value) - stddev_samp(value)) AS lower, ceil(avg(value) + stddev_samp(value)) AS upper
  FROM events GROUP BY 1)"""


@query("clip_to_bounds", sql(BOUNDS, select="""
SELECT event_id, least(greatest(coalesce(v, lower), lower), upper) AS value
FROM (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) JOIN bounds ON ptid = user_id"""))
def _(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("ptid"), F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )
    return jn.clip_to_bounds(e, event_bounds(spark, d), "value").select("event_id", "value")


@query("center_of_bounds", sql(BOUNDS, select="""
SELECT ptid, lower, upper, round_even((lower + upper) / 2, 0) AS center_of_bounds FROM bounds"""))
def _(spark, d):
    return jn.center_of_bounds(event_bounds(spark, d))


def founders(spark, d):
    """Estimates: one consensus per document. Truths: one per language of the source."""
    rows = alignment(spark, d, "doc")
    est = st.majority_consensus(rows, ["ptid", "sample_id"]).select(
        "ptid", F.substr("sample_id", F.lit(2)).cast("bigint").alias("estimate_id"), F.col("cons").alias("seq"))
    tru = st.majority_consensus(rows, ["ptid", "region"]).select("ptid", F.col("region").alias("truth_id"), F.col("cons").alias("seq"))
    return est, tru


def _cons_of(name: str, key: str, out: str) -> str:
    return f"""
{name} AS (
  SELECT ptid, k AS {out}, string_agg(base, '' ORDER BY pos) AS seq FROM (
    SELECT ptid, k, pos, base FROM (
      SELECT ptid, {key} AS k, unnest(range(1, 61)) AS pos, substr(seq, pos, 1) AS base FROM aln)
    GROUP BY ptid, k, pos, base QUALIFY row_number() OVER (PARTITION BY ptid, k, pos ORDER BY count(*) DESC, base) = 1)
  GROUP BY ptid, k)"""


def _planes_of(name: str, src: str, key: str) -> str:
    from seqcohort.plans.inputs import _known, _plane

    return f"{name} AS (SELECT ptid, {key}, {', '.join([*[_plane(b) for b in 'acgt'], _known()])} FROM {src})"


FOUNDERS = ",".join([
    _cons_of("est", "CAST(substr(sample_id, 2) AS BIGINT)", "estimate_id"), _cons_of("tru", "region", "truth_id"),
    _planes_of("estp", "est", "estimate_id"), _planes_of("trup", "tru", "truth_id"), """
et AS (
  SELECT x.ptid, estimate_id, truth_id,
         bit_count((x.pk & y.pk) & ~((x.pa & y.pa) | (x.pc & y.pc) | (x.pg & y.pg) | (x.pt & y.pt)))::BIGINT AS hd_ign,
         bit_count(x.pk & y.pk)::BIGINT AS n_ign, bit_count(xor(x.pk, y.pk))::BIGINT AS gd
  FROM estp x JOIN trup y USING (ptid)),
dist AS (SELECT ptid, estimate_id, truth_id, hd_ign + gd AS hd_inc, n_ign + gd AS n_inc, hd_ign, n_ign FROM et)"""])


@query("estimate_truth_distances", sql(DOC, FOUNDERS, select="SELECT * FROM dist"))
def _(spark, d):
    return jn.estimate_truth_distances(*founders(spark, d))


@query("pair_estimate_truth_files", """
SELECT DISTINCT o_custkey AS ptid, estimate_type, truth_type FROM orders,
  (VALUES ('single'), ('multiple')) e(estimate_type), (VALUES ('single'), ('multiple')) t(truth_type)""")
def _(spark, d):
    return jn.pair_estimate_truth_files(table(spark, d, "orders").select(F.col("o_custkey").alias("ptid")).distinct())


@query("shared_ids", """
WITH a AS (SELECT DISTINCT user_id AS ptid FROM events), b AS (SELECT DISTINCT o_custkey AS ptid FROM orders)
SELECT coalesce(a.ptid, b.ptid) AS ptid, CASE WHEN a.ptid IS NULL THEN 'only_b' WHEN b.ptid IS NULL THEN 'only_a' ELSE 'both' END AS found_in
FROM a FULL JOIN b ON a.ptid = b.ptid""")
def _(spark, d):
    return jn.shared_ids(
        table(spark, d, "events").select(F.col("user_id").alias("ptid")),
        table(spark, d, "orders").select(F.col("o_custkey").alias("ptid")),
    )
