"""The distance fit of a sample, plain, within clusters, pooled over regions, or masked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcohort.operators import dedup as dd
from seqcohort.operators import founder as fo
from seqcohort.operators import pairs as pr
from seqcohort.operators import scalars as sc
from seqcohort.operators import sites as st
from seqcohort.session import settle

KEYS = ("sample_id",)


def _pool(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    return hist.groupBy(*keys, "hd").agg(F.sum("n").alias("n"))


def poisson_fit(
    df: DataFrame, keys: Sequence[str] = KEYS, within: Sequence[str] = (), idx: str = "seq_idx",
    name: str = "seq_name", seq: str = "seq", include_gaps: bool = False, goodness: bool = True,
) -> DataFrame:
    """Rate, sd, days with interval, star check and goodness of fit, one row per ``keys``.

    ``within`` names columns (cluster, region part) inside which pairs are formed; their
    histograms are pooled per ``keys``. Duplicates are collapsed before any distance is
    taken, and sites where the consensus is a gap are dropped.
    """
    keys, inner = list(keys), [*keys, *within]
    consensus = st.majority_consensus(df, inner, seq)
    unique = dd.exact_dedup(df, inner, name, idx, seq)
    compact = settle(sc.drop_consensus_gap_columns(unique, consensus, inner, seq))
    cons = compact.groupBy(*inner).agg(F.first("cons").alias("cons"))
    rows = compact.select(*inner, idx, seq, "mult")
    cons_hist = _pool(fo.consensus_histogram(pr.consensus_distance(rows, cons, inner, seq, include_gaps=include_gaps), inner), keys)
    stats = settle(pr.pair_statistics(rows, inner, idx, seq, "mult", include_gaps))
    between = pr.statistics_histogram(stats, inner)
    pair_hist = _pool(fo.distance_histogram(rows, inner, idx, seq, "mult", include_gaps, between), keys)
    centres = pr.statistics_centres(stats, inner)
    if goodness:
        cons_hist, pair_hist = settle(cons_hist), settle(pair_hist)
    lengths = rows.groupBy(*inner).agg(F.max(F.length(seq)).alias("len"), F.sum("mult").alias("n"))
    nbases = (
        pr.effective_length(lengths, keys) if within
        else lengths.select(*keys, F.col("len").cast("double").alias("nbases"))
    )
    lam = fo.poisson_lambda(pair_hist, keys)
    cons_lam = fo.poisson_lambda(cons_hist, keys).select(*keys, F.col("lambda").alias("cons_lambda"))
    sd = fo.distance_sd_ustat(centres, keys)
    out = lam.join(sd, keys, "left").join(cons_lam, keys, "left").join(nbases, keys, "left")
    out = out.select("*", *fo.days_confidence_interval(F.col("lambda"), F.col("sd"), F.col("nbases")))
    if goodness:
        out = out.join(fo.star_convolution(cons_hist, pair_hist, keys), keys, "left").join(
            fo.poisson_goodness(cons_hist, pair_hist, keys), keys, "left"
        ).join(fo.star_rate_test(cons_hist, pair_hist, keys), keys, "left")
    return fo.degenerate_sample_rule(out)


def synonymous_fit(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", **kw) -> DataFrame:
    """The fit on synonymous differences: codons whose amino acid differs are masked."""
    consensus = st.majority_consensus(df, keys, seq)
    return poisson_fit(sc.mask_codons(df, consensus, "synonymous", keys, seq), keys, seq=seq, **kw)


def multifounder_fit(df: DataFrame, clusters: DataFrame, keys: Sequence[str] = KEYS, idx: str = "seq_idx", **kw) -> DataFrame:
    """The fit with pairs inside clusters only."""
    keys = list(keys)
    return poisson_fit(df.join(clusters.withColumnRenamed("idx", idx), [*keys, idx]), keys, ["cluster"], idx, **kw)


def region_pooled_fit(df: DataFrame, base: str = "base_name", part: str = "genome_part",
                      cluster: str | None = None, **kw) -> DataFrame:
    """Sibling region samples of one base name fitted together, pairs inside regions."""
    return poisson_fit(df, [base], [part] + ([cluster] if cluster else []), **kw)
