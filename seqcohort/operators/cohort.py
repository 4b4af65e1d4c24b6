"""Participant-level aggregation, pooling of result tables, founder scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcohort.functions import formulas as fm
from seqcohort.operators.ranks import exact_quantiles
from seqcohort.session import settle


def weighted_mean(x: Column, w: Column, renormalize: bool = False) -> Column:
    """Aggregate sum(x w) / sum(w). By default the weight of a row without a value still
    counts; ``renormalize`` leaves it out. No value at all gives NULL."""
    total = F.sum(F.when(x.isNotNull(), w)) if renormalize else F.sum(w)
    return F.when(F.count(x) > 0, F.try_divide(F.sum(x * w), total))


def weighted_mean_per_person(df: DataFrame, values: Sequence[str], weight: Column, keys: Sequence[str] = ("ptid",),
                             renormalize: bool = False) -> DataFrame:
    return df.groupBy(*keys).agg(*[weighted_mean(F.col(v), weight, renormalize).alias(v) for v in values])


def all_true(x: Column) -> Column:
    """AND over rows that is NULL when nothing is false but something is missing."""
    return (
        F.when(F.count_if(x == 0) > 0, 0).when(F.count_if(x.isNull()) > 0, F.lit(None)).otherwise(1)
    )


def all_single_per_person(df: DataFrame, flag: str, keys: Sequence[str] = ("ptid",)) -> DataFrame:
    return df.groupBy(*keys).agg(all_true(F.col(flag)).alias(flag))


def summarize_covariates(
    df: DataFrame, constant: Sequence[str] = (), weighted: Mapping[str, str] | None = None,
    flags: Sequence[str] = (), minimum: Sequence[str] = (), maximum: Sequence[str] = (),
    keys: Sequence[str] = ("ptid",),
) -> DataFrame:
    """One row per person: constants (two different values are an error), means weighted
    by the named column, flags combined with AND, minima and maxima."""
    aggs = []
    for c in constant:
        one = F.when(F.min(c) == F.max(c), F.max(c)).when(F.max(c).isNull(), F.max(c)).otherwise(
            F.raise_error(F.lit(f"{c} differs within a person")).cast(df.schema[c].dataType)
        )
        aggs.append(one.alias(c))
    aggs += [weighted_mean(F.col(c), F.col(w)).alias(c) for c, w in (weighted or {}).items()]
    aggs += [all_true(F.col(c)).alias(c) for c in flags]
    aggs += [F.min(c).alias(c) for c in minimum] + [F.max(c).alias(c) for c in maximum]
    return df.groupBy(*keys).agg(*aggs)


def rate_coefficients(df: DataFrame, lam: str = "lambda", nbases: str = "nbases", nseq: str = "nseq") -> DataFrame:
    return df.withColumns(
        {
            "rate_coefficient": fm.rate_coefficient(F.col(lam), F.col(nbases)),
            "total_bases": F.col(nseq) * F.col(nbases),
        }
    )


def depth_equivalents(df: DataFrame, file: str = "file", n: str = "num_seqs", keys: Sequence[str] = ("ptid",)) -> DataFrame:
    """Full-genome equivalents: half-genome files count half, env files not at all."""
    share = (
        F.when(F.col(file).rlike(r"_env\.fasta$"), 0.0).when(F.col(file).rlike("_[RL]H"), 0.5)
        .when(F.col(file).rlike("_NFLG"), 1.0).otherwise(0.0)
    )
    return df.groupBy(*keys).agg(F.sum(F.col(n) * share).alias("depth"))


def widths_by_part(df: DataFrame, part: str = "genome_part", width: str = "nbases", keys: Sequence[str] = ("ptid",),
                   parts: Sequence[str] = ("nflg", "lh", "rh")) -> DataFrame:
    return df.groupBy(*keys).pivot(part, list(parts)).agg(F.max(width))


# --- founder scores ---------------------------------------------------------------------


def nearest_founder_scores(distances: DataFrame, on: Sequence[str] = ("ptid",), estimate: str = "estimate_id",
                           truth: str = "truth_id") -> DataFrame:
    """For each truth its nearest estimate (smallest share of differing sites, first on
    ties) and for each estimate its nearest truth, summed per key, in both gap modes. The
    minimum combines on the map side, so a truth with many estimates is no hot spot."""
    distances = settle(distances)  # compared once, then read from either side
    modes = ("inc", "ign")

    def best(mode: str, other: str) -> Column:
        share = F.try_divide(F.col(f"hd_{mode}"), F.col(f"n_{mode}"))
        order = F.struct(share.isNull().alias("m"), share.alias("s"), F.col(other).alias("o"))
        return F.min_by(F.struct(F.col(f"hd_{mode}").alias("hd"), F.col(f"n_{mode}").alias("n")), order)

    out = []
    for side, own, other in (("truth", truth, estimate), ("estimate", estimate, truth)):
        sums = distances.groupBy(*on, own).agg(*[best(m, other).alias(m) for m in modes]).groupBy(*on).agg(
            *[F.sum(f"{m}.{c}").alias(f"{m}_{c}") for m in modes for c in ("hd", "n")]
        )
        rows = F.array(*[F.struct(F.lit(m).alias("gaps"), F.col(f"{m}_hd").alias("hd"), F.col(f"{m}_n").alias("compared")) for m in modes])
        out.append(sums.select(*on, F.lit(side).alias("perspective"), F.inline(rows)).withColumn("share", F.try_divide("hd", "compared")))
    return reduce(DataFrame.unionByName, out)


def match_gold_multiplicity(df: DataFrame, gold: str = "gold_is_multiple", truth: str = "truth_is_multiple",
                            estimate: str = "estimate_is_multiple", keys: Sequence[str] = ("ptid",)) -> DataFrame:
    """Per person the rows of the best match with the gold multiplicity: truth and estimate,
    then truth alone, estimate alone, neither."""
    t, e = F.col(truth) == F.col(gold), F.col(estimate) == F.col(gold)
    ranked = df.withColumn("match_rank", F.when(t & e, 1).when(t, 2).when(e, 3).otherwise(4))
    best = ranked.groupBy(*keys).agg(F.min("match_rank").alias("match_rank"))
    return ranked.join(best, [*keys, "match_rank"], "left_semi")


def genome_wide_sum(long: DataFrame, keys: Sequence[str] = ("ptid", "metric"), value: str = "value") -> DataFrame:
    """Sum of a metric over genes, from long form."""
    return long.groupBy(*keys).agg(F.sum(value).alias(value))


def founder_hd_per_person(scores: DataFrame, keys: Sequence[str] = ("ptid", "gaps")) -> DataFrame:
    """Share of differing sites per person and perspective, then their mean."""
    each = scores.groupBy(*keys, "perspective").agg(F.try_divide(F.sum("hd"), F.sum("compared")).alias("share"))
    return each.groupBy(*keys).agg(
        F.max(F.when(F.col("perspective") == "truth", F.col("share"))).alias("truth_share"),
        F.max(F.when(F.col("perspective") == "estimate", F.col("share"))).alias("estimate_share"),
        F.avg("share").alias("mean_share"),
    )


def results_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spread of each result column: exact quantiles for any number of rows."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("v")) for c in columns
    ])).alias("_r")).select("_r.stat", "_r.v")
    moments = long.groupBy("stat").agg(
        F.count("v").alias("n"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"),
        F.stddev_samp("v").alias("sd"), F.avg((F.col("v") == 0).cast("double")).alias("zero_share"),
    )
    quantiles = exact_quantiles(long, ["stat"], "v", (0.25, 0.5, 0.75), ("q1", "median", "q3"))
    return moments.join(quantiles, "stat", "left")


def group_pivot_rows_to_columns(df: DataFrame, label: str, pattern: str, kinds: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows labelled base + kind become one row per base with a column group per kind."""
    kind = F.regexp_extract(label, pattern, 0)
    return (
        df.withColumn("_kind", kind).withColumn(label, F.regexp_replace(label, pattern, ""))
        .groupBy(label).pivot("_kind", list(kinds))
        .agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])
    )


# --- pooling ----------------------------------------------------------------------------


def pool_times(by_time: Mapping[str, DataFrame], late: str = "6m") -> DataFrame:
    """Union over times with missing columns NULL, the time as key and a late flag."""
    tagged = [
        df.withColumns({"time": F.lit(t), f"{late}_not_early": F.lit(1 if t == late else 0)}) for t, df in by_time.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def pool_regions(df: DataFrame, region: str = "region", skip: Sequence[tuple[str, str]] = (("nflg", "rv217_v3"),),
                 regions: Sequence[str] | None = None) -> DataFrame:
    """Every ordered region pair ``from < to`` pooled, with a flag for the second one. Rows
    are repeated once per pair their region takes part in; the regions are a short list."""
    if regions is None:
        regions = sorted(r[0] for r in df.select(region).distinct().collect())
    pairs = [(a, b) for i, a in enumerate(regions) for b in regions[i + 1:] if (a, b) not in skip and (b, a) not in skip]
    tags = F.array(*[F.struct(F.lit(a).alias("f"), F.lit(b).alias("t")) for a, b in pairs])
    mine = F.filter(tags, lambda p: (p["f"] == F.col(region)) | (p["t"] == F.col(region)))
    return df.withColumn("_p", F.explode(mine)).withColumns(
        {
            "region_pair": F.concat_ws("_", "_p.f", "_p.t"),
            "to_not_from": (F.col("_p.t") == F.col(region)).cast("int"),
        }
    ).drop("_p")


def outer_cbind(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "full_outer")


def merge_equivalent_rows(df: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    """Rows with one label collapse to the single non-missing value of each column; two
    different values are an error."""
    def one(v: str) -> Column:
        return F.when(F.min(v).eqNullSafe(F.max(v)), F.max(v)).otherwise(
            F.raise_error(F.concat(F.lit(f"{v} is not unique for "), F.first(label))).cast(df.schema[v].dataType)
        ).alias(v)

    return df.groupBy(label).agg(*[one(v) for v in values])


def combine_configurations(df: DataFrame, row: str, config: str, code: str, value: str, codes: Sequence[str],
                           configs: Sequence[str], shared_code: str = "none") -> DataFrame:
    """Results of several model configurations side by side: chosen training codes, one
    column per (configuration, code), and one shared uncalibrated column."""
    kept = df.filter(F.col(code).isin(*codes, shared_code))
    label = F.when(F.col(code) == shared_code, F.lit("uncalibrated")).otherwise(F.concat_ws("+", code, config))
    names = ["uncalibrated"] + [f"{c}+{k}" for k in configs for c in codes]
    return kept.withColumn("_l", label).groupBy(row).pivot("_l", names).agg(F.first(value, ignorenulls=True))
