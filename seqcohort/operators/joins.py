"""Joins of sequences with duplicate maps and exclusion lists, and of result rows with
dates, viral loads, bounds and true founders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcohort.functions import formulas as fm
from seqcohort.operators import pairs as pr

KEYS = ("sample_id",)
RECOMBINANT_P = 0.0007  # Fixed value: p below which a listed recombinant is dropped.


def reduplicate(
    kept: DataFrame, duplicates: DataFrame, keys: Sequence[str] = KEYS, name: str = "seq_name",
    but_first_remove: DataFrame | None = None, strip_suffix: bool = False,
) -> dict[str, DataFrame]:
    """Bring removed duplicates back under their own names. ``sequences`` is the result;
    ``orphans`` are inputs the map does not know, ``not_found`` map entries without input.

    ``strip_suffix`` drops a ``_n`` copy number from the input names first; see
    ``names_carry_copies`` for when that is needed.
    """
    keys = list(keys)
    if but_first_remove is not None:
        kept = kept.join(but_first_remove.select(*keys, name), [*keys, name], "left_anti")
    if strip_suffix:
        kept = kept.withColumn(name, F.regexp_replace(name, "_[0-9]+$", ""))
    left = kept.withColumnRenamed(name, "kept")
    return {
        "sequences": duplicates.join(left, [*keys, "kept"]).withColumnRenamed("dup", name).drop("kept"),
        "orphans": left.join(duplicates.select(*keys, "kept"), [*keys, "kept"], "left_anti").select(*keys, "kept"),
        "not_found": duplicates.join(left.select(*keys, "kept"), [*keys, "kept"], "left_anti"),
    }


def names_carry_copies(kept: DataFrame, duplicates: DataFrame, keys: Sequence[str] = KEYS, name: str = "seq_name") -> DataFrame:
    """One row: do more input names match the map after dropping a copy-number suffix?"""
    keys = list(keys)
    known = duplicates.select(*keys, "kept").distinct()
    plain = kept.select(*keys, F.col(name).alias("kept"), F.lit(1).alias("_plain"))
    stripped = kept.select(*keys, F.regexp_replace(name, "_[0-9]+$", "").alias("kept"), F.lit(0).alias("_plain"))
    return plain.unionByName(stripped).join(known, [*keys, "kept"], "left_semi").agg(
        (F.count_if(F.col("_plain") == 0) > F.count_if(F.col("_plain") == 1)).alias("strip_suffix")
    )


def exclude_listed(
    df: DataFrame, listed: DataFrame, threshold: float = RECOMBINANT_P, on: Sequence[str] = ("sample_id", "seq_idx"),
    p: str = "p",
) -> DataFrame:
    """Drop sequences an external table lists with a p below the threshold. The p text is
    compared as a number; entries without a number do not exclude."""
    value = F.regexp_extract(F.col(p).cast("string"), r"([0-9.]+(?:[eE][-+]?[0-9]+)?)", 1)
    bad = listed.filter(F.when(value != "", value).try_cast("double") < threshold).select(*on)
    return df.join(bad, list(on), "left_anti")


def days_since_infection(samples: DataFrame, gold: DataFrame, ptid: str = "ptid", date: str = "sample_date",
                         infected: str = "infection_date") -> DataFrame:
    """Days from the true infection date to the sample date; rows without a numeric
    participant or a date are left out."""
    valid = samples.filter(F.col(ptid).cast("string").rlike("^[0-9]+$") & F.col(date).isNotNull())
    return valid.join(gold, ptid).withColumn("days", F.datediff(date, infected).cast("bigint"))


def attach_viral_load(df: DataFrame, loads: DataFrame, on: Sequence[str] = ("ptid", "timepoint"), load: str = "viralload") -> DataFrame:
    """Natural log of the viral load at the same time point."""
    value = F.when(F.col(load) > 0, F.ln(load)).alias("lpvl")
    return df.join(loads.select(*on, value), list(on), "left")


def clip_to_bounds(df: DataFrame, bounds: DataFrame, value: str, on: Sequence[str] = ("ptid",), strict: bool = True) -> DataFrame:
    """Estimates moved into their participant's interval; a missing estimate becomes the
    lower bound. A participant without bounds is an error unless ``strict`` is off."""
    joined = df.join(bounds.select(*on, "lower", "upper"), list(on), "left")
    clipped = fm.clip(F.col(value), F.col("lower"), F.col("upper"))
    if strict:
        clipped = F.when(
            F.col("lower").isNull() | F.col("upper").isNull(),
            F.raise_error(F.concat(F.lit("no bounds for "), *[F.col(k).cast("string") for k in on])).cast("double"),
        ).otherwise(clipped)
    return joined.withColumn(value, clipped)


def center_of_bounds(bounds: DataFrame) -> DataFrame:
    """Middle of the interval, rounded half to even, as an estimator of its own."""
    return bounds.withColumn("center_of_bounds", F.bround((F.col("lower") + F.col("upper")) / 2, 0))


def estimate_truth_distances(
    estimates: DataFrame, truths: DataFrame, on: Sequence[str] = ("ptid",), estimate: str = "estimate_id",
    truth: str = "truth_id", seq: str = "seq",
) -> DataFrame:
    """Each estimate against each true founder of its key: differences and compared sites
    with gaps counted as a difference (``inc``) or ignored (``ign``). Sites that are gaps
    in both never count. True founders are one or two per key, so the result grows with
    the estimates."""
    left = estimates.select(*on, estimate, pr.bit_planes(F.col(seq)).alias("_e"))
    right = truths.select(*on, truth, pr.bit_planes(F.col(seq)).alias("_t"))
    c = F.col("_c")
    return (
        left.join(right, list(on)).withColumn("_c", pr.plane_counts(F.col("_e"), F.col("_t")))
        .select(
            *on, estimate, truth,
            (c["hd"] + c["gap_difference"]).cast("bigint").alias("hd_inc"),
            (c["compared"] + c["gap_difference"]).cast("bigint").alias("n_inc"),
            c["hd"].cast("bigint").alias("hd_ign"), c["compared"].cast("bigint").alias("n_ign"),
        )
    )


def pair_estimate_truth_files(participants: DataFrame) -> DataFrame:
    """The four single/multiple combinations of estimate and truth per row."""
    kinds = ("single", "multiple")
    combos = F.array(*[
        F.struct(F.lit(e).alias("estimate_type"), F.lit(t).alias("truth_type")) for e in kinds for t in kinds
    ])
    return participants.withColumn("_c", F.explode(combos)).select(*participants.columns, "_c.estimate_type", "_c.truth_type")


def shared_ids(a: DataFrame, b: DataFrame, key: str = "ptid") -> DataFrame:
    """Each participant of either set with where it occurs: both, only_a or only_b."""
    tagged = a.select(key, F.lit(True).alias("_a"), F.lit(False).alias("_b")).unionByName(
        b.select(key, F.lit(False).alias("_a"), F.lit(True).alias("_b"))
    )
    both = tagged.groupBy(key).agg(F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b"))
    where: Column = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_a").otherwise("only_b")
    return both.select(key, where.alias("found_in"))
