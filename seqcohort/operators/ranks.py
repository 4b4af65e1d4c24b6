"""Distributed ranks, running totals and exact quantiles.

A window ordered over a whole table, or over one hot key, runs in one task. Here rows are
first combined per distinct value, then cut into ranges at approximate quantiles, so each
window sees one range; the offsets between ranges come from one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcohort.session import settle

RANGE_ROWS = 200_000


def running_totals(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per key and distinct ``order`` value: the summed ``values``, their totals over
    smaller order values (``_before``) and up to this one (``_through``). Only keys of more than
    ``range_rows`` distinct values are cut into ranges, so that many small keys cost no more
    than their rows and no range grows with the table. Rows without a key are left out."""
    keys = list(keys) or ["_all"]
    if keys == ["_all"]:
        df = df.withColumn("_all", F.lit(1))
    distinct = settle(df.dropna(subset=keys).groupBy(*keys, order).agg(*[F.sum(v).alias(v) for v in values]))
    large = settle(distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > range_rows))
    top = large.agg(F.max("_n")).first()[0]
    if top is None:
        through = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return distinct.select("*", *[F.sum(v).over(through).alias(f"{v}_through") for v in values]).select(
            *[k for k in keys if k != "_all"], order, *values, *[f"{v}_through" for v in values],
            *[(F.col(f"{v}_through") - F.col(v)).alias(f"{v}_before") for v in values],
        )
    ranges = max(8, -(-top // range_rows))
    probs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = settle(
        distinct.join(large, keys, "left_semi").groupBy(*keys).agg(
            F.array_distinct(F.percentile_approx(order, probs, F.lit(10 * ranges))).alias("_cuts")
        )
    )
    below = F.size(F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda c: c < F.col(order)))
    ranged = distinct.join(cuts, keys, "left").withColumn("_range", below).drop("_cuts")
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    offsets = totals.select(
        *keys, "_range",
        *[F.coalesce(F.sum(f"_t_{v}").over(across), F.lit(0)).alias(f"_o_{v}") for v in values],
    )
    out = ranged.select(
        "*", *[F.sum(v).over(inside).alias(f"_i_{v}") for v in values]
    ).join(offsets, [*keys, "_range"])
    return out.select(
        *[k for k in keys if k != "_all"], order, *values,
        *[(F.col(f"_o_{v}") + F.col(f"_i_{v}")).alias(f"{v}_through") for v in values],
        *[(F.col(f"_o_{v}") + F.col(f"_i_{v}") - F.col(v)).alias(f"{v}_before") for v in values],
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str], weight: str | None = None) -> DataFrame:
    """Quantiles by linear interpolation between order statistics, for groups of any size."""
    rows = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias(value),
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"),
    )
    ranked = running_totals(rows, keys, value, ["_w"])
    sizes = rows.groupBy(*keys).agg(F.sum("_w").alias("_n")) if keys else rows.agg(F.sum("_w").alias("_n"))
    both = ranked.join(sizes, list(keys)) if keys else ranked.join(F.broadcast(sizes))

    def order_stat(p: float, up: bool) -> Column:
        h = F.lit(float(p)) * (F.col("_n") - 1)
        at = F.ceil(h) if up else F.floor(h)
        return F.max(F.when((F.col("_w_before") <= at) & (at < F.col("_w_through")), F.col(value)))

    found = both.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[order_stat(p, False).alias(f"_lo{i}") for i, p in enumerate(probs)],
        *[order_stat(p, True).alias(f"_hi{i}") for i, p in enumerate(probs)],
    )
    part = [F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1)) for p in probs]
    return found.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + part[i] * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(n)
            for i, n in enumerate(names)
        ],
    )
