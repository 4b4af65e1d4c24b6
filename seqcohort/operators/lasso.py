"""Binomial regression with an L1 penalty, with each person left out in turn.

A fit is one row: the person left out, the part of the others held back for choosing the
penalty (or none), and the penalty. All fits move together: per round, blocks of rows meet
blocks of fits, a task returns one short row of sums per fit, and the sums give the next
coefficients of each fit by themselves. Nothing is joined on the key alone and no task sees
all rows or all fits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcohort.operators.evaluate import design, predict
from seqcohort.session import release, settle

NONE = ""
FIT = ("_person", "_hold", "_i")


def _meet(rows: DataFrame, fits: DataFrame, keys: Sequence[str], names: Sequence[str],
          work: Callable[..., dict[str, np.ndarray]], row_block: int, fit_block: int) -> DataFrame:
    """Every fit with its sums ``names`` over the rows of its key."""
    n_rows, n_fits = max(1, -(-rows.count() // row_block)), max(1, -(-fits.count() // fit_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_rb", F.pmod(F.xxhash64("_own", "_y", "_x"), F.lit(n_rows)).cast("int")).withColumn("_fb", each(n_fits))
    right = fits.withColumn("_fb", F.pmod(F.xxhash64(*FIT), F.lit(n_fits)).cast("int")).withColumn("_rb", each(n_rows))
    fixed = [*keys, *FIT, "_lam", "_beta"]
    schema = ", ".join(f"`{c}` {fits.schema[c].dataType.simpleString()}" for c in fixed) + "".join(f", {c} double" for c in names)

    def sums(r: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(f):
            return pd.DataFrame(columns=[*fixed, *names], dtype=object)
        own, person = r["_own"].to_numpy(), f["_person"].to_numpy()
        others = own[:, None] != person[None, :]
        back = r["_group"].to_numpy()[:, None] == f["_hold"].to_numpy()[None, :]
        x, b = np.stack(r["_x"].to_numpy()), np.stack(f["_beta"].to_numpy())
        out = work(x, r["_y"].to_numpy(), r["_w"].to_numpy(dtype=float), x @ b.T, others, back)
        return pd.concat([f[fixed], pd.DataFrame(out, index=f.index)], axis=1)

    by = [*keys, "_rb", "_fb"]
    parts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(sums, schema)
    return parts.groupBy(*keys, *FIT).agg(
        F.first("_lam").alias("_lam"), F.first("_beta").alias("_beta"), *[F.sum(c).alias(c) for c in names]
    )


def _training_sums(p: int) -> tuple[list[str], Callable]:
    """Gradient, curvature and column moments over the rows a fit is trained on."""
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    names = ["_n"] + [f"_{k}{i}" for k in ("g", "m", "q") for i in range(p)] + [f"_h{i}_{j}" for i, j in upper]

    def work(x, y, w, eta, others, back):
        train = (others & ~back) * w[:, None]
        mu = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
        gap, curve = train * (y[:, None] - mu), train * mu * (1 - mu)
        out = {"_n": train.sum(0)}
        for i in range(p):
            out |= {f"_g{i}": gap.T @ x[:, i], f"_m{i}": train.T @ x[:, i], f"_q{i}": train.T @ x[:, i] ** 2}
        return out | {f"_h{i}_{j}": curve.T @ (x[:, i] * x[:, j]) for i, j in upper}

    return names, work


def _deviance(x, y, w, eta, others, back):
    """Deviance of the rows that a fit held back."""
    return {"_dev": ((others & back) * w[:, None] * 2 * (np.logaddexp(0, eta) - y[:, None] * eta)).sum(0)}


def penalised_step(beta: np.ndarray, grad: np.ndarray, hess: np.ndarray, spread: np.ndarray, n: np.ndarray,
                   lam: np.ndarray, free: Sequence[int], sweeps: int = 2000) -> np.ndarray:
    """The next coefficients of a stack of fits: minimum of the quadratic form of the loss at
    ``beta`` plus the penalty ``n * lam * spread`` per column, by coordinate descent. ``free``
    columns carry no penalty; columns without spread (beside the first, the intercept) get 0."""
    own = np.einsum("bjj->bj", hess)
    target = np.einsum("bjk,bk->bj", hess, beta) + grad
    open_ = own > 1e-12
    dead = spread <= 1e-12
    dead[:, 0] = False
    new = np.where(dead, 0.0, beta)
    weight = np.maximum(spread, 1e-300)
    weight[:, 0] = 1.0
    for _ in range(sweeps):
        largest = 0.0
        for j in range(beta.shape[1]):
            r = target[:, j] - np.einsum("bk,bk->b", hess[:, j], new) + own[:, j] * new[:, j]
            if j not in free:
                r = np.where(np.isinf(lam), 0.0, np.sign(r) * np.maximum(np.abs(r) - n * np.where(np.isinf(lam), 0.0, lam) * spread[:, j], 0.0))
            value = np.where(dead[:, j], 0.0, np.where(open_[:, j], r / np.where(open_[:, j], own[:, j], 1.0), new[:, j]))
            largest = max(largest, float(np.max(np.abs(value - new[:, j]) * weight[:, j], initial=0.0)))
            new[:, j] = value
        if largest < 1e-11:
            break
    # coefficients without a penalty run off where the rows are separable: no step beyond 5
    size = np.max(np.abs(new - beta) * weight, axis=1)
    return beta + (new - beta) * np.minimum(1.0, 5.0 / np.maximum(size, 5.0))[:, None]


def _settle_fits(rows: DataFrame, fits: DataFrame, keys: Sequence[str], p: int, free: Sequence[int], rounds: int,
                 row_block: int, fit_block: int) -> DataFrame:
    """``fits`` moved until their coefficients stay, with ``_done``; those that stay drop out of
    the following rounds."""
    names, work = _training_sums(p)
    pack = lambda k: F.array(*[F.col(f"_{k}{i}") for i in range(p)])
    square = F.array(*[F.col(f"_h{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])

    @F.pandas_udf("array<double>")
    def step(beta: pd.Series, grad: pd.Series, mean: pd.Series, sq: pd.Series, hess: pd.Series, n: pd.Series, lam: pd.Series) -> pd.Series:
        if not len(beta):
            return pd.Series([], dtype=object)
        b, g, m, q = (np.stack(c.to_numpy()).astype(float) for c in (beta, grad, mean, sq))
        size = np.maximum(n.to_numpy(dtype=float), 1.0)
        sd = np.sqrt(np.maximum(q / size[:, None] - (m / size[:, None]) ** 2, 0.0))
        sd[sd <= 1e-9 * np.sqrt(q / size[:, None])] = 0.0
        h = np.stack(hess.to_numpy()).astype(float).reshape(len(b), p, p)
        return pd.Series(list(penalised_step(b, g, h, sd, size, lam.to_numpy(dtype=float), free)))

    done, moving = None, fits
    for turn in range(rounds):
        moved = _meet(rows, moving, keys, names, work, row_block, fit_block).select(
            *keys, *FIT, "_lam", F.col("_beta").alias("_old"),
            step("_beta", pack("g"), pack("m"), pack("q"), square, "_n", "_lam").alias("_beta"),
        )
        stays = ~F.exists(F.zip_with("_old", "_beta", lambda a, b: F.abs(a - b) > 1e-9 * (1 + F.abs(b))), lambda t: t)
        fresh = settle(moved.select(*keys, *FIT, "_lam", "_beta", stays.alias("_done")))
        settled = fresh if turn == rounds - 1 else fresh.filter("_done")
        done = settled if done is None else done.unionByName(settled)
        if turn == rounds - 1 or fresh.filter("NOT _done").isEmpty():
            break
        moving = fresh.filter("NOT _done").drop("_done")
    return settle(done)


def lasso_logistic_coefficients(
    df: DataFrame, y: str, terms: Sequence[str], person: str = "ptid", keys: Sequence[str] = ("estimator",),
    free: Sequence[int] = (0, 1), n_lambda: int = 30, smallest: float = 1e-3, inner_folds: int | None = None,
    rounds: int = 50, row_block: int = 4096, fit_block: int = 1024,
) -> DataFrame:
    """Per key and person left out: ``beta`` (intercept first), the penalty ``lam``, whether the
    fit ``converged`` and whether it is the ``fallback``.

    The penalties of a fold fall from the smallest that keeps all penalised columns at 0 to
    ``smallest`` of it; each column is penalised on the scale of its own standard deviation,
    ``free`` columns (0 is the intercept) not at all. The penalty with the least deviance on
    held-back persons is taken, the largest on ties. Persons are held back one at a time, or
    in ``inner_folds`` hashed groups, which makes the number of fits linear in persons. Where
    the chosen fit does not settle, the fold falls back to the free columns alone.

    Rows with a missing value in a used column or without a person train nothing. A column
    that is constant in a fold gets 0 there; a key with one person gives no row. Equal rows of
    one person are fitted as one row with a weight.
    """
    keys = list(keys)
    free = tuple(sorted({0, *free}))
    _, cols = design(terms)
    p = len(cols)
    group = F.col("_own") if inner_folds is None else F.pmod(F.xxhash64("_own"), F.lit(inner_folds)).cast("string")
    rows = settle(
        df.dropna(subset=[person, y, *terms])
        .select(*keys, F.col(person).cast("string").alias("_own"), F.col(y).cast("double").alias("_y"), F.array(*cols).alias("_x"))
        .groupBy(*keys, "_own", "_y", "_x").agg(F.count(F.lit(1)).alias("_w"))
        .withColumn("_group", F.concat(F.lit("g"), group))
    )
    persons = settle(rows.groupBy(*keys, "_own").agg(F.first("_group").alias("_group")))
    many = persons.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(*keys)
    outer = persons.join(many, keys, "left_semi").select(*keys, F.col("_own").alias("_person"))
    zero = F.array(*[F.lit(0.0)] * p)
    start = outer.select(*keys, "_person", F.lit(NONE).alias("_hold"), F.lit(-1).alias("_i"),
                         F.lit(float("inf")).alias("_lam"), zero.alias("_beta"))
    null = _settle_fits(rows, settle(start), keys, p, free, rounds, row_block, fit_block)

    names, work = _training_sums(p)
    at_null = _meet(rows, null.drop("_done"), keys, names, work, row_block, fit_block)
    slope = [
        F.try_divide(F.abs(F.col(f"_g{j}")), F.col("_n") * F.sqrt(F.greatest(
            F.col(f"_q{j}") / F.col("_n") - F.pow(F.col(f"_m{j}") / F.col("_n"), 2), F.lit(0.0))))
        for j in range(p) if j not in free
    ]
    top = F.coalesce(F.array_max(F.array(*[F.when(s < float("inf"), s) for s in slope])), F.lit(0.0)) if slope else F.lit(0.0)
    shares = np.logspace(0, np.log10(smallest), n_lambda)
    path = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)]))
    folds = settle(at_null.select(*keys, "_person", "_beta", top.alias("_top"), path.alias("_l")).select(
        *keys, "_person", F.col("_l.i").alias("_i"), (F.col("_top") * F.col("_l.s")).alias("_lam"), "_beta"))
    # groups that hold anyone but the person itself
    held = persons.groupBy(*keys, "_group").agg(F.count(F.lit(1)).alias("_c"), F.min("_own").alias("_only"))
    inner = folds.join(held, keys).filter((F.col("_c") > 1) | (F.col("_only") != F.col("_person")))
    shape = [*keys, "_person", "_hold", "_i", "_lam", "_beta"]
    fits = settle(folds.withColumn("_hold", F.lit(NONE)).select(*shape).unionByName(
        inner.withColumnRenamed("_group", "_hold").select(*shape)))
    fitted = _settle_fits(rows, fits, keys, p, free, rounds, row_block, fit_block)
    scored = _meet(rows, fitted.filter(F.col("_hold") != NONE).drop("_done"), keys, ["_dev"], _deviance, row_block, fit_block)
    chosen = scored.groupBy(*keys, "_person", "_i").agg(F.sum("_dev").alias("_dev")).groupBy(*keys, "_person").agg(
        F.min_by("_i", F.struct("_dev", "_i")).alias("_i"))
    best = fitted.filter(F.col("_hold") == NONE).join(chosen, [*keys, "_person", "_i"]).select(
        *keys, "_person", F.col("_beta").alias("_best"), "_lam", F.col("_done").alias("_best_done"))
    out = null.select(*keys, "_person", "_beta", "_done").join(best, [*keys, "_person"], "left")
    good = F.coalesce("_best_done", F.lit(False))
    result = settle(out.select(
        *keys, F.col("_person").cast(df.schema[person].dataType).alias(person),
        F.when(good, F.col("_best")).otherwise(F.col("_beta")).alias("beta"),
        F.when(good, F.col("_lam")).alias("lam"),
        (good | F.col("_done")).alias("converged"), (~good).alias("fallback"),
    ))
    release(rows, persons, null, folds, fits, fitted)
    return result


def lopo_lasso_logistic_predictions(df: DataFrame, y: str, terms: Sequence[str], person: str = "ptid",
                                    keys: Sequence[str] = ("estimator",), **kw) -> DataFrame:
    """Held-out probabilities of the penalised binomial regression."""
    out = predict(df, lasso_logistic_coefficients(df, y, terms, person, keys, **kw), terms, person, keys)
    return out.withColumn("prediction", 1 / (1 + F.exp(-F.greatest(F.least("prediction", F.lit(30.0)), F.lit(-30.0)))))
