"""Errors, discrimination and leave-one-person-out calibration of estimators.

Models are solved on sums of products, never on rows: one map-side-combined aggregate per
(estimator, person), from which the statistics of every fold are the total minus its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcohort.functions import formulas as fm
from seqcohort.functions import tails
from seqcohort.operators.ranks import running_totals
from seqcohort.session import release, settle, spread

# --- errors -----------------------------------------------------------------------------


def unpivot_estimators(df: DataFrame, keys: Sequence[str], estimators: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(estimators), "estimator", "estimate")


def estimate_errors(df: DataFrame, estimators: Sequence[str], truth: str, keys: Sequence[str]) -> DataFrame:
    long = unpivot_estimators(df, [*keys, truth], estimators)
    return long.withColumn("error", F.col("estimate") - F.col(truth))


def bias_se_rmse(errors: DataFrame, keys: Sequence[str] = ("estimator",), within: str | None = None,
                 error: str = "error") -> DataFrame:
    """Mean, sd and root mean square of errors, skipping missing ones and with them as 0;
    with ``within`` also per value of that column (overall rows hold NULL there)."""
    zero = F.coalesce(error, F.lit(0.0))
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("bias"), F.stddev_samp(error).alias("se"),
        F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"), F.avg(zero).alias("bias_zero"),
        F.stddev_samp(zero).alias("se_zero"), F.sqrt(F.avg(zero * zero)).alias("rmse_zero"),
    ]
    if within is None:
        return errors.groupBy(*keys).agg(*aggs)
    sets = [[*map(F.col, keys), F.col(within)], [*map(F.col, keys)]]
    return errors.groupingSets(sets, *keys, within).agg(*aggs)


def auc(long: DataFrame, keys: Sequence[str] = ("estimator",), score: str = "score", gold: str = "gold",
        missing: float = 1.0) -> DataFrame:
    """Area under the ROC curve by mid-ranks. A missing score counts as ``missing``; one
    distinct value gives 0. Ranks come from distributed running totals per distinct score."""
    rows = long.withColumns(
        {
            score: F.coalesce(F.col(score).cast("double"), F.lit(missing)),
            "_pos": F.col(gold).cast("bigint"), "_neg": (1 - F.col(gold)).cast("bigint"),
        }
    )
    ranked = running_totals(rows, keys, score, ["_pos", "_neg"])
    wins = F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2))
    return ranked.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) <= 1, 0.0).otherwise(
            F.try_divide(wins, F.sum("_pos").cast("double") * F.sum("_neg"))
        ).alias("auc"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"),
    )


def drop_constant_estimators(long: DataFrame, keys: Sequence[str] = ("estimator",), value: str = "estimate") -> DataFrame:
    varying = long.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).filter("_a < _b").select(*keys)
    return long.join(varying, list(keys), "left_semi")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations, all in one aggregate; one row per column pair."""
    def r(x: str, y: str) -> Column:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        return F.corr(F.when(both, F.col(x)).cast("double"), F.when(both, F.col(y)).cast("double"))

    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1:]]
    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), r(x, y).alias("r")) for x, y in pairs])
    return df.agg(cells.alias("_c")).select(F.explode("_c").alias("c")).select("c.x", "c.y", "c.r")


def correlation_screen(df: DataFrame, outcome: str, estimator: str, covariates: Sequence[str], upper: str | None = None,
                       weak: float = 0.1, strong: float = 0.8, min_df: int = 2) -> list[str]:
    """Covariates in order of |r| with the outcome, without weak ones and those too close
    to the estimator, the upper bound or an already kept covariate. Only the small
    correlation matrix reaches the driver."""
    columns = [outcome, estimator, *([upper] if upper else []), *covariates]
    rows = correlation_matrix(df, columns).collect()
    r = {frozenset((x, y)): abs(v) if v is not None and not math.isnan(v) else 0.0 for x, y, v in rows}
    n = df.filter(F.col(outcome).isNotNull()).count()
    kept: list[str] = []
    for c in sorted(covariates, key=lambda c: (-r[frozenset((outcome, c))], c)):
        fixed = [estimator, *([upper] if upper else []), *kept]
        if r[frozenset((outcome, c))] > weak and all(r[frozenset((f, c))] < strong for f in fixed):
            kept.append(c)
    return kept[: max(0, n - 2 - min_df - (1 if upper else 0))]


# --- linear models on sums of products --------------------------------------------------


def design(terms: Sequence[str], intercept: bool = True, interactions: bool = False) -> tuple[list[str], list[Column]]:
    names, cols = (["1"], [F.lit(1.0)]) if intercept else ([], [])
    names += terms
    cols += [F.col(t).cast("double") for t in terms]
    if interactions:
        for i, a in enumerate(terms):
            for b in terms[i + 1:]:
                names.append(f"{a}:{b}")
                cols.append(F.col(a).cast("double") * F.col(b).cast("double"))
    return names, cols


def fold_statistics(df: DataFrame, y: str, terms: Sequence[str], person: str = "ptid", keys: Sequence[str] = ("estimator",),
                    intercept: bool = True, interactions: bool = False) -> DataFrame:
    """Per key and held-out person: sums of products of the training rows (all but this
    person's), as arrays: ``xx`` (row by row), ``xy``, and ``yy``, ``y1``, ``n``. Rows with
    a missing value in any used column are left out before summing."""
    _, cols = design(terms, intercept, interactions)
    p = len(cols)
    complete = df.dropna(subset=[y, *terms])
    target = F.col(y).cast("double")
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(cols[i] * cols[j]).alias(f"_xx{i}_{j}") for i, j in upper]
    sums += [F.sum(c * target).alias(f"_xy{i}") for i, c in enumerate(cols)]
    sums += [F.sum(target * target).alias("yy"), F.sum(target).alias("y1"), F.count(F.lit(1)).cast("double").alias("n")]
    own = settle(complete.groupBy(*keys, person).agg(*sums))
    names = [c for c in own.columns if c not in (*keys, person)]
    total = own.groupBy(*keys).agg(*[F.sum(c).alias(f"_t{c}") for c in names])
    left = {c: F.col(f"_t{c}") - F.col(c) for c in names}
    full = [left[f"_xx{min(i, j)}_{max(i, j)}"] for i in range(p) for j in range(p)]
    return own.join(total, list(keys)).select(
        *keys, person, F.array(*full).alias("xx"), F.array(*[left[f"_xy{i}"] for i in range(p)]).alias("xy"),
        left["yy"].alias("yy"), left["y1"].alias("y1"), left["n"].alias("n"),
    )


def solve_normal(xx: np.ndarray, xy: np.ndarray, skip: Sequence[int] = ()) -> np.ndarray:
    """Least-squares coefficients; columns that add nothing to earlier ones (constant or
    aliased within the fold) get 0, as do ``skip``ped ones."""
    p = len(xy)
    kept: list[int] = []
    for j in range(p):
        if j in skip or xx[j, j] <= 0:
            continue
        if kept:
            part = xx[np.ix_(kept, kept)]
            rest = xx[j, j] - xx[j, kept] @ np.linalg.solve(part, xx[kept, j])
        else:
            rest = xx[j, j]
        if rest > 1e-9 * xx[j, j]:
            kept.append(j)
    beta = np.zeros(p)
    if kept:
        beta[kept] = np.linalg.solve(xx[np.ix_(kept, kept)], xy[kept])
    return beta


def _arrays(xx, xy) -> tuple[np.ndarray, np.ndarray]:
    xy = np.asarray(xy, dtype=float)
    return np.asarray(xx, dtype=float).reshape(len(xy), len(xy)), xy


def ols(xx: str, xy: str) -> Column:
    """Coefficients from sums of products, one short solve per row."""

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([solve_normal(*_arrays(a, b)).tolist() for a, b in zip(xx, xy)])

    return solve(xx, xy)


def rss(xx: np.ndarray, xy: np.ndarray, yy: float, beta: np.ndarray) -> float:
    return max(yy - 2 * beta @ xy + beta @ xx @ beta, 1e-300)


def stepwise(forced: Sequence[int]):
    """Both-direction search for the smallest AIC that never drops ``forced`` columns."""

    @F.pandas_udf("array<double>")
    def search(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, s, m in zip(xx, xy, yy, n):
            a, b = _arrays(a, b)
            everything = set(range(len(b)))

            def score(use: frozenset) -> tuple[float, np.ndarray]:
                beta = solve_normal(a, b, everything - use)
                return m * math.log(rss(a, b, s, beta) / m) + 2 * len(use), beta

            use = frozenset(everything)
            best, beta = score(use)
            while True:
                moves = [use ^ {j} for j in sorted(everything - set(forced))]
                tried = [(score(u), u) for u in moves]
                if not tried:
                    break
                (value, candidate), u = min(tried, key=lambda t: t[0][0])
                if value >= best - 1e-9:
                    break
                best, beta, use = value, candidate, u
            out.append(beta.tolist())
        return pd.Series(out)

    return search


def lasso_descend(xx: np.ndarray, xy: np.ndarray, n: np.ndarray, free: Sequence[int], lam: float, beta: np.ndarray,
                  sweeps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate descent on sums of products, for a stack of problems at once; ``free``
    columns carry no penalty, the others are penalised on their own scale. Also returns
    which problems settled within ``sweeps``."""
    own = np.maximum(np.einsum("bjj->bj", xx), 1e-300)
    scale = np.sqrt(own / n[:, None])
    beta = beta.copy()
    for _ in range(sweeps):
        largest = np.zeros(len(beta))
        for j in range(xy.shape[1]):
            r = xy[:, j] - np.einsum("bk,bk->b", xx[:, j], beta) + own[:, j] * beta[:, j]
            limit = 0.0 if j in free else n * lam * scale[:, j]
            new = np.where(own[:, j] > 1e-12, np.sign(r) * np.maximum(np.abs(r) - limit, 0.0) / own[:, j], 0.0)
            largest = np.maximum(largest, np.abs((new - beta[:, j]) * scale[:, j]))
            beta[:, j] = new
        if largest.max(initial=0.0) < 1e-8:
            break
    return beta, largest < 1e-8


def _lasso_fold(left: np.ndarray, group: int, sums: list, p: int, free: Sequence[int], n_lambda: int) -> tuple[np.ndarray, bool]:
    """Coefficients of one fold. ``left``: its sums of products without its person, packed as
    xx, xy, yy, n; ``sums``: number of persons and summed packs of every inner group."""
    parts = lambda v: (v[: p * p].reshape(p, p), v[p * p : p * p + p], v[-2], v[-1])
    persons = sum(c for _, c, _ in sums)
    xx, xy, _, n = parts(left)
    base = solve_normal(xx, xy, set(range(p)) - set(free))
    scale = np.sqrt(np.maximum(np.diag(xx) / max(n, 1.0), 1e-300))
    top = np.max(np.abs(xy - xx @ base) / (max(n, 1.0) * scale), initial=1e-12)
    grid = top * np.logspace(0, -3, n_lambda)
    pick = n_lambda - 1
    if persons > 1:
        total = sum(v for _, _, v in sums) / (persons - 1)
        held = [c * total - v - ((total - left) if g == group else 0.0) for g, c, v in sums]
        held = [h for h in held if h[-1] > 0.5 and left[-1] - h[-1] > 0.5]
        if held:
            own = [parts(h) for h in held]
            inner = [parts(left - h) for h in held]
            a, b, m = (np.stack([x[i] for x in inner]) for i in (0, 1, 3))
            beta, error = np.tile(base, (len(held), 1)), np.zeros(n_lambda)
            for i, lam in enumerate(grid):
                beta, _ = lasso_descend(a, b, m, free, lam, beta)
                error[i] = sum(yy - 2 * be @ y1 + be @ x2 @ be for be, (x2, y1, yy, _) in zip(beta, own))
            pick = int(error.argmin())
    beta, fine = base[None, :], np.ones(1, bool)
    for lam in grid[: pick + 1]:
        beta, fine = lasso_descend(xx[None], xy[None], np.array([max(n, 1.0)]), free, lam, beta)
    return beta[0], bool(fine[0])


def lasso_coefficients(stats: DataFrame, free: Sequence[int], person: str = "ptid", keys: Sequence[str] = ("estimator",),
                       n_lambda: int = 30, inner_folds: int = 10) -> DataFrame:
    """L1 fit per key and held-out person: ``beta`` and whether it ``converged``. The penalty
    is chosen by leaving out the other persons in ``inner_folds`` groups (by a hash of the
    person); every group's sums of products follow from the folds' own. A row is one fold with
    the sums of these few groups, so folds are spread like rows and none sees all persons."""
    keys = list(keys)
    packed = settle(stats.select(
        *keys, person, F.size("xy").alias("_p"), F.concat("xx", "xy", F.array("yy", "n")).alias("_v"),
        F.pmod(F.xxhash64(person), F.lit(inner_folds)).cast("int").alias("_g"),
    ))
    cells = packed.select(*keys, "_g", F.posexplode("_v").alias("_at", "_x")).groupBy(*keys, "_g", "_at").agg(
        F.sum("_x").alias("_x"), F.count(F.lit(1)).alias("_c")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda c: c["_x"])
    groups = cells.groupBy(*keys, "_g").agg(F.max("_c").alias("c"), ordered.alias("v")).groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("_g").alias("g"), "c", "v")).alias("_sums")
    )

    @F.pandas_udf("struct<beta:array<double>,converged:boolean>")
    def fit(size: pd.Series, left: pd.Series, group: pd.Series, sums: pd.Series) -> pd.DataFrame:
        out = []
        for p, v, g, own in zip(size, left, group, sums):
            others = [(int(s["g"]), int(s["c"]), np.asarray(s["v"], float)) for s in own]
            out.append(_lasso_fold(np.asarray(v, float), int(g), others, int(p), free, n_lambda))
        return pd.DataFrame({"beta": [b.tolist() for b, _ in out], "converged": [c for _, c in out]})

    folds = spread(packed, *keys, person).join(groups, keys)
    return folds.select(*keys, person, fit("_p", "_v", "_g", "_sums").alias("_f")).select(*keys, person, "_f.beta", "_f.converged")


def predict(df: DataFrame, coefficients: DataFrame, terms: Sequence[str], person: str = "ptid",
            keys: Sequence[str] = ("estimator",), intercept: bool = True, interactions: bool = False,
            beta: str = "beta") -> DataFrame:
    """Held-out predictions: each row meets the coefficients fitted without its person."""
    _, cols = design(terms, intercept, interactions)
    value = sum((F.col(beta)[i] * c for i, c in enumerate(cols)), F.lit(0.0))
    return df.join(coefficients.select(*keys, person, beta), [*keys, person]).withColumn("prediction", value).drop(beta)


def lopo_linear_predictions(df: DataFrame, y: str, terms: Sequence[str], person: str = "ptid",
                            keys: Sequence[str] = ("estimator",), intercept: bool = True, interactions: bool = False) -> DataFrame:
    """Least squares per key with each person left out, predicted for that person."""
    stats = fold_statistics(df, y, terms, person, keys, intercept, interactions)
    fitted = stats.withColumn("beta", ols("xx", "xy"))
    return predict(df, fitted, terms, person, keys, intercept, interactions)


def lopo_stepwise_predictions(df: DataFrame, y: str, terms: Sequence[str], person: str = "ptid",
                              keys: Sequence[str] = ("estimator",), forced: Sequence[int] = (0, 1)) -> DataFrame:
    stats = fold_statistics(df, y, terms, person, keys)
    fitted = stats.withColumn("beta", stepwise(forced)("xx", "xy", "yy", "n"))
    return predict(df, fitted, terms, person, keys)


def lopo_lasso_predictions(df: DataFrame, y: str, terms: Sequence[str], person: str = "ptid",
                           keys: Sequence[str] = ("estimator",), free: Sequence[int] = (0, 1)) -> DataFrame:
    coefficients = lasso_coefficients(fold_statistics(df, y, terms, person, keys), free, person, keys)
    return predict(df, coefficients, terms, person, keys)


def logistic_coefficients(df: DataFrame, y: str, terms: Sequence[str], person: str = "ptid", keys: Sequence[str] = ("estimator",),
                          rounds: int = 50, ridge: float = 1e-8, row_block: int = 8192, fold_block: int = 1024) -> DataFrame:
    """Binomial regression with each person left out: ``beta`` per key and person, and
    whether its Newton steps ``converged`` within ``rounds``.

    Rows and folds are cut into blocks by a hash; a task meets one block of rows with one
    block of fold coefficients, forms the gradients and curvatures of all its folds as matrix
    products, and returns one short row per fold. Nothing is joined on the key alone."""
    keys = list(keys)
    _, cols = design(terms)
    p = len(cols)
    rows = settle(df.dropna(subset=[y, *terms]).select(
        *keys, F.col(person).alias("_own"), F.xxhash64(person).alias("_o"), F.col(y).cast("double").alias("_y"), F.array(*cols).alias("_x")))
    folds = settle(rows.select(*keys, F.col("_own").alias(person), F.col("_o").alias("_p")).distinct())
    beta = folds.select(*keys, person, "_p", F.array(*[F.lit(0.0)] * p).alias("beta"), F.lit(False).alias("converged"))
    n_rows, n_folds = max(1, -(-rows.count() // row_block)), max(1, -(-folds.count() // fold_block))
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    names = [f"_g{i}" for i in range(p)] + [f"_h{i}_{j}" for i, j in upper]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_rb", F.pmod(F.xxhash64("_o", "_y", "_x"), F.lit(n_rows)).cast("int")).withColumn("_fb", each(n_folds))
    left = left.select(*keys, "_rb", "_fb", "_o", "_y", "_x")

    def sums(r: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(f):
            return pd.DataFrame({c: [] for c in ["_p", *names]}).astype({"_p": "int64"})
        x, b = np.stack(r["_x"].to_numpy()), np.stack(f["beta"].to_numpy())
        mu = 1 / (1 + np.exp(-np.clip(x @ b.T, -30, 30)))
        others = r["_o"].to_numpy()[:, None] != f["_p"].to_numpy()[None, :]
        gap = (r["_y"].to_numpy()[:, None] - mu) * others
        curve = mu * (1 - mu) * others
        out = {"_p": f["_p"].to_numpy()}
        out |= {f"_g{i}": gap.T @ x[:, i] for i in range(p)}
        out |= {f"_h{i}_{j}": curve.T @ (x[:, i] * x[:, j]) for i, j in upper}
        return pd.DataFrame(out)

    @F.pandas_udf("array<double>")
    def step(beta: pd.Series, grad: pd.Series, hess: pd.Series) -> pd.Series:
        out = []
        for b, g, h in zip(beta, grad, hess):
            h, g = _arrays(h, g)
            h = h + ridge * np.diag(np.maximum(np.diag(h), 1e-12))
            move = np.linalg.lstsq(h, g, rcond=None)[0]
            # coefficients run off to infinity when a fold is separable
            size = np.abs(move).max()
            out.append((np.asarray(b, float) + move * min(1.0, 25.0 / size if size > 0 else 1.0)).tolist())
        return pd.Series(out)

    schema = "_p long, " + ", ".join(f"{c} double" for c in names)
    for _ in range(rounds):
        right = beta.select("*", F.pmod("_p", F.lit(n_folds)).cast("int").alias("_fb")).withColumn("_rb", each(n_rows))
        right = right.select(*keys, "_rb", "_fb", "_p", "beta")
        parts = left.groupBy(*keys, "_rb", "_fb").cogroup(right.groupBy(*keys, "_rb", "_fb")).applyInPandas(
            lambda key, r, f: sums(r, f).assign(**dict(zip(keys, key))), schema + "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
        )
        total = parts.groupBy(*keys, "_p").agg(*[F.sum(c).alias(c) for c in names])
        hess = F.array(*[F.col(f"_h{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
        fresh = beta.join(total, [*keys, "_p"]).select(
            *keys, person, "_p", F.col("beta").alias("_old"), step("beta", F.array(*names[:p]), hess).alias("beta")
        )
        still = F.exists(F.zip_with("_old", "beta", lambda a, b: F.abs(a - b) > 1e-9 * (1 + F.abs(b))), lambda t: t)
        before, beta = beta, settle(fresh.select(*keys, person, "_p", "beta", (~still).alias("converged")))
        release(before)
        if beta.filter("NOT converged").isEmpty():
            break
    return beta.drop("_p")


def lopo_logistic_predictions(df: DataFrame, y: str, terms: Sequence[str], person: str = "ptid",
                              keys: Sequence[str] = ("estimator",), rounds: int = 50) -> DataFrame:
    """Held-out probabilities of the binomial regression."""
    out = predict(df, logistic_coefficients(df, y, terms, person, keys, rounds), terms, person, keys)
    return out.withColumn("prediction", 1 / (1 + F.exp(-F.greatest(F.least("prediction", F.lit(30.0)), F.lit(-30.0)))))


def covariate_usage(coefficients: DataFrame, names: Sequence[str], keys: Sequence[str] = ("estimator",)) -> DataFrame:
    """Share of folds in which each covariate kept a coefficient."""
    return coefficients.groupBy(*keys).agg(
        *[F.avg((F.abs(F.col("beta")[i]) > 1e-12).cast("double")).alias(f"use_{n}") for i, n in enumerate(names)]
    )


def formula_usage(coefficients: DataFrame, names: Sequence[str], keys: Sequence[str] = ("estimator",)) -> DataFrame:
    """How many folds chose each set of terms."""
    used = F.array_compact(F.array(*[F.when(F.abs(F.col("beta")[i]) > 1e-12, n) for i, n in enumerate(names)]))
    return coefficients.groupBy(*keys, F.array_join(used, "+").alias("formula")).agg(F.count(F.lit(1)).alias("n_folds"))


def coefficient_table(df: DataFrame, y: str, terms: Sequence[str], keys: Sequence[str] = ("estimator",)) -> DataFrame:
    """The formula refitted on all rows: estimate, 95 % interval and p per term."""
    names, cols = design(terms)
    p = len(cols)
    complete = df.dropna(subset=[y, *terms])
    t = F.col(y).cast("double")
    sums = complete.groupBy(*keys).agg(
        F.array(*[F.sum(cols[i] * cols[j]) for i in range(p) for j in range(p)]).alias("xx"),
        F.array(*[F.sum(c * t) for c in cols]).alias("xy"), F.sum(t * t).alias("yy"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )

    @F.pandas_udf("array<struct<term:string,estimate:double,low:double,high:double,p:double>>")
    def table(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, s, m in zip(xx, xy, yy, n):
            a, b = _arrays(a, b)
            beta = solve_normal(a, b)
            df_left = m - p
            inverse = np.linalg.pinv(a)
            se = np.sqrt(np.maximum(np.diag(inverse), 0) * rss(a, b, s, beta) / df_left) if df_left > 0 else np.full(p, np.nan)
            half = tails.t_quantile(0.975, df_left) if df_left > 0 else math.nan
            out.append([
                {"term": names[i], "estimate": float(beta[i]), "low": float(beta[i] - half * se[i]),
                 "high": float(beta[i] + half * se[i]),
                 "p": tails.t_two_sided(beta[i] / se[i], df_left) if se[i] > 0 else math.nan}
                for i in range(p)
            ])
        return pd.Series(out)

    return sums.select(*keys, F.explode(table("xx", "xy", "yy", "n")).alias("c")).select(*keys, "c.*")


# --- comparisons and tables -------------------------------------------------------------


def ranked_errors(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return summary.orderBy(*keys, F.desc("rmse"), "estimator").select(*keys, "estimator", "rmse", "bias")


def variance_explained(long: DataFrame, x: str, y: str, keys: Sequence[str] = ("estimator",)) -> DataFrame:
    r = F.corr(x, y)
    return long.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg((r * r).alias("r2")).withColumn(
        "r2_text", F.concat(fm.fixed_digits(F.col("r2") * 100, 2), F.lit("%"))
    )


def paired_difference_test(a: DataFrame, b: DataFrame, value: str, person: str = "ptid", keys: Sequence[str] = ()) -> DataFrame:
    """One-sample t test of within-person differences; p on the aggregated rows only."""
    both = a.select(*keys, person, F.col(value).alias("_a")).join(
        b.select(*keys, person, F.col(value).alias("_b")), [*keys, person]
    ).withColumn("d", F.col("_a") - F.col("_b")).filter("d IS NOT NULL")
    s = both.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    s = s.withColumn("t", F.try_divide("mean", F.col("sd") / F.sqrt("n")))

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([tails.t_two_sided(x, m - 1) if m > 1 and x == x else math.nan for x, m in zip(t, n)])

    return s.withColumn("p", p_value(F.col("t"), F.col("n").cast("double")))


def assign_interval(df: DataFrame, center: Column, width: Column, percentile: Column) -> DataFrame:
    """Interval of a width with its centre at a share of it; both sides whole numbers."""
    below = F.bround(width * percentile, 0)
    return df.withColumns({"lower": center - below, "upper": center + F.bround(width - below, 0)})


def uniform_hash(*cols: Column | str) -> Column:
    """Reproducible number in [0, 1) from key columns: the first 40 bits of their MD5."""
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("bigint") / float(1 << 40)


def assign_sampled_interval(df: DataFrame, widths: DataFrame, center: str, width: str = "width", person: str = "ptid",
                            seed: int = 1) -> DataFrame:
    """Width drawn from an empirical table, uniform placement; both follow from the person
    and the seed. Widths are numbered by distributed running counts over their values."""
    ranked = running_totals(widths.withColumn("_c", F.lit(1).cast("bigint")), [], width, ["_c"])
    numbered = ranked.select(F.col(width), F.explode(F.sequence("_c_before", F.col("_c_through") - 1)).alias("_no"))
    total = widths.agg(F.count(F.lit(1)).alias("_total"))
    drawn = df.join(F.broadcast(total)).withColumn("_no", F.floor(uniform_hash(person, F.lit(seed)) * F.col("_total")))
    placed = drawn.join(numbered, "_no").drop("_no", "_total")
    return assign_interval(placed, F.col(center), F.col(width), uniform_hash(person, F.lit(seed), F.lit("place")))


def rescale_pooled_widths(a: DataFrame, b: DataFrame, limits: tuple[float, float] = (180.0, 90.0), target: float = 30.0,
                          tail: float = 270.0, width: str = "width") -> DataFrame:
    """Pool two width samples after scaling the second to the mean of the first, and bring
    the pool to the mean a visit spacing of ``target`` implies on the log-log line through
    the two samples. ``in_tail`` marks widths the spread estimate leaves out."""
    means = a.agg(F.avg(width).alias("ma")).join(F.broadcast(b.agg(F.avg(width).alias("mb"))))
    xa, xb = limits
    slope = F.ln((xa - F.col("ma")) / (xb - F.col("mb"))) / F.ln(F.lit(xa / xb))
    y = F.exp(F.ln(F.lit(target / xb)) * slope) * (xb - F.col("mb"))
    scalars = means.select("ma", "mb", (F.lit(target) - y).alias("goal"))
    pool = (
        a.select(F.lit("a").alias("sample"), F.col(width).alias("raw"))
        .unionByName(b.select(F.lit("b").alias("sample"), F.col(width).alias("raw")))
        .join(F.broadcast(scalars))
        .withColumn("scaled", F.when(F.col("sample") == "a", F.col("raw")).otherwise(F.col("raw") * F.col("ma") / F.col("mb")))
        .withColumn("in_tail", F.col("raw") >= tail)
    )
    mean = pool.agg(F.avg("scaled").alias("_mean"))
    return pool.join(F.broadcast(mean)).select(
        "sample", "raw", "scaled", "in_tail", (F.col("scaled") * F.col("goal") / F.col("_mean")).alias("rescaled")
    )


def partition_error_summary(errors: DataFrame, person: str = "ptid", keys: Sequence[str] = ("estimator",), error: str = "error") -> DataFrame:
    """Mean and sd of errors over the partitions of a person, then their spread over
    persons."""
    from seqcohort.operators.ranks import exact_quantiles

    each = settle(errors.groupBy(*keys, person).agg(F.avg(error).alias("mean"), F.stddev_samp(error).alias("sd")))
    ends = each.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("mean", "sd") for n, f in (("min", F.min), ("max", F.max))])
    for c in ("mean", "sd"):
        ends = ends.join(exact_quantiles(each, keys, c, (0.5,), (f"median_{c}",)), list(keys), "left")
    return ends


def partition_bootstrap(errors: DataFrame, replicates: int = 100, seed: int = 1, person: str = "ptid",
                        partition: str = "partition_id", keys: Sequence[str] = ("estimator",), error: str = "error") -> DataFrame:
    """Each replicate keeps one partition per person (the one with the smallest digest of
    replicate, person and partition) and summarises the errors again. Errors are summed per
    person and partition first; replicates are numbers joined to these sums, never copies of
    the table."""
    keys = list(keys)
    e = F.col(error).cast("double")
    sums = settle(errors.groupBy(*keys, person, partition).agg(
        F.count(F.lit(1)).alias("_n"), F.count(e).alias("_k"), F.coalesce(F.sum(e), F.lit(0.0)).alias("_s"),
        F.coalesce(F.sum(e * e), F.lit(0.0)).alias("_q"),
    ))
    draw = F.md5(F.concat_ws("|", F.col("replicate").cast("string"), F.col(person).cast("string"), F.col(partition).cast("string"), F.lit(str(seed))))
    chosen = (
        sums.select(person, partition).distinct()
        .withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .groupBy(person, "replicate").agg(F.min_by(partition, F.struct(draw, F.col(partition))).alias(partition))
    )
    t = sums.join(chosen, [person, partition]).groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in ("_n", "_k", "_s", "_q")])

    def moments(count: str, tail: str) -> list[Column]:
        n, mean = F.col(count), F.try_divide("_s", count)
        spread_ = F.sqrt(F.greatest(F.try_divide(F.col("_q") - n * mean * mean, n - 1), F.lit(0.0)))
        return [mean.alias(f"bias{tail}"), F.when(n > 1, spread_).alias(f"se{tail}"), F.sqrt(F.try_divide("_q", count)).alias(f"rmse{tail}")]

    return t.select(*keys, "replicate", F.col("_n").alias("n"), *moments("_k", ""), *moments("_n", "_zero"))


def label_training_code(df: DataFrame, regions: str = "n_regions", times: str = "n_times", bounded: str = "bounded",
                        method: str = "method", intercept: bool = True) -> DataFrame:
    """Label of a model column: R/r for both regions or the same one, T/t for times, then
    the formula parts."""
    code = F.concat(
        F.lit("["), F.when(F.col(regions) > 1, "R").otherwise("r"), F.when(F.col(times) > 1, "T").otherwise("t"),
        F.lit("] days~"), F.concat_ws("+", F.lit("1" if intercept else "0"), F.when(F.col(bounded), "bound"), F.col(method)),
    )
    return df.withColumn("label", code)


def calibrated_mutation_rate(df: DataFrame, days: str, coefficient: str, keys: Sequence[str]) -> DataFrame:
    """Mutation rate implied by regressing days on the rate coefficient, per key."""
    return df.groupBy(*keys).agg(F.regr_slope(days, coefficient).alias("slope"), F.regr_count(days, coefficient).alias("n")).withColumn(
        "epsilon", F.try_divide(F.lit(1.0), F.col("slope")))


def predictions_and_errors_table(long: DataFrame, estimators: Sequence[str], person: str = "ptid", gold: str = "gold",
                                 value: str = "estimate") -> DataFrame:
    """Person x estimator matrix of estimates and of their errors beside the gold value."""
    return long.groupBy(person).pivot("estimator", list(estimators)).agg(
        F.avg(value).alias("days"), F.avg(F.col(value) - F.col(gold)).alias("error")
    ).join(long.groupBy(person).agg(F.avg(gold).alias(gold)), person)
