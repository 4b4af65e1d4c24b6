"""Per-sample founder statistics: hypermutation, distance fits, star tests and calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from seqcohort.functions import alphabet as ab
from seqcohort.functions import formulas as fm
from seqcohort.functions import tails
from seqcohort.operators import dedup as dd
from seqcohort.operators import pairs as pr
from seqcohort.operators.ranks import exact_quantiles, running_totals
from seqcohort.session import settle, spread

KEYS = ("sample_id",)

# The two bases after a G, read over gaps, that enable (1) or control for (2) a
# G-to-A change; 0 to 3 are a, c, g, t, 4 is any other character, 5 the end.
CONTEXT = np.zeros((6, 6), np.uint8)
CONTEXT[np.ix_([0, 2], [0, 2, 3])] = 1
CONTEXT[np.ix_([1, 3], [0, 1, 2, 3])] = 2
CONTEXT[[0, 2], 1] = 2
PLACE = np.full(128, 4, np.uint8)
PLACE[[ord(c) for c in ab.BASES]] = range(4)

# --- hypermutation ----------------------------------------------------------------------


def site_marks(query: str, width: int, refs: np.ndarray) -> np.ndarray:
    """Marks of sequences of ``width`` sites, written one after another: per site m where the
    consensus is a G (``refs``) and a mutation context follows, c with a control context, in
    upper case where the base is the mutated one, else a blank."""
    sites = np.minimum(np.frombuffer(query.encode("utf-32-le"), np.uint32), 127).astype(np.uint8).reshape(-1, width)
    gap, place = np.ascontiguousarray((sites == ord("-")).T), np.ascontiguousarray(PLACE[sites].T)
    marks = np.empty(place.shape, np.uint8)
    letters = np.frombuffer(b" mc MC", np.uint8)
    first = second = np.full(len(sites), 5, np.uint8)
    for i in range(width - 1, -1, -1):
        marks[i] = letters[np.where(refs[:, i], CONTEXT[first, second], 0) + 3 * (place[i] == 0)]
        first, second = np.where(gap[i], first, place[i]), np.where(gap[i], second, first)
    return marks.T


MARK_CHARS = 1 << 20


@F.pandas_udf(StringType())
def _marks(query: pd.Series, ref: pd.Series) -> pd.Series:
    """``site_marks`` of rows of any width."""
    out = pd.Series([None] * len(query), dtype=object)
    known = query.notna().to_numpy() & ref.notna().to_numpy()
    widths = query[known].str.len().to_numpy()
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(known)[widths == width]
        if not width:
            out.iloc[at] = ""
            continue
        step = max(1, MARK_CHARS // width)
        for start in range(0, len(at), step):
            rows = at[start:start + step]
            which, names = pd.factorize(ref.iloc[rows])
            guanine = np.array([[c == "g" for c in name[:width].ljust(width)] for name in names])
            text = site_marks("".join(query.iloc[rows]), width, guanine[which]).tobytes().decode()
            out.iloc[rows] = [text[k * width:(k + 1) * width] for k in range(len(rows))]
    return out


def _with_marks(df: DataFrame, consensus: DataFrame, keys: Sequence[str], seq: str, ref: str) -> DataFrame:
    """Adds ``_marks``: one character per site that says whether a mutation (m) or control (c)
    context follows, in upper case where the base is the mutated one."""
    return (
        df.join(consensus.select(*keys, ref), list(keys))
        .withColumn("_marks", _marks(F.lower(seq), F.lower(ref))).drop(ref)
    )


def hypermutation_sites(df: DataFrame, consensus: DataFrame, keys: Sequence[str] = KEYS,
                        name: str = "seq_name", seq: str = "seq", ref: str = "cons") -> DataFrame:
    """Potential mutation and control positions of each sequence with the base it has."""
    rows = _with_marks(df, consensus, keys, seq, ref)
    sites = rows.select(*keys, name, F.lower(seq).alias("_q"), F.posexplode(ab.chars(F.col("_marks"))).alias("_i", "_mark"))
    return sites.filter(F.trim("_mark") != "").select(
        *keys, name, F.when(F.lower("_mark") == "m", "mutation").otherwise("control").alias("kind"),
        (F.col("_i") + 1).alias("pos"), F.substr("_q", F.col("_i") + 1, F.lit(1)).alias("base"),
    )


def hypermutation_counts(df: DataFrame, consensus: DataFrame, keys: Sequence[str] = KEYS,
                         seq: str = "seq", ref: str = "cons") -> DataFrame:
    """The input rows with the four counts of their 2x2 table."""
    marked = _with_marks(df, consensus, keys, seq, ref)
    size = lambda letters: F.length(F.translate(F.col("_marks"), " " + letters, "")).cast("bigint")
    return marked.withColumns(
        {
            "n_mut": size("mcC"), "n_potential_mut": size("cC"),
            "n_control": size("cmM"), "n_potential_control": size("mM"),
        }
    ).drop("_marks")


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str, out: str = "p") -> DataFrame:
    """Two-sided exact p of the table ((a, b), (c, d)): total probability of the tables no
    likelier than the observed one, within a relative tolerance of 1e-7.

    Distinct tables are few beside sequences, so they are computed once each. Log
    factorials come from one table up to the largest margin, summed by a running window
    over as many rows as one sequence has sites.
    """
    cells = [a, b, c, d]
    tables = df.select(*cells).distinct()
    x, row1, col1, n = F.col(a), F.col(a) + F.col(b), F.col(a) + F.col(c), sum((F.col(v) for v in cells[1:]), F.col(a))

    @F.pandas_udf("double")
    def p_value(x: pd.Series, row1: pd.Series, col1: pd.Series, n: pd.Series) -> pd.Series:
        top = int(n.max()) if len(n) else 0
        lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
        out = np.ones(len(x))
        for i, (xi, r, k, t) in enumerate(zip(x, row1, col1, n)):
            s = np.arange(max(0, r + k - t), min(r, k) + 1)
            logp = -(lf[s] + lf[r - s] + lf[k - s] + lf[t - r - k + s])
            p = np.exp(logp - logp.max())
            seen = p[xi - s[0]]
            out[i] = min(1.0, p[p <= seen * (1 + 1e-7)].sum() / p.sum())
        return pd.Series(out)

    return df.join(tables.withColumn(out, p_value(x, row1, col1, n)), cells)


def hypermutation_p(df: DataFrame, consensus: DataFrame, keys: Sequence[str] = KEYS, idx: str = "seq_idx",
                    name: str = "seq_name", seq: str = "seq", ref: str = "cons") -> DataFrame:
    """Unique sequences of each sample with their counts and exact p."""
    unique = dd.exact_dedup(df, keys, name, idx, seq)
    counts = hypermutation_counts(unique, consensus, keys, seq, ref).withColumns(
        {
            "_cn": F.col("n_potential_control") - F.col("n_control"),
            "_mn": F.col("n_potential_mut") - F.col("n_mut"),
        }
    )
    return fisher_exact(settle(counts), "n_control", "_cn", "n_mut", "_mn").drop("_cn", "_mn")


def remove_hypermutated(df: DataFrame, consensus: DataFrame, threshold: float = 0.1,
                        keys: Sequence[str] = KEYS, idx: str = "seq_idx", name: str = "seq_name",
                        seq: str = "seq", ref: str = "cons") -> DataFrame:
    """Drop sequences with a small p, and with them all their identical copies."""
    flagged = hypermutation_p(df, consensus, keys, idx, name, seq, ref).filter(F.col("p") < threshold)
    return df.withColumn("_h", F.unhex(F.sha2(seq, 256))).join(
        flagged.select(*keys, F.unhex(F.sha2(seq, 256)).alias("_h")), [*keys, "_h"], "left_anti"
    ).drop("_h").select(*df.columns)


def fix_hypermutated(df: DataFrame, consensus: DataFrame, threshold: float = 0.1, fix_with: str = "r",
                     keys: Sequence[str] = KEYS, idx: str = "seq_idx", name: str = "seq_name",
                     seq: str = "seq", ref: str = "cons") -> DataFrame:
    """Keep all sequences; in those with a small p each mutated base becomes ``fix_with``."""
    flagged = hypermutation_p(df, consensus, keys, idx, name, seq, ref).filter(F.col("p") < threshold)
    rows = _with_marks(df, consensus, keys, seq, ref).withColumn("_h", F.unhex(F.sha2(seq, 256)))
    marks = flagged.select(*keys, F.unhex(F.sha2(seq, 256)).alias("_h"), F.lit(True).alias("_bad"))
    repaired = F.zip_with(
        ab.chars(F.lower(seq)), ab.chars(F.col("_marks")), lambda base, mark: F.when(mark == "M", fix_with).otherwise(base)
    )
    fixed = F.array_join(repaired, "")
    return rows.join(marks, [*keys, "_h"], "left").withColumn(
        seq, F.when(F.col("_bad"), fixed).otherwise(F.col(seq))
    ).select(*df.columns)


def propagate_exclusion(excluded: DataFrame, duplicates: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Excluded names and, through a kept -> dup map of any depth, all they stand for."""
    keys = list(keys)
    links = duplicates.filter("kept <> dup").select(*keys, F.col("kept").alias("seq_name"), "dup")
    known = settle(excluded.select(*keys, "seq_name").distinct())
    front = known
    while not front.isEmpty():
        reached = front.join(links, [*keys, "seq_name"]).select(*keys, F.col("dup").alias("seq_name")).distinct()
        front = settle(reached.join(known, [*keys, "seq_name"], "left_anti"))
        known = settle(known.unionByName(front))
    return known


# --- distance histograms and fits -------------------------------------------------------


def distance_histogram(unique: DataFrame, keys: Sequence[str] = KEYS, idx: str = "seq_idx", seq: str = "seq",
                       mult: str = "mult", include_gaps: bool = False, between: DataFrame | None = None) -> DataFrame:
    """Weighted number of pairs per distance; the copies of one sequence add to bin 0.
    ``between`` (``hd, n``) is the histogram of distinct sequences where it is already known."""
    if between is None:
        between = pr.pair_histogram(unique, keys, idx, seq, mult, include_gaps).select(*keys, "hd", "n")
    copies = unique.groupBy(*keys).agg(
        F.sum(fm.choose2(F.col(mult))).cast("bigint").alias("n")
    ).select(*keys, F.lit(0).alias("hd"), "n")
    return between.unionByName(copies).groupBy(*keys, "hd").agg(F.sum("n").alias("n")).filter("n > 0")


def consensus_histogram(distances: DataFrame, keys: Sequence[str] = KEYS, mult: str = "mult") -> DataFrame:
    return distances.groupBy(*keys, "hd").agg(F.sum(mult).alias("n"))


def poisson_lambda(hist: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean distance (the Poisson rate), largest distance and number of pairs."""
    return hist.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("hd") * F.col("n")), F.sum("n")).alias("lambda"),
        F.max("hd").alias("max_hd"), F.sum("n").alias("n_pairs"),
    )


def distance_sd_ustat(centres: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """U-statistic sd of the mean distance with copy numbers, from per-sequence sums.

    A triple sum over sequences collapses to squares of per-centre sums, so nothing beyond
    one row per sequence is aggregated. Fewer than four sequences give NULL.
    """
    keys = list(keys)
    centres = settle(centres)  # used twice; it comes from the pass over all pairs
    copies = fm.choose2(F.col("m"))
    mean = centres.groupBy(*keys).agg(
        F.sum("m").alias("nseq"),
        F.try_divide(
            F.sum(F.col("m") * F.col("s1")) / 2, F.sum(F.col("m") * F.col("s0")) / 2 + F.sum(copies)
        ).alias("mu"),
    )
    c = centres.join(mean, keys)
    mu, m = F.col("mu"), F.col("m")
    lin = F.col("s1") - mu * F.col("s0")
    square = F.col("s2") - 2 * mu * F.col("s1") + mu * mu * F.col("s0")
    own_square = F.col("q2") - 2 * mu * F.col("q1") + mu * mu * F.col("q0")
    cross = F.col("s2") - 4 * mu * F.col("s1") + 3 * mu * mu * F.col("s0")
    sums = c.groupBy(*keys).agg(
        F.max("nseq").alias("nseq"), F.max("mu").alias("mu"),
        F.sum(m * (lin * lin - own_square) / 2).alias("triples"),
        F.sum(copies * cross).alias("doubles"),
        (F.sum(m * square) / 2).alias("pairs"),
        F.sum(fm.choose3(m)).alias("c3"), F.sum(copies).alias("c2"),
    )
    n = F.col("nseq")
    falling = n * (n - 1) * (n - 2) * (n - 3)
    den1 = F.try_divide(F.lit(12.0), falling)
    sigma1 = F.col("c3") * den1 * 2 * mu * mu + F.lit(2 / 3) * (F.col("doubles") + F.col("triples"))
    sigma2 = F.col("c2") * den1 / 4 * mu * mu + F.col("pairs")
    variance = F.try_divide(8 * sigma1 + 4 * sigma2, falling)
    return sums.select(
        *keys, n.cast("bigint").alias("nseq"), "mu",
        F.when(n >= 4, F.when(variance >= 0, F.sqrt(variance))).alias("sd"),
    )


def days_confidence_interval(lam: Column, sd: Column, nbases: Column) -> list[Column]:
    """days, low and high columns, rounded half to even."""
    day = lambda x: F.bround(fm.days_from_lambda(x, nbases), 0)
    return [day(lam).alias("days"), day(lam - 1.96 * sd).alias("days_low"), day(lam + 1.96 * sd).alias("days_high")]


def star_convolution(cons_hist: DataFrame, pair_hist: DataFrame, keys: Sequence[str] = KEYS,
                     tolerance: float = 0.1, beyond_reach: bool = True) -> DataFrame:
    """Pair histogram expected under a star phylogeny (the consensus histogram convolved
    with itself) against the observed one. Joins bins, of which a sample has no more than
    sites. Nothing is expected beyond twice the largest consensus distance: pairs observed
    there count as gap, unless ``beyond_reach`` is false, which leaves them out as the
    surveyed pipeline does. All distances zero: not evaluated (NULL)."""
    keys = list(keys)
    cons_hist, pair_hist = settle(cons_hist), settle(pair_hist)
    left = cons_hist.select(*keys, F.col("hd").alias("_a"), F.col("n").alias("_na"))
    right = cons_hist.select(*keys, F.col("hd").alias("_b"), F.col("n").alias("_nb"))
    conv = (
        left.join(right, keys)
        .select(*keys, (F.col("_a") + F.col("_b")).alias("hd"), (F.col("_na") * F.col("_nb") / 2).alias("v"))
        .unionByName(cons_hist.select(*keys, (2 * F.col("hd")).alias("hd"), (-F.col("n") / 2).alias("v")))
        .groupBy(*keys, "hd").agg(F.sum("v").alias("conv"))
    )
    top = pair_hist.groupBy(*keys).agg(F.max("hd").alias("max_hd"))
    both = conv.join(pair_hist.select(*keys, "hd", F.col("n").alias("obs")), [*keys, "hd"], "full_outer").join(top, keys)
    gap = F.abs(F.coalesce("obs", F.lit(0)) - F.coalesce("conv", F.lit(0.0)))
    reach = cons_hist.groupBy(*keys).agg((2 * F.max("hd") + 1).alias("reach"))
    check = both.join(reach, keys).groupBy(*keys).agg(
        F.max("max_hd").alias("max_hd"),
        F.try_divide(
            F.sum(F.when((F.col("hd") <= F.col("max_hd")) & (F.lit(beyond_reach) | (F.col("hd") <= F.col("reach"))), gap).otherwise(0.0)),
            F.sum("conv"),
        ).alias("check"),
    )
    return check.select(
        *keys, F.when(F.col("max_hd") > 0, F.col("check")).alias("check"),
        F.when(F.col("max_hd") > 0, F.col("check") <= tolerance).alias("follows_star"),
    )


def _log_sum_terms(dim: int, rate: float, scale: float = 0.0) -> np.ndarray:
    """Matrix of the two combinatorial sums in the covariance of pair counts that share
    one sequence, for all bin pairs at once, times ``exp(-3 scale)``. Both sums are equal: over the
    differences j that two pairs share, of products of three Poisson terms (j, l - j, h - j)."""
    k = np.arange(dim)
    term = np.exp(k * np.log(rate) - tails.lgamma(k + 1.0) - scale)
    apart = k[:, None] - k
    own = np.where(apart >= 0, term[np.abs(apart)], 0.0)
    return 2 * (own * term) @ own.T


def chi_square(cons: np.ndarray, observed: np.ndarray) -> tuple[float, float, float, float]:
    """(statistic, df, p, pairs outside) of observed pair counts against the Poisson model fitted to the
    consensus counts; both arrays are indexed by distance. Every bin of either takes part:
    counts are in logarithms, so that their number is not limited. Bins that the model all but
    rules out have no usable variance (the inverse is a pseudo-inverse); the pairs observed in
    them are counted as outside, and a fit with such pairs gets the smallest p."""
    nseq = cons.sum()
    width = len(cons)
    rate = (np.arange(width) * cons).sum() / nseq
    if rate <= 0 or not observed[1:].any():
        return np.nan, np.nan, 0.0, 0.0
    dim = max(2 * width, len(observed))
    x = np.arange(dim)
    lf = tails.lgamma(x + 1.0)
    pairs = np.exp(2 * np.log(nseq) + x * np.log(2 * rate) - 2 * rate - lf)
    single = nseq * np.exp(x * np.log(rate) - rate - lf)
    cov = 0.5 * nseq**3 * _log_sum_terms(dim, rate, rate)
    cov[x, x] += 0.5 * pairs
    even = x[x % 2 == 0]
    cov[even, even] -= 0.25 * single[even // 2]
    s, u = np.linalg.eigh(cov)
    keep = np.abs(s) > 1e-4
    y = np.zeros(dim)
    y[: len(observed)] = observed
    gap = np.abs(y - 0.5 * pairs)
    stat = float(((gap @ u[:, keep]) ** 2 / s[keep]).sum())
    df = width - 1
    outside = float(y[np.diag(cov) <= 1e-4].sum())
    p = 2e-16 if stat < 0 or outside else max(tails.chi2_sf(stat, df), 2e-16)
    return (tails.chi2_isf(2e-16, df) if stat < 0 else stat), float(df), p, outside


def _both_bins(cons_hist: DataFrame, pair_hist: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """One row per sample with the bins of both histograms (``kind`` 0: consensus, 1: pairs)."""
    both = cons_hist.select(*keys, F.lit(0).alias("kind"), "hd", "n").unionByName(
        pair_hist.select(*keys, F.lit(1).alias("kind"), "hd", "n")
    )
    bins = spread(both, *keys).groupBy(*keys).agg(F.collect_list(F.struct("kind", "hd", "n")).alias("_b"))
    return bins.select(*keys, *more, *[F.col(f"_b.{c}").alias(f"_{c}") for c in ("kind", "hd", "n")])


def _per_sample(bins: DataFrame, keys: Sequence[str], schema: str, function: Callable[..., tuple]) -> DataFrame:
    """``function`` of every row of ``bins`` but its keys; many small samples are one batch."""
    kinds = ", ".join(f"`{k}` {bins.schema[k].dataType.simpleString()}" for k in keys)
    names, inputs = [c.split()[0] for c in schema.split(", ")], [c for c in bins.columns if c not in keys]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [function(*row) for row in zip(*(frame[c] for c in inputs))]
            yield frame[list(keys)].reset_index(drop=True).join(pd.DataFrame(found, columns=names, dtype=float))

    return bins.mapInPandas(run, f"{kinds}, {schema}")


def poisson_goodness(cons_hist: DataFrame, pair_hist: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Chi-square fit of the pair histogram per sample. A row holds histogram bins, at
    most two per site of the alignment."""
    keys = list(keys)

    def fit(kind: np.ndarray, hd: np.ndarray, n: np.ndarray) -> tuple:
        dense = []
        for side in (0, 1):
            mine = kind == side
            counts = np.zeros(int(hd[mine].max(initial=0)) + 1)
            counts[hd[mine]] = n[mine]
            dense.append(counts)
        if dense[0].sum() == 0 or dense[1].sum() == 0:
            return np.nan, np.nan, np.nan, np.nan
        return chi_square(*dense)

    fitted = _per_sample(_both_bins(cons_hist, pair_hist, keys), keys, "chi2 double, df double, p double, n_outside double", fit)
    tidy = {c: F.nanvl(c, F.lit(None)) for c in ("chi2", "df", "p", "n_outside")}
    return fitted.withColumns(tidy).withColumn("is_poisson", F.col("p") > 0.05)


def degenerate_sample_rule(fit: DataFrame, max_hd: str = "max_hd") -> DataFrame:
    """A sample without any distance has rate 0, days 0 (0, 1), p 1 and follows a star."""
    flat = F.col(max_hd) == 0
    fixed = {"lambda": 0.0, "days": 0.0, "days_low": 0.0, "days_high": 1.0, "p": 1.0, "follows_star": True, "is_poisson": True}
    present = {
        c: F.when(flat, F.lit(v).cast(fit.schema[c].dataType)).otherwise(F.col(c))
        for c, v in fixed.items() if c in fit.columns
    }
    return fit.withColumns(present)


# --- star rate test ---------------------------------------------------------------------


def shrink_histogram(hist: DataFrame, size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Histograms of more than ``size`` observations scaled down to about that many; bins
    that round to nothing are lost, so no other operator uses it unasked."""
    total = hist.groupBy(*keys).agg(F.sum("n").alias("_t"))
    scaled = F.bround(F.lit(float(size)) * F.col("n") / F.col("_t"), 0).cast("bigint")
    return (
        hist.join(total, list(keys))
        .withColumn("n", F.when(F.col("_t") > size, scaled).otherwise(F.col("n")))
        .drop("_t").filter("n > 0")
    )


def star_rate_test(cons_hist: DataFrame, pair_hist: DataFrame, keys: Sequence[str] = KEYS, draws: int = 1000,
                   low: float = 1.5, high: float = 2.5, seed: int = 1, limit: float = 0.95) -> DataFrame:
    """Monte-Carlo test that the pair rate is between ``low`` and ``high`` times the
    consensus rate. Each draw gives both rates an interval: from the largest of one gamma
    draw per observation, with an exponential width of rate n. Shares of draws in which
    the intervals nest (P), are disjoint (Q) or neither (R); the star fits below ``limit``.

    The largest of all observations' draws is drawn from its own distribution, so that their
    number costs nothing and none is left out.

    The generator is seeded from the sample key, so results do not depend on partitioning.
    """
    keys = list(keys)

    def interval(rng: np.random.Generator, hd: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = hd > 0
        u = 1 - rng.random(draws)
        top = tails.largest_gamma(hd[far], n[far].astype(float), u) if far.any() else np.zeros(draws)
        return top, top + rng.exponential(1 / n.sum(), draws)

    def test(own_seed: int, kind: np.ndarray, hd: np.ndarray, n: np.ndarray) -> tuple:
        order = np.lexsort([hd, kind])
        kind, hd, n = kind[order], hd[order], n[order]
        one, two = kind == 0, kind == 1
        if not one.any() or not two.any():
            return None, None, None
        rng = np.random.default_rng(int(own_seed) & (2**63 - 1))
        lo1, hi1 = interval(rng, hd[one], n[one])
        lo2, hi2 = interval(rng, hd[two], n[two])
        lo1, hi1 = low * lo1, high * hi1
        q = (hi1 < lo2) | (lo1 > hi2)
        p = ~q & (lo1 >= lo2) & (hi1 <= hi2)
        return p.mean(), q.mean(), (~p & ~q).mean()

    bins = _both_bins(cons_hist, pair_hist, keys, F.xxhash64(*keys, F.lit(seed)).alias("_seed"))
    shares = _per_sample(bins, keys, "star_p double, star_q double, star_r double", test)
    tidy = {c: F.nanvl(c, F.lit(None)) for c in ("star_p", "star_q", "star_r")}
    return shares.withColumns(tidy).withColumn("fits_star", F.col("star_q") < limit)


def empirical_upper_p(null: DataFrame, stat: Column, keys: Sequence[str] = KEYS, value: str = "null_stat",
                      add_one: bool = True, use_interval: bool = True) -> DataFrame:
    """One-sided p of a statistic against null draws, or its Wilson upper bound."""
    extra = 1 if add_one else 0
    counted = null.groupBy(*keys).agg(
        (F.count_if(F.col(value) >= stat) + extra).alias("_k"), (F.count(value) + extra).alias("_n")
    )
    p = fm.wilson_upper(F.col("_k"), F.col("_n")) if use_interval else F.col("_k") / F.col("_n")
    return counted.select(*keys, p.alias("p"))


# --- diversity and calls ----------------------------------------------------------------


def fixed_size_subset(df: DataFrame, size: int, keys: Sequence[str] = KEYS, name: str = "seq_name") -> DataFrame:
    """Reproducible random subset per sample: the ``size`` smallest name hashes.

    A cut-off taken from per-bucket counts keeps hot samples out of a single window.
    """
    hashed = df.withColumn("_h", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint"))
    ranked = running_totals(hashed.withColumn("_one", F.lit(1).cast("bigint")), keys, "_h", ["_one"])
    chosen = ranked.filter(F.col("_one_through") <= size).select(*keys, "_h")
    return hashed.join(chosen, [*keys, "_h"], "left_semi").select(*df.columns)


def pairwise_diversity(unique: DataFrame, keys: Sequence[str] = KEYS, idx: str = "seq_idx", seq: str = "seq",
                       mult: str = "mult", jukes_cantor: bool = False) -> DataFrame:
    """Spread of pairwise per-site distances over all pairs, from the histogram of
    (differences, sites compared): quantiles over at most sites^2 weighted values. Pairs
    that share no site are left out. The Jukes-Cantor distance is infinite for pairs that
    differ at three quarters of their sites or more; ``n_saturated`` counts those beside
    the ``n_pairs`` of the statistics."""
    keys = list(keys)
    width = unique.groupBy(*keys).agg(F.max(F.length(seq)).alias("_w"))
    between = pr.pair_histogram(unique, keys, idx, seq, mult, with_compared=True).select(*keys, "hd", "compared", "n")
    # copies of one sequence are compared on the sites it knows
    known = F.length(F.translate(F.col(seq), "-?", "")).cast("int")
    copies = unique.groupBy(*keys, known.alias("compared")).agg(
        F.sum(fm.choose2(F.col(mult))).cast("bigint").alias("n")
    ).select(*keys, F.lit(0).alias("hd"), "compared", "n")
    p = F.col("hd") / F.col("compared")
    dist = F.when(p < 0.75, -0.75 * F.ln(1 - 4 * p / 3)) if jukes_cantor else p
    combined = settle(
        between.unionByName(copies).filter("compared > 0 AND n > 0").withColumn("d", dist).groupBy(*keys, "d").agg(
            F.sum("n").alias("n"))
    )
    probs, names = (0.0, 0.25, 0.5, 0.75, 1.0), ("min", "q1", "median", "q3", "max")
    quantiles = exact_quantiles(combined, keys, "d", probs, names, weight="n")
    known_n = F.when(F.col("d").isNotNull(), F.col("n"))
    s = combined.groupBy(*keys).agg(
        F.coalesce(F.sum(known_n), F.lit(0)).alias("n_pairs"), F.sum(F.when(F.col("d").isNull(), F.col("n")).otherwise(0)).alias("n_saturated"),
        F.sum(F.col("d") * F.col("n")).alias("_s1"), F.sum(F.col("d") * F.col("d") * F.col("n")).alias("_s2"),
    )
    n = F.col("n_pairs")
    mean = F.try_divide("_s1", n)
    variance = F.try_divide(F.greatest(F.col("_s2") - n * mean * mean, F.lit(0.0)), n - 1)
    nseq = unique.groupBy(*keys).agg(F.sum(mult).alias("num_seqs"))
    return s.join(nseq, keys).join(quantiles, keys, "left").select(
        *keys, "num_seqs", "n_pairs", mean.alias("mean"), F.sqrt(F.try_divide(variance, n)).alias("sem"), *names,
        *(["n_saturated"] if jukes_cantor else []),
    )


def founder_call(df: DataFrame, diversity: str = "diversity", ratio: str = "ratio", sample: str = "sample_id",
                 clusters: str | None = None, min_diversity: float = 0.001, threshold: float = 0.85,
                 threshold_v3: float = 0.33) -> DataFrame:
    """Multiple founders when diversity and the informative-to-private ratio both exceed
    their thresholds (the V3 region has its own)."""
    limit = F.when(F.lower(sample).contains("_v3"), threshold_v3).otherwise(threshold)
    multiple = (F.col(diversity) > min_diversity) & (F.col(ratio) > limit)
    out = df.withColumn("is_one_founder", F.when(multiple, 0).otherwise(1))
    if clusters:
        out = out.withColumn("num_founders", F.when(F.col("is_one_founder") == 1, F.lit(1)).otherwise(F.col(clusters)))
    return out


def star_founder_call(df: DataFrame, fits: str = "fits_star", diversity: str = "diversity",
                      min_diversity: float = 0.001) -> DataFrame:
    """Multiple founders when the star test fails, unless diversity is known to be small."""
    multiple = ~F.col(fits) & (F.col(diversity).isNull() | (F.col(diversity) > min_diversity))
    return df.withColumn("star_is_one_founder", F.when(F.coalesce(multiple, F.lit(False)), 0).otherwise(1))


def total_distance(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    """Sum of all pair distances of a sample without forming a pair: per site, every
    character count times the counts of the characters that differ from it."""
    from seqcohort.operators.sites import base_counts

    codes = F.create_map(*[F.lit(x) for c, m in ab.MASK.items() for x in (c, m)])
    masks = base_counts(df, keys, seq).withColumn("m", F.try_element_at(codes, F.lower("base"))).filter("m IS NOT NULL")
    per_site = masks.groupBy(*keys, "pos").agg(F.collect_list(F.struct("m", "n")).alias("v"))
    zero = F.lit(0).cast("bigint")

    def differing(x: Column) -> Column:
        return F.aggregate(
            "v", zero, lambda acc, y: acc + F.when(x["m"].bitwiseAND(y["m"]) == 0, x["n"] * y["n"]).otherwise(zero)
        )

    twice = F.aggregate("v", zero, lambda acc, x: acc + differing(x))
    return per_site.groupBy(*keys).agg((F.sum(twice) / 2).cast("bigint").alias("sum_hd"))
