"""What leaves a tile: spanning links in place of pairs, several results of one comparison."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcohort.functions import tails
from seqcohort.operators import dedup as dd
from seqcohort.operators import founder as fo
from seqcohort.operators import pairs as pr
from seqcohort.operators import sites as st
from seqcohort.plans import inputs
from tests.test_small import hamming, random_rows


def classes(n, links):
    root = list(range(n + 1))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return [top(i) for i in range(1, n + 1)]


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("cut", [0, 3, 6, 60])
def test_links_connect_what_pairs_connect(seqs, gaps, cut):
    rows = random_rows(50, 40, cut, changes=9)
    near = [(i + 1, j + 1) for i, j in itertools.combinations(range(50), 2) if hamming(rows[i], rows[j], gaps) <= cut]
    for block_rows in (9, 1000):
        got = [(r.a, r.b) for r in pr.near_links(seqs(*rows), cut, include_gaps=gaps, block_rows=block_rows).collect()]
        assert set(got) <= set(near) and len(set(got)) == len(got)
        assert classes(50, got) == classes(50, near)
        if block_rows == 1000:
            assert len(got) == 50 - len(set(classes(50, near)))


@pytest.mark.parametrize("gaps", [False, True])
def test_without_a_distance_every_pair_is_listed(seqs, gaps):
    rows = random_rows(40, 70, 3, changes=60) + ["a" * 70, "c" * 70, "-" * 70]
    want = {(i + 1, j + 1): hamming(rows[i], rows[j]) for i, j in itertools.combinations(range(43), 2)}
    df = seqs(*rows).unionByName(seqs("acgt", "tgca", sample="t"))
    for block_rows in (9, 1000):
        got = [tuple(r)[:4] for r in pr.near_pairs(df, include_gaps=gaps, block_rows=block_rows).collect()]
        assert sorted(got) == sorted([("s", a, b, d) for (a, b), d in want.items()] + [("t", 1, 2, 4)])


def test_pairwise_hamming_lists_pairs_at_any_distance(spark, tmp_path):
    import __spark_entry__ as entry

    texts = [(1, "a" * 60 + "b" * 60 + "c" * 60), (2, "d" * 60 + "i" * 30), (3, None), (4, "a" * 60)]
    docs = [(i, "web", "en", t) for i, t in texts] + [(5, "web", "de", "a" * 60)]
    spark.createDataFrame(docs, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["pairwise_hamming"](spark, str(tmp_path))
    # letters a to d and i read a, c, g, t, a
    assert {(r.sample_id, r.a, r.b): (r.hd, r.compared) for r in got.collect()} == {
        ("web_en", a, b): hd for a, b, hd in (
            (100001, 100002, (60, 60)), (100001, 100003, (60, 60)), (100001, 200001, (60, 60)), (100001, 200002, (0, 30)),
            (100002, 100003, (60, 60)), (100002, 200001, (60, 60)), (100002, 200002, (30, 30)),
            (100003, 200001, (60, 60)), (100003, 200002, (30, 30)), (200001, 200002, (30, 30)))}
    assert "hd <=" not in entry.oracle_sql()["pairwise_hamming"]


def test_links_of_small_groups(seqs):
    assert pr.near_links(seqs("acgt"), 4).count() == 0
    assert pr.near_links(seqs("acgt").limit(0), 4).count() == 0
    df = seqs("acgt", "acgt").unionByName(seqs("tttt", "acgt", sample="t"))
    assert [tuple(r) for r in pr.near_links(df, 0).collect()] == [("s", 1, 2)]


def test_clusters_equal_components_of_all_pairs(seqs):
    rows = random_rows(60, 50, 4, changes=12)
    df = seqs(*rows)
    sites = {r.seq_idx: r.seq for r in st.informative_subalignment(
        df.select("sample_id", "seq_idx", F.lit("").alias("seq_name"), "seq"), ["sample_id"], "seq_name", "seq").collect()}
    near = [(a, b) for a, b in itertools.combinations(range(1, 61), 2) if hamming(sites[a], sites[b]) <= 5]
    want = classes(60, near)
    number = {c: i + 1 for i, c in enumerate(sorted(set(want)))}
    got = {r.idx: r.cluster for r in dd.cluster_by_distance(df, 5).collect()}
    assert got == {i + 1: number[c] for i, c in enumerate(want)}


@pytest.mark.parametrize("gaps", [False, True])
def test_one_comparison_equals_separate_ones(seqs, gaps):
    rows = random_rows(40, 70, 8, changes=20)
    df = seqs(*rows).unionByName(seqs(*rows[:5], sample="t")).unionByName(seqs(rows[0], sample="u"))
    df = df.withColumn("m", F.lit(1) + F.col("seq_idx") % 3)
    stats = pr.pair_statistics(df, mult="m", include_gaps=gaps, block_rows=7)
    plain = pr.pair_histogram(df, mult="m", include_gaps=gaps, block_rows=7).select("sample_id", "hd", "n")
    assert sorted(map(tuple, pr.statistics_histogram(stats).collect())) == sorted(map(tuple, plain.collect()))
    sums = pr.centre_sums(df, mult="m", include_gaps=gaps, block_rows=7)
    assert sorted(map(tuple, pr.statistics_centres(stats).collect())) == sorted(map(tuple, sums.collect()))


def test_large_groups_travel_a_bounded_number_of_times(seqs):
    rows = random_rows(60, 30, 3, changes=9)
    df = seqs(*rows)
    tiles = pr._tiles(df, ["sample_id"], "seq_idx", "seq", None, 1)
    most = pr.SPLITS * (pr.SPLITS + 1) // 2
    got = tiles.agg(F.count(F.lit(1)), F.sum(F.size("a_ids") + F.coalesce(F.size("b_ids"), F.lit(0)))).first()
    assert got[0] <= most and got[1] <= 60 * pr.SPLITS
    hist = {r.hd: r.n_pairs for r in pr.pair_histogram(df, block_rows=1).collect()}
    near = [hamming(a, b) for a, b in itertools.combinations(rows, 2)]
    assert hist == {d: near.count(d) for d in near}


def test_covariance_sums_take_each_pair_of_bins_once(monkeypatch):
    dim, rate, seen, exp = 20, 3.7, [], np.exp
    monkeypatch.setattr(np, "exp", lambda x: seen.append(np.size(x)) or exp(x))
    got = fo._log_sum_terms(dim, rate)
    assert sum(seen) < dim**3 / 2
    for a, b in itertools.product(range(dim), repeat=2):
        lo, hi = min(a, b), max(a, b)
        want = sum(2 * rate ** (hi + j) / (math.factorial(j) * math.factorial(lo - j) * math.factorial(hi - lo + j)) for j in range(lo + 1))
        assert math.isclose(got[a, b], want, rel_tol=1e-9)


def test_whole_shapes_share_one_sum(monkeypatch):
    shapes, counts, u = np.arange(1, 41), np.linspace(1, 900, 40), np.linspace(1e-4, 1, 500, endpoint=False)
    got = tails.largest_gamma(shapes, counts, u)
    # by the incomplete gamma function of every shape
    tail = [np.minimum(tails._gamma_upper_array(float(a), got), 1 - 1e-16) for a in shapes]
    log_cdf = sum(n * np.log1p(-q) for n, q in zip(counts, tail))
    assert np.allclose(log_cdf, np.log(u), atol=1e-3)
    monkeypatch.setattr(tails, "_gamma_upper_array", None)
    assert np.array_equal(tails.largest_gamma(shapes, counts, u), got)


def test_samples_are_fitted_in_batches(spark):
    rng = np.random.default_rng(7)
    cons, pairs, want = [], [], {}
    for i in range(40):
        d = rng.poisson(rng.uniform(0.3, 6), 12)
        one, two = np.bincount(d), np.bincount([abs(a - b) for a, b in itertools.combinations(d, 2)])
        want[f"s{i}"] = fo.chi_square(one.astype(float), two.astype(float))
        cons += [(f"s{i}", k, int(n)) for k, n in enumerate(one) if n]
        pairs += [(f"s{i}", k, int(n)) for k, n in enumerate(two) if n]
    schema = "sample_id string, hd int, n bigint"
    cons, pairs = (spark.createDataFrame(rows, schema) for rows in (cons + [("none", 1, 3), (None, 2, 5)], pairs + [(None, 1, 4)]))
    good = fo.poisson_goodness(cons, pairs)
    got = {r.sample_id: r for r in good.collect()}
    assert set(got) == {*want, "none", None} and got["none"].chi2 is None and got[None].df == 2
    for k, v in want.items():
        assert [got[k].chi2, got[k].df, got[k].p, got[k].n_outside] == pytest.approx([None if math.isnan(x) else x for x in v])
    star = fo.star_rate_test(cons, pairs)
    shares = {r.sample_id: r for r in star.collect()}
    assert shares["none"].star_p is None and shares["none"].fits_star is None
    alone = fo.star_rate_test(cons.filter("sample_id = 's3'"), pairs.filter("sample_id = 's3'")).first()
    assert alone == shares["s3"] and alone.star_p + alone.star_q + alone.star_r == pytest.approx(1)
    for df in (good, star):
        assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_goodness_of_long_alignments_is_a_number():
    d = np.random.default_rng(3).poisson(400, 50)
    stat, df, _, _ = fo.chi_square(np.bincount(d).astype(float), np.bincount([a + b for a, b in itertools.combinations(d, 2)]).astype(float))
    assert math.isfinite(stat) and df == d.max()


@pytest.mark.parametrize("gaps", [False, True])
def test_sums_of_large_groups_come_from_sites(seqs, monkeypatch, gaps):
    big, small = random_rows(60, 30, 8, changes=20), random_rows(9, 21, 3, changes=9)
    df = seqs(*big, "-" * 30).unionByName(seqs(*small, sample="t")).withColumn("m", F.col("seq_idx") % 3 * (F.col("seq_idx") % 2) + 1)
    want = [r.asDict() for r in pr.centre_sums(df, mult="m", include_gaps=gaps).orderBy("sample_id", "idx").collect()]
    bins = sorted(map(tuple, pr.pair_histogram(df, mult="m", include_gaps=gaps).select("sample_id", "hd", "n").collect()))
    monkeypatch.setattr(pr, "MOMENT_ROWS", 20)
    monkeypatch.setattr(pr, "MOMENT_BLOCK", 25)
    rest, rows, large = pr._by_size(df, ["sample_id"], "seq", "m")
    assert rest.count() == 9 and rows.count() == 61 and large.count() == 1
    got = pr.centre_sums(df, mult="m", include_gaps=gaps).orderBy("sample_id", "idx")
    assert [r.asDict() for r in got.collect()] == want
    stats = pr.pair_statistics(df, mult="m", include_gaps=gaps)
    assert [r.asDict() for r in pr.statistics_centres(stats).orderBy("sample_id", "idx").collect()] == want
    assert sorted(map(tuple, pr.statistics_histogram(stats).collect())) == bins


@pytest.mark.parametrize("diag", [False, True])
@pytest.mark.parametrize("top", [60, 1 << 23])
def test_histogram_of_a_tile(diag, top):
    rng = np.random.default_rng(5)
    a, b = (pr.Block(np.ones((n, 3), np.uint8), np.arange(n), rng.integers(1, 4, n)) for n in (40, 31))
    b = a if diag else b
    code = rng.integers(0, 9, (a.n, b.n)) * (top // 8)
    if diag:
        code = np.triu(code) + np.triu(code, 1).T
    want = {}
    for i in range(a.n):
        for j in range(i + 1 if diag else 0, b.n):
            n, count = want.get(code[i, j], (0, 0))
            want[code[i, j]] = n + a.mult[i] * b.mult[j], count + 1
    value, n, count = pr._histogram(code, a, b, diag)
    assert {v: (x, y) for v, x, y in zip(value, n, count)} == want


def test_alignment_takes_letters_of_any_text(spark, tmp_path):
    texts = ["Ab, xyZ.\n q\u00e9\u4e2d\U0001f600\x00-'j" * 9, "", None, "12 ;", "k" * 121]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.seq_name, r.seq) for r in inputs.alignment(spark, str(tmp_path)).collect()}
    want, place = set(), dict(zip(inputs.LETTERS, inputs.CODES))
    for i, text in enumerate(texts):
        codes = "".join(place.get(c, "") for c in text or "")
        want |= {(f"d{i}.{k // 60 + 1}", codes[k:k + 60].ljust(60, "-")) for k in range(0, len(codes), 60)}
    assert got == want
    plan = inputs.alignment(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
