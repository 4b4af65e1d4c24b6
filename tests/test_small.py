"""Hand-worked frames and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcohort.functions import alphabet as ab
from seqcohort.functions import formulas as fm
from seqcohort.functions import tails
from seqcohort.operators import dedup as dd
from seqcohort.operators import evaluate as ev
from seqcohort.operators import founder as fo
from seqcohort.operators import joins as jn
from seqcohort.operators import pairs as pr
from seqcohort.operators import ranks as rk
from seqcohort.operators import scalars as sc
from seqcohort.operators import sites as st
from seqcohort.session import scratch_path
from seqcohort.sources import alignments as al
from seqcohort.sources import tables as tb


def hamming(x, y, gaps=False):
    mask = lambda c: ab.MASK.get(c, 0)
    d = sum(1 for a, b in zip(x, y) if mask(a) and mask(b) and not mask(a) & mask(b))
    return d + (sum(1 for a, b in zip(x, y) if bool(mask(a)) != bool(mask(b))) if gaps else 0)


def random_rows(n, width, seed, letters="acgt", base=None, changes=3):
    rng = random.Random(seed)
    base = base or "".join(rng.choice(letters) for _ in range(width))
    out = []
    for _ in range(n):
        row = list(base)
        for _ in range(rng.randint(0, changes)):
            row[rng.randrange(width)] = rng.choice(letters + "-rn")
        out.append("".join(row))
    return out


def test_consensus_ties_take_the_first_character(seqs):
    df = seqs("ac-", "ca-", "a--", "c--")
    assert st.majority_consensus(df).first()["cons"] == "a--"


def test_flanking_gaps_do_not_vote(seqs):
    df = seqs("--acg-", "ttac-a", "ttacga")
    assert st.flank_aware_consensus(df).first()["cons"] == "ttacga"
    assert seqs("--", "--").transform(st.flank_aware_consensus).first()["cons"] == "--"


def test_entropy_splits_ambiguity_and_skips_gaps(seqs):
    got = {r.pos: r.entropy for r in st.site_entropy(seqs("ra-", "ga-", "-a-")).collect()}
    p = np.array([0.25, 0.75])
    assert got[1] == pytest.approx(-(p * np.log2(p)).sum())
    assert got[2] == 0 and got[3] is None


def test_site_can_be_informative_and_private(seqs):
    r = st.informative_and_private_sites(seqs("a", "a", "a", "a", "c", "c", "g")).first()
    assert r.informative and r.private and not r.private_gap_only


@pytest.mark.parametrize("codon,aa", [("atg", "M"), ("---", "-"), ("atn", "X"), ("ytr", "L"), ("sar", "Z"), ("ray", "B"), ("gt", "V"), ("gc-", "A")])
def test_translation(spark, codon, aa):
    assert spark.range(1).select(ab.amino_acid(F.lit(codon))).first()[0] == aa


def test_codon_masks(seqs, spark):
    df = seqs("atg---gctc", "ataaa-gccc")
    ref = spark.createDataFrame([("s", "atg---gctc")], "sample_id string, cons string")
    non = {r.seq_idx: r.seq for r in sc.mask_codons(df, ref, "nonsynonymous").collect()}
    syn = {r.seq_idx: r.seq for r in sc.mask_codons(df, ref, "synonymous").collect()}
    assert non == {1: "---------c", 2: "ata------c"}
    assert syn == {1: "atg---gctc", 2: "---aa-gccc"}


def test_ambiguity_distance_is_not_transitive(seqs):
    got = {(r.a, r.b): r.hd for r in pr.near_pairs(seqs("acgt", "rcgt", "gcgt"), 9).collect()}
    assert got == {(1, 2): 0, (2, 3): 0, (1, 3): 1}


@pytest.mark.parametrize("gaps", [False, True])
def test_tiles_see_every_pair_once(seqs, gaps):
    rows = random_rows(45, 70, 1, changes=30)
    want = {(i + 1, j + 1): hamming(rows[i], rows[j], gaps) for i, j in itertools.combinations(range(45), 2)}
    df = seqs(*rows).withColumn("m", F.lit(1) + F.col("seq_idx") % 3)
    near = pr.near_pairs(df, 12, include_gaps=gaps, block_rows=7).collect()
    assert {(r.a, r.b) for r in near} == {k for k, v in want.items() if v <= 12}
    hist = {r.hd: (r.n, r.n_pairs) for r in pr.pair_histogram(df, mult="m", include_gaps=gaps, block_rows=7).collect()}
    expect = {}
    for (a, b), d in want.items():
        n, k = expect.get(d, (0, 0))
        expect[d] = (n + (1 + a % 3) * (1 + b % 3), k + 1)
    assert hist == expect
    nearest = {r.idx: (r.hd, r.nearest) for r in pr.nearest_pairs(df, include_gaps=gaps, block_rows=7).collect()}
    for i in range(1, 46):
        assert nearest[i] == min((want[tuple(sorted((i, j)))], j) for j in range(1, 46) if j != i)
    sums = {r.idx: r.s2 for r in pr.centre_sums(df, mult="m", include_gaps=gaps, block_rows=7).collect()}
    assert sums[1] == sum((1 + j % 3) * want[(1, j)] ** 2 for j in range(2, 46))


def test_bit_planes_match_brute_force(spark):
    rows = random_rows(20, 130, 2, changes=60)
    df = spark.createDataFrame([(x, y) for x in rows for y in rows], "x string, y string")
    got = df.select("x", "y", pr.plane_counts(pr.bit_planes(F.col("x")), pr.bit_planes(F.col("y"))).alias("c")).collect()
    assert all(r.c.hd == hamming(r.x, r.y) and r.c.hd + r.c.gap_difference == hamming(r.x, r.y, True) for r in got)


def test_total_distance_without_pairs(seqs):
    rows = random_rows(30, 40, 3, changes=12)
    want = sum(hamming(x, y) for x, y in itertools.combinations(rows, 2))
    assert fo.total_distance(seqs(*rows)).first()["sum_hd"] == want


def greedy(n, dist, k, removed):
    """Input-order absorption, one sequence after the other."""
    removed = dict(removed)
    for i in range(n):
        if i in removed:
            continue
        out = [j for j in range(n) if j != i and j in removed and dist[i][j] <= k]
        if out:
            removed[i] = removed[out[0]]
            continue
        for j in [j for j in range(n) if j != i and dist[i][j] <= k]:
            removed[j] = i
    return removed


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 2), (3, 3), (4, 0)])
def test_greedy_dedup_equals_sequential(seqs, seed, k):
    rows = list(dict.fromkeys(random_rows(60, 24, seed, changes=4)))
    dist = [[hamming(x, y, True) for y in rows] for x in rows]
    want = {i + 1: r + 1 for i, r in greedy(len(rows), dist, k, {}).items()}
    assert {r.idx: r.rep for r in dd.distance_dedup(seqs(*rows), k).collect()} == want


def test_dedup_to_max_equals_sequential(seqs):
    rows = list(dict.fromkeys(random_rows(40, 24, 7, changes=5)))
    dist = [[hamming(x, y, True) for y in rows] for x in rows]
    removed, k = {}, 0
    while len(rows) - len(removed) > 20:
        removed = greedy(len(rows), dist, k, removed)
        k += 1
    got = {r.idx: r.rep for r in dd.dedup_to_max(seqs(*rows), 20).collect()}
    assert got == {i + 1: r + 1 for i, r in removed.items()}


@pytest.mark.parametrize("block", [4096, 1])
def test_dedup_to_max_takes_every_threshold_of_a_sample(seqs, monkeypatch, block):
    """Keepers go with what they absorbed at the next threshold, before any farther pair merges."""
    monkeypatch.setattr(dd, "BLOCK_ROWS", block)
    rows = ["a" * 24, "a" * 23 + "c", "c" * 24, "c" * 23 + "a", "g" * 24, "g" * 20 + "tttt"]
    dist = [[hamming(x, y, True) for y in rows] for x in rows]
    want = greedy(6, dist, 2, greedy(6, dist, 1, {}))
    assert want == {1: 0, 3: 2, 0: 0, 2: 2}
    assert {r.idx: r.rep for r in dd.dedup_to_max(seqs(*rows), 3).collect()} == {i + 1: r + 1 for i, r in want.items()}


def test_reduced_blocks_equal_sequential():
    for seed in range(60):
        rows = list(dict.fromkeys(random_rows(4 + seed % 30, 16, seed, changes=2 + seed % 5)))
        dist = [[hamming(x, y, True) for y in rows] for x in rows]
        removed, k, n_max = {}, 0, 2 + seed % 9
        while k == 0 or len(rows) - len(removed) > n_max:
            step = greedy(len(rows), dist, k, removed)
            if len(step) == len(rows) or k > 16:
                break
            removed, k = step, k + 1
        got = dd.reduced_block(rows, n_max, True)
        assert {i: r for i, r in enumerate(got.tolist()) if r >= 0} == removed, seed


def test_components_and_clusters(spark, seqs):
    edges = spark.createDataFrame([("s", i, i + 1) for i in range(1, 30) if i != 17] + [("s", 40, 41)], "sample_id string, a bigint, b bigint")
    vertices = spark.createDataFrame([("s", i) for i in range(1, 43)], "sample_id string, idx bigint")
    got = {r.idx: r.component for r in dd.connected_components(vertices, edges).collect()}
    assert got == {i: 1 if i <= 17 else 18 if i <= 30 else 40 if i in (40, 41) else i for i in range(1, 43)}
    rows = ["aaaaaaaa"] * 3 + ["aaaaaaac"] * 2 + ["ccccccaa"] * 3
    clusters = {r.idx: r.cluster for r in dd.cluster_by_distance(seqs(*rows), 2).collect()}
    assert clusters == {i: 1 if i <= 5 else 2 for i in range(1, 9)}


def test_ustat_equals_triple_sum(seqs):
    rows, mult = random_rows(7, 30, 5, changes=8), [3, 1, 2, 1, 1, 4, 1]
    n, d = sum(mult), [[hamming(x, y) for y in rows] for x in rows]
    pairs = list(itertools.combinations(range(7), 2))
    mu = sum(mult[i] * mult[j] * d[i][j] for i, j in pairs) / (n * (n - 1) / 2)
    den1 = 12 / (n * (n - 1) * (n - 2) * (n - 3))
    s1 = sum(math.comb(m, 3) for m in mult) * den1 * 2 * mu**2
    s2 = sum(math.comb(m, 2) for m in mult) * den1 / 4 * mu**2
    for i, j in pairs:
        s2 += mult[i] * mult[j] * (d[i][j] - mu) ** 2
        s1 += 2 / 3 * (math.comb(mult[i], 2) * mult[j] + mult[i] * math.comb(mult[j], 2)) * (d[i][j] - mu) * (d[i][j] - 3 * mu)
    for i, j, k in itertools.combinations(range(7), 3):
        a, b, c = d[i][j] - mu, d[i][k] - mu, d[j][k] - mu
        s1 += 2 / 3 * mult[i] * mult[j] * mult[k] * (a * b + a * c + b * c)
    want = math.sqrt((8 * s1 + 4 * s2) / (n * (n - 1) * (n - 2) * (n - 3)))
    df = seqs(*rows).withColumn("m", F.array(*map(F.lit, mult))[(F.col("seq_idx") - 1).cast("int")])
    got = fo.distance_sd_ustat(pr.centre_sums(df, mult="m", block_rows=3)).first()
    assert got.nseq == n and got.mu == pytest.approx(mu) and got.sd == pytest.approx(want)


def test_hypermutation_reads_over_gaps(seqs, spark):
    df = seqs("aaa-ggcgta")
    cons = spark.createDataFrame([("s", "ggaggcgtaa")], "sample_id string, cons string")
    got = {(r.pos, r.kind, r.base) for r in fo.hypermutation_sites(df, cons).collect()}
    assert got == {(1, "mutation", "a"), (2, "mutation", "a"), (4, "mutation", "-"), (5, "control", "g"), (7, "mutation", "c")}


def test_fisher(spark):
    df = spark.createDataFrame([(3, 1, 1, 3), (0, 0, 0, 0), (10, 2, 3, 15)], "a bigint, b bigint, c bigint, d bigint")
    got = {r.a: r.p for r in fo.fisher_exact(df, "a", "b", "c", "d").collect()}
    assert got[3] == pytest.approx(0.4857142857) and got[0] == 1 and got[10] == pytest.approx(0.000536724119, rel=1e-6)


def test_tails():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi2_sf(tails.chi2_isf(1e-6, 7), 7) == pytest.approx(1e-6)
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138852)


def test_goodness_accepts_star_and_rejects_mixture():
    rng = np.random.default_rng(1)
    d = rng.poisson(1.5, 60)
    cons = np.bincount(d)
    pairs = np.bincount([a + b for a, b in itertools.combinations(d, 2)])
    assert fo.chi_square(cons, pairs)[2] > 0.05
    two = np.bincount([abs(a - b) + 20 * (i % 2 != j % 2) for (i, a), (j, b) in itertools.combinations(enumerate(d), 2)])
    assert fo.chi_square(cons, two)[2] < 0.05
    assert fo.chi_square(np.array([5.0]), np.array([10.0]))[2] == 0


def test_star_rate_shares(spark):
    rows = [("s", d, n) for d, n in enumerate(np.bincount(np.random.default_rng(2).poisson(2, 40)).tolist()) if n]
    cons = spark.createDataFrame(rows, "sample_id string, hd int, n bigint")
    pairs = cons.withColumns({"hd": F.col("hd") * 2, "n": F.col("n") * 30})
    r = fo.star_rate_test(cons, pairs).first()
    assert r.star_p + r.star_q + r.star_r == pytest.approx(1)
    assert fo.star_rate_test(cons.repartition(3), pairs).first() == r


def test_degenerate_sample(spark):
    df = spark.createDataFrame([("s", 0.0, -5.0, 0)], "sample_id string, lambda double, days double, max_hd int")
    assert fo.degenerate_sample_rule(df).first()["days"] == 0.0


def test_fixed_digits_round_like_c(spark):
    values = [0.00375, 0.125, 2.675, -1.005, 1e6 + 0.5, 0.5, 1.5, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r)[1:] for r in df.select("v", fm.fixed_digits(F.col("v"), 4), fm.fixed_digits(F.col("v"), 2), fm.fixed_digits(F.col("v"), 0)).collect()]
    assert got == [(f"{v:.4f}", f"{v:.2f}", f"{v:.0f}") for v in values]


def test_names(spark):
    name = "a|b/c\\d..e.f"
    r = spark.createDataFrame([(name,)], "n string").select(sc.escape_names(F.col("n")).alias("e"))
    assert r.select(sc.unescape_names(F.col("e"))).first()[0] == name
    got = spark.createDataFrame([("a_3",), ("b",), ("_4",), ("x_y",)], "n string").select(sc.parse_multiplicity(F.col("n"))).collect()
    assert [g[0] for g in got] == [3, 1, 1, 1]


def test_exclusion_follows_chains(spark):
    dups = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "d"), ("s", "x", "y")], "sample_id string, kept string, dup string")
    bad = spark.createDataFrame([("s", "a")], "sample_id string, seq_name string")
    assert {r.seq_name for r in fo.propagate_exclusion(bad, dups).collect()} == set("abcd")


def test_reduplicate_reports(seqs, spark):
    df = seqs("aa", "aa", "cc")
    dups = dd.duplicate_map(df)
    kept = dd.with_copy_number(dd.exact_dedup(df)).select("sample_id", "seq_name", "seq")
    assert jn.names_carry_copies(kept, dups).first()[0]
    back = jn.reduplicate(kept, dups, strip_suffix=True)
    assert {(r.seq_name, r.seq) for r in back["sequences"].collect()} == {("n1", "aa"), ("n2", "aa"), ("n3", "cc")}
    assert back["orphans"].isEmpty() and back["not_found"].isEmpty()


def test_clip_without_bounds_fails(spark):
    v = spark.createDataFrame([("p", 3.0)], "ptid string, v double")
    b = spark.createDataFrame([("q", 1.0, 2.0)], "ptid string, lower double, upper double")
    with pytest.raises(Exception, match="no bounds"):
        jn.clip_to_bounds(v, b, "v").collect()
    assert jn.clip_to_bounds(v, b.withColumn("ptid", F.lit("p")), "v").first()["v"] == 2.0


def test_running_totals_and_quantiles(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.exponential(10, 3000), 1)
    df = spark.createDataFrame([("k" if i % 3 else "j", float(v)) for i, v in enumerate(values)], "k string, v double")
    got = {r.k: r for r in rk.exact_quantiles(df, ["k"], "v", (0.1, 0.5, 0.77), ("a", "b", "c")).collect()}
    for key in "kj":
        part = [v for i, v in enumerate(values) if ("k" if i % 3 else "j") == key]
        assert [got[key].a, got[key].b, got[key].c] == pytest.approx(np.quantile(part, [0.1, 0.5, 0.77]).tolist())


def test_lopo_models(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=120), rng.normal(size=120)
    y = 2 + 3 * x + 0.1 * rng.normal(size=120)
    rows = [("e", f"p{i % 12}", float(a), float(b), float(c), int(c + rng.normal() > 2)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    df = spark.createDataFrame(rows, "estimator string, ptid string, x double, z double, y double, g int")
    got = {(r.ptid, r.x): r.prediction for r in ev.lopo_linear_predictions(df, "y", ["x", "z"]).collect()}
    for p in ("p0", "p5"):
        train = np.array([[1, r[2], r[3]] for r in rows if r[1] != p])
        beta = np.linalg.lstsq(train, np.array([r[4] for r in rows if r[1] != p]), rcond=None)[0]
        for r in (r for r in rows if r[1] == p):
            assert got[(p, r[2])] == pytest.approx(float(beta @ [1, r[2], r[3]]))
    stats = ev.fold_statistics(df, "y", ["x", "z"])
    lasso = ev.lasso_coefficients(stats, (0, 1)).first()["beta"]
    assert lasso[1] == pytest.approx(3, abs=0.05) and abs(lasso[2]) < 0.05
    p = "p3"
    a = np.array([[1, r[2]] for r in rows if r[1] != p])
    g = np.array([r[5] for r in rows if r[1] != p])
    beta = np.zeros(2)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-a @ beta))
        beta += np.linalg.solve((a * (mu * (1 - mu))[:, None]).T @ a, a.T @ (g - mu))
    logit = {(r.ptid, r.x): r.prediction for r in ev.lopo_logistic_predictions(df, "g", ["x"]).collect()}
    for r in (r for r in rows if r[1] == p):
        assert logit[(p, r[2])] == pytest.approx(1 / (1 + math.exp(-(beta @ [1, r[2]]))), rel=1e-5)


def test_alignment_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x one\nACG\nT-A\n>y>z\nacg\nttt\n")
    (tmp_path / "b.fasta").write_text(">x\nacg\n>X\nacgt\n")
    rows = al.read_fasta(spark, str(tmp_path / "*.fasta"))
    got = [(r.sample_id, r.seq_name, r.seq) for r in rows.orderBy("sample_id", "seq_idx").collect()]
    assert got == [("a", "x", "acgt-a"), ("a", "y>z", "acgttt"), ("b", "x", "acg"), ("b", "X", "acgt")]
    good, bad = al.split_valid(rows)
    assert {r.sample_id for r in good.collect()} == {"a"}
    assert bad.first()["reason"] == "duplicate name, unequal length"
    path = scratch_path(spark, "out")
    al.write_fasta(good, path, 4)
    again = al.read_fasta(spark, path + "/*", r"sample_id=([^/]+)/")
    assert [(r.seq_name, r.seq) for r in again.orderBy("seq_idx").collect()] == [("x", "acgt-a"), ("y>z", "acgttt")]


def test_dates(spark):
    df = spark.createDataFrame([("03/04/11",), ("2011/03/04",), ("",)], "t string")
    got = [r[0] and str(r[0]) for r in df.select(tb.parse_date(F.col("t"))).collect()]
    assert got == ["2011-03-04", "2011-03-04", None]


def test_goodness_sees_bins_at_any_distance():
    cons = np.array([60.0, 25, 10, 5])
    pairs = np.array([600.0, 900, 800, 500, 300, 150, 60, 20, 5])
    far = np.zeros(200)
    far[: len(pairs)] = pairs
    more = far.copy()
    more[190] = 20
    assert fo.chi_square(cons, far)[3] == 0
    assert fo.chi_square(cons, more)[2:] == (2e-16, 20.0)


def test_largest_of_many_gamma_draws():
    rng = np.random.default_rng(1)
    shapes, counts = np.array([1, 5, 12]), np.array([300.0, 200, 2])
    drawn = np.max([rng.gamma(a, size=(4000, int(n))).max(axis=1) for a, n in zip(shapes, counts)], axis=0)
    made = tails.largest_gamma(shapes, counts, 1 - rng.random(4000))
    assert np.quantile(made, [0.1, 0.5, 0.9]) == pytest.approx(np.quantile(drawn, [0.1, 0.5, 0.9]), rel=0.03)
    # a few observations far out decide the largest, however many lie near
    assert np.median(tails.largest_gamma(np.array([5, 60]), np.array([1e7, 1500.0]), 1 - rng.random(500))) > 80


def test_threshold_zero_does_not_depend_on_other_rows(seqs):
    removed = lambda *rows: {(r.idx, r.rep) for r in dd.distance_dedup(seqs(*rows), 0).collect()}
    assert removed("ACGT", "acgt", "aaaa") == {(2, 1)}
    assert removed("ACGT", "acgt", "ccnn") == {(2, 1)}
    assert removed("acgt", "ac-t", "acnt", "acrt", "tttt", "acgt") == {(3, 1), (4, 1), (6, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_threshold_zero_equals_sequential_with_codes(seqs, seed):
    rows = random_rows(60, 6, seed, letters="acgt", changes=2)
    got = {r.idx: r.rep for r in dd.distance_dedup(seqs(*rows), 0).collect()}
    dist = [[hamming(x, y, True) for y in rows] for x in rows]
    assert got == {i + 1: r + 1 for i, r in greedy(len(rows), dist, 0, {}).items()}


def test_distance_dedup_query_merges_through_codes(spark, tmp_path):
    import __spark_entry__ as entry

    # letters a to d become a c g t; j and z the codes r and n
    texts = ["abcd" * 15, "jbcd" + "abcd" * 14, "abcd" * 14 + "abcz", "dddd" * 15, "abcd" * 15]
    docs = spark.createDataFrame([(i + 1, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    from seqcohort.plans.inputs import alignment

    rows = alignment(spark, str(tmp_path)).orderBy("seq_idx").collect()
    dist = [[hamming(x.seq, y.seq, True) for y in rows] for x in rows]
    want = {rows[i].seq_idx: rows[r].seq_idx for i, r in greedy(len(rows), dist, 0, {}).items()}
    got = {r.idx: r.rep for r in entry.queries()["distance_dedup"](spark, str(tmp_path)).collect()}
    assert got == want and set(want) == {200001, 300001, 500001}


def test_dedup_to_max_query_reaches_common_samples(spark, tmp_path):
    import __spark_entry__ as entry

    docs = [(1, "abcd" * 15 * 30, "en", "s"), (2, "abcd" * 15 * 20, "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.sample_id, r.idx, r.rep) for r in entry.queries()["dedup_to_max"](spark, str(tmp_path)).collect()}
    assert got == {("d1", 100001 + i, 100001) for i in range(1, 30)}


def test_unequal_lengths_are_an_error(seqs):
    with pytest.raises(Exception, match="differ in length"):
        pr.near_pairs(seqs("acg", "acgta"), 5).collect()


def test_saturated_pairs_are_reported(seqs, spark):
    df = dd.exact_dedup(seqs("acgt", "tgca", "acga"))
    row = fo.pairwise_diversity(df, jukes_cantor=True).first()
    assert (row.n_pairs, row.n_saturated) == (1, 2) or row.n_pairs + row.n_saturated == 3


def test_many_copies_stay_on_one_line(spark):
    dups = spark.createDataFrame([("s", "a", f"d{i}") for i in range(1500)] + [("s", "a", "a")], "sample_id string, kept string, dup string")
    line = tb.duplicate_lines(dups).collect()
    assert len(line) == 1 and len(line[0].removed.split(",")) == 1500


def test_nexus_comments_and_declared_sizes(spark, tmp_path):
    text = "#NEXUS\n[ a comment\n over lines ]\nbegin data;\ndimensions ntax=2 nchar=8;\nmatrix\n[ comment line]\na acgt [4]\nb tt-t\na ccgg\nb cc?g\n;\nend;\n"
    (tmp_path / "x.nex").write_text(text)
    assert {(r.seq_name, r.seq) for r in al.read_nexus(spark, str(tmp_path / "x.nex")).collect()} == {("a", "acgtccgg"), ("b", "tt-tcc?g")}
    (tmp_path / "y.nex").write_text(text.replace("ntax=2", "ntax=3"))
    with pytest.raises(Exception, match="declares 3 sequences"):
        al.read_nexus(spark, str(tmp_path / "y.nex")).collect()
    (tmp_path / "z.nex").write_text(text.replace("ccgg", "cc9g"))
    with pytest.raises(Exception, match="characters"):
        al.read_nexus(spark, str(tmp_path / "z.nex")).collect()


def test_phylip_with_wrapped_records_is_rejected(spark, tmp_path):
    (tmp_path / "x.phy").write_text("2 8\na acgt\nacgt\nb tttt\ntttt\n")
    with pytest.raises(Exception, match="declares"):
        al.read_phylip(spark, str(tmp_path / "x.phy")).collect()


def test_model_fits_say_whether_they_converged(spark):
    rng = np.random.default_rng(4)
    rows = [("e", f"p{i % 12}", float(x), float(z), int(x + rng.normal() > 0)) for i, (x, z) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "estimator string, ptid string, x double, z double, g int")
    assert {r.converged for r in ev.logistic_coefficients(df, "g", ["x"]).collect()} == {True}
    assert {r.converged for r in ev.logistic_coefficients(df, "g", ["x"], rounds=1).collect()} == {False}
    small = ev.logistic_coefficients(df, "g", ["x"], row_block=10, fold_block=3).collect()
    whole = {r.ptid: r.beta for r in ev.logistic_coefficients(df, "g", ["x"]).collect()}
    assert all(r.beta == pytest.approx(whole[r.ptid], rel=1e-9) for r in small)
    assert {r.converged for r in ev.lasso_coefficients(ev.fold_statistics(df, "g", ["x", "z"]), (0, 1)).collect()} == {True}


def test_running_totals_cut_large_keys_only(spark, monkeypatch):
    """Ranges of every key grew with the whole table, so that many small keys cost a square."""
    rows = spark.createDataFrame([(k, v, 1) for k in range(20) for v in range(6)] + [(None, 1, 1)], "k bigint, v bigint, w bigint")
    want = {(k, v, 1, v + 1, v) for k in range(20) for v in range(6)}
    with monkeypatch.context() as m:
        m.setattr(F, "percentile_approx", lambda *a: (_ for _ in ()).throw(AssertionError("small keys were cut")))
        assert {tuple(r) for r in rk.running_totals(rows, ["k"], "v", ["w"], 10).collect()} == want
    more = rows.unionByName(spark.range(50).select(F.lit(99).cast("bigint").alias("k"), F.col("id").alias("v"), F.lit(1).cast("bigint").alias("w")))
    got = {tuple(r) for r in rk.running_totals(more, ["k"], "v", ["w"], 10).collect()}
    assert got == want | {(99, v, 1, v + 1, v) for v in range(50)}


def test_site_counts_without_a_row_per_site(spark, monkeypatch):
    rows = [("a", "x", s) for s in ("acgt", "ac-t", "", "é€\U0001d11ea", None, "ACGTACGT")] + [(None, "y", "gg"), ("b", None, "t")]
    df = spark.createDataFrame(rows, "k string, j string, seq string")
    want = {}
    for k, j, s in rows:
        for i, c in enumerate([""] if s == "" else s or ""):
            want[k, j, i + 1, c] = want.get((k, j, i + 1, c), 0) + 1
    monkeypatch.setattr(st, "site_rows", None)
    for held in (1, 7, 1 << 22):
        monkeypatch.setattr(st, "COUNT_CHARS", held)
        assert {tuple(r)[:4]: r.n for r in st.base_counts(df, ["k", "j"]).collect()} == want


def test_hypermutation_marks_equal_the_patterns():
    import re

    assert not hasattr(fo, "_with_contexts")  # which held arrays of sites
    rng = random.Random(5)
    for _ in range(300):
        seq = "".join(rng.choice("aaggccttnr-?") for _ in range(20))
        ref = "".join(rng.choice("gga") for _ in range(rng.choice([12, 20, 26])))
        mut, ctl = (re.sub(f".(?={p})", "*", seq) for p in ("-*[ag]-*[agt]", "-*(?:[ct]-*[acgt]|[ag]-*c)"))
        want = "".join(
            " " if r != "g" or "*" not in (m, c) else ("m" if m == "*" else "c").upper() if b == "a" else ("m" if m == "*" else "c")
            for b, m, c, r in zip(seq, mut, ctl, ref.ljust(20))
        )
        got = fo.site_marks(seq, 20, np.array([[c == "g" for c in ref[:20].ljust(20)]]))
        assert got.tobytes().decode() == want


def test_files_are_written_by_tasks_and_read_once(spark, tmp_path, monkeypatch):
    rows = [(f"s{i}", b, j, f"r{j} acgt"[: 7 if b == 1 else None] if b else "#NEXUS\nmatrix") for i in range(9) for b in range(3) for j in range(3 if b else 1)]
    rows += [(f"s{i}", 3, 0, ";\nend;") for i in range(9)] + [(None, 0, 0, "matrix"), (None, 1, 0, "[two"), (None, 1, 1, "lines] x ac-t"), (None, 2, 0, ";")]
    df = spark.createDataFrame(rows, "sample_id string, b int, i int, value string").repartition(5)
    al.write_files(df, f"file://{tmp_path}/some", "sample_id", ["b", "i"])
    files = {p.name: p.read_text() for p in (tmp_path / "some").glob("*/*")}
    assert set(files) == {*(f"sample_id=s{i}.txt" for i in range(9)), "sample_id=__HIVE_DEFAULT_PARTITION__.txt"}
    assert files["sample_id=s4.txt"] == "#NEXUS\nmatrix\n" + "".join(f"r{j} acgt"[:7] + "\n" for j in range(3)) + "".join(f"r{j} acgt\n" for j in range(3)) + ";\nend;\n"
    got = {(r.sample_id, r.seq_name, r.seq) for r in al.read_nexus(spark, f"{tmp_path}/some/*", r"sample_id=([^/]+)\.txt$").collect()}
    assert got == {*((f"s{i}", f"r{j}", "acgtacgt") for i in range(9) for j in range(3)), ("__HIVE_DEFAULT_PARTITION__", "x", "ac-t")}
    opened, records = [], al.read_records
    monkeypatch.setattr(al, "read_records", lambda *a, **kw: opened.append(records(*a, **kw)) or opened[-1])
    al._numbered(spark, f"{tmp_path}/some/*")
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("file_block_start") for df in opened] == [0]
