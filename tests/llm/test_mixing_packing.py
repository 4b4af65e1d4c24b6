import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcohort.llm import mixing, packing
from tests.llm import cases


def by_row(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("share, repeats", [(0.9, 2.0), (0.5, 1.2), (1.0, 50.0)])
def test_mixture_meets_target_and_budget(spark, share, repeats):
    rows = [(i, None, s, 1 + i % 50) for i in range(3000) for s in [("a", "a", "a", "a", "a", "b", "b", "c")[i % 8]]]
    df = spark.createDataFrame(rows, "id long, mark long, source string, n_tokens long")
    total = sum(r[3] for r in rows)
    own = collections.Counter()
    for _, _, s, n in rows:
        own[s] += n
    out = mixing.mix(df, entropy_share=share, max_repeats=repeats, block_tokens=500).collect()
    weight = {r.source: r.weight for r in out}
    entropy = -sum(w * np.log(w) for w in weight.values())
    assert max(weight[s] * total / own[s] for s in own) <= repeats + 1e-3
    assert entropy <= share * np.log(3) + 1e-3 or share < 0.8  # natural shares are flatter than 0.5
    got = collections.Counter()
    for r in out:
        got[r.source] += r.n_tokens
    for s in own:
        quota = weight[s] * total
        assert quota - 500 - 50 <= got[s] <= quota + 1e-6
        times = collections.Counter(r.id for r in out if r.source == s)
        assert max(times.values()) <= np.ceil(quota / own[s])
        if quota >= own[s]:
            assert len(times) == sum(r[2] == s for r in rows)  # whole passes leave nothing out
    # a prefix of the mixture is close to the weights
    ahead = [r for r in out if r.progress < 0.5]
    for s in own:
        assert abs(sum(r.n_tokens for r in ahead if r.source == s) / sum(r.n_tokens for r in ahead) - weight[s]) < 0.05


def test_mixture_cases(spark):
    docs = cases.documents(spark)
    rows = mixing.token_rows(docs)
    assert by_row(rows.select("id", "n_tokens").collect()) == by_row((r.doc_id, len((r.text or "").split(None)) if "\x85" not in (r.text or "") and "\xa0" not in (r.text or "") else 2) for r in docs.collect())
    out = mixing.mix(rows)
    assert {r.source for r in out.select("source").distinct().collect()} == {"s0", "s1", "(none)"}
    assert mixing.mix(mixing.token_rows(cases.empty(spark))).count() == 0
    silent = mixing.token_rows(docs.withColumn("text", F.lit(" ")))
    assert mixing.mix(silent).count() == docs.count()  # nothing to weigh: one pass


def test_rows_of_one_id_spread_over_blocks(spark):
    """Rows without an id, rows of one id and equal rows fill blocks like other rows."""
    rows = [(None, 7, "a", 1 + i % 3) for i in range(3000)] + [(5, None, "b", 2)] * 9000 + [(i, i, "c", 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, mark long, source string, n_tokens long")
    assert by_row(mixing.numbered_copies(df).drop("copy").select("id", "mark", "source", "n_tokens").collect()) == by_row(rows)
    assert mixing.numbered_copies(df).distinct().count() == len(rows)
    out = mixing.mix(df, max_repeats=50.0, block_tokens=300).filter("pass = 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("n"))
    for source, own in (("a", 6000), ("b", 18000), ("c", 6000)):
        held = [r.n for r in out.filter(F.col("source") == source).collect()]
        assert len(held) > own / 500 and max(held) < 600


def brute_pack(sizes, source, cluster, capacity, per_source):
    bins = []
    placed = []
    for size, s, c in zip(sizes, source, cluster):
        fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and b["s"][s] < per_source and (c < 0 or c not in b["c"])]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"left": capacity, "s": collections.Counter(), "c": set()})
        placed.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= size
        bins[i]["s"][s] += 1
        bins[i]["c"].add(c)
    return placed


@pytest.mark.parametrize("per_source", [1, 3])
def test_best_fit_equals_brute_force(per_source):
    rng = np.random.default_rng(8)
    sizes = np.sort(rng.integers(1, 101, 600))[::-1]
    source, cluster = rng.integers(0, 5, 600), np.where(rng.random(600) < 0.4, rng.integers(0, 6, 600), -1)
    bins, offsets = packing.pack_items(sizes, source, cluster, 100, per_source)
    assert list(zip(bins.tolist(), offsets.tolist())) == brute_pack(sizes.tolist(), source.tolist(), cluster.tolist(), 100, per_source)


def check_packing(out, items, capacity, per_source):
    held = collections.defaultdict(list)
    whole = collections.Counter()
    for r in out:
        held[r.bin].append((r.offset, r.length, r.id, r.copy, r.piece))
        whole[(r.id, r.copy)] += r.length
    for pieces in held.values():
        at = 0
        for offset, length, *_ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return held, whole


def test_packing_cases(spark):
    docs = cases.documents(spark)
    items = docs.select(F.col("doc_id").alias("id"), "source", F.xxhash64("text").alias("cluster"), mixing.count_tokens("text").alias("n_tokens"))
    out = packing.pack(items, capacity=64, per_source=4, shard_items=50).collect()
    held, whole = check_packing(out, items, 64, 4)
    assert sum(whole.values()) == sum(r.n_tokens + 1 for r in items.collect())
    text = {(r.id): r.cluster for r in items.collect() if r.id is not None}
    for pieces in held.values():
        known = [text[p[2]] for p in pieces if p[2] is not None]
        assert len(known) == len(set(known))
    assert packing.pack(items.limit(0)).count() == 0


def test_copies_of_one_row_are_numbered_and_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    rows = [(1, "s", 5, 3)] * 40 + [(None, None, None, None)] * 9
    df = spark.createDataFrame(rows, "id long, source string, cluster long, n_tokens long")
    out = packing.pack(df, capacity=16, shard_items=10).collect()
    assert sorted(r.copy for r in out if r.id == 1) == list(range(40))
    assert len({r.bin for r in out if r.id == 1}) == 40
    assert sorted(r.copy for r in out if r.id is None) == list(range(9)) and {r.length for r in out if r.id is None} == {1}
    assert len({r.bin >> 32 for r in out}) > 2
