"""Duplicate removal and clustering of the sequences of a sample."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcohort.functions import alphabet as ab
from seqcohort.operators import mismatch as mm
from seqcohort.operators import pairs as pr
from seqcohort.operators import sites as st
from seqcohort.session import checksum, release, settle, spread

KEYS = ("sample_id",)
# Distinct sequences, and characters of them, of a sample that is reduced where it is gathered.
BLOCK_ROWS = 4096
BLOCK_CHARS = 1 << 23


def exact_dedup(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "seq_name",
                idx: str = "seq_idx", seq: str = "seq") -> DataFrame:
    """First of each group of identical sequences with its copy number ``mult``. One
    aggregate with map-side combine; copies never meet in one task."""
    return df.groupBy(*keys, seq).agg(
        F.min_by(name, idx).alias(name), F.min(idx).alias(idx), F.count(F.lit(1)).alias("mult")
    ).select(*keys, idx, name, seq, "mult")


def duplicate_map(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "seq_name",
                  idx: str = "seq_idx", seq: str = "seq") -> DataFrame:
    """Long map kept -> duplicate, the kept sequence itself included. The kept name is
    joined back on a digest of the sequence."""
    digest = F.sha2(seq, 256).alias("_h")
    kept = df.groupBy(*keys, digest).agg(F.min_by(name, idx).alias("kept"))
    return (
        df.select(*keys, digest, F.col(name).alias("dup")).join(kept, [*keys, "_h"]).select(*keys, "kept", "dup")
    )


def duplicate_summary(unique: DataFrame, keys: Sequence[str] = KEYS, mult: str = "mult") -> DataFrame:
    """How many unique sequences have each copy number, and what that removes."""
    return unique.groupBy(*keys, F.col(mult).alias("copies")).agg(
        F.count(F.lit(1)).alias("n_unique"), F.sum(F.col(mult) - 1).alias("n_removed")
    )


def with_copy_number(unique: DataFrame, name: str = "seq_name", mult: str = "mult") -> DataFrame:
    """Names with the copy number as suffix, for files that carry it there."""
    return unique.withColumn(name, F.concat_ws("_", name, mult))


def _both_ways(edges: DataFrame, keys: Sequence[str], *cols: str) -> DataFrame:
    return edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("x"), *cols).unionByName(
        edges.select(*keys, F.col("b").alias("u"), F.col("a").alias("x"), *cols)
    )


def greedy_absorb(edges: DataFrame, keys: Sequence[str] = KEYS, removed: DataFrame | None = None) -> DataFrame:
    """Result of absorbing neighbours in input order, as (keys, idx, rep) of what is
    removed; ``edges`` hold pairs within the threshold, ``removed`` earlier removals.

    In input order a sequence stays when it has no earlier neighbour left, none already
    removed, and no neighbour that an earlier keeper absorbs. The first two conditions are
    local; the third is settled in rounds, each letting every candidate that is the first
    among the candidates around each of its neighbours become a keeper. The number of
    rounds follows the longest chain of such conflicts, not the number of sequences.
    """
    keys = list(keys)
    nb = settle(_both_ways(edges, keys))
    if removed is None:
        removed = nb.sparkSession.createDataFrame([], nb.select(*keys, F.col("u").alias("idx"), F.col("u").alias("rep")).schema)
    old = removed.select(*keys, F.col("idx").alias("x"), F.col("rep").alias("_old"))
    live = (
        nb.join(old.select(*keys, F.col("x").alias("u")), [*keys, "u"], "left_anti")
        .join(old.select(*keys, "x", F.lit(True).alias("_gone")), [*keys, "x"], "left")
    )
    candidates = settle(
        live.groupBy(*keys, "u")
        .agg(F.min(F.when(F.col("_gone").isNull(), F.col("x"))).alias("first"), F.max("_gone").alias("_gone"))
        .filter(F.col("_gone").isNull() & (F.col("first") > F.col("u")))
        .select(*keys, "u")
    )
    keepers = None
    while not candidates.isEmpty():
        around = nb.join(candidates, [*keys, "u"])
        first = around.groupBy(*keys, "x").agg(F.min("u").alias("first"))
        won = settle(
            around.join(first, [*keys, "x"])
            .groupBy(*keys, "u").agg(F.bool_and(F.col("first") == F.col("u")).alias("won"))
            .filter("won").select(*keys, "u")
        )
        keepers = won if keepers is None else settle(keepers.unionByName(won))
        touched = nb.join(won, [*keys, "u"]).select(*keys, "x").distinct()
        beaten = nb.join(touched, [*keys, "x"]).select(*keys, "u").distinct()
        candidates = settle(
            candidates.join(won, [*keys, "u"], "left_anti").join(beaten, [*keys, "u"], "left_anti")
        )
    if keepers is None:
        absorbed = removed.select(*keys, "idx", "rep").limit(0)
    else:
        absorbed = settle(
            nb.join(keepers, [*keys, "u"]).select(*keys, F.col("x").alias("idx"), F.col("u").alias("rep"))
        )
    # late joiners point to their first neighbour that was already out, and follow it
    stays = (keepers if keepers is not None else candidates).select(*keys, "u")
    late = (
        nb.select(*keys, "u").distinct()
        .join(stays, [*keys, "u"], "left_anti")
        .join(absorbed.select(*keys, F.col("idx").alias("u")), [*keys, "u"], "left_anti")
        .join(old.select(*keys, F.col("x").alias("u")), [*keys, "u"], "left_anti")
    )
    out = (
        nb.join(late, [*keys, "u"])
        .join(absorbed.select(*keys, F.col("idx").alias("x"), F.col("rep").alias("_abs")), [*keys, "x"], "left")
        .join(old, [*keys, "x"], "left")
        .join(late.select(*keys, F.col("u").alias("x"), F.lit(True).alias("_late")), [*keys, "x"], "left")
    )
    was_out = (
        F.col("_old").isNotNull()
        | (F.col("_abs") < F.col("u"))
        | (F.col("_late") & (F.col("x") < F.col("u")))
    )
    pointed = settle(
        out.filter(was_out)
        .groupBy(*keys, "u")
        .agg(F.min_by(F.struct(F.coalesce("_old", "_abs").alias("rep"), "x"), "x").alias("p"))
        .select(*keys, F.col("u").alias("idx"), F.col("p.rep").alias("rep"), F.col("p.x").alias("via"))
    )
    while not pointed.filter("rep IS NULL").isEmpty():
        up = pointed.select(*keys, F.col("idx").alias("via"), F.col("rep").alias("_r"), F.col("via").alias("_v"))
        pointed = settle(
            pointed.join(up, [*keys, "via"], "left").select(
                *keys, "idx", F.coalesce("rep", "_r").alias("rep"),
                F.coalesce("_v", "via").alias("via"),
            )
        )
    return absorbed.unionByName(pointed.select(*keys, "idx", "rep"))


def distance_dedup(df: DataFrame, threshold: int = 0, keys: Sequence[str] = KEYS, idx: str = "seq_idx",
                   seq: str = "seq", include_gaps: bool = True) -> DataFrame:
    """Removed sequences with their representative: (keys, idx, rep).

    Sequences that read the same (upper and lower case, ``?`` and ``-``) always go to the
    first of them, so the distance work runs on distinct ones only and the others are mapped
    through afterwards. At threshold 0 with gaps counted, two distinct sequences can only be
    equal through an ambiguity code. Pairs come from the index of ``mismatch``, so small
    thresholds compare few of them; what is decided for a sequence never depends on unrelated rows.
    """
    keys = list(keys)
    df = df.withColumn(seq, F.translate(F.lower(seq), "?", "-"))
    unique = settle(df.groupBy(*keys, seq).agg(F.min(idx).alias(idx)))
    edges = mm.near_pairs(unique, threshold, keys, idx, seq, include_gaps, distinct=True)
    removed = settle(greedy_absorb(edges, keys))
    copies = _copies(df, keys, idx, seq)
    through = copies.join(
        removed.select(*keys, F.col("idx").alias("rep"), F.col("rep").alias("_r")), [*keys, "rep"], "left"
    ).select(*keys, "idx", F.coalesce("_r", "rep").alias("rep"))
    return removed.unionByName(through)


def _copies(df: DataFrame, keys: Sequence[str], idx: str, seq: str) -> DataFrame:
    digest = F.unhex(F.sha2(seq, 256)).alias("_h")
    first = df.groupBy(*keys, digest).agg(F.min(idx).alias("rep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return (
        df.select(*keys, digest, F.col(idx).alias("idx")).join(first, [*keys, "_h"])
        .filter(F.col("idx") != F.col("rep")).select(*keys, "idx", "rep")
    )


def reduced_block(seqs: Sequence[str], n_max: int, include_gaps: bool) -> np.ndarray:
    """``dedup_to_max`` of the distinct sequences of a sample that fits one block, in input order:
    the place of each one's representative, -1 for those that stay."""
    if len({len(s) for s in seqs}) > 1:
        raise ValueError("sequences of one group differ in length")
    code = np.zeros(256, np.uint8)
    for c, mask in ab.MASK.items():
        code[ord(c)] = mask
    n = len(seqs)
    if n < 2:
        return np.full(n, -1)
    text = np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8).reshape(n, -1)
    block = pr.Block(code[text], np.arange(n), np.ones(n))
    differ, _, indel = pr.compare(block, block, include_gaps, False)
    far = differ if indel is None else np.add(differ, indel, out=differ)
    np.fill_diagonal(far, np.iinfo(far.dtype).max)
    nearest = far.min(axis=1, initial=np.iinfo(far.dtype).max)
    rep, threshold = np.full(n, -1), 0
    while True:
        step, near = rep.copy(), far <= threshold
        for i in np.flatnonzero((rep < 0) & (nearest <= threshold)):
            if step[i] >= 0:
                continue
            around = np.flatnonzero(near[i])
            out = around[step[around] >= 0]
            if len(out):
                step[i] = step[out[0]]
            else:
                step[around] = i
        left = step < 0
        if not left.any():
            return rep
        rep = step
        waiting = nearest[left].min()
        if left.sum() <= n_max or waiting == np.iinfo(far.dtype).max:
            return rep
        threshold = max(threshold + 1, waiting)


def dedup_to_max(df: DataFrame, n_max: int, keys: Sequence[str] = KEYS, idx: str = "seq_idx",
                 seq: str = "seq", include_gaps: bool = True) -> DataFrame:
    """Raise the threshold from 0, sample by sample, until at most ``n_max`` sequences
    remain; removals accumulate, and a step that would leave nothing is taken back.

    Sequences that read the same go to the first of them at threshold 0, so that distances
    are only taken between distinct ones. Samples whose distinct sequences fit one block are
    done where they are gathered, larger ones together in rounds, with equal results.
    """
    if n_max < 2:
        raise ValueError("n_max must exceed 1")
    keys = list(keys)
    df = df.withColumn(seq, F.translate(F.lower(seq), "?", "-"))
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = settle(total.filter(F.col("_n") > n_max).select(*keys))
    rows = df.join(large, keys, "left_semi")
    copies = settle(_copies(rows, keys, idx, seq))
    unique = settle(rows.groupBy(*keys, seq).agg(F.min(idx).cast("bigint").alias(idx)))
    fits = (F.count(F.lit(1)) <= BLOCK_ROWS) & (F.sum(F.length(seq).cast("bigint")) <= BLOCK_CHARS)
    sized = unique.join(unique.groupBy(*keys).agg(F.coalesce(fits, F.lit(False)).alias("_fits")), keys)
    kinds = ", ".join(f"`{k}` {unique.schema[k].dataType.simpleString()}" for k in keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([idx, seq])
        ids = frame[idx].to_numpy(np.int64)
        rep = reduced_block(frame[seq].tolist(), n_max, include_gaps)
        gone = rep >= 0
        out = frame[keys][gone].copy()
        out["idx"], out["rep"] = ids[gone], ids[rep[gone]]
        return out

    small = spread(sized.filter("_fits").select(*keys, idx, seq), *keys).groupBy(*keys).applyInPandas(run, f"{kinds}, idx bigint, rep bigint")
    finished = settle(small)
    wide = settle(sized.filter("NOT _fits").select(*keys, idx, seq))
    if not wide.isEmpty():
        finished = settle(finished.unionByName(_reduced_in_rounds(wide, n_max, keys, idx, seq, include_gaps)))
    through = copies.join(
        finished.select(*keys, F.col("idx").alias("rep"), F.col("rep").alias("_r")), [*keys, "rep"], "left"
    ).select(*keys, "idx", F.coalesce("_r", "rep").alias("rep"))
    return finished.unionByName(through)


def _reduced_in_rounds(unique: DataFrame, n_max: int, keys: list[str], idx: str, seq: str, include_gaps: bool) -> DataFrame:
    """``dedup_to_max`` of distinct sequences, all samples at one threshold after the other.
    Thresholds at which no remaining sequence has another one are skipped."""
    # from here on only distinct sequences count: the copies are gone at threshold 0
    active = settle(unique.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    removed = settle(unique.select(*keys, F.col(idx).alias("idx"), F.col(idx).alias("rep")).limit(0))
    finished = removed
    nearest = None
    threshold = 0
    while not active.isEmpty():
        rows = unique.join(active.select(*keys), keys, "left_semi")
        focus = F.col(seq).rlike("[^acgt-]") if threshold == 0 and include_gaps else None
        edges = pr.near_pairs(rows, threshold, keys, idx, seq, include_gaps, focus=focus)
        step = settle(removed.unionByName(greedy_absorb(edges, keys, removed)))
        left = step.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gone"))
        state = settle(
            active.join(left, keys, "left")
            .select(*keys, "_n", (F.col("_n") - F.coalesce("_gone", F.lit(0))).alias("_left"))
        )
        emptied = state.filter("_left = 0").select(*keys)
        reached = state.filter((F.col("_left") > 0) & (F.col("_left") <= n_max)).select(*keys)
        ended = settle(
            finished.unionByName(removed.join(emptied, keys, "left_semi"))
            .unionByName(step.join(reached, keys, "left_semi"))
        )
        open_keys = settle(state.filter(F.col("_left") > n_max).select(*keys, "_n"))
        kept = settle(step.join(open_keys.select(*keys), keys, "left_semi"))
        release(active, state, step, removed, *([finished] if finished is not removed else []))
        active, removed, finished = open_keys, kept, ended
        if nearest is None:
            nearest = settle(pr.nearest_pairs(unique, keys, idx, seq, include_gaps))
        waiting = (
            nearest.join(active.select(*keys), keys, "left_semi")
            .join(removed.select(*keys, "idx"), [*keys, "idx"], "left_anti")
            .agg(F.min(F.greatest(F.col("hd"), F.lit(threshold + 1))).alias("k")).first()["k"]
        )
        if waiting is None:
            finished = settle(finished.unionByName(removed))
            break
        threshold = waiting
    return finished


def connected_components(vertices: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, idx, component) with the smallest member as component.

    Alternating star contraction: every round hangs the neighbours of a vertex on the
    smallest of them, which halves path lengths, with aggregates and joins only.
    """
    keys = list(keys)
    links = settle(edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("x")).distinct())
    seen = checksum(links)
    while True:
        both = _both_ways(links.select(*keys, F.col("u").alias("a"), F.col("x").alias("b")), keys)
        low = both.groupBy(*keys, "u").agg(F.least(F.min("x"), F.col("u")).alias("m"))
        large = both.join(low, [*keys, "u"]).filter("x > u").select(*keys, F.col("m").alias("u"), "x").distinct()
        down = settle(large.filter("u <> x").select(*keys, F.least("u", "x").alias("u"), F.greatest("u", "x").alias("x")).distinct())
        low2 = down.groupBy(*keys, "x").agg(F.min("u").alias("m"))
        small = (
            down.join(low2, [*keys, "x"])
            .select(*keys, F.col("m").alias("u"), F.explode(F.array("u", "x")).alias("x"))
            .filter("u <> x").distinct()
        )
        fresh = settle(small)
        release(links, down)
        links, before = fresh, seen
        seen = checksum(links)
        if seen == before:
            break
    label = links.groupBy(*keys, "x").agg(F.min("u").alias("component"))
    return vertices.select(*keys, "idx").join(
        label.withColumnRenamed("x", "idx"), [*keys, "idx"], "left"
    ).select(*keys, "idx", F.coalesce("component", "idx").alias("component"))


def cluster_by_distance(df: DataFrame, cut: int, keys: Sequence[str] = KEYS, idx: str = "seq_idx",
                        seq: str = "seq", force_one: bool = False) -> DataFrame:
    """Single-linkage clusters at a cut height, numbered from 1 in order of their first
    member. Distances use the informative sites; a sample without one is one cluster."""
    keys = list(keys)
    everyone = df.select(*keys, F.col(idx).alias("idx"))
    if force_one:
        return everyone.withColumn("cluster", F.lit(1).cast("bigint"))
    informative = settle(st.informative_subalignment(df.select(*keys, idx, F.lit("").alias("seq_name"), seq), keys, "seq_name", seq))
    unique = informative.groupBy(*keys, seq).agg(F.min(idx).alias(idx))
    links = settle(pr.near_links(unique, cut, keys, idx, seq))
    component = connected_components(unique.select(*keys, F.col(idx).alias("idx")), links, keys)
    # number the components of a sample: their count is small beside the sequences
    heads = component.filter("idx = component").select(*keys, "component")
    from seqcohort.operators.ranks import running_totals

    numbered = running_totals(heads.withColumn("_one", F.lit(1).cast("bigint")), keys, "component", ["_one"])
    rep = informative.select(*keys, F.col(idx).alias("idx"), F.sha2(seq, 256).alias("_h"))
    first = rep.groupBy(*keys, "_h").agg(F.min("idx").alias("_rep"))
    labelled = (
        rep.join(first, [*keys, "_h"])
        .join(component.withColumnRenamed("idx", "_rep"), [*keys, "_rep"])
        .join(numbered.select(*keys, "component", F.col("_one_through").alias("cluster")), [*keys, "component"])
        .select(*keys, "idx", "cluster")
    )
    return everyone.join(labelled, [*keys, "idx"], "left").select(
        *keys, "idx", F.coalesce("cluster", F.lit(1)).cast("bigint").alias("cluster")
    )


def cluster_consensus(df: DataFrame, clusters: DataFrame, keys: Sequence[str] = KEYS, idx: str = "seq_idx",
                      seq: str = "seq") -> DataFrame:
    """Consensus per cluster, and one per sample as ``cluster = 0``."""
    keys = list(keys)
    joined = df.select(*keys, idx, seq).join(clusters.withColumnRenamed("idx", idx), [*keys, idx])
    each = st.majority_consensus(joined, [*keys, "cluster"], seq)
    whole = st.majority_consensus(df, keys, seq).withColumn("cluster", F.lit("0").cast(clusters.schema["cluster"].dataType))
    return each.unionByName(whole)


def span_filter(vectors: DataFrame, vec: str = "embedding", share: float = 0.01) -> DataFrame:
    """Span of each feature dimension and whether it exceeds the smallest span by more
    than ``share`` of the range of spans. Dimensions are few; rows are combined map-side."""
    spans = (
        vectors.select(F.posexplode(vec).alias("dim", "v"))
        .groupBy("dim").agg((F.max("v") - F.min("v")).cast("double").alias("span"))
    )
    ends = spans.agg(F.min("span").alias("_lo"), F.max("span").alias("_hi"))
    return spans.join(F.broadcast(ends)).select(
        "dim", "span", (F.col("span") > F.col("_lo") + share * (F.col("_hi") - F.col("_lo"))).alias("kept")
    )


def keep_dimensions(vectors: DataFrame, spans: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vectors without the dimensions ``span_filter`` leaves out; the list of kept ones is
    one row as wide as a vector."""
    kept = spans.filter("kept").agg(F.array_sort(F.collect_list("dim")).alias("_dims"))
    return vectors.join(F.broadcast(kept)).withColumn(
        vec, F.transform("_dims", lambda i: F.get(F.col(vec), i).cast("double"))
    ).drop("_dims")
