"""Alignment-column profiles.

Characters are counted per site inside the tasks that read the sequences, a few million at a
time; ``groupBy(sample, pos, base)`` adds these counts up, so what is shuffled is at most
samples x sites x alphabet rows however many sequences one sample has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from seqcohort.functions import alphabet as ab
from seqcohort.session import settle

KEYS = ("sample_id",)
BLANK = " "
# Characters that a task counts at once.
COUNT_CHARS = 1 << 22


def site_rows(df: DataFrame, *extra: str | Column, keys: Sequence[str] = KEYS, seq: str | Column = "seq") -> DataFrame:
    """One row per sequence and site: keys, ``pos`` (from 1), ``base``."""
    source = F.col(seq) if isinstance(seq, str) else seq
    return df.select(*keys, *extra, F.posexplode(ab.chars(source)).alias("_p", "base")).select(
        *keys, *[e if isinstance(e, str) else e for e in extra], (F.col("_p") + 1).alias("pos"), "base"
    )


def blank_flanks(seq: Column) -> Column:
    """Leading and trailing gaps become blanks: they are missing data, not deletions."""
    bare = F.ltrim(seq, F.lit("-"))
    lead = F.length(seq) - F.length(bare)
    core = F.rtrim(bare, F.lit("-"))
    return F.rpad(F.concat(F.repeat(F.lit(BLANK), lead), core), F.length(seq), F.lit(BLANK))


def _numbered_groups(columns: Sequence[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's group, and one row of every group; nulls are a value."""
    group, first = np.zeros(n, np.int64), np.zeros(min(n, 1), np.int64)
    for column in columns:
        coded = column.dictionary_encode(null_encoding="encode")
        code = group * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return group, first


def _count_sites(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Keys, ``pos``, ``base``, ``n`` of rows of keys and a sequence, the last column."""
    *columns, seq = rows.columns
    group, first = _numbered_groups(columns, rows.num_rows)
    texts = seq.to_pylist()
    lengths = pc.utf8_length(seq).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if int(chars.max(initial=0)) < 1 << 16:
        letters = np.flatnonzero(np.bincount(chars))
        place = np.zeros(1 << 16, np.int64)
        place[letters] = np.arange(len(letters))
        code = place[chars]
    else:
        letters, code = np.unique(chars, return_inverse=True)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        site = (group[:, None] * width + np.arange(width)).ravel()
    else:
        site = np.repeat(group * width - np.cumsum(lengths) + lengths, lengths) + np.arange(len(chars))
    code += site * len(letters)
    if len(first) * width * len(letters) <= 4 * len(code):
        n = np.bincount(code)
        value = np.flatnonzero(n)
        n = n[value]
    else:
        value, n = np.unique(code, return_counts=True)
    site, letter = np.divmod(value, max(len(letters), 1))
    group, pos = np.divmod(site, max(width, 1))
    names = pa.array([chr(c) if c else "" for c in letters], pa.string())
    return pa.RecordBatch.from_arrays(
        [*[c.take(pa.array(first[group])) for c in columns], pa.array((pos + 1).astype(np.int32)),
         names.take(pa.array(letter)), pa.array(n.astype(np.int64))],
        [*rows.schema.names[:-1], "pos", "base", "n"],
    )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + COUNT_CHARS - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            start = stop
            if size >= COUNT_CHARS or start < batch.num_rows:
                yield _count_sites(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size = [], 0
    if held:
        yield _count_sites(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def base_counts(df: DataFrame, keys: Sequence[str] = KEYS, seq: str | Column = "seq", weight: str | None = None) -> DataFrame:
    """Number (or summed ``weight``) of the rows of a group that have each character at each site."""
    if weight is not None:
        return site_rows(df, weight, keys=keys, seq=seq).groupBy(*keys, "pos", "base").agg(F.sum(weight).alias("n"))
    source = F.col(seq) if isinstance(seq, str) else seq
    # an empty sequence has one empty site, counted as the zero character
    rows = df.select(*keys, F.when(source == "", "\0").otherwise(source).alias("_seq")).filter("_seq IS NOT NULL")
    counted = StructType([StructField("pos", IntegerType()), StructField("base", StringType()), StructField("n", LongType())])
    schema = StructType(rows.schema.fields[:-1] + counted.fields)
    return rows.mapInArrow(_count_batches, schema).groupBy(*keys, "pos", "base").agg(F.sum("n").alias("n"))


def _pick_majority(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent character per site; ties go to the first in sorted order."""
    return counts.groupBy(*keys, "pos").agg(
        F.min_by("base", F.struct((-F.col("n")).alias("n"), F.col("base"))).alias("cons")
    )


def _join_sites(sites: DataFrame, keys: Sequence[str], value: str = "cons", out: str = "cons") -> DataFrame:
    """Sites of a sample back to one string; grows with alignment width only."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", value)))
    return sites.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s[value]), "").alias(out)
    )


def majority_consensus(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", weight: str | None = None) -> DataFrame:
    """Gaps vote like bases."""
    return _join_sites(_pick_majority(base_counts(df, keys, seq, weight), keys), keys)


def flank_aware_counts(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    return base_counts(df, keys, blank_flanks(F.col(seq)))


def flank_aware_sites(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Consensus per site without votes from flanking gaps and ``?``; ``-`` if none is left."""
    votes = F.when(~F.col("base").isin(BLANK, "?"), F.struct((-F.col("n")).alias("n"), F.col("base")))
    return counts.groupBy(*keys, "pos").agg(
        F.coalesce(F.min_by("base", votes), F.lit("-")).alias("cons")
    )


def flank_aware_consensus(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    return _join_sites(flank_aware_sites(flank_aware_counts(df, keys, seq), keys), keys)


def alignment_with_consensus(
    df: DataFrame, consensus: DataFrame, keys: Sequence[str] = KEYS, name: str = "seq_name",
    idx: str = "seq_idx", seq: str = "seq", label: str = "Consensus",
) -> DataFrame:
    """Members plus one consensus row per sample, at order number -1."""
    head = consensus.select(
        *keys, F.lit(-1).cast("bigint").alias(idx), F.lit(label).alias(name), F.col("cons").alias(seq)
    )
    return head.unionByName(df.select(*keys, idx, name, seq))


def site_profile(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    """Counts and 4-digit frequencies of the four bases per site, and the bases in order
    of frequency."""
    counts = base_counts(df, keys, seq).filter(F.col("base").isin(*ab.BASES))
    wide = counts.groupBy(*keys, "pos").pivot("base", list(ab.BASES)).agg(F.sum("n"))
    n = {b: F.coalesce(F.col(b), F.lit(0)).cast("bigint") for b in ab.BASES}
    total = n["a"] + n["c"] + n["g"] + n["t"]
    ranked = F.array_sort(
        F.array(*[F.struct((-n[b]).alias("k"), F.lit(b).alias("b")) for b in ab.BASES])
    )
    return wide.select(
        *keys, "pos",
        *[n[b].alias(f"n_{b}") for b in ab.BASES],
        total.alias("total"),
        *[(F.floor(n[b] / total * 10000 + 0.5) / 10000).alias(f"freq_{b}") for b in ab.BASES],
        F.array_join(F.transform(F.filter(ranked, lambda s: s["k"] < 0), lambda s: s["b"]), "").alias("top"),
    )


def variant_counts(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", counts: DataFrame | None = None) -> DataFrame:
    """Count of each non-consensus character per site (flanking gaps and ``?`` left out),
    with the flank-aware consensus beside it. ``counts``: of these sites, if already there."""
    counts = flank_aware_counts(df, keys, seq) if counts is None else counts
    per_site = counts.groupBy(*keys, "pos").agg(
        F.collect_list(F.struct("base", "n")).alias("all")
    )
    votes = F.filter("all", lambda s: ~s["base"].isin(BLANK, "?"))
    best = F.array_min(F.transform(votes, lambda s: F.struct((-s["n"]).alias("k"), s["base"].alias("base"))))
    return (
        per_site.withColumn("votes", votes)
        .withColumn("cons", F.coalesce(best["base"], F.lit("-")))
        .select(*keys, "pos", "cons", F.explode("votes").alias("v"))
        .filter(F.col("v.base") != F.col("cons"))
        .select(*keys, "pos", "cons", F.col("v.base").alias("variant"), F.col("v.n").alias("n"))
    )


def variable_sites(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    return variant_counts(df, keys, seq).groupBy(*keys, "pos").agg(F.first("cons").alias("cons"))


def informative_and_private_sites(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq",
                                  counts: DataFrame | None = None) -> DataFrame:
    """A variant seen once makes its site private, one seen again informative; a site can
    be both. The no-gap flags ignore sites with one variant where it or the consensus is a
    gap."""
    return (
        variant_counts(df, keys, seq, counts)
        .groupBy(*keys, "pos")
        .agg(
            F.max("cons").alias("cons"),
            F.count(F.lit(1)).alias("n_variants"),
            F.bool_or(F.col("n") == 1).alias("private"),
            F.bool_or(F.col("n") > 1).alias("informative"),
            F.count_if(F.col("n") == 1).alias("_np"),
            F.count_if(F.col("n") > 1).alias("_ni"),
            F.bool_or((F.col("n") == 1) & (F.col("variant") == "-")).alias("_gp"),
            F.bool_or((F.col("n") > 1) & (F.col("variant") == "-")).alias("_gi"),
        )
        .withColumn("private_gap_only", (F.col("_np") == 1) & (F.col("_gp") | (F.col("cons") == "-")))
        .withColumn("informative_gap_only", (F.col("_ni") == 1) & (F.col("_gi") | (F.col("cons") == "-")))
        .drop("_np", "_ni", "_gp", "_gi")
    )


def gap_only_site_correction(sites: DataFrame, samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Site totals per sample with and without gap-only sites."""
    totals = sites.groupBy(*keys).agg(
        F.count_if("informative").alias("informative"),
        F.count_if("private").alias("private"),
        F.count_if(F.col("informative") & ~F.col("informative_gap_only")).alias("informative_no_gap"),
        F.count_if(F.col("private") & ~F.col("private_gap_only")).alias("private_no_gap"),
    )
    cols = ("informative", "private", "informative_no_gap", "private_no_gap")
    return samples.select(*keys).distinct().join(totals, list(keys), "left").fillna(0, list(cols))


def informative_to_private_ratio(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    counts = settle(flank_aware_counts(df, keys, seq))  # sites and the list of samples come from it
    totals = gap_only_site_correction(informative_and_private_sites(df, keys, seq, counts), counts, keys)
    return totals.select(
        *keys,
        F.col("informative_no_gap").alias("inf"),
        F.col("private_no_gap").alias("priv"),
        (F.col("informative_no_gap") / F.greatest(F.col("private_no_gap"), F.lit(1))).alias("ratio"),
    )


def ambiguous_sites(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    """Sites that hold anything but a base, a gap, ``.`` or ``?``. Rows without such a
    character are dropped before the explode."""
    odd = df.filter(F.col(seq).rlike("[^acgtACGT.?-]"))
    return (
        site_rows(odd, keys=keys, seq=seq)
        .filter(~F.col("base").rlike("[acgtACGT.?-]"))
        .groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("n"))
    )


def mutation_spectrum(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    """Consensus-to-variant counts at informative sites, gaps left out; rows with a NULL
    ``pos`` are the totals per type."""
    v = variant_counts(df, keys, seq)
    informative = F.filter("vs", lambda s: s["n"] > 1)
    per_site = (
        v.groupBy(*keys, "pos", "cons").agg(F.collect_list(F.struct("variant", "n")).alias("vs"))
        .filter(F.size(informative) > 0)
        .select(*keys, "pos", "cons", F.explode("vs").alias("v"))
        .filter((F.col("cons") != "-") & (F.col("v.variant") != "-"))
        .select(*keys, "pos", F.concat_ws("-", "cons", "v.variant").alias("mutation"), F.col("v.n").alias("n"))
    )
    return per_site.unionByName(
        per_site.groupBy(*keys, "mutation").agg(F.sum("n").alias("n")).withColumn("pos", F.lit(None).cast("int"))
    )


def informative_subalignment(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "seq_name", seq: str = "seq") -> DataFrame:
    """Each sequence restricted to the informative sites of its sample; ``.`` becomes the
    consensus of its site. The sites are marked in one string per sample, built from their
    sorted positions, so the work grows with the width."""
    at = F.array_sort(F.collect_set(F.struct("pos", "cons")))
    chosen = informative_and_private_sites(df, keys, seq).filter("informative").groupBy(*keys).agg(at.alias("_at"))
    pos = F.transform("_at", lambda s: s["pos"])
    before = F.concat(F.array(F.lit(0)), F.slice(pos, F.lit(1), F.size("_at") - 1))
    # one character per site: the consensus where it is kept, else a blank
    marked = F.array_join(F.zip_with(
        before, F.col("_at"), lambda p, s: F.concat(F.repeat(F.lit(" "), s["pos"] - p - 1), s["cons"])
    ), "")
    marks = settle(chosen.select(*keys, marked.alias("_mark")))
    width = F.length(seq)
    kept = F.zip_with(
        ab.chars(F.col(seq)), ab.chars(F.rpad("_mark", width, " ")),
        lambda base, mark: F.when(mark == " ", "").when(base == ".", mark).otherwise(base),
    )
    return df.join(marks, list(keys)).withColumn(seq, F.array_join(kept, "")).drop("_mark")


def site_entropy(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    """Base-2 entropy per site without gaps; ambiguity codes count evenly for their
    component bases; NULL where only gaps stand."""
    parts = ab.ambiguity_map()
    counts = base_counts(df, keys, seq)
    spread = counts.withColumn("_parts", F.try_element_at(parts, F.lower("base")))
    weights = spread.select(
        *keys, "pos",
        *[
            F.when(F.array_contains("_parts", b), F.col("n") / F.size("_parts")).otherwise(0.0).alias(b)
            for b in ab.BASES
        ],
    )
    sums = weights.groupBy(*keys, "pos").agg(*[F.sum(b).alias(b) for b in ab.BASES])
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")

    def term(b: str) -> Column:
        p = F.col(b) / F.col("_t")
        return F.when(F.col(b) > 0, -p * F.log2(p)).otherwise(0.0)

    return (
        sums.withColumn("_t", total)
        .withColumn("entropy", F.when(F.col("_t") > 0, term("a") + term("c") + term("g") + term("t")))
        .select(*keys, "pos", "entropy")
    )


def entropy_summary(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    """Spread of site entropies; K counts all sites, also those without an entropy. The
    exact percentile holds one value per site, so it grows with alignment width only."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"))
    q = F.percentile("entropy", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = site_entropy(df, keys, seq).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("K"),
        F.min("entropy").alias("min"), q.alias("_q"), F.avg("entropy").alias("mean"),
        F.max("entropy").alias("max"), F.stddev_samp("entropy").alias("sd"),
    )
    r = lambda c: F.round(c, 4)
    return n.join(stats, list(keys)).select(
        *keys, "N", "K", r("min").alias("min"), r(F.col("_q")[0]).alias("q1"),
        r(F.col("_q")[1]).alias("median"), r("mean").alias("mean"), r(F.col("_q")[2]).alias("q3"),
        r("max").alias("max"), r("sd").alias("sd"),
    )


def gap_stats(df: DataFrame, keys: Sequence[str] = KEYS, gap: str = "gap_fraction", limit: float = 0.9) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("avg_gaps"), F.max(gap).alias("max_gaps"),
        F.min(gap).alias("min_gaps"), F.count_if(F.col(gap) < limit).alias("n_included"),
    )


def unique_rows_with_counts(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "seq_name",
                            idx: str = "seq_idx", seq: str = "seq") -> DataFrame:
    """Identical rows collapsed to ``name_count``, most frequent first."""
    return (
        df.groupBy(*keys, seq)
        .agg(F.count(F.lit(1)).alias("n"), F.min_by(name, idx).alias("_first"))
        .select(*keys, F.concat_ws("_", "_first", "n").alias("label"), "n", seq)
        .orderBy(F.desc("n"), "label")
    )
