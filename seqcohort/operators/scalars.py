"""Row-level transforms of sequences, names and result rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcohort.functions import alphabet as ab
from seqcohort.functions import formulas as fm

# Header marks of genome parts, in matching order.
GENOME_PARTS = ("env|", "NFLG|", "LH|", "RH|")
# Escape marks used in exchanged sequence names.
NAME_ESCAPES = (
    ("|", "-x-BAR-x-"),
    ("/", "-x-SLASH-x-"),
    ("\\", "-x-BACKSLASH-x-"),
    ("..", "-x-DOTDOT-x-"),
    (".", "-x-DOT-x-"),
)


def sanitize(df: DataFrame, seq: str = "seq", name: str = "seq_name") -> DataFrame:
    """``!`` is illegal in residues and headers and becomes a gap."""
    return df.withColumns({c: F.translate(c, "!", "-") for c in (name, seq)})


def drop_singletons(df: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Leave out samples with one sequence. Counts are pre-aggregated and the lone keys
    anti-joined, so a hot sample is never gathered in one window."""
    lone = df.groupBy(*keys).count().filter(F.col("count") == 1).select(*keys)
    return df.join(lone, list(keys), "left_anti")


def genome_part(name: Column, patterns: Sequence[str] = GENOME_PARTS) -> Column:
    """First mark found in the header, without its bar."""
    return F.coalesce(
        *[F.when(F.instr(name, p) > 0, p.replace("|", "")) for p in patterns]
    )


def split_by_header_pattern(
    df: DataFrame,
    patterns: Sequence[str] = GENOME_PARTS,
    trigger: Sequence[str] = ("RH|", "LH|"),
    sample: str = "sample_id",
    name: str = "seq_name",
    min_sequences: int = 2,
) -> DataFrame:
    """Samples that hold every trigger mark fall apart into one sub-sample per part; parts
    with too few sequences are left out, other samples pass unchanged."""
    parts = df.withColumn("genome_part", genome_part(F.col(name), patterns))
    found = [F.max(F.instr(F.col(name), t) > 0).alias(f"_has{i}") for i, t in enumerate(trigger)]
    both = F.lit(True)
    for i in range(len(trigger)):
        both = both & F.col(f"_has{i}")
    splitting = df.groupBy(sample).agg(*found).filter(both).select(sample, F.lit(True).alias("_split"))
    marked = parts.join(splitting, sample, "left")
    small = (
        parts.join(splitting, sample, "left_semi")
        .groupBy(sample, "genome_part").count()
        .filter((F.col("count") < min_sequences) | F.col("genome_part").isNull())
        .select(F.col(sample).alias("_s"), F.col("genome_part").alias("_p"))
    )
    return (
        marked.join(
            small,
            F.col("_split") & (F.col(sample) == F.col("_s")) & F.col("genome_part").eqNullSafe(F.col("_p")),
            "left_anti",
        )
        .withColumn(
            sample,
            F.when(F.col("_split"), F.concat_ws("_", sample, "genome_part")).otherwise(F.col(sample)),
        )
        .drop("_split")
    )


def base_sample_name(sample: Column) -> Column:
    """Name shared by the region siblings of one sample."""
    base = F.regexp_extract(sample, r"^(.+)(?:_[LR]H|_NFLG|_env)", 1)
    return F.when(base == "", sample).otherwise(base)


def ungap(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def escape_names(name: Column) -> Column:
    for raw, mark in NAME_ESCAPES:
        name = F.replace(name, F.lit(raw), F.lit(mark))
    return name


def unescape_names(name: Column) -> Column:
    for raw, mark in NAME_ESCAPES:
        name = F.replace(name, F.lit(mark), F.lit(raw))
    return name


def standard_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")


def parse_multiplicity(name: Column) -> Column:
    """Trailing ``_nnn`` of a name; 1 when there is none. Opt-in: many names end in a
    number that is no multiplicity."""
    digits = F.regexp_extract(name, r"^.+_([0-9]+)$", 1)
    return F.coalesce(F.when(digits != "", digits).try_cast("bigint"), F.lit(1).cast("bigint"))


def gap_fraction(seq: Column) -> Column:
    return (F.length(seq) - F.length(ungap(seq))) / F.length(seq)


def gap_fraction_filter(
    requested: DataFrame, found: DataFrame, on: Sequence[str] = ("sample_id", "seq_name"),
    seq: str = "seq", limit: float = 0.9,
) -> DataFrame:
    """Every requested sequence with ``found``, its gap share and whether it is kept."""
    facts = found.select(
        *on,
        gap_fraction(F.col(seq)).alias("gap_fraction"),
        F.length(ungap(F.col(seq))).cast("bigint").alias("n_non_gap"),
    )
    return (
        requested.select(*on).join(facts, list(on), "left")
        .withColumn("found", F.col("gap_fraction").isNotNull())
        .withColumn("kept", F.coalesce(F.col("gap_fraction") < limit, F.lit(False)))
    )


def reading_strand(seq: Column, frame: int = 1, reverse: bool = False, complement: bool = False) -> Column:
    if frame not in (1, 2, 3):
        raise ValueError("frame is 1, 2 or 3")
    if complement:
        # Complement of each code.
        seq = F.translate(seq, "acgtrykmbdhv", "tgcayrmkvhdb")
    if reverse:
        seq = F.reverse(seq)
    return seq if frame == 1 else F.substring(seq, frame, 2**30)


def translate_codons(
    df: DataFrame, frame: int = 1, reverse: bool = False, complement: bool = False,
    seq: str = "seq", out: str = "aa",
) -> DataFrame:
    strand = reading_strand(F.col(seq), frame, reverse, complement)
    return df.withColumn(out, F.array_join(F.transform(ab.codons(strand), ab.amino_acid), ""))


def mask_codons(
    df: DataFrame, reference: DataFrame, keep: str = "nonsynonymous",
    keys: Sequence[str] = ("sample_id",), seq: str = "seq", ref: str = "cons",
) -> DataFrame:
    """Gap out codons by comparing amino acids with the sample's reference sequence.

    ``keep='nonsynonymous'`` masks codons whose amino acid matches, ``'synonymous'``
    those that differ. Bases after the last whole codon stay as they are.
    """
    if keep not in ("synonymous", "nonsynonymous"):
        raise ValueError("keep is 'synonymous' or 'nonsynonymous'")

    def mask(codon: Column, ref_codon: Column) -> Column:
        same = ab.strict_amino_acid(codon) == ab.strict_amino_acid(ref_codon)
        hide = same if keep == "nonsynonymous" else ~same
        return F.when(hide, F.lit("---")).otherwise(codon)

    whole = F.col("_tail_at")
    masked = F.array_join(
        F.zip_with(ab.codons(F.col(seq), True), ab.codons(F.col(ref), True), mask), ""
    )
    return (
        df.join(reference.select(*keys, ref), list(keys))
        .withColumn("_tail_at", (F.floor(F.length(seq) / 3) * 3 + 1).cast("int"))
        .withColumn(seq, F.concat(masked, F.substr(F.col(seq), whole)))
        .drop(ref, "_tail_at")
    )


def drop_consensus_gap_columns(
    df: DataFrame, consensus: DataFrame, keys: Sequence[str] = ("sample_id",),
    seq: str = "seq", ref: str = "cons",
) -> DataFrame:
    """Remove the sites at which the consensus is a gap, from sequences and consensus."""
    zipped = F.zip_with(
        ab.chars(F.col(seq)), ab.chars(F.col(ref)), lambda base, cons: F.when(cons != "-", base).otherwise("")
    )
    return (
        df.join(consensus.select(*keys, ref), list(keys))
        .withColumn(seq, F.when(F.instr(ref, "-") > 0, F.array_join(zipped, "")).otherwise(F.col(seq)))
        .withColumn(ref, ungap(F.col(ref)))
    )


def exclude_by_pattern(files: DataFrame, existing: DataFrame, pattern: str = "env", path: str = "path") -> DataFrame:
    """Listed sources that do not match the pattern and that exist."""
    return files.filter(~F.col(path).rlike(pattern)).join(existing.select(path), path, "left_semi")


def results_zero_variation_rule(
    df: DataFrame, nbases: str = "nbases", nbases_by_column: dict[str, str] | None = None,
) -> DataFrame:
    """Where no variable base was fitted: rates and days are 0 and every is-/fits- call
    (but the informative-sites one) is 1."""
    by = nbases_by_column or {}
    out = {}
    for c in df.columns:
        lowered = c.lower()
        if "lambda" in lowered or "days" in lowered or "time" in lowered:
            value = 0
        elif ("_is_" in lowered or lowered.startswith("is_") or "fits" in lowered) and "insites" not in lowered:
            value = 1
        else:
            continue
        kind = df.schema[c].dataType
        out[c] = F.when(F.col(by.get(c, nbases)) == 0, F.lit(value).cast(kind)).otherwise(F.col(c))
    return df.withColumns(out) if out else df


def select_columns_by_pattern(
    df: DataFrame, keep: Iterable[str] = (), drop: Iterable[str] = (), always: Iterable[str] = (),
) -> DataFrame:
    import re

    keep, drop, always = list(keep), list(drop), set(always)

    def wanted(c: str) -> bool:
        if c in always:
            return True
        if any(re.search(p, c) for p in drop):
            return False
        return not keep or any(re.search(p, c) for p in keep)

    return df.select(*[c for c in df.columns if wanted(c)])


def filter_results_rows(
    df: DataFrame, label: str, drop: Iterable[str] = (), rename: Iterable[tuple[str, str]] = (),
    order_by: Column | None = None,
) -> DataFrame:
    """Drop rows whose label matches a pattern, rewrite labels, optionally sort."""
    for pattern in drop:
        df = df.filter(~F.col(label).rlike(pattern))
    for pattern, text in rename:
        df = df.withColumn(label, F.regexp_replace(label, pattern, text))
    return df if order_by is None else df.orderBy(order_by)


def pretty_p_value(p: Column, digits: int = 4, equals_text: str = "", less_text: str = "<") -> Column:
    """Fixed digits; below the resolution a ``<0.0..1`` text; missing or infinite empty."""
    text = fm.fixed_digits(p, digits)
    zero = f"{0:.{digits}f}"
    floor = less_text + "0." + "0" * (digits - 1) + "1"
    gone = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return F.when(gone, "").when(text == zero, floor).otherwise(F.concat(F.lit(equals_text), text))
