"""Frames derived from the given tables, and the same derivations as SQL.

The tables hold no alignments, so every document is turned into one: its letters, commas
and full stops, mapped to nucleotide codes and gaps, are cut into rows of 60 sites, whole
text, last row padded. Two groupings are used: ``doc`` (one sample per document: many
small samples) and ``part`` (source and language: few large ones with many copies, one
language holding most rows).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WIDTH = 60
# Fixed values of the derivation: letters and the codes they become.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,"
CODES = "acgtacgtarctacgtyacgtackcn" * 2 + "--"
assert len(LETTERS) == len(CODES)
BYTES = bytes.maketrans(LETTERS.encode(), CODES.encode())
OTHERS = bytes(set(range(256)) - set(LETTERS.encode()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_input(df: DataFrame, key: str) -> DataFrame:
    """Small inputs come as fewer splits than there are cores; those alone are spread out
    before rows multiply. Inputs of many splits are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


@F.pandas_udf(StringType())
def coded(text: pd.Series) -> pd.Series:
    """Codes of the letters of a text, in one pass over its bytes; all else is left out."""
    return text.map(lambda t: t.encode().translate(BYTES, OTHERS).decode(), na_action="ignore")


def alignment(spark: SparkSession, sf_dir: str, by: str = "part") -> DataFrame:
    text = coded(F.col("text"))
    rows = spread_input(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id").select(
        "doc_id", "source", "lang",
        F.posexplode(F.regexp_extract_all(text, F.lit(f".{{1,{WIDTH}}}"), F.lit(0))).alias("_i", "_s"),
    )
    sample = F.concat_ws("_", "source", "lang") if by == "part" else F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    number = (F.col("_i") + 1).cast("bigint")
    return rows.select(
        sample.alias("sample_id"), F.col("source").alias("ptid"), F.col("lang").alias("region"),
        (F.col("doc_id") * 100000 + number).alias("seq_idx"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), number.cast("string")).alias("seq_name"),
        F.rpad("_s", WIDTH, "-").alias("seq"),
    )


def aln_sql(by: str = "part") -> str:
    """CTEs ending in ``aln``."""
    sample = "source || '_' || lang" if by == "part" else "'d' || doc_id"
    return f"""
letters AS (
  SELECT doc_id, source, lang,
         translate(regexp_replace(text, '[^A-Za-z.,]', '', 'g'), '{LETTERS}', '{CODES}') AS s
  FROM documents),
pieces AS (
  SELECT doc_id, source, lang, unnest(regexp_extract_all(s, '.{{1,{WIDTH}}}')) AS piece,
         generate_subscripts(regexp_extract_all(s, '.{{1,{WIDTH}}}'), 1) AS i
  FROM letters),
aln AS (
  SELECT {sample} AS sample_id, source AS ptid, lang AS region,
         CAST(doc_id * 100000 + i AS BIGINT) AS seq_idx, 'd' || doc_id || '.' || i AS seq_name,
         rpad(piece, {WIDTH}, '-') AS seq
  FROM pieces)"""


SITES_SQL = f"""
sites AS (
  SELECT sample_id, seq_idx, seq, pos, substr(seq, pos, 1) AS base
  FROM (SELECT sample_id, seq_idx, seq, unnest(range(1, {WIDTH + 1})) AS pos FROM aln))"""

CONS_SQL = f"""
base_n AS (SELECT sample_id, pos, base, count(*) AS n FROM sites GROUP BY ALL),
cons_site AS (
  SELECT sample_id, pos, base AS cons FROM base_n
  QUALIFY row_number() OVER (PARTITION BY sample_id, pos ORDER BY n DESC, base) = 1),
cons AS (SELECT sample_id, string_agg(cons, '' ORDER BY pos) AS cons FROM cons_site GROUP BY sample_id)"""

# flanking gaps blank out
FLANK_SQL = f"""
flank AS (
  SELECT sample_id, seq_idx, pos, base,
         pos <= length(seq) - length(ltrim(seq, '-')) OR pos > length(rtrim(seq, '-')) AS blank
  FROM sites),
flank_n AS (
  SELECT sample_id, pos, base, count(*) AS n FROM flank WHERE NOT blank AND base <> '?' GROUP BY ALL),
all_pos AS (SELECT DISTINCT sample_id, pos FROM sites),
flank_top AS (
  SELECT sample_id, pos, base FROM flank_n
  QUALIFY row_number() OVER (PARTITION BY sample_id, pos ORDER BY n DESC, base) = 1),
flank_cons AS (
  SELECT sample_id, pos, coalesce(base, '-') AS cons FROM all_pos LEFT JOIN flank_top USING (sample_id, pos)),
variants AS (
  SELECT sample_id, pos, cons, base AS variant, n
  FROM flank_n JOIN flank_cons USING (sample_id, pos) WHERE base <> cons)"""


def _plane(base: str) -> str:
    from seqcohort.functions.alphabet import IUPAC

    codes = "".join(IUPAC) + "-"
    bits = "".join("1" if base in IUPAC[c] else "0" for c in IUPAC) + "0"
    return f"CAST(CAST(lpad(translate(seq, '{codes}', '{bits}'), 64, '0') AS BIT) AS BIGINT) AS p{base}"


def _known() -> str:
    from seqcohort.functions.alphabet import IUPAC

    codes = "".join(IUPAC) + "-"
    return f"CAST(CAST(lpad(translate(seq, '{codes}', '{'1' * len(IUPAC)}0'), 64, '0') AS BIT) AS BIGINT) AS pk"


# unique sequences with copy numbers as 64-bit planes (rows have 60 sites)
UNIQUE_SQL = f"""
uniq AS (
  SELECT sample_id, min(seq_idx) AS idx, arg_min(seq_name, seq_idx) AS seq_name, seq, count(*) AS mult
  FROM aln GROUP BY sample_id, seq),
planes AS (
  SELECT sample_id, idx, mult, {_plane('a')}, {_plane('c')}, {_plane('g')}, {_plane('t')}, {_known()} FROM uniq)"""

PAIRS_SQL = """
pairs AS (
  SELECT x.sample_id, x.idx AS a, y.idx AS b, x.mult AS ma, y.mult AS mb,
         bit_count((x.pk & y.pk) & ~((x.pa & y.pa) | (x.pc & y.pc) | (x.pg & y.pg) | (x.pt & y.pt))) AS hd,
         bit_count(x.pk & y.pk) AS compared, bit_count(xor(x.pk, y.pk)) AS gap_difference
  FROM planes x JOIN planes y ON x.sample_id = y.sample_id AND x.idx < y.idx)"""


def sql(*ctes: str, select: str) -> str:
    """CTEs and the final select, which may open with further CTEs after a comma."""
    return "WITH " + ",".join(ctes) + "\n" + select.lstrip("\n")
