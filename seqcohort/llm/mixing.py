"""Mixing sources by temperature: DataFrame expressions only.

A source's share of all tokens, raised to an exponent and normalised, is its weight: exponent
1 keeps the shares, 0 makes all sources equal. The exponent is bisected between them to the
flattest mixture that is not flatter than a target entropy and repeats no source more than
``max_repeats`` times within the token budget; eight bisection steps are decided by one
aggregate over the per-source totals, which returns 255 rows whatever the number of sources.

A source's quota (weight x budget) is realised as block permutations. Documents fall into
blocks of about ``block_tokens`` tokens by a hash of id, size, mark and copy number, so that rows
of one id, null included, spread like others, and are ordered by it inside; each pass over a source takes its blocks in an order of its own. Whole passes come first, then the blocks and
documents of one more pass for as long as the quota lasts, so a budget is never exceeded and
is missed by less than one block per source. ``progress`` (how much of the source's quota lies
before the block) orders the mixture: every prefix is close to the weights.

Tokens are runs without ASCII white space. Null and empty texts have none; they ride along
with their blocks. A null source is the source ``(none)``; sources without a token have weight
0 and keep one pass. Repeated rows are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcohort.session import settle

LEVELS, PASSES = 8, 4
COPIES = 4096
NO_SOURCE = "(none)"
TOKEN = r"[^ \t\n\x0B\f\r]+"


def count_tokens(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(TOKEN)).cast("long")


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               mark: Column | None = None) -> DataFrame:
    """``id, source, n_tokens, mark`` of every row; ``mark`` is a long of the caller's to tell
    rows of one id apart."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"),
        count_tokens(text_col).alias("n_tokens"), (mark if mark is not None else F.lit(None)).cast("long").alias("mark"),
    )


def exponent(totals: DataFrame, entropy_share: float, budget_share: float, max_repeats: float) -> float:
    """The bisected exponent of ``totals`` (``source, tokens``), to six decimals."""
    live = totals.filter("tokens > 0")
    whole = live.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k")).first()
    if not whole.k:
        return 1.0
    share = live.select((F.col("tokens") / F.lit(float(whole.t))).alias("p"))
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        width = (high - low) / 2**LEVELS
        tried = share.select("p", F.explode(F.sequence(F.lit(0), F.lit(2**LEVELS - 1))).alias("i"))
        x = F.pow("p", F.lit(low) + F.lit(width) * F.col("i"))
        sums = tried.select("i", "p", x.alias("x")).groupBy("i").agg(
            F.sum("x").alias("z"), F.sum(F.col("x") * F.log("x")).alias("s"), F.max(F.col("x") / F.col("p")).alias("most")
        )
        flat = (F.log("z") - F.col("s") / F.col("z") > F.log(F.lit(float(whole.k))) * entropy_share) | (
            F.col("most") / F.col("z") * budget_share > max_repeats
        )
        last = sums.filter(flat).agg(F.max("i")).first()[0]  # both fall as the exponent rises
        if last is None:
            return round(low, 6)
        low, high = low + width * last, low + width * (last + 1)
    return round(high, 6)


def hashed(*parts: str | Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts]))


def first_bits(digest: Column) -> Column:
    """The first 32 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def numbered_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``, which counts rows that are equal from 1. They are counted with
    map-side combine and written out again, in two steps so that no array is long."""
    equal = rows.groupBy("id", "mark", "source", "n_tokens").agg(F.count(F.lit(1)).alias("times"))
    runs = equal.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES))).alias("run"))
    step = F.least(F.lit(COPIES).cast("long"), F.col("times") - F.col("run") * COPIES)
    return runs.select(
        "id", "mark", "source", "n_tokens", "run", F.explode(F.sequence(F.lit(1).cast("long"), step)).alias("copy")
    ).withColumn("copy", F.col("copy") + F.col("run") * COPIES).drop("run")


def mix(rows: DataFrame, entropy_share: float = 0.95, max_repeats: float = 2.0, budget_share: float = 1.0,
        block_tokens: int = 50_000, seed: str = "mix") -> DataFrame:
    """``id, mark, source, pass, block, slot, n_tokens, weight, progress``: every occurrence of a
    document in the mixture of ``rows`` (as from ``token_rows``). The budget is
    ``budget_share`` of all tokens."""
    rows = settle(rows)
    totals = settle(rows.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") + 1).alias("volume")
    ))
    power = exponent(totals, entropy_share, budget_share, max_repeats)
    whole = totals.agg(F.sum("tokens").alias("t")).first().t or 0
    raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(whole, 1))), F.lit(power))).otherwise(0.0)
    z = totals.agg(F.sum(raised).alias("z")).first().z or 1.0
    quota = F.floor(F.col("weight") * F.lit(float(whole) * budget_share)).cast("long")
    plan = totals.select(
        "source", "tokens", F.round(raised / F.lit(z), 9).alias("weight"),
        F.ceil(F.col("volume") / F.lit(float(block_tokens))).cast("long").alias("blocks"),
    ).select("*", quota.alias("quota")).select(
        "*", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("long").alias("passes"),
    ).select("*", (F.col("quota") - F.col("passes") * F.col("tokens")).alias("rest"))
    plan = settle(plan)
    # One row per source on the right; the adaptive join splits a source of very many rows.
    key = hashed(seed, F.col("source"), F.col("id"), F.col("n_tokens"), F.col("mark"), F.col("copy"))
    dealt = numbered_copies(rows).join(plan.select("source", "blocks"), "source").select(
        "id", "mark", "source", "n_tokens", key.alias("key"), F.pmod(first_bits(key), F.col("blocks")).alias("block")
    )
    inside = Window.partitionBy("source", "block").orderBy("key", "id", "n_tokens", "mark").rowsBetween(Window.unboundedPreceding, 0)
    dealt = settle(dealt.select(
        "id", "mark", "source", "n_tokens", "block", F.count(F.lit(1)).over(inside).alias("slot"), F.sum("n_tokens").over(inside).alias("through"),
    ))
    runs = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("held")).join(plan, "source").select(
        "source", "block", "held", "weight", "quota", "passes", "rest", "tokens", "blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1))).alias("pass"),
    ).filter((F.col("passes") > 0) | (F.col("rest") > 0))
    order = hashed(seed, F.col("source"), F.col("pass"), F.col("block"))
    # Totals over the blocks before: first within ranges of the block order, then over ranges,
    # both about the root of the number of blocks, so that no window holds all of a source's.
    ranges = F.ceil(F.sqrt(F.col("blocks")))
    runs = runs.withColumn("order", order).withColumn("range", F.floor(first_bits(F.col("order")) * ranges / F.lit(float(2**32))))
    within = Window.partitionBy("source", "pass", "range").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("source", "pass", "range").agg(F.sum("held").alias("held")).select(
        "source", "pass", "range", F.coalesce(F.sum("held").over(across), F.lit(0)).alias("start")
    )
    runs = runs.withColumn("inner", F.coalesce(F.sum("held").over(within), F.lit(0))).join(starts, ["source", "pass", "range"])
    before = F.col("start") + F.col("inner")
    done = F.when(F.col("quota") > 0, F.round((F.col("pass") * F.col("tokens") + before) / F.col("quota"), 9)).otherwise(0.0)
    runs = runs.select("source", "block", "pass", "weight", "passes", "rest", before.alias("before"), done.alias("progress"))
    return dealt.join(runs, ["source", "block"]).filter(
        (F.col("pass") < F.col("passes")) | (F.col("before") + F.col("through") <= F.col("rest"))
    ).select("id", "mark", "source", "pass", "block", "slot", "n_tokens", "weight", "progress")


def mix_sql(entropy_share: float = 0.95, max_repeats: float = 2.0, budget_share: float = 1.0,
            block_tokens: int = 50_000, seed: str = "mix") -> str:
    """The same over ``documents`` in DuckDB, one bisection step per round of the recursion."""
    return f"""
WITH RECURSIVE r AS (
  SELECT doc_id AS id, coalesce(source, '{NO_SOURCE}') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens + 1)::BIGINT AS volume FROM r GROUP BY source),
p AS (SELECT tokens / (SELECT sum(tokens)::DOUBLE FROM t) AS p, (SELECT count(*) FROM t WHERE tokens > 0) AS k FROM t WHERE tokens > 0),
steps(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, mid, (SELECT ln(sum(pow(p, mid))) - sum(pow(p, mid) * ln(pow(p, mid))) / sum(pow(p, mid)) > ln(max(k)) * {entropy_share}
        OR max(pow(p, mid) / p) / sum(pow(p, mid)) * {budget_share} > {max_repeats} FROM p) AS flat
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM steps WHERE i < {LEVELS * PASSES}))),
a AS (SELECT CASE WHEN (SELECT count(*) FROM p) = 0 THEN 1.0 WHEN NOT (SELECT ln(max(k)) > ln(max(k)) * {entropy_share}
        OR max(1 / p) / count(*) * {budget_share} > {max_repeats} FROM p) THEN 0.0
      ELSE round((SELECT hi FROM steps WHERE i = {LEVELS * PASSES}), 6) END AS power),
x AS (SELECT source, tokens, volume, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens)::DOUBLE FROM t), (SELECT power FROM a)) ELSE 0 END AS raised FROM t),
w AS (SELECT source, tokens, round(raised / (SELECT sum(raised) FROM x), 9) AS weight, CAST(ceil(volume / {float(block_tokens)}) AS BIGINT) AS blocks FROM x),
q AS (SELECT *, CAST(floor(weight * ((SELECT sum(tokens)::DOUBLE FROM t) * {budget_share})) AS BIGINT) AS quota FROM w),
plan AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes,
         quota - CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END * tokens AS rest FROM q),
keyed AS (SELECT id, source, n_tokens, md5('{seed}|' || source || '|' || coalesce(CAST(id AS VARCHAR), 'null') || '|' || n_tokens || '|null|' ||
    row_number() OVER (PARTITION BY id, source, n_tokens)) AS key, blocks FROM r JOIN plan USING (source)),
dealt AS (SELECT id, source, n_tokens, block, count(*) OVER o AS slot, sum(n_tokens) OVER o AS through FROM (
    SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) % blocks AS block FROM keyed)
  WINDOW o AS (PARTITION BY source, block ORDER BY key, id, n_tokens ROWS UNBOUNDED PRECEDING)),
held AS (SELECT source, block, sum(n_tokens) AS held FROM dealt GROUP BY ALL),
runs AS (SELECT held.*, weight, quota, passes, rest, tokens, unnest(range(0, passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS pass FROM held JOIN plan USING (source)),
placed AS (SELECT *, coalesce(sum(held) OVER (PARTITION BY source, pass ORDER BY md5('{seed}|' || source || '|' || pass || '|' || block), block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM runs)
SELECT id AS doc_id, source, pass, block, slot, n_tokens, weight,
       CASE WHEN quota > 0 THEN round((pass * tokens + before) / quota, 9) ELSE 0 END AS progress
FROM dealt JOIN placed USING (source, block) WHERE pass < passes OR before + through <= rest"""
