"""Distances between the sequences of a group.

The number of pairs grows with the square of a group, so pairs are never rows of a
shuffle. A group is cut into hashed blocks; every tile (block x block) is one bounded task
unit that compares its two blocks on packed bit planes, piece by piece, and emits only what
was asked for: histogram bins, per-sequence sums, nearest neighbours, or the pairs, all or those
within a distance. A sequence travels once per block of its own group at four bits a site: once for
ordinary groups, ``SPLITS`` times for large ones, whose blocks grow with them (more often only
beyond ``SPLITS`` blocks of ``TILE_ROWS``), so that the volume grows with the rows, not the pairs.

Two bases differ when both are known and no nucleotide is common to both codes, so the
relation is not transitive under ambiguity codes. Gaps and ``?`` are unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcohort.functions import alphabet as ab
from seqcohort.functions.labels import labels_of
from seqcohort.session import settle, spread

KEYS = ("sample_id",)
# Rows and characters compared at once, and the most that one side of a tile holds.
BLOCK_ROWS = 1024
BLOCK_CHARS = 1 << 23
TILE_ROWS = 1 << 18
TILE_CHARS = 1 << 24
SPLITS = 12
FLUSH_ROWS = 200_000
SUMS = ("s0", "s1", "s2", "q0", "q1", "q2")


def _tiles(df: DataFrame, keys: Sequence[str], idx: str, seq: str, mult: str | None, block_rows: int,
           focus: Column | None = None) -> DataFrame:
    """One row per tile. With ``focus`` (a condition) only pairs that have at least one such
    row are looked at: the rows in focus get blocks of their own, numbered first, and the
    others meet those blocks only."""
    rows = df.select(
        *keys,
        F.col(idx).cast("bigint").alias("_idx"),
        F.col(seq).alias("_seq"),
        (F.col(mult) if mult else F.lit(1)).cast("bigint").alias("_m"),
        (focus if focus is not None else F.lit(True)).alias("_f"),
    )

    def blocks(mine: Column) -> Column:
        n = F.count_if(mine)
        text = F.coalesce(F.sum(F.when(mine, F.length("_seq").cast("bigint"))), F.lit(0))
        least = F.greatest(F.lit(SPLITS), F.ceil(n / TILE_ROWS), F.ceil(text / TILE_CHARS))
        return F.least(F.ceil(F.greatest(n / block_rows, text / BLOCK_CHARS)), least).cast("int")

    sizes = rows.groupBy(*keys).agg(
        blocks(F.col("_f")).alias("_first"), blocks(~F.col("_f")).alias("_rest"),
        F.min(F.length("_seq")).alias("_short"), F.max(F.length("_seq")).alias("_long"),
    ).filter("_first > 0")
    same = F.when(F.col("_short") != F.col("_long"), F.raise_error(F.lit("sequences of one group differ in length")).cast("int"))
    sizes = sizes.withColumn("_first", F.coalesce(same, F.col("_first"))).drop("_short", "_long")
    own = F.when(F.col("_f"), F.pmod(F.xxhash64("_idx"), F.col("_first"))).otherwise(
        F.col("_first") + F.pmod(F.xxhash64("_idx"), F.col("_rest"))
    ).cast("int")
    met = F.col("_first") + F.when(F.col("_own") < F.col("_first"), F.col("_rest")).otherwise(0)
    held = (
        _gathered(rows.join(sizes, list(keys)).withColumn("_own", own), *keys, "_own", "_first", "_rest")
        .select(*keys, "_own", F.explode(F.sequence(F.lit(0), met - 1)).alias("_other"),
                F.struct("ids", "ms", "sites", "width").alias("_block"))
        .withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    )
    side = lambda which: F.first(F.when(F.col("_own") == F.col(which), F.col("_block")), ignorenulls=True)
    tile = spread(held, *keys, "_lo", "_hi").groupBy(*keys, "_lo", "_hi").agg(side("_lo").alias("_a"), side("_hi").alias("_b"))
    diag = F.col("_lo") == F.col("_hi")
    # a block without its partner has no pair
    return tile.filter("_a IS NOT NULL AND _b IS NOT NULL").select(
        *keys, diag.alias("t_diag"),
        *[F.col(f"_a.{c}").alias(f"a_{c}") for c in ("ids", "ms", "sites", "width")],
        *[F.when(~diag, F.col(f"_b.{c}")).alias(f"b_{c}") for c in ("ids", "ms", "sites", "width")],
    )


_CODES = "".join(ab.MASK).lower()
_DIGITS = "".join(f"{m:x}" for m in ab.MASK.values())


def _gathered(rows: DataFrame, *by: str) -> DataFrame:
    """One row per block with its numbers, copies and sites (``_idx, _m, _seq`` of its rows)."""
    # a site is a hexadecimal digit with one bit per base, two sites are a byte
    digits = F.translate(F.regexp_replace(F.lower("_seq"), f"[^{_CODES}]", "-"), _CODES + "-", _DIGITS + "0")
    even = F.when(F.length("_seq") % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return rows.withColumn("_hex", even).groupBy(*by).agg(
        F.collect_list(F.struct(F.col("_idx").alias("idx"), F.col("_m").alias("m"), F.col("_hex").alias("hex"))).alias("_r"),
        F.max(F.length("_seq")).alias("_len"),
    ).select(
        *by, F.col("_r.idx").alias("ids"), F.col("_r.m").alias("ms"),
        F.unhex(F.array_join("_r.hex", "")).alias("sites"), F.col("_len").alias("width"),
    )


class Block:
    """Bit planes of one block, 64 sites per word: per base where it is ruled out (nowhere at
    unknown sites, which differ from nothing) and the known plane."""

    def __init__(self, masks: np.ndarray, ids: np.ndarray, mult: np.ndarray):
        self.ids, self.mult = ids, mult.astype(np.float64)
        n, length = masks.shape
        words = -(-length // 64)
        padded = np.zeros((n, words * 64), np.uint8)
        padded[:, :length] = masks
        known = np.packbits(padded != 0, axis=1).view(np.uint64)
        without = [np.packbits((padded >> k) & 1, axis=1).view(np.uint64) ^ known for k in range(4)]
        self.without = [[np.ascontiguousarray(p[:, w]) for p in without] for w in range(words)]
        self.known = [np.ascontiguousarray(known[:, w]) for w in range(words)]
        self.n = n


STRIP = 1 << 15


def compare(a: Block, b: Block, gaps: bool, with_compared: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(differing sites, sites compared, sites where one of the two is a gap)."""
    return tuple(None if c is None else c.astype(np.int32) for c in _compare(a, b, gaps, with_compared))


def _compare(a: Block, b: Block, gaps: bool, with_compared: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """``compare`` in bytes where all sites together fit one, filled in strips of rows that stay
    in the processor cache."""
    shape = (a.n, b.n)
    kind = np.uint8 if len(a.known) < 4 else np.int32
    differ = np.zeros(shape, kind)
    compared = np.zeros(shape, kind) if with_compared else None
    indel = np.zeros(shape, kind) if gaps else None
    height = max(1, min(a.n, STRIP // max(b.n, 1)))
    room = [np.empty((height, b.n), np.uint64) for _ in range(2)]
    counts = np.empty((height, b.n), np.uint8)
    for top in range(0, a.n, height):
        rows = slice(top, min(top + height, a.n))
        size = rows.stop - top
        apart, part, bits = room[0][:size], room[1][:size], counts[:size]

        def add(words: np.ndarray, out: np.ndarray, first: bool) -> None:
            np.bitwise_count(words, out=bits)
            np.copyto(out[rows], bits) if first else np.add(out[rows], bits, out=out[rows])

        for w in range(len(a.known)):
            ka, kb = a.known[w][rows, None], b.known[w][None, :]
            # bases that each is ruled out on one side at least
            np.bitwise_or(a.without[w][0][rows, None], b.without[w][0][None, :], out=apart)
            for pa, pb in zip(a.without[w][1:], b.without[w][1:]):
                np.bitwise_or(pa[rows, None], pb[None, :], out=part)
                np.bitwise_and(apart, part, out=apart)
            add(apart, differ, w == 0)
            if with_compared:
                np.bitwise_and(ka, kb, out=part)
                add(part, compared, w == 0)
            if gaps:
                np.bitwise_xor(ka, kb, out=part)
                add(part, indel, w == 0)
    return differ, compared, indel


def _counted(code: np.ndarray, bins: int, weight: np.ndarray | None = None) -> np.ndarray:
    """How often each code below ``bins`` occurs; many bytes are counted two at a time."""
    if weight is not None:
        return np.bincount(code.ravel(), weight.ravel(), minlength=bins).astype(np.int64)
    flat = np.ascontiguousarray(code).ravel()
    if flat.dtype == np.uint8 and len(flat) >= 1 << 18 and len(flat) % 2 == 0:
        both = np.bincount(flat.view(np.uint16), minlength=1 << 16).reshape(256, 256)
        return (both.sum(0) + both.sum(1))[:bins]
    return np.bincount(flat, minlength=bins)


def _unpacked(ids, ms, sites, width) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Numbers, copies, packed sites by row, and width of a block."""
    ids, ms = np.asarray(ids, dtype=np.int64), np.asarray(ms, dtype=np.int64)
    width = 0 if width is None or width != width else int(width)
    packed = np.frombuffer(sites, np.uint8)
    if len(packed) != len(ids) * ((width + 1) // 2):
        raise ValueError("sequences of one group differ in length")
    return ids, ms, packed.reshape(len(ids), -1), width


def _masks(packed: np.ndarray, width: int) -> np.ndarray:
    masks = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    masks[:, 0::2], masks[:, 1::2] = packed >> 4, packed & 15
    return masks[:, :width]


def _side(ids, ms, sites, width, block_rows: int) -> list[Block]:
    """One side of a tile in pieces that are compared at once, in order of ids."""
    ids, ms, packed, width = _unpacked(ids, ms, sites, width)
    order = np.argsort(ids, kind="stable")
    step = max(1, min(block_rows, BLOCK_CHARS // max(width, 1)))
    out = []
    for start in range(0, len(ids), step):
        mine = order[start:start + step]
        out.append(Block(_masks(packed[mine], width), ids[mine], ms[mine]))
    return out


def _fold(parts: list[dict[str, np.ndarray]], by: Sequence[str], sums: Sequence[str] = (), least: Sequence[str] = ()) -> dict[str, np.ndarray]:
    """One row per ``by``: columns ``sums`` added up, the others from the row that is first in ``least``."""
    whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    if not len(whole[by[0]]):
        return whole
    order = np.lexsort([whole[k] for k in reversed([*by, *least])])
    whole = {k: v[order] for k, v in whole.items()}
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in by:
        new[1:] |= whole[k][1:] != whole[k][:-1]
    first = np.flatnonzero(new)
    return {k: np.add.reduceat(v, first) if k in sums else v[first] for k, v in whole.items()}


def _run(
    df: DataFrame, keys: Sequence[str], schema: str, per_tile: Callable[..., dict[str, np.ndarray]],
    idx: str, seq: str, mult: str | None, block_rows: int, focus: Column | None = None,
    merge: Callable[[list[dict[str, np.ndarray]]], dict[str, np.ndarray]] | None = None,
) -> DataFrame:
    """``per_tile`` of all pieces of all tiles; ``merge`` combines what the pieces of one tile give."""
    tiles = _tiles(df, keys, idx, seq, mult, block_rows, focus)
    key_schema = ", ".join(f"`{k}` {tiles.schema[k].dataType.simpleString()}" for k in keys)
    names = list(keys)

    def pieces(row) -> Iterator[dict[str, np.ndarray]]:
        a = _side(row.a_ids, row.a_ms, row.a_sites, row.a_width, block_rows)
        b = a if row.t_diag else _side(row.b_ids, row.b_ms, row.b_sites, row.b_width, block_rows)
        found, held, limit = [], 0, FLUSH_ROWS
        for i, x in enumerate(a):
            for j in range(i if row.t_diag else 0, len(b)):
                out = per_tile(x, b[j], bool(row.t_diag) and i == j)
                found.append(out)
                held += len(next(iter(out.values())))
                if held >= limit:
                    if merge is None:
                        yield from found
                        found, held = [], 0
                    else:
                        found = [merge(found)]
                        held = len(next(iter(found[0].values())))
                        limit = max(FLUSH_ROWS, 2 * held)
        yield from found if merge is None or len(found) < 2 else [merge(found)]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[dict[str, np.ndarray]] = []
        held = 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                for out in pieces(row):
                    n = len(next(iter(out.values())))
                    if n:
                        tags = {k: np.full(n, row[i], dtype=object) for i, k in enumerate(names)}
                        done.append(tags | out)
                        held += n
                    if held >= FLUSH_ROWS:
                        yield _stack(done)
                        done, held = [], 0
        if done:
            yield _stack(done)

    return tiles.mapInPandas(batches, f"{key_schema}, {schema}")


def _stack(parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})


def _distance(differ, indel):
    return differ if indel is None else differ + indel


def pair_histogram(
    df: DataFrame, keys: Sequence[str] = KEYS, idx: str = "seq_idx", seq: str = "seq",
    mult: str | None = None, include_gaps: bool = False, with_compared: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number of pairs per distance (and per number of compared sites when asked);
    ``n`` weights each pair with the product of the copy numbers."""

    def per_tile(a: Block, b: Block, diag: bool) -> dict:
        differ, compared, indel = _compare(a, b, include_gaps, with_compared)
        code = _distance(differ, indel)
        base = int(compared.max(initial=0)) + 1 if with_compared else 1
        if with_compared:
            kind = np.uint16 if code.dtype == np.uint8 else np.int64
            code = code.astype(kind) * kind(base) + compared
        value, n, pairs = _histogram(code, a, b, diag)
        return {
            "hd": (value // base).astype(np.int32), "compared": (value % base).astype(np.int32),
            "n": n, "n_pairs": pairs.astype(np.int64),
        }

    parts = _run(df, keys, "hd int, compared int, n bigint, n_pairs bigint", per_tile, idx, seq, mult, block_rows,
                 merge=lambda found: _fold(found, ("hd", "compared"), ("n", "n_pairs")))
    by = [*keys, "hd"] + (["compared"] if with_compared else [])
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n_pairs").alias("n_pairs"))


def near_pairs(
    df: DataFrame, max_distance: int | None = None, keys: Sequence[str] = KEYS, idx: str = "seq_idx",
    seq: str = "seq", include_gaps: bool = False, block_rows: int = BLOCK_ROWS, focus: Column | None = None,
) -> DataFrame:
    """Pairs ``a < b`` of a group at most ``max_distance`` apart, all of them without one; with
    ``focus`` those of them that have a row meeting that condition."""

    def per_tile(a: Block, b: Block, diag: bool) -> dict:
        differ, compared, indel = _compare(a, b, True, True)
        hit = (np.ones(differ.shape, bool) if max_distance is None
               else _distance(differ, indel if include_gaps else None) <= max_distance)
        i, j = np.nonzero(np.triu(hit, 1) if diag else hit)
        ia, ib = a.ids[i], b.ids[j]
        return {
            "a": np.minimum(ia, ib), "b": np.maximum(ia, ib), "hd": differ[i, j].astype(np.int32),
            "compared": compared[i, j].astype(np.int32), "gap_difference": indel[i, j].astype(np.int32),
        }

    return _run(df, keys, "a bigint, b bigint, hd int, compared int, gap_difference int",
                per_tile, idx, seq, None, block_rows, focus)


def spanning_links(hit: np.ndarray, diag: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of links that connect what the hits of a tile connect: a
    spanning forest, hence fewer links than the tile has rows and columns. Few hits are searched as links."""
    if hit.sum(dtype=np.int64) <= 4 * sum(hit.shape):
        i, j = np.nonzero(hit)
        if diag:
            i, j = i[i < j], j[i < j]
        kept = _forest([{"a": i, "b": j if diag else j + len(hit)}])
        return kept["a"], kept["b"] if diag else kept["b"] - len(hit)
    views = (hit, hit) if diag else (hit, np.ascontiguousarray(hit.T))
    rows = np.ones(hit.shape[0], bool)
    free = (rows, rows if diag else np.ones(hit.shape[1], bool))
    found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    for start in range(len(rows)):
        if not rows[start]:
            continue
        rows[start] = False
        reached = [(0, start)]
        while reached:
            side, i = reached.pop()
            new = np.nonzero(views[side][i] & free[1 - side])[0]
            free[1 - side][new] = False
            found[side].append(np.full(len(new), i))
            found[1 - side].append(new)
            reached += [(1 - side, j) for j in new.tolist()]
    return np.concatenate(found[0]), np.concatenate(found[1])


def _forest(found: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Those of the links that connect what all of them connect: every component takes the
    first link that leaves it, until none leaves."""
    links = {c: np.concatenate([p[c] for p in found]) for c in "ab"}
    ids, place = np.unique(np.concatenate([links["a"], links["b"]]), return_inverse=True)
    i, j = np.split(place, 2)
    label, left, chosen = np.arange(len(ids)), np.arange(len(i)), [np.empty(0, np.int64)]
    while len(left := left[label[i[left]] != label[j[left]]]):
        first = np.full(len(ids), len(i))
        np.minimum.at(first, label[i[left]], left)
        np.minimum.at(first, label[j[left]], left)
        taken = np.unique(first[first < len(i)])
        chosen.append(taken)
        label = labels_of(len(ids), i[taken], j[taken], label)
    kept = np.concatenate(chosen)
    return {c: links[c][kept] for c in "ab"}


def near_links(
    df: DataFrame, max_distance: int, keys: Sequence[str] = KEYS, idx: str = "seq_idx",
    seq: str = "seq", include_gaps: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Links ``a < b`` with the connected components of ``near_pairs``: of the pairs of a tile
    only a spanning forest leaves it, so a group of n sequences gives at most n links per
    block of it that it meets, whatever the number of its pairs."""

    def per_tile(a: Block, b: Block, diag: bool) -> dict:
        differ, _, indel = _compare(a, b, include_gaps, False)
        i, j = spanning_links(_distance(differ, indel) <= max_distance, diag)
        ia, ib = a.ids[i], b.ids[j]
        return {"a": np.minimum(ia, ib), "b": np.maximum(ia, ib)}

    return _run(df, keys, "a bigint, b bigint", per_tile, idx, seq, None, block_rows, merge=_forest)


def _histogram(code: np.ndarray, a: Block, b: Block, diag: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of a tile's pairs with their weight and count. Codes of a block with
    itself are symmetric: what remains without the diagonal is halved."""
    if code.size and code.max() >= 1 << 22:
        value, place = np.unique(code, return_inverse=True)
        found, n, count = _histogram(place.reshape(code.shape), a, b, diag)
        return value[found], n, count
    bins = int(code.max(initial=0)) + 1
    count = _counted(code, bins)
    own = np.diagonal(code) if diag else None
    total, many, more = count, a.mult != 1, b.mult != 1
    if many.any() or more.any():
        # what pairs weigh beyond one: in the rows of many copies, then in the columns beside them
        total = (count + _counted(code[many], bins, np.multiply.outer(a.mult[many], b.mult) - 1)
                 + _counted(code[:, more], bins, np.multiply.outer(~many, b.mult[more] - 1)))
    if diag:
        total = (total - _counted(own, bins, a.mult * a.mult)) // 2
        count = (count - _counted(own, bins)) // 2
    value = np.nonzero(count)[0]
    return value, total[value], count[value]


def _moments(d: np.ndarray, a: Block, b: Block, diag: bool) -> dict[str, np.ndarray]:
    """Per-sequence sums of one tile, for both of its sides."""
    d = d.astype(np.float64)
    present = np.ones_like(d)
    if diag:
        np.fill_diagonal(present, 0.0)

    def sums(dist, there, ids, own, other):
        m, m2 = other, other * other
        return {
            "idx": ids, "m": own,
            "s0": there @ m, "s1": dist @ m, "s2": (dist * dist) @ m,
            "q0": there @ m2, "q1": dist @ m2, "q2": (dist * dist) @ m2,
        }

    first = sums(d, present, a.ids, a.mult, b.mult)
    if diag:
        return first
    second = sums(d.T, present.T, b.ids, b.mult, a.mult)
    return {k: np.concatenate([first[k], second[k]]) for k in first}


# Groups of more sequences, of at most so many sites, take their sums from site counts, in blocks.
MOMENT_ROWS = 1 << 12
MOMENT_SITES = 128
MOMENT_BLOCK = 1 << 16
MOMENT_STEP = 1 << 12


def _by_size(df: DataFrame, keys: Sequence[str], seq: str, mult: str | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of the groups whose sums come from pairs, rows of the others and, per such group, its
    rows, copies and squared copies (``_n, _t1, _t2``)."""
    m = (F.col(mult) if mult else F.lit(1)).cast("bigint")
    large = settle(df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(m).alias("_t1"), F.sum(m * m).alias("_t2"),
        F.min(F.length(seq)).alias("_short"), F.max(F.length(seq)).alias("_long"),
    ).filter((F.col("_n") > MOMENT_ROWS) & (F.col("_short") == F.col("_long")) & F.col("_long").between(1, MOMENT_SITES))
        .drop("_short", "_long"))
    if large.isEmpty():
        return df, None, None
    names = large.select(*keys)
    return df.join(names, list(keys), "left_anti"), df.join(names, list(keys), "left_semi"), large


def _apart(include_gaps: bool) -> np.ndarray:
    """What two codes (4-bit base masks, 0 unknown) at a site add to the distance."""
    code = np.arange(16)
    both = np.logical_and.outer(code != 0, code != 0) & (np.bitwise_and.outer(code, code) == 0)
    return (both | np.logical_xor.outer(code != 0, code != 0) if include_gaps else both).astype(np.float64)


def _site_products(masks: np.ndarray, copies: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies, and squared copies, of the rows with one of ``codes`` at one site and another at
    another: indexed by (site, code, site, code)."""
    width, kinds = masks.shape[1], len(codes)
    hot = np.zeros((16, kinds), np.float32)
    hot[codes, np.arange(kinds)] = 1
    one = np.zeros((width * kinds, width * kinds))
    more = [np.zeros_like(one), np.zeros_like(one)]
    for start in range(0, len(masks), MOMENT_STEP):
        x = hot[masks[start:start + MOMENT_STEP]].reshape(-1, width * kinds)
        m = copies[start:start + MOMENT_STEP].astype(np.float64)
        single = x[m == 1]
        one += single.T @ single  # numbers of rows of a step, exact in single precision
        if len(single) < len(x):
            many, m = x[m != 1].astype(np.float64), m[m != 1]
            for power, total in enumerate(more, 1):
                total += (many * m[:, None] ** power).T @ many
    return tuple((one + total).reshape(width, kinds, width, kinds) for total in more)


def _large_sums(rows: DataFrame, large: DataFrame, keys: Sequence[str], idx: str, seq: str, mult: str | None,
                include_gaps: bool) -> DataFrame:
    """``centre_sums`` without pairs. A distance is a sum over sites of what two codes add, so its
    sum and square over all others follow from how often codes, and codes of two sites, occur:
    work grows with the rows and the square of the sites, and is exact (whole numbers)."""
    names, apart = list(keys), _apart(include_gaps)
    useful = np.flatnonzero(apart.any(axis=1))
    shares = F.ceil(F.col("_n") / MOMENT_BLOCK)
    own = rows.join(large.select(*keys, "_n"), names).select(
        *keys, F.col(idx).cast("bigint").alias("_idx"), F.col(seq).alias("_seq"),
        (F.col(mult) if mult else F.lit(1)).cast("bigint").alias("_m"),
        F.pmod(F.xxhash64(F.col(idx).cast("bigint")), shares).cast("int").alias("_own"),
    )
    blocks = _gathered(spread(own, *keys, "_own"), *keys, "_own")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names)
    slab = "site int, codes binary, one binary, two binary"

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                _, ms, packed, width = _unpacked(row.ids, row.ms, row.sites, row.width)
                masks = _masks(packed, width)
                codes = np.intersect1d(masks, useful)
                one, two = (t.astype(np.int64) for t in _site_products(masks, ms, codes))
                out = {k: [row[i]] * width for i, k in enumerate(names)}
                yield pd.DataFrame(out | {
                    "site": range(width), "codes": [codes.astype(np.uint8).tobytes()] * width,
                    "one": [t.tobytes() for t in one], "two": [t.tobytes() for t in two],
                })

    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(c, np.uint8) for c in frame["codes"]]
        codes = np.unique(np.concatenate(held))
        out = {k: [v] for k, v in zip(names, key)} | {"site": [key[-1]], "codes": [codes.tobytes()]}
        for c in ("one", "two"):
            total = 0
            for mine, part in zip(held, frame[c]):
                if len(mine):
                    part = np.frombuffer(part, np.int64).reshape(len(mine), -1, len(mine))
                    at = np.searchsorted(codes, mine)
                    whole = np.zeros((len(codes), part.shape[1], len(codes)), np.int64)
                    whole[np.ix_(at, np.arange(part.shape[1]), at)] = part
                    total = total + whole
            out[c] = [total.tobytes() if len(codes) else b""]
        return pd.DataFrame(out)

    products = (
        blocks.mapInPandas(counted, f"{kinds}, {slab}").groupBy(*keys, "site").applyInPandas(merged, f"{kinds}, {slab}")
        .groupBy(*keys).agg(F.first("codes").alias("codes"), F.array_sort(F.collect_list(F.struct("site", "one", "two"))).alias("_r"))
        .join(large, names)
        .select(*keys, "codes", "_t1", "_t2", F.col("_r.one").alias("one"), F.col("_r.two").alias("two"),
                F.explode(F.sequence(F.lit(0), (shares - 1).cast("int"))).alias("_own"))
    )

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids, ms, packed, width = _unpacked(row.ids, row.ms, row.sites, row.width)
                codes = np.frombuffer(row.codes, np.uint8) if len(row.codes) else np.empty(0, np.uint8)
                size = width * len(codes)
                one, two = (np.frombuffer(b"".join(t), np.int64).astype(np.float64).reshape(size, size) if size
                            else np.zeros((0, 0)) for t in (row.one, row.two))
                reach, plain = apart[:, codes], np.array_equal(one, two)
                for start in range(0, len(ids), MOMENT_STEP):
                    mine = slice(start, start + MOMENT_STEP)
                    y = reach[_masks(packed[mine], width)].reshape(-1, size)
                    m = ms[mine].astype(np.float64)
                    first = [y @ np.diagonal(one), ((y @ one) * y).sum(axis=1)]
                    second = first if plain else [y @ np.diagonal(two), ((y @ two) * y).sum(axis=1)]
                    out = {k: [row[i]] * len(m) for i, k in enumerate(names)}
                    yield pd.DataFrame(out | {
                        "idx": ids[mine], "m": m, "s0": row.t1 - m, "s1": first[0], "s2": first[1],
                        "q0": row.t2 - m * m, "q1": second[0], "q2": second[1],
                    })

    joined = blocks.join(products, [*keys, "_own"])
    return joined.select(*keys, "ids", "ms", "sites", "width", "codes", "one", "two", F.col("_t1").alias("t1"), F.col("_t2").alias("t2")).mapInPandas(
        summed, f"{kinds}, idx bigint, m double, " + ", ".join(f"{c} double" for c in SUMS))


def pair_statistics(
    df: DataFrame, keys: Sequence[str] = KEYS, idx: str = "seq_idx", seq: str = "seq",
    mult: str | None = None, include_gaps: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``pair_histogram`` and ``centre_sums`` from one comparison of every tile and one
    aggregation: rows with ``centre`` hold ``idx, m`` and the sums, the others ``hd, n``.
    ``statistics_histogram`` and ``statistics_centres`` take them apart. ``df`` is read several times."""
    rest, rows, large = _by_size(df, keys, seq, mult)

    def per_tile(a: Block, b: Block, diag: bool) -> dict:
        differ, _, indel = _compare(a, b, include_gaps, False)
        d = _distance(differ, indel)
        hd, n, _ = _histogram(d, a, b, diag)
        own = _moments(d, a, b, diag)
        bins, rows = len(hd), len(own["idx"])
        none = np.zeros(bins)
        out = {
            "centre": np.repeat([False, True], [bins, rows]),
            "hd": np.concatenate([hd.astype(np.int32), np.zeros(rows, np.int32)]),
            "n": np.concatenate([n, np.zeros(rows, np.int64)]),
            "idx": np.concatenate([np.zeros(bins, np.int64), own["idx"]]),
        }
        return out | {c: np.concatenate([none, own[c]]) for c in ("m", *SUMS)}

    parts = _run(rest, keys, "centre boolean, hd int, n bigint, idx bigint, m double, " + ", ".join(f"{c} double" for c in SUMS),
                 per_tile, idx, seq, mult, block_rows,
                 merge=lambda found: _fold(found, ("centre", "hd", "idx"), ("n", *SUMS)))
    out = parts.groupBy(*keys, "centre", "hd", "idx").agg(
        F.sum("n").alias("n"), F.max("m").alias("m"), *[F.sum(c).alias(c) for c in SUMS]
    )
    if large is None:
        return out
    none = [F.lit(0.0).alias(c) for c in ("m", *SUMS)]
    bins = pair_histogram(rows, keys, idx, seq, mult, include_gaps, block_rows=block_rows).select(
        *keys, F.lit(False).alias("centre"), "hd", F.lit(0).cast("bigint").alias("idx"), "n", *none)
    sums = _large_sums(rows, large, keys, idx, seq, mult, include_gaps).select(
        *keys, F.lit(True).alias("centre"), F.lit(0).alias("hd"), "idx", F.lit(0).cast("bigint").alias("n"), "m", *SUMS)
    return out.unionByName(bins).unionByName(sums)


def statistics_histogram(stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return stats.filter(~F.col("centre")).select(*keys, "hd", "n")


def statistics_centres(stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return stats.filter("centre").select(*keys, "idx", "m", *SUMS)


def centre_sums(
    df: DataFrame, keys: Sequence[str] = KEYS, idx: str = "seq_idx", seq: str = "seq",
    mult: str | None = None, include_gaps: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per sequence: sums over all others of m, m*d, m*d^2 (s0..s2) and of m^2, m^2*d,
    m^2*d^2 (q0..q2), from which every pair and triple moment follows. Large groups take them
    from site counts in place of pairs."""
    df = settle(df.select(*keys, idx, seq, *([mult] if mult else [])))
    rest, rows, large = _by_size(df, keys, seq, mult)

    def per_tile(a: Block, b: Block, diag: bool) -> dict:
        differ, _, indel = _compare(a, b, include_gaps, False)
        return _moments(_distance(differ, indel), a, b, diag)

    parts = _run(rest, keys, "idx bigint, m double, " + ", ".join(f"{c} double" for c in SUMS), per_tile, idx, seq, mult, block_rows,
                 merge=lambda found: _fold(found, ("idx",), SUMS))
    out = parts.groupBy(*keys, "idx").agg(F.max("m").alias("m"), *[F.sum(c).alias(c) for c in SUMS])
    return out if large is None else out.unionByName(_large_sums(rows, large, keys, idx, seq, mult, include_gaps))


def nearest_pairs(
    df: DataFrame, keys: Sequence[str] = KEYS, idx: str = "seq_idx", seq: str = "seq",
    include_gaps: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Distance from each sequence to its nearest other one (lowest number on ties)."""

    def per_tile(a: Block, b: Block, diag: bool) -> dict:
        differ, _, indel = compare(a, b, include_gaps, False)
        d = _distance(differ, indel)
        if diag:
            np.fill_diagonal(d, np.iinfo(np.int32).max)
        if not a.n or not b.n or (diag and a.n < 2):
            return {"idx": np.empty(0, np.int64), "hd": np.empty(0, np.int32), "nearest": np.empty(0, np.int64)}
        j = d.argmin(1)
        out = {"idx": a.ids, "hd": d[np.arange(a.n), j], "nearest": b.ids[j]}
        if diag:
            return out
        i = d.argmin(0)
        return {
            "idx": np.concatenate([out["idx"], b.ids]),
            "hd": np.concatenate([out["hd"], d[i, np.arange(b.n)]]),
            "nearest": np.concatenate([out["nearest"], a.ids[i]]),
        }

    parts = _run(df, keys, "idx bigint, hd int, nearest bigint", per_tile, idx, seq, None, block_rows,
                 merge=lambda found: _fold(found, ("idx",), least=("hd", "nearest")))
    best = F.min(F.struct("hd", "nearest"))
    return parts.groupBy(*keys, "idx").agg(best.alias("_b")).select(
        *keys, "idx", F.col("_b.hd").alias("hd"), F.col("_b.nearest").alias("nearest")
    )


def near_vectors(df: DataFrame, max_distance: float, keys: Sequence[str], idx: str, vec: str = "embedding",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of feature vectors of a group at most ``max_distance`` apart (Euclidean),
    compared tile by tile like sequences."""
    rows = df.select(*keys, F.col(idx).cast("bigint").alias("_idx"), F.col(vec).cast("array<double>").alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    copies = (
        rows.join(sizes, list(keys))
        .withColumn("_own", F.pmod(F.xxhash64("_idx"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    )
    tiles = (
        spread(copies, *keys, "_lo", "_hi")
        .groupBy(*keys, "_lo", "_hi")
        .agg(F.collect_list(F.struct((F.col("_own") == F.col("_lo")).alias("lo"), F.col("_idx").alias("idx"), F.col("_v").alias("v"))).alias("_r"))
        .select(*keys, (F.col("_lo") == F.col("_hi")).alias("t_diag"), F.col("_r.lo").alias("t_in_lo"),
                F.col("_r.idx").alias("t_ids"), F.flatten("_r.v").alias("t_flat"))
    )
    names = list(keys)
    kinds = ", ".join(f"`{k}` {tiles.schema[k].dataType.simpleString()}" for k in names)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = np.asarray(row.t_ids, dtype=np.int64)
                values = np.asarray(row.t_flat, dtype=float).reshape(len(ids), -1)
                lo = np.ones(len(ids), bool) if row.t_diag else np.asarray(row.t_in_lo, dtype=bool)
                x, xi = values[lo], ids[lo]
                y, yi = (x, xi) if row.t_diag else (values[~lo], ids[~lo])
                hits = []
                for i in range(len(x)):  # one row against a block keeps the exact difference form
                    dist = np.sqrt(((y - x[i]) ** 2).sum(axis=1))
                    j = np.nonzero(dist <= max_distance)[0]
                    j = j[j > i] if row.t_diag else j
                    hits.append((np.full(len(j), xi[i]), yi[j], dist[j]))
                if hits:
                    a, b, dist = (np.concatenate(p) for p in zip(*hits))
                    out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": dist})
                    for k, c in enumerate(names):
                        out.insert(k, c, row[k])
                    yield out

    return tiles.mapInPandas(batches, f"{kinds}, a bigint, b bigint, distance double")


# --- one sequence against another, as column expressions -------------------------------

def bit_planes(seq: Column) -> Column:
    """Sequence as an array of words: per 64 sites a struct of the four base planes and
    the known plane."""
    codes = "".join(ab.MASK)

    def plane(word: Column, test: Callable[[int], bool]) -> Column:
        bits = "".join("1" if test(m) else "0" for m in ab.MASK.values())
        text = F.translate(F.lower(word), codes + "-?", bits + "00")
        return F.conv(F.lpad(text, 64, "0"), 2, -10).cast("bigint")

    words = F.regexp_extract_all(seq, F.lit("(?s).{1,63}"), F.lit(0))
    return F.transform(
        words,
        lambda w: F.struct(
            *[plane(w, lambda m, k=k: bool(m >> k & 1)).alias(ab.BASES[k]) for k in range(4)],
            plane(w, lambda m: m > 0).alias("known"),
        ),
    )


def plane_counts(x: Column, y: Column) -> Column:
    """struct(hd, compared, gap_difference) of two bit-plane arrays."""

    def word(p: Column, q: Column) -> Column:
        shared = (
            p["a"].bitwiseAND(q["a"]).bitwiseOR(p["c"].bitwiseAND(q["c"]))
            .bitwiseOR(p["g"].bitwiseAND(q["g"])).bitwiseOR(p["t"].bitwiseAND(q["t"]))
        )
        both = p["known"].bitwiseAND(q["known"])
        return F.struct(
            F.bit_count(both.bitwiseAND(F.bitwise_not(shared))).alias("hd"),
            F.bit_count(both).alias("compared"),
            F.bit_count(p["known"].bitwiseXOR(q["known"])).alias("gap_difference"),
        )

    zero = F.struct(F.lit(0).alias("hd"), F.lit(0).alias("compared"), F.lit(0).alias("gap_difference"))
    return F.aggregate(
        F.zip_with(x, y, word), zero,
        lambda acc, w: F.struct(*[(acc[f] + w[f]).alias(f) for f in ("hd", "compared", "gap_difference")]),
    )


def consensus_distance(
    df: DataFrame, consensus: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq",
    ref: str = "cons", include_gaps: bool = False,
) -> DataFrame:
    """Distance of each sequence to the consensus of its group. One consensus row per
    group, encoded once; the join is left to the optimizer, which splits hot groups."""
    encoded = consensus.select(*keys, bit_planes(F.col(ref)).alias("_ref"))
    c = F.col("_c")
    return (
        df.join(encoded, list(keys))
        .withColumn("_c", plane_counts(bit_planes(F.col(seq)), F.col("_ref")))
        .withColumn("hd", c["hd"] + c["gap_difference"] if include_gaps else c["hd"])
        .withColumn("compared", c["compared"])
        .drop("_c", "_ref")
    )


def effective_length(lengths: DataFrame, sample: Sequence[str] = KEYS, length: str = "len", n: str = "n") -> DataFrame:
    """Length of a sample fitted within clusters: mean of cluster widths weighted with
    their pair numbers."""
    pairs = F.col(n) * (F.col(n) - 1) / 2
    return lengths.groupBy(*sample).agg(
        F.try_divide(F.sum(F.col(length) * pairs), F.sum(pairs)).alias("nbases")
    )


def expand_multiplicity(hist: DataFrame, hd: str = "hd", n: str = "n") -> DataFrame:
    """Written-out form of weighted distances, for exchange only: the fits use weights."""
    return hist.filter(F.col(n) > 0).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n)))).drop("_i", n)
