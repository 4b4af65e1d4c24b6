"""Nucleotide alphabet and genetic code as column expressions."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases meant by each nucleotide code.
IUPAC = {
    "a": "a", "c": "c", "g": "g", "t": "t",
    "r": "ag", "y": "ct", "k": "gt", "m": "ac", "s": "cg", "w": "at",
    "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt",
}

# Standard genetic code, codons in the order t, c, a, g.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

BASES = "acgt"
BIT = {b: 1 << i for i, b in enumerate(BASES)}
MASK = {code: sum(BIT[b] for b in bases) for code, bases in IUPAC.items()}


def codon_table() -> dict[str, str]:
    """The 64 unambiguous codons."""
    return {"".join(c): aa for c, aa in zip(product("tcag", repeat=3), GENETIC_CODE)}


def _resolve(masks: tuple[int, int, int], strict: bool) -> str:
    sets = [[b for b in BASES if BIT[b] & m] for m in masks]
    codes = codon_table()
    amino = {codes["".join(c)] for c in product(*sets)}
    if strict:
        return amino.pop() if all(len(s) == 1 for s in sets) else "-"
    if len(amino) == 1:
        return amino.pop()
    if amino and amino <= {"D", "N"}:
        return "B"
    if amino and amino <= {"E", "Q"}:
        return "Z"
    return "X"


@lru_cache(maxsize=2)
def _lookup(strict: bool) -> str:
    """Amino acid for each triple of 4-bit base masks, addressed by a 12-bit number."""
    return "".join(_resolve(m, strict) for m in product(range(16), repeat=3))


def _codon_address(codon: Column) -> Column:
    codes = "".join(MASK) + "-"
    digits = "".join(f"{m:X}" for m in MASK.values()) + "0"
    return F.conv(F.translate(codon, codes, digits), 16, 10).cast("int")


def amino_acid(codon: Column) -> Column:
    """``---`` gives ``-``; other gaps and missing trailing bases count as ``n``; a codon
    that stays ambiguous gives ``X`` (``B``, ``Z`` for the two named pairs)."""
    full = F.rpad(F.translate(codon, "-", "n"), 3, "n")
    table = F.split(F.lit(_lookup(False)), "")
    return F.when(F.translate(codon, "-", "") == "", "-").otherwise(
        F.get(table, _codon_address(full))
    )


def strict_amino_acid(codon: Column) -> Column:
    """Any gap or ambiguity in the codon gives ``-``."""
    table = F.split(F.lit(_lookup(True)), "")
    known = codon.rlike("^[acgt]{3}$")
    return F.when(known, F.get(table, _codon_address(codon))).otherwise("-")


def codons(seq: Column, whole_only: bool = False) -> Column:
    return F.regexp_extract_all(seq, F.lit("(?s).{3}" if whole_only else "(?s).{1,3}"), F.lit(0))


def chars(seq: Column) -> Column:
    return F.split(seq, "")


def ambiguity_map() -> Column:
    """code -> component bases, as a constant map column."""
    items: list[Column] = []
    for code, bases in IUPAC.items():
        items += [F.lit(code), F.array(*[F.lit(b) for b in bases])]
    return F.create_map(*items)
