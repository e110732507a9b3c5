"""Nucleotide sequence functions over string Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import let

#: Complements (IUPAC) and the standard genetic code, in TCAG order of the three bases.
_IUPAC, _COMPLEMENT = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def complement(s: Column) -> Column:
    return F.translate(s, _IUPAC, _COMPLEMENT)


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def transcribe(s: Column) -> Column:
    return F.translate(s, "Tt", "Uu")


def back_transcribe(s: Column) -> Column:
    return F.translate(s, "Uu", "Tt")


def gc_content(s: Column) -> Column:
    """Share of G and C among A, C, G, T and U."""
    return F.try_divide(F.regexp_count(s, F.lit("[GCgc]")), F.regexp_count(s, F.lit("[ACGTUacgtu]")))


def gc_skew(s: Column) -> Column:
    g, c = F.regexp_count(s, F.lit("[Gg]")), F.regexp_count(s, F.lit("[Cc]"))
    return F.try_divide(g - c, g + c)


def kmers(s: Column, k: int) -> Column:
    """Overlapping, in one pass over the text."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def canonical_kmers(s: Column, k: int) -> Column:
    return F.transform(kmers(s, k), lambda x: F.least(x, reverse_complement(x)))


def count_motif(s: Column, motif: str) -> Column:
    """Overlapping occurrences."""
    return F.regexp_count(s, F.lit(f"(?={motif})"))


def max_homopolymer(s: Column) -> Column:
    runs = F.regexp_extract_all(s, F.lit(r"(.)\1*"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def phred(q: Column, offset: int = 33) -> Column:
    return F.transform(F.filter(F.split(q, ""), lambda x: x != ""), lambda x: F.ascii(x) - offset)


def mean_quality(q: Column, offset: int = 33) -> Column:
    return let(phred(q, offset), lambda a: F.try_divide(F.aggregate(a, F.lit(0), lambda t, x: t + x), F.size(a)))


def expected_errors(q: Column, offset: int = 33) -> Column:
    return F.aggregate(phred(q, offset), F.lit(0.0), lambda t, x: t + F.pow(F.lit(10.0), -x / 10))


def translate(s: Column, frame: int = 0) -> Column:
    """Amino acids of the whole codons from a frame; X for one with an unknown base."""
    codons = F.regexp_extract_all(F.substring(F.upper(back_transcribe(s)), frame + 1, 2**31 - 1), F.lit("(?s).{3}"), F.lit(0))

    def amino(codon: Column) -> Column:
        codes = [F.position(F.substring(codon, j + 1, 1), F.lit("TCAG")) - 1 for j in range(3)]
        at = codes[0] * 16 + codes[1] * 4 + codes[2]
        known = (codes[0] >= 0) & (codes[1] >= 0) & (codes[2] >= 0)
        return F.when(known, F.substring(F.lit(_CODE), at + 1, F.lit(1))).otherwise("X")

    return F.array_join(F.transform(codons, amino), "")
