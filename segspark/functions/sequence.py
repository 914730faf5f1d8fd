"""DNA and codon expressions; all are built-in columns, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amino acids of the standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT, ...
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = [BASES[i // 16] + BASES[i // 4 % 4] + BASES[i % 4] for i, a in enumerate(AMINO_ACIDS) if a == "*"]
#: IUPAC letter of two different bases.
IUPAC = {"AT": "W", "CG": "S", "AC": "M", "GT": "K", "CT": "Y", "AG": "R"}


def _degeneracy() -> str:
    """Three digits for each codon: how many of the four bases keep the amino acid at each
    place (one: 0, two or three: 2, four: 4)."""
    at = lambda i, j, k: AMINO_ACIDS[16 * i + 4 * j + k]
    out = []
    for i in range(4):
        for j in range(4):
            for k in range(4):
                same = [sum(at(*c) == at(i, j, k) for c in cs) for cs in ([(x, j, k) for x in range(4)], [(i, x, k) for x in range(4)], [(i, j, x) for x in range(4)])]
                # Fixed value: the stop codon TAG counts as degenerate in the middle, too.
                out.append("022" if (i, j, k) == (0, 2, 3) else "".join("0224"[n - 1] for n in same))
    return "".join(out)


DEGENERACY = _degeneracy()


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTUacgtu", "TGCAATGCAA")


def revcomp_iupac(seq: Column) -> Column:
    """Reverse complement that also turns ambiguity letters."""
    return F.translate(F.reverse(seq), "ACTGactgMRVHmrvhKYBDkybd", "TGACtgacKYBDkybdMRVHmrvh")


def to_iupac(a: Column, b: Column) -> Column:
    """Ambiguity letter of two bases in either order; null for equal or other letters."""
    pair = F.concat(F.least(a, b), F.greatest(a, b))
    out = F.lit(None).cast("string")
    for bases, letter in IUPAC.items():
        out = F.when(pair == bases, F.lit(letter)).otherwise(out)
    return out


def _codon_index(codon: Column) -> Column:
    """0 to 63, or null if a letter is not one of the four bases."""
    place = [F.instr(F.lit(BASES), F.substr(codon, F.lit(i), F.lit(1))) for i in (1, 2, 3)]
    known = (F.length(codon) == 3) & (place[0] > 0) & (place[1] > 0) & (place[2] > 0)
    return F.when(known, 16 * place[0] + 4 * place[1] + place[2] - 21)


def translate_codon(codon: Column) -> Column:
    """Amino acid of a codon in capitals; ``X`` if it has another letter."""
    return F.coalesce(F.substr(F.lit(AMINO_ACIDS), _codon_index(codon) + 1, F.lit(1)), F.lit("X"))


def degeneracy(codon: Column, place: Column) -> Column:
    """Degeneracy of a codon at ``place`` (1 to 3); ``-`` if it has another letter."""
    return F.coalesce(F.substr(F.lit(DEGENERACY), 3 * _codon_index(codon) + place, F.lit(1)), F.lit("-"))


def codon_at(cds: Column, cds_pos: Column) -> Column:
    """The codon that holds 1-based ``cds_pos``, as it stands on the plus strand."""
    return F.substr(cds, (F.floor((cds_pos - 1) / 3) * 3 + 1).cast("int"), F.lit(3))


def replace_base(codon: Column, place: Column, base: Column) -> Column:
    return F.overlay(codon, base, place, F.lit(1))


def mark_base(codon: Column, place: Column) -> Column:
    """The codon in small letters but for the base at ``place``."""
    return F.overlay(F.lower(codon), F.substr(codon, place, F.lit(1)), place, F.lit(1))


def translate_cds(cds: Column) -> Column:
    """Protein of whole codons from the first base on.

    Codons get a mark at their end and are replaced one kind after another, which can only
    match where a mark is, so frames stay; all 64 replacements are plain string functions."""
    whole = F.substr(cds, F.lit(1), (F.floor(F.length(cds) / 3) * 3).cast("int"))
    out = F.regexp_replace(whole, "(?s)(...)", "$1,")
    for i, letter in enumerate(AMINO_ACIDS):
        out = F.replace(out, F.lit(BASES[i // 16] + BASES[i // 4 % 4] + BASES[i % 4] + ","), F.lit(letter))
    return F.regexp_replace(out, "(?s)...,", "X")


def masked_length(seq: Column, letter: str = "N") -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def clean_dna(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")
