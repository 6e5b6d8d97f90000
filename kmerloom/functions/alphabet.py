"""Alphabets and letter-wise functions, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for any letter outside an alphabet that has none for them; no k-mer holds it.
BREAK = "#"


@dataclass(frozen=True)
class Alphabet:
    """unknown: the letter that others become (BREAK: they cut the sequence)."""

    name: str
    letters: str
    unknown: str
    fold_case: bool = True
    complement: tuple[str, str] | None = None
    uracil: bool = True

    def normalise(self, seq: Column | str) -> Column:
        """Only ASCII letters are folded; one code point stays one letter."""
        c = F.col(seq) if isinstance(seq, str) else seq
        if self.fold_case:
            c = F.translate(c, _LOWER, _UPPER)
        if self.uracil:
            c = F.translate(c, "Uu", "Tt")
        return F.regexp_replace(c, f"[^{self.letters}]", self.unknown)

    def reverse_complement(self, seq: Column | str) -> Column:
        if self.complement is None:
            raise ValueError(f"alphabet {self.name} has no complement")
        return F.reverse(F.translate(seq, *self.complement))


# Letters and complements of the alphabets.
DNA = Alphabet("dna", "ACGT", BREAK, complement=("ACGT", "TGCA"))
DNA5 = Alphabet("dna5", "ACGTN", "N", complement=("ACGT", "TGCA"))
DNA_CASE = Alphabet("dna_case", "ACGTNacgt", "N", fold_case=False, complement=("ACGTacgt", "tgcaTGCA"))
PROTEIN = Alphabet("protein", _UPPER, "X", uracil=False)
ALPHABETS = {a.name: a for a in (DNA, DNA5, DNA_CASE, PROTEIN)}

# IUPAC nucleotide codes and their complements.
_IUPAC = ("ACGTUMRWSYKVHDBN", "TGCAAKYWSRMBDHVN")


def revcomp(seq: Column | str) -> Column:
    """Reverse complement over IUPAC codes in either case; other characters stay."""
    return F.reverse(F.translate(seq, _IUPAC[0] + _IUPAC[0].lower(), _IUPAC[1] + _IUPAC[1].lower()))
