"""K-mer expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rc(seq: Column) -> Column:
    """Reverse complement, case kept; letters other than ACGT stay as they are (an N stays N)."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(seq: Column) -> Column:
    """The alphabetically smaller of a sequence and its reverse complement."""
    return F.least(seq, rc(seq))


def clean_kmer(raw: Column, k: int = 31) -> Column:
    """Canonical form of a delivered k-mer, null where the value is no k-mer.

    Surrounding blanks (space, tab, carriage return) are removed and letters upper-cased.
    """
    text = F.upper(F.btrim(raw, F.lit(" \t\r")))
    return F.when(text.rlike(f"^[ACGT]{{{k}}}$") & (F.length(text) == k), canonical(text))


def pack(kmer: Column) -> Column:
    """An upper-case ACGT k-mer of at most 31 letters as a number of the same order."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(code: Column, k: int = 31) -> Column:
    """The k-mer of a number made by :func:`pack`."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")
