"""Column functions on nucleotide sequences."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.arrays import chunks, let
from strandline.functions.kernels import letters_around

#: Letters of nucleotides and sets of nucleotides, in the order of their codes, and their complements.
ALPHABET = "ACGTNWSMKRYBVDHZ"
COMPLEMENT = "TGCANWSKMYRVBHDZ"
#: The nucleotides each letter stands for.
SETS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
PROXIMITY = 10


def expand(motifs: str) -> list[str]:
    """All plain motifs that comma-separated motifs with set letters stand for."""
    return ["".join(p) for m in motifs.upper().split(",") if m.strip() for p in product(*(SETS[x] for x in m.strip()))]


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; unknown letters become N."""
    return F.translate(F.regexp_replace(F.reverse(F.upper(seq)), f"[^{ALPHABET}]", "N"), ALPHABET, COMPLEMENT)


#: Letters searched at once; longer sequences are cut into pieces of this size.
PIECE = 1024


def motif_sites(seq: Column, motifs: list[str], offset: int = 0) -> Column:
    """Places from 0 at which a motif begins, overlaps included, shifted by ``offset``; all motifs have one length.

    The sequence is cut into pieces that overlap by all but one letter of a motif, so the work follows its length.
    """
    found = F.transform(chunks(seq, PIECE, len(motifs[0]) - 1), lambda piece, k: F.transform(_sites_in_piece(piece, motifs), lambda i: i + k * PIECE + offset))
    short = _sites_in_piece(seq, motifs)
    return F.when(F.length(seq) <= PIECE, F.transform(short, lambda i: i + offset) if offset else short).otherwise(F.flatten(found))


def _sites_in_piece(piece: Column, motifs: list[str]) -> Column:
    """The places in a short sequence. It is split in front of every motif, so the work after that follows the sites, not the letters."""
    parts = F.split(piece, f"(?={'|'.join(motifs)})")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    starts = F.aggregate(parts, none, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    opens = F.substring(piece, 1, len(motifs[0])).isin(motifs)
    return F.when(opens, starts).otherwise(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))))


def codes(seq: Column) -> Column:
    """Code of each letter; -1 for letters without one."""
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def centre(seq: Column, length: int = 5) -> Column:
    """The letters in the middle of a k-mer."""
    middle, half = F.floor(F.length(seq) / 2), length // 2
    return F.substring(seq, (F.greatest(middle - half, F.lit(0)) + 1).cast("int"), F.lit(length))


def proximity(places: Column, reach: int = PROXIMITY) -> Column:
    """For each of sorted places 1 if another one lies within ``reach``, else 0: the nearest on either side tells."""

    def near(p: Column) -> Column:
        n = F.size(p)
        far = F.lit(reach + 1)
        gap = lambda i, j: F.when((i >= 0) & (j < n), F.get(p, j) - F.get(p, i)).otherwise(far)
        return F.transform(p, lambda _, i: (F.least(gap(i - 1, i), gap(i, i + 1)) <= reach).cast("int"))

    return let(places, near)


def gc_shares(seq: Column, motif: str = "CG", reach: int = 50) -> Column:
    """For each place of a motif the G and C letters from ``reach`` before it to ``reach`` behind it, out of 2 * reach whatever is there."""
    return letters_around(motif, "GC", reach)(seq)
