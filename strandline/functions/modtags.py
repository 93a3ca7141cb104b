"""Base-modification tags of reads: which Cs are called, and how surely."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.kernels import gaps_between, places_after_gaps


def skips(seq: Column, places: Column) -> Column:
    """Cs between one called C and the next; null if some place is not a C. ``places`` are sorted, from 0."""
    return gaps_between("C")(seq, places)


def tag_of(skipped: Column) -> Column:
    """The MM tag of skips; empty without any, null for null."""
    return F.when(F.size(skipped) == 0, F.lit("")).otherwise(F.concat(F.lit("C+m?,"), F.array_join(F.transform(skipped, lambda x: x.cast("string")), ","), F.lit(";")))


def mm_tag(seq: Column, places: Column) -> Column:
    """The MM tag; null if a place is not a C, empty without places."""
    return tag_of(skips(seq, places))


def ml_tag(probabilities: Column) -> Column:
    """Probabilities as bytes."""
    return F.transform(probabilities, lambda p: F.least(F.lit(255), F.floor(p * 256).cast("int")))


def called_places(seq: Column, mm: Column) -> Column:
    """The places an MM tag names; null if it names more Cs than there are."""
    return places_after_gaps("C")(seq, F.regexp_extract(mm, r"^C\+m\?,([\d,]*);", 1))
