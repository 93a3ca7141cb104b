"""Column functions on CIGAR strings: where the letters of a read lie on the reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.arrays import let, prefix_sums

#: CIGAR letters in the order of their codes.
LETTERS = "MIDNSHP=XB"


def parsed(cigar: Column) -> Column:
    """``op, len`` of each step."""
    number, letter = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=XB])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=XB])"), F.lit(2))
    return F.zip_with(number, letter, lambda n, c: F.struct((F.instr(F.lit(LETTERS), c) - 1).alias("op"), n.cast("int").alias("len")))


def stretches(cigar: Column, reverse: Column) -> Column:
    """``q, r, len, kind`` of each step along the aligned part of the read, in the read's direction: kind 0 lies on the
    reference, 1 is inserted, 2 is deleted. Clips and pads are left out; a reverse read walks the steps backwards."""
    kept = F.filter(parsed(cigar), lambda s: s["op"].isin(0, 1, 2, 3, 7, 8))
    kind = lambda s: F.when(s["op"] == 1, 1).when(s["op"].isin(2, 3), 2).otherwise(0)

    def placed(steps: Column) -> Column:
        q = prefix_sums(F.transform(steps, lambda s: F.when(kind(s) == 2, 0).otherwise(s["len"]).cast("bigint")))
        r = prefix_sums(F.transform(steps, lambda s: F.when(kind(s) == 1, 0).otherwise(s["len"]).cast("bigint")))
        both = F.zip_with(q, r, lambda x, y: F.struct(x.cast("int").alias("q"), y.cast("int").alias("r")))
        return F.zip_with(steps, both, lambda s, at: F.struct(at["q"].alias("q"), at["r"].alias("r"), s["len"].alias("len"), kind(s).alias("kind")))

    return let(F.when(reverse, F.reverse(kept)).otherwise(kept), placed)


def query_to_reference(cigar: Column, reverse: Column) -> Column:
    """For each aligned letter of the read its place on the reference from 0, -1 if inserted; then the place behind the last."""
    return let(stretches(cigar, reverse), places_of)


def places_of(done: Column) -> Column:
    """The same from :func:`stretches`."""
    kept = F.filter(done, lambda s: (s["kind"] != 2) & (s["len"] > 0))
    last = F.element_at(done, -1)
    end = last["r"] + F.when(last["kind"] == 1, 0).otherwise(last["len"])
    each = F.flatten(F.transform(kept, lambda s: F.when(s["kind"] == 1, F.array_repeat(F.lit(-1), s["len"])).otherwise(F.sequence(s["r"], s["r"] + s["len"] - 1))))
    return F.when(F.size(done) > 0, F.concat(each, F.array(end))).otherwise(F.array(F.lit(0)))


def reference_to_query(cigar: Column, reverse: Column) -> Column:
    """For each letter of the reference its place in the read; deleted ones repeat the place that comes next."""
    return let(stretches(cigar, reverse), places_back)


def places_back(done: Column) -> Column:
    """The same from :func:`stretches`."""
    kept = F.filter(done, lambda s: (s["kind"] != 1) & (s["len"] > 0))
    return F.flatten(F.transform(kept, lambda s: F.when(s["kind"] == 2, F.array_repeat(s["q"], s["len"])).otherwise(F.sequence(s["q"], s["q"] + s["len"] - 1))))


def _sum(steps: Column, ops: list[int]) -> Column:
    return F.aggregate(F.filter(steps, lambda s: s["op"].isin(ops)), F.lit(0), lambda a, s: a + s["len"])


def reference_length(cigar: Column) -> Column:
    return _sum(parsed(cigar), [0, 2, 3, 7, 8])


def aligned_length(cigar: Column) -> Column:
    """Letters of the read inside the alignment."""
    return _sum(parsed(cigar), [0, 1, 7, 8])


def identity(cigar: Column) -> Column:
    """Matches out of all steps but clips."""
    steps = parsed(cigar)
    return F.try_divide(_sum(steps, [0, 7]), _sum(steps, [0, 1, 2, 3, 6, 7, 8, 9]))
