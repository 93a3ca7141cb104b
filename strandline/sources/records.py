"""Lines of text files with their numbers, and records assembled over line breaks inside enclosed fields.

A file is read in blocks, as Spark splits it. A first pass tells of each block how many lines it has and, for either state in
which it may begin (between records, or inside a field enclosed in quotes), in which state it ends. Prefix windows over the blocks of a
file (one row a block) give the true states; a second pass then cuts records in every block, and only the pieces of
records that cross a border of blocks are shuffled.

An enclosed field left open goes on in the next lines until a quote ends it. If what follows that quote is no field's end, or the file ends
first, the opening line was damaged: its lines stand alone, and assembly starts anew at the line that broke it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from enum import IntEnum

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import maybe_broadcast
from strandline.sources.files import existing

ENDS = " \t\r"
_FIELD = r'(?:"(?:[^"]|"")*+"|[^"\t]*+)'
_OPENS = re.compile(rf'(?:{_FIELD}\t)*+"(?:[^"]|"")*+')
_WHOLE = re.compile(rf"{_FIELD}(?:\t{_FIELD})*+")
_INSIDE = re.compile(r'(?:[^"]|"")*+')


class After(IntEnum):
    """What becomes of an open field in a line."""

    OPEN, CLOSED, BROKEN = 0, 1, 2


def opens(line: str) -> bool:
    """Whether a line that begins a record ends inside an enclosed field."""
    return '"' in line and _OPENS.fullmatch(line.lstrip(ENDS)) is not None


def after_open(line: str) -> After:
    """What becomes in this line of a field left open by the lines before."""
    end = _INSIDE.match(line).end()
    if end == len(line):
        return After.OPEN
    rest = line[end + 1 :]
    if not rest.strip(ENDS):
        return After.CLOSED
    if rest[0] != "\t":
        return After.BROKEN
    if _WHOLE.fullmatch(rest[1:].rstrip(ENDS)):
        return After.CLOSED
    return After.OPEN if _OPENS.fullmatch(rest[1:]) else After.BROKEN


def _raw(spark: SparkSession, paths: list[str], name_part: str) -> DataFrame:
    """``file_name, block, id, value``: lines in the order of their block; ids only tell the order inside a block."""
    reader = spark.read.option("lineSep", "\n")
    reader = reader.option("pathGlobFilter", f"*{name_part}*") if name_part else reader
    return reader.text(existing(spark, paths)).select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Each batch cut where the block changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        name, block = batch.column("file_name"), batch.column("block")
        new = pc.or_(pc.not_equal(block.slice(1), block.slice(0, len(block) - 1)), pc.not_equal(name.slice(1), name.slice(0, len(name) - 1)))
        starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield name[a].as_py(), block[a].as_py(), batch.slice(a, b - a)


_BLOCKS = "file_name string, block bigint, n_lines bigint, first_id bigint, end_bare boolean, end_open boolean, through boolean, resolved int"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block; only lines with a quote are looked at."""
    held: dict | None = None

    def row(x: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([x], schema=_SCHEMA)

    for name, block, part in _runs(batches):
        if held is None or (held["file_name"], held["block"]) != (name, block):
            if held is not None:
                yield row(held)
            held = {"file_name": name, "block": block, "n_lines": 0, "first_id": part.column("id")[0].as_py(), "end_bare": False, "end_open": True, "through": True, "resolved": None}
        held["n_lines"] += part.num_rows
        values = part.column("value")
        for i in np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)):
            line = values[int(i)].as_py()
            begins, goes = opens(line), after_open(line)
            for state in ("end_bare", "end_open"):
                held[state] = (goes == After.OPEN or (goes == After.BROKEN and begins)) if held[state] else begins
            if held["through"] and goes != After.OPEN:
                held["through"], held["resolved"] = False, int(goes)
    if held is not None:
        yield row(held)


_SCHEMA = pa.schema([("file_name", pa.string()), ("block", pa.int64()), ("n_lines", pa.int64()), ("first_id", pa.int64()), ("end_bare", pa.bool_()), ("end_open", pa.bool_()), ("through", pa.bool_()), ("resolved", pa.int32())])


def _states(blocks: DataFrame) -> DataFrame:
    """Adds ``base`` (lines before the block), ``start_open``, ``chain`` (the block in which the open record began) and ``outcome`` (what becomes of a record open at the block's end)."""
    everywhere = Window.orderBy("file_name", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block of input
    ordered = Window.partitionBy("file_name").orderBy("block")
    before, behind = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    swaps = (F.col("end_bare") & ~F.col("end_open")).cast("int")
    fixed = F.when(F.col("end_bare") == F.col("end_open"), F.struct(F.col("end_bare").alias("state"), "swapped"))
    counted = blocks.withColumn("base", F.coalesce(F.sum("n_lines").over(everywhere), F.lit(0))).withColumn("swapped", F.sum(swaps).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    last = counted.withColumn("last", F.last(fixed, ignorenulls=True).over(before)).withColumn("upto", F.coalesce(F.lag("swapped").over(ordered), F.lit(0)))
    odd = F.pmod(F.col("upto") - F.coalesce(F.col("last.swapped"), F.lit(0)), F.lit(2)) == 1
    known = last.withColumn("start_open", F.coalesce(F.col("last.state"), F.lit(False)) != odd)
    own = F.when(~(F.col("start_open") & F.col("through")), F.col("block"))
    resolution = F.when(~F.col("through"), F.col("resolved"))
    known = known.withColumn("chain", F.last(own, ignorenulls=True).over(before)).withColumn("outcome", F.coalesce(F.first(resolution, ignorenulls=True).over(behind), F.lit(int(After.BROKEN))))
    return known.withColumn("ends_open", F.when(F.col("start_open"), F.col("end_open")).otherwise(F.col("end_bare")))


def numbered_lines(spark: SparkSession, paths: list[str], name_part: str = "") -> DataFrame:
    """``line_no, file_name, value``: lines numbered from 0 in the order of file names and lines, over all files.

    Blocks are counted first; a line's number is the lines of the blocks before it and its place in its own.
    """
    raw = _raw(spark, paths, name_part)
    counts = raw.groupBy("file_name", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.min("id").alias("first_id"))
    before = Window.orderBy("file_name", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block of input
    bases = counts.select("file_name", "block", "first_id", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("base"))
    return raw.join(maybe_broadcast(bases), ["file_name", "block"]).select((F.col("base") + F.col("id") - F.col("first_id")).alias("line_no"), "file_name", "value")


_PIECES = "file_name string, chain bigint, block bigint, line_no bigint, lines array<string>"
_PIECE_SCHEMA = pa.schema([("file_name", pa.string()), ("chain", pa.int64()), ("block", pa.int64()), ("line_no", pa.int64()), ("lines", pa.list_(pa.string()))])


class _Cutter:
    """Cuts the records of one block; ``chain`` is null for whole records, else the key of a record that crosses a border."""

    def __init__(self, name: str, block: int, first: dict) -> None:
        self.name, self.block, self.number = name, block, first["base"]
        self.outcome, self.chain = first["outcome"], first["chain"] if first["start_open"] else None
        self.joins_on = first["ends_open"] and first["outcome"] == After.CLOSED
        # a head that a later quote breaks stands alone, line by line
        closes = first["resolved"] == After.CLOSED if not first["through"] else first["outcome"] == After.CLOSED
        self.held: list[str] | None = [] if first["start_open"] and closes else None
        self.loose = first["start_open"] and not closes
        self.start = self.number
        self.out: list[tuple] = []

    def _emit(self, lines: list[str], at: int, chain: int | None = None) -> None:
        self.out.append((self.name, chain, self.block, at, lines))

    def _alone(self) -> None:
        for i, line in enumerate(self.held or ()):
            self._emit([line], self.start + i)
        self.held = None

    def add(self, line: str) -> None:
        goes = after_open(line) if (self.held is not None or self.loose) and '"' in line else After.OPEN
        if self.loose and goes != After.OPEN:
            self.loose = False
        if self.held is not None:
            if goes == After.BROKEN:
                self._alone()
            else:
                self.held.append(line)
                if goes == After.CLOSED:
                    self._emit(self.held, self.start, self.chain)
                    self.held, self.chain = None, None
                self.number += 1
                return
        if self.loose:
            self._emit([line], self.number)
        elif opens(line):
            self.held, self.start, self.chain = [line], self.number, None
        else:
            self._emit([line], self.number)
        self.number += 1

    def close(self) -> None:
        if self.held is None:
            return
        if self.joins_on:
            self._emit(self.held, self.start, self.block if self.chain is None else self.chain)
            self.held = None
        else:
            self._alone()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter: _Cutter | None = None

    def taken(c: _Cutter) -> pa.RecordBatch:
        rows, c.out = c.out, []
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)

    for name, block, part in _runs(batches):
        if cutter is None or (cutter.name, cutter.block) != (name, block):
            if cutter is not None:
                cutter.close()
                yield taken(cutter)
            cutter = _Cutter(name, block, {k: part.column(k)[0].as_py() for k in ("base", "outcome", "chain", "start_open", "ends_open", "resolved", "through")})
        for line in part.column("value").to_pylist():
            cutter.add(line)
        yield taken(cutter)
    if cutter is not None:
        cutter.close()
        yield taken(cutter)


def records(spark: SparkSession, paths: list[str], name_part: str = "") -> DataFrame:
    """``line_no, file_name, line_text``: records of text files, line breaks inside enclosed fields kept; the number is that of the record's first line.

    Files are read twice. Records inside a block are cut where they are read; pieces of records over a border meet by
    file and first block. A record has to fit one cell, as every value has; lines of a damaged record never meet. Empty files have no records.
    """
    raw = _raw(spark, paths, name_part)
    blocks = _states(raw.mapInArrow(_summaries, _BLOCKS))
    known = blocks.select("file_name", "block", "base", "start_open", "ends_open", "chain", "outcome", "resolved", "through")
    # one row per block of input (some 128 MB): a broadcast keeps the lines in their order
    pieces = raw.join(F.broadcast(known), ["file_name", "block"]).mapInArrow(_cut, _PIECES)
    whole = pieces.where("chain is null").select("line_no", "file_name", F.array_join("lines", "\n").alias("line_text"))
    crossing = pieces.where("chain is not null").groupBy("file_name", "chain").agg(F.min("line_no").alias("line_no"), F.sort_array(F.collect_list(F.struct("block", "lines"))).alias("parts"))
    joined = crossing.select("line_no", "file_name", F.array_join(F.flatten(F.transform("parts", lambda x: x["lines"])), "\n").alias("line_text"))
    return whole.unionByName(joined)
