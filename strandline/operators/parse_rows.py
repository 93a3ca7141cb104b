"""Loading delivered feature lines: typed rows where a line parses, the reason where it does not.

Records are assembled quote-aware: a line break inside an enclosed field belongs to the record. Each record is parsed
by Python's strict csv reader inside the tasks; structural errors are caught before any value is converted,
then typed constructors check the values. Reasons, first that applies:

* ``quoting``       a quote that does not belong to a field enclosed in quotes as a whole,
* ``column_count``  neither 13 nor 14 columns (an empty or null line has none),
* ``bad_value``     a list or a label that is not what its column needs.
"""

from __future__ import annotations

import csv
import math
import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.filters import contigs
from strandline.session import spread

BASES, PLACES = 21, 15
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
ENDS = " \t\r"
_ENCLOSED = re.compile(r'(?:"(?:[^"]|"")*+"|[^"\t]*+)(?:\t(?:"(?:[^"]|"")*+"|[^"\t]*+))*+')
_NUMBERS = {n: re.compile(rf"{NUMBER}(?:,{NUMBER}){{{n - 1}}}") for n in (BASES, PLACES)}
_MATRIX = re.compile(rf"{_NUMBERS[PLACES].pattern}(?:;{_NUMBERS[PLACES].pattern}){{{BASES - 1}}}")
_WHOLE = re.compile(rf"[0-9]+(?:,[0-9]+){{{BASES - 1}}}")
_INTEGER = re.compile(r"[+-]?[0-9]{1,18}")

PARSED = (
    "line_no bigint, file_name string, reason string, chrom string, pos bigint, strand string, pos_in_strand string, readname string, read_loc string, k_mer string, "
    "signal_means array<double>, signal_stds array<double>, signal_lens array<int>, raw_signals array<array<double>>, methy_label int, tag int, gc_content double"
)
_NESTED = pa.list_(pa.list_(pa.float64()))
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), _NESTED, pa.int32(), pa.int32(), pa.float64()]
_NAMES = [part.split()[0] for part in PARSED.split(", ")]


class RowError(ValueError):
    """A line that fails; its text is the reason."""


def split_record(text: str | None) -> list[str]:
    """The fields of one record, or a :class:`RowError` for its structure."""
    line = (text or "").strip(ENDS)
    if not line:
        raise RowError("column_count")
    if '"' not in line:
        fields = line.split("\t") if "\n" in line or "\r" in line else next(csv.reader([line], delimiter="\t", strict=True))
    else:
        try:
            records = list(csv.reader([line], delimiter="\t", strict=True))
        except csv.Error as error:
            if "new-line" not in str(error):
                raise RowError("quoting") from None
            records = []
        if not _ENCLOSED.fullmatch(line):  # the reader lets a quote inside a bare field pass
            raise RowError("quoting")
        fields = records[0] if len(records) == 1 else [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in re.findall(r'"(?:[^"]|"")*+"|[^"\t]++|(?<=\t)(?=\t)|^(?=\t)|(?<=\t)$', line)]
    if len(fields) not in (13, 14):
        raise RowError("column_count")
    return fields


def _floats(text: str, pattern: re.Pattern) -> list[float]:
    if not pattern.fullmatch(text):
        raise RowError("bad_value")
    values = list(map(float, text.split(",")))
    if not all(map(math.isfinite, values)):
        raise RowError("bad_value")
    return values


def _whole(text: str) -> int | None:
    """A whole number, or null where the column's rules do not judge it."""
    return int(text) if _INTEGER.fullmatch(text) else None


def typed_row(fields: list[str]) -> tuple:
    """The typed values of a record, or a :class:`RowError` for a value. Lengths beyond 32 bits come out null."""
    means, stds = (_floats(fields[i], _NUMBERS[BASES]) for i in (7, 8))
    if not _WHOLE.fullmatch(fields[9]):
        raise RowError("bad_value")
    lens = [int(x) if len(x) < 300 and int(x) < 2**31 else None for x in fields[9].split(",")]
    if not _MATRIX.fullmatch(fields[10]):
        raise RowError("bad_value")
    raw = [list(map(float, row.split(","))) for row in fields[10].split(";")]
    if not all(math.isfinite(x) for row in raw for x in row):
        raise RowError("bad_value")
    if fields[11] not in ("0", "1") or fields[12] not in ("0", "1"):
        raise RowError("bad_value")
    content = float(fields[13]) if len(fields) == 14 and re.fullmatch(NUMBER, fields[13]) else None
    return (fields[0], _whole(fields[1]), *fields[2:7], means, stds, lens, raw, int(fields[11]), int(fields[12]), content)


def parse_lines(lines: DataFrame, values: bool = True) -> DataFrame:
    """Each line with its typed values, or with the ``reason`` why it fails and nulls for values.

    Needs ``line_no``, ``file_name``, ``line_text``; other columns are ignored. A null or blank line fails by
    ``column_count``. Values outside the judged columns that cannot be typed come out null. ``values=False`` leaves the
    values out (the checks are the same), for jobs that only want the reasons.
    """
    blank = (None,) * 14

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                out = []
                for number, name, text in zip(*(batch.column(c).to_pylist() for c in ("line_no", "file_name", "line_text"))):
                    try:
                        row, reason = typed_row(split_record(text)), None
                    except RowError as error:
                        row, reason = blank, str(error)
                    out.append((number, name, reason, *(row if values else blank)))
                columns = list(zip(*out)) if out else [[]] * len(_TYPES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    return spread(lines.select("line_no", "file_name", "line_text")).mapInArrow(parse, PARSED)


def valid_rows(lines: DataFrame) -> DataFrame:
    """The typed rows of the lines that parse."""
    return parse_lines(lines).where("reason is null").drop("reason")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """``line_no, reason`` of the lines that fail."""
    return parse_lines(lines, values=False).where("reason is not null").select("line_no", "reason")


def reject_counts(lines: DataFrame) -> DataFrame:
    """Lines and rejects by file and reason, as a report of a load; ``reason`` is null for lines that parse."""
    return parse_lines(lines, values=False).groupBy("file_name", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def scoring_rows(lines: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Feature rows for scoring, by Spark's own columns: lines with at least twelve columns, of chosen contigs; labels are not needed.

    Elements of arrays that are no numbers come out null; other lines are left out.
    """
    cut = F.split(F.regexp_replace("line_text", r"\s+$", ""), "\t")
    numbers = lambda c: F.transform(F.split(c, ","), lambda x: x.try_cast("double"))
    rows = lines.select("line_no", cut.alias("c")).where((F.size("c") >= 12) & (F.coalesce(F.length(F.get("c", F.lit(0))), F.lit(0)) > 0))
    column = lambda i: F.get("c", F.lit(i))
    typed = rows.select(
        "line_no", column(0).alias("chrom"), column(1).try_cast("bigint").alias("pos"), column(2).alias("strand"), column(3).alias("pos_in_strand"), column(4).alias("readname"), column(5).alias("read_loc"), column(6).alias("k_mer"),
        numbers(column(7)).alias("signal_means"), numbers(column(8)).alias("signal_stds"), F.transform(numbers(column(9)), lambda x: x.try_cast("int")).alias("signal_lens"), F.transform(F.split(column(10), ";"), numbers).alias("raw_signals"),
    )
    return contigs(typed, include, exclude)


def with_repeated_values(rows: DataFrame, single: bool = False) -> DataFrame:
    """Adds ``tags`` and ``gc_contents``: tag and GC content once per base, or as arrays of one element."""
    repeated = lambda c: F.when(F.col(c).isNotNull(), F.array(c) if single else F.array_repeat(F.col(c), F.size("signal_lens")))
    return rows.withColumns({"tags": repeated("tag"), "gc_contents": repeated("gc_content")})
