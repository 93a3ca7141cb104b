"""Alignments of BAM files as a Spark data source.

A BAM file is a row of gzip members; its records follow each other across members, so a file is one partition and
is read as a stream. The scan gives the fields that the operators use, among them the move table.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Letters of the four-bit sequence code, CIGAR letters, and sizes of array elements.
SEQ_LETTERS = "=ACMGRSVTWYHKDBN"
CIGAR_LETTERS = "MIDNSHP=XB"
ELEMENTS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

SCHEMA = "read_id string, parent_id string, flag int, ref_name string, ref_start bigint, mapq int, cigar string, seq string, stride int, moves array<int>, ts int, sp int, nm int"


def parse_tags(data: bytes) -> dict[str, object]:
    """The optional fields of a record."""
    tags: dict[str, object] = {}
    at = 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            tags[name], at = chr(data[at]), at + 1
        elif kind in ELEMENTS:
            size = struct.calcsize("<" + ELEMENTS[kind])
            tags[name], at = struct.unpack_from("<" + ELEMENTS[kind], data, at)[0], at + size
        elif kind in "ZH":
            end = data.index(0, at)
            tags[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            code, n = ELEMENTS[chr(data[at])], struct.unpack_from("<I", data, at + 1)[0]
            tags[name] = list(struct.unpack_from(f"<{n}{code}", data, at + 5))
            at += 5 + n * struct.calcsize("<" + code)
        else:
            raise ValueError(f"unknown tag type {kind}")
    return tags


def parse_record(data: bytes, names: list[str]) -> tuple:
    """One alignment record, without its length, as a row of :data:`SCHEMA`."""
    ref, pos, name_size, mapq, _, n_cigar, flag, length = struct.unpack_from("<iiBBHHHi", data, 0)
    at = 32
    name = data[at : at + name_size - 1].decode()
    at += name_size
    steps = struct.unpack_from(f"<{n_cigar}I", data, at)
    at += 4 * n_cigar
    packed = data[at : at + (length + 1) // 2]
    seq = "".join(SEQ_LETTERS[b >> 4] + SEQ_LETTERS[b & 15] for b in packed)[:length]
    tags = parse_tags(data[at + (length + 1) // 2 + length :])
    moves = tags.get("mv") or []
    cigar = "".join(f"{s >> 4}{CIGAR_LETTERS[s & 15]}" for s in steps)
    return (name, str(tags.get("pi") or name), flag, names[ref] if ref >= 0 else None, pos, mapq, cigar or None, seq, moves[0] if moves else None, moves[1:] or None, tags.get("ts"), tags.get("sp"), tags.get("NM"))


def read_bam(path: str) -> Iterator[tuple]:
    """The records of a file as rows of :data:`SCHEMA`."""
    with gzip.open(path, "rb") as file:
        if file.read(4) != b"BAM\1":
            raise ValueError(f"not a BAM file: {path}")
        file.read(struct.unpack("<i", file.read(4))[0])
        names = []
        for _ in range(struct.unpack("<i", file.read(4))[0]):
            names.append(file.read(struct.unpack("<i", file.read(4))[0])[:-1].decode())
            file.read(4)
        while head := file.read(4):
            yield parse_record(file.read(struct.unpack("<i", head)[0]), names)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_bam(partition.path)


class BamSource(DataSource):
    """``spark.read.format("bam").option("paths", "a.bam,b.bam").load()``; the files must be reachable from the executors."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        paths = [p for p in (self.options.get("paths") or self.options.get("path") or "").split(",") if p]
        if not paths:
            raise ValueError("name the files in option paths")
        return _Reader(paths)
