"""Schemas of the domain's files and tables."""

from __future__ import annotations

CALLS = "chrom string, pos bigint, strand string, pos_in_strand bigint, readname string, read_loc string, prob_0 double, prob_1 double, called_label int, k_mer string"
FEATURES = (
    "chrom string, pos bigint, strand string, pos_in_strand string, readname string, read_loc string, k_mer string, signal_means array<double>, signal_stds array<double>, "
    "signal_lens array<int>, raw_signals array<array<double>>, methy_label int, tag int, gc_content double"
)
POSITIONS = "chrom string, pos bigint, strand string"
REFERENCE = "contig string, seq string, length int"
SIGNALS = "read_id string, signal array<double>"
ALIGNMENTS = "read_id string, parent_id string, flag int, ref_name string, ref_start bigint, mapq int, cigar string, seq string, stride int, moves array<int>, ts int, sp int, nm int"
