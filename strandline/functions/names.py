"""Keys for names that are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_key(name: Column) -> Column:
    """One key for all spellings of a read name.

    Spellings differ in letter case, blanks around, a leading ``@`` or text after the name.
    Null, empty, blank and ``.`` name nothing: the key is null.
    """
    word = F.lower(F.regexp_extract(name, r"^\s*@?\s*([^\s@]\S*)", 1))
    return F.when(~word.isin("", "."), word)


def folded(name: Column) -> Column:
    """Lower case without blanks around; null for null, empty, blank and ``.``."""
    word = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    return F.when(~word.isin("", "."), word)


def contig_lookup(contigs: DataFrame, aliases: DataFrame) -> DataFrame:
    """``spelling -> contig``: the contigs themselves in lower case, and their other names.

    A name of a contig wins over an equal alias of another one; of several aliases the smallest contig holds.
    """
    own = contigs.select(folded(F.col("contig")).alias("spelling"), F.col("contig").alias("contig_key"), F.lit(0).alias("rank"))
    other = aliases.select(folded(F.col("alias_name")).alias("spelling"), F.col("contig").alias("contig_key"), F.lit(1).alias("rank"))
    return own.unionByName(other).where("spelling is not null and contig_key is not null").groupBy("spelling").agg(F.min_by("contig_key", F.struct("rank", "contig_key")).alias("contig_key"))


def read_strand(subgroup: Column) -> Column:
    """``t`` for the template strand, else ``c``, from the name of a basecall group."""
    return F.when(subgroup.endswith("template"), "t").otherwise("c")
