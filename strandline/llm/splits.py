"""Splits that keep related rows together.

Rows share a group if they share a read or a contig, also by way of other rows. Groups are the trees of a spanning
forest of the graph of reads and contigs, built by contraction along minimum edges (Boruvka): in each round every
component takes its least edge to another one, the chosen edges join the forest, chains of chosen edges are
shortened by pointer jumping, and edges are relabelled, cleared of loops and deduplicated. The number of
components at least halves each round. The forest is a table in the shared folder, written round by round.

Roots are then stratified by size band and dealt systematically to the splits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.functions.names import contig_lookup, folded, read_key
from strandline.operators.ranks import hash_bucket
from strandline.operators.skew import Side, side, split_join
from strandline.session import cut, ensure_checkpoint_dir

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
MAX_ROUNDS = 64
#: Cells of a size band, in which neighbours in hash order are dealt together.
CELLS = 1024


@dataclass(frozen=True)
class Forest:
    """``edges``: the edges (u, v) of the spanning forest with the round that chose them; ``labels``: node, root.

    ``path`` is the folder of both tables (``edges``, ``parents`` by round); they stay there until someone removes it.
    """

    edges: DataFrame
    labels: DataFrame
    path: str


def _relabel(frame: DataFrame, column: str, parents: Side) -> DataFrame:
    """The column with each label replaced by its root, if it has one."""
    named = parents.select(F.col("label").alias(column), "parent")
    return split_join(frame, named, column, "left").withColumn(column, F.coalesce("parent", column)).drop("parent")


def _jumped(parents: DataFrame, known: Side) -> Side:
    """Parents followed to the root; each pass halves the depth of all chains and ends by counting those that moved.

    ``known`` holds the same rows as the frame.
    """
    while True:
        further = known.select(F.col("label").alias("parent"), F.col("parent").alias("next"))
        moved = split_join(parents, further, "parent", "left").select("label", F.coalesce("next", "parent").alias("parent"), (F.col("next") != F.col("parent")).alias("changed"))
        seen = Observation()
        parents = cut(moved.observe(seen, F.count_if("changed").alias("n"))).select("label", "parent")
        known = Side(parents, known.small)  # as many rows, whose labels are as long
        if not seen.get["n"]:
            return known


def spanning_forest(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> Forest:
    """The spanning forest of a graph: ``nodes(node)``, ``edges(u, v)``; loops and repeated edges are allowed.

    Nodes without edges are their own roots. Null ends connect nothing. ``path`` is the folder of the forest's tables; without one
    it is a new folder beside the checkpoints, which all executors share.
    """
    spark = nodes.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    labels = nodes.where("node is not null").select("node", F.col("node").alias("root")).distinct()
    ends = edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    live = cut(ends.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct(F.xxhash64("u", "v").alias("w"), "u", "v").alias("edge")))
    rounds = 0
    while not live.isEmpty():
        if rounds == MAX_ROUNDS:
            raise RuntimeError("the forest is not complete")
        ways = F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("b").alias("other")), F.struct(F.col("b").alias("label"), F.col("a").alias("other")))).alias("x")
        least = cut(live.select("edge", ways).select("x.label", "x.other", "edge").groupBy("label").agg(F.min(F.struct("edge", "other")).alias("x")).select("label", "x.edge", F.col("x.other").alias("parent")))
        least.select("edge.u", "edge.v").distinct().write.parquet(f"{path}/edges/round={rounds}")
        # two components that chose the same edge would point at each other: the smaller label stays root
        other = side(least.select(F.col("label").alias("parent"), F.col("edge").alias("back")), ready=True)
        hooked = split_join(least, other, "parent", "left").select("label", F.when((F.col("back") == F.col("edge")) & (F.col("label") < F.col("parent")), F.col("label")).otherwise(F.col("parent")).alias("parent"))
        hooked = cut(hooked)
        parents = _jumped(hooked, Side(hooked, other.small))
        parents.frame.write.parquet(f"{path}/parents/round={rounds}")
        labels = _relabel(labels, "root", parents)
        moved = _relabel(_relabel(live, "a", parents), "b", parents).where("a <> b")
        live = cut(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("edge").alias("edge")))
        rounds += 1
    if rounds:
        chosen = spark.read.parquet(f"{path}/edges").select("u", "v", F.col("round").cast("int").alias("round"))
    else:
        chosen = ends.select("u", "v", F.lit(0).alias("round")).limit(0)
    return Forest(chosen, cut(labels), path)


def _keyed(features: DataFrame, contigs: DataFrame, aliases: DataFrame) -> DataFrame:
    """``row_id, r, c``: the keys of read and contig, null where a name names nothing."""
    rows = features.select("row_id", read_key(F.col("readname")).alias("r"), folded(F.col("chrom")).alias("spelling"))
    found = split_join(rows, contig_lookup(contigs, aliases), "spelling", "left")
    return found.select("row_id", "r", F.coalesce("contig_key", "spelling").alias("c"))


def _node(kind: str, name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.concat(F.lit(kind), F.col(name)))


def related_groups(features: DataFrame, contigs: DataFrame, aliases: DataFrame, everything: bool = False) -> tuple[DataFrame, Forest]:
    """``row_id, group_key`` of each row that names a read or a contig, and the forest behind the groups.

    The key is the smallest contig of the group in byte order, or its smallest read name if it has no contig.
    Repeated rows keep their own row ids and share a group. A contig that is in no list stands for itself in lower case.
    ``everything`` keeps the other rows as well, with a null key.
    """
    rows = _keyed(features, contigs, aliases)
    links = cut(rows.select("r", "c").where("r is not null or c is not null").distinct())
    read, contig = _node("r", "r"), _node("c", "c")
    nodes = links.select(F.explode(F.array(read, contig)).alias("node")).where("node is not null").distinct()
    forest = spanning_forest(nodes, links.select(read.alias("u"), contig.alias("v")))
    name, kind = F.substring("node", 2, 2**31 - 1), F.substring("node", 1, 1)
    keys = forest.labels.groupBy("root").agg(F.coalesce(F.min(F.when(kind == "c", name)), F.min(F.when(kind == "r", name))).alias("group_key"))
    named = split_join(forest.labels, keys, "root", "inner").select("node", "group_key")
    at = rows.select("row_id", F.coalesce(contig, read).alias("node"))
    at = at if everything else at.where("node is not null")
    return split_join(at, named, "node", "left" if everything else "inner").select("row_id", "group_key"), forest


def _dealt(shares: dict[str, float]):
    """Deals the cells of all bands, the greatest band first: see :func:`deal`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"band": [], "bucket": [], "n": []})])
        lacking, names = np.array(list(shares.values())) * cells["n"].sum(), list(shares)
        for _, band in cells.sort_values(["band", "bucket"], ascending=[False, True]).groupby("band", sort=False):
            need = np.maximum(lacking, 0.0)
            need = need if need.sum() > 0 else np.array(list(shares.values()))
            given, split = np.zeros(len(need)), []
            for size in band["n"].to_numpy(float):
                at = int(np.argmin(np.where(need > 0, (given + size / 2) / np.where(need > 0, need, 1.0), np.inf)))
                given[at] += size
                split.append(names[at])
            lacking -= given
            yield pd.DataFrame({"band": band["band"].astype("int32"), "bucket": band["bucket"].astype("int32"), "split": split})

    return run


def deal(sizes: DataFrame, shares: dict[str, float] = SHARES, seed: int = 17, cells: int = CELLS) -> DataFrame:
    """``group_key, n_rows, split``: whole groups dealt so that each split gets its share of the rows.

    All groups are stratified by band of size (powers of two). In each band they stand in hash order, in cells of neighbours, and
    are dealt systematically: each cell goes to the split that it leaves at the least share of its need. Bands are dealt from
    the greatest groups to the smallest, so smaller ones make up for what larger ones left over. Only the cells' sums
    (at most 64 bands of ``cells`` cells, whatever the number of groups) meet in one task. Null keys are no groups.
    """
    placed = cut(sizes.where("group_key is not null and n_rows > 0").withColumn("band", F.floor(F.log2("n_rows")).cast("int")).withColumn("bucket", hash_bucket(["group_key"], seed, cells)))
    sums = placed.groupBy("band", "bucket").agg(F.sum("n_rows").alias("n"))
    given = sums.coalesce(1).mapInPandas(_dealt(shares), "band int, bucket int, split string")
    return placed.join(F.broadcast(given), ["band", "bucket"]).select("group_key", "n_rows", "split")


def split_rows(features: DataFrame, contigs: DataFrame, aliases: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """``row_id, group_key, split`` of every row; a row that names neither read nor contig is a group of its own.

    Such rows get the key ``row:<row_id>``.
    """
    groups = cut(related_groups(features, contigs, aliases, everything=True)[0])
    rows = groups.select("row_id", F.coalesce("group_key", F.concat(F.lit("row:"), F.col("row_id").cast("string"))).alias("group_key"))
    dealt = deal(rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_rows")), shares)
    return split_join(rows, dealt.select("group_key", "split"), "group_key", "inner").select("row_id", "group_key", "split")


def split_report(rows: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """``split, n_rows, n_groups, share, target_share, n_mixed_groups`` of dealt rows; the last counts groups that lie in several splits."""
    groups = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("split"), F.max("split").alias("last"))
    sums = groups.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("split") != F.col("last")).alias("n_mixed_groups"))
    total = F.lit(rows.count())
    wanted = rows.sparkSession.createDataFrame(list(shares.items()), "split string, target_share double")  # one row per split
    out = wanted.join(sums, "split", "left").fillna(0, ["n_rows", "n_groups", "n_mixed_groups"])
    return out.select("split", "n_rows", "n_groups", F.round(F.try_divide("n_rows", total), 6).alias("share"), "target_share", "n_mixed_groups")


def forest_report(forest: Forest) -> DataFrame:
    """``n_nodes, n_groups, n_edges, n_lost_edges``: a spanning forest has as many edges as nodes less groups, all of them inside a group."""
    labels = forest.labels.groupBy("root").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.count(F.lit(1)).alias("n_groups"))
    left, right = (forest.labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "uv")
    inside = split_join(split_join(forest.edges, left, "u", "left"), right, "v", "left")
    edges = inside.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(~F.col("u_root").eqNullSafe(F.col("v_root"))).alias("n_lost_edges"))
    return labels.join(F.broadcast(edges))  # one row each
