"""Mixing sources to target weights, by size in tokens, into shuffled output shards.

Each source is laid out in a random order as a stream of tokens, whole passes first and then the part of a pass that its
quota asks for, and cut into blocks. A splitting tree deals the blocks to the shards: at each node the blocks of
all sources are divided between the halves of its shards by a multivariate hypergeometric draw, so that every shard gets
its number of blocks and the quotas are kept exactly. The draw of a node is seeded by the node, so a shard finds its
quotas by walking down from the root, on any executor, and knows where its disjoint run of each source's permuted
blocks begins. Inside a shard the documents are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tokens import VOCABULARY, count_tokens
from strandline.operators.ranks import with_running_total
from strandline.session import bounded_rows, cut

BLOCK_TOKENS, SHARD_TOKENS = 1 << 13, 1 << 18


@dataclass(frozen=True)
class Quota:
    """What a source has (tokens, one pass) and gives: ``passes`` whole passes and ``rest`` tokens of one more."""

    source: str
    weight: float
    max_repeats: int
    size: int
    quota: float

    @property
    def passes(self) -> int:
        return min(self.max_repeats, int(self.quota / self.size + 1e-9)) if self.size else 0

    @property
    def rest(self) -> float:
        return max(0.0, self.quota - self.passes * self.size) if self.passes < self.max_repeats else 0.0


def quotas(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> list[Quota]:
    """The tokens each source gives.

    Sources without tokens cannot give any; the weights of the others are scaled to sum to 1. Without a ``total`` it is the
    greatest at which no source is repeated more often than allowed, so that all weights are met; with one, a
    source gives at most its allowed passes.
    """
    there = [(s, w, m) for s, w, m in targets if sizes.get(s, 0) > 0 and w > 0 and m > 0]
    whole = sum(w for _, w, _ in there)
    if total is None:
        total = min((m * sizes[s] * whole / w for s, w, m in there), default=0.0)
    gives = {s: min(total * w / whole, m * sizes[s]) for s, w, m in there}
    return [Quota(s, w, m, sizes.get(s, 0), gives.get(s, 0.0)) for s, w, m in targets]


def shard_quotas(blocks: tuple[int, ...], shards: int, seed: int, shard: int, cached=lru_cache(maxsize=4096)(lambda *a: _left(*a))) -> tuple[list[int], list[int]]:
    """Of each source, where the shard's run of blocks begins and how many it has."""
    counts, first, low, high = list(blocks), [0] * len(blocks), 0, shards
    total = sum(blocks)
    upto = lambda k: (total * k) // shards
    while high - low > 1:
        middle = (low + high) // 2
        left = cached(tuple(counts), upto(middle) - upto(low), seed, low, high)
        if shard < middle:
            counts, high = list(left), middle
        else:
            first = [f + x for f, x in zip(first, left)]
            counts, low = [c - x for c, x in zip(counts, left)], middle
    return first, counts


def _left(counts: tuple[int, ...], draws: int, seed: int, low: int, high: int) -> tuple[int, ...]:
    """The blocks that the left half of a node gets: a multivariate hypergeometric draw, source by source."""
    random = np.random.default_rng([seed, low, high])
    out, rest = [], sum(counts)
    for n in counts:
        rest -= n
        got = hypergeometric(random, n, rest, draws)
        out.append(got)
        draws -= got
    return tuple(out)


def hypergeometric(random: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` blocks out of ``good + bad`` are good ones, for populations of any size.

    Rejection from a flat middle with exponential tails around the mode, which covers every distribution whose logarithm
    is concave (Devroye 1986); probabilities stand relative to the mode's.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    logp = lambda x: choose(good, x) + choose(bad, draws - x)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    top = logp(mode)
    peak = math.exp(min(0.0, top - choose(good + bad, draws)))
    width = 1 + peak / 2
    while True:
        u, v = random.random(), random.random()
        if u <= width / (1 + width):
            away, bound = random.random() * width / peak, 1.0
        else:
            tail = random.exponential()
            away, bound = (width + tail) / peak, math.exp(-tail)
        x = mode + (1 if random.random() < 0.5 else -1) * round(away)
        if low <= x <= high and v * bound <= math.exp(min(0.0, logp(x) - top)):
            return x


def _step(n: int, seed: int) -> int:
    """A multiplier without common factor with n: block -> block * step + seed mod n is a permutation."""
    step = max(1, int(n * 0.6180339887) + seed % 97)
    while math.gcd(step, n) != 1:
        step += 1
    return step


def _sized(documents: DataFrame, targets: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents with tokens, of the sources of the targets."""
    wanted = documents.select("doc_id", "source", "text").join(targets.select("source").distinct(), "source", "left_semi")
    return count_tokens(wanted, vocabulary).where("n_tokens > 0")


def _listed(targets: DataFrame) -> list[tuple[str, float, int]]:
    """The targets, one row per source; this table is a parameter of the mix."""
    rows = targets.where("source is not null").groupBy("source").agg(F.sum("target_weight").alias("w"), F.max("max_repeats").alias("m"))
    return sorted((r["source"], r["w"] or 0.0, r["m"] if r["m"] is not None else 1) for r in bounded_rows(rows, "the table of targets"))


def _planned(sized: DataFrame, targets: DataFrame, total: float | None) -> tuple[DataFrame, list[Quota]]:
    """The documents with their place in their source's stream and their number of copies, and the quotas."""
    spark = sized.sparkSession
    listed = _listed(targets)
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per target source
    plan = quotas(sizes, listed, total)
    rows = [(q.source, q.size, q.passes, q.rest) for q in plan if q.quota > 0]
    table = spark.createDataFrame(rows, "source string, size bigint, passes int, rest double")  # one row per target source
    placed = with_running_total(sized.join(F.broadcast(table), "source"), ["source"], ["doc_id"], F.col("n_tokens"), 3)
    copies = F.col("passes") + F.when(F.col("running_before") + F.col("n_tokens") / 2 < F.col("rest"), 1).otherwise(0)
    return placed.withColumn("copies", copies).where("copies > 0"), plan


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = 29) -> DataFrame:
    """``doc_id, source, repeat_no, shard, place, n_tokens``: each copy of each chosen document with its place.

    Shares are exact to one document per source. Null and empty texts and documents of other sources are not
    drawn. Without any document with tokens the result is empty.
    """
    spark = documents.sparkSession
    sized = cut(_sized(documents, targets, vocabulary))
    placed, plan = _planned(sized, targets, total)
    active = [q for q in plan if q.quota > 0]
    whole = sum(q.quota for q in active)
    blocks = tuple(int(q.quota // block_tokens) + 1 for q in active)
    shards = max(1, min(sum(blocks), math.ceil(whole / shard_tokens)))
    names = [q.source for q in active]

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for shard in batch["id"]:
                first, counts = shard_quotas(blocks, shards, seed, int(shard))
                out += [(int(shard), s, f, n) for s, f, n in zip(names, first, counts) if n]
            yield pd.DataFrame(out, columns=["shard", "source", "first", "n"])

    runs = spark.range(shards).mapInPandas(leaves, "shard bigint, source string, first bigint, n bigint")
    dealt = runs.select("shard", "source", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    steps = spark.createDataFrame([(s, n, _step(n, seed)) for s, n in zip(names, blocks)], "source string, n_blocks bigint, step bigint")  # one row per target source
    copies = placed.select("doc_id", "source", "n_tokens", "running_before", "size", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("repeat_no"))
    number = F.floor((F.col("repeat_no") * F.col("size") + F.col("running_before")) / F.lit(block_tokens))
    slotted = copies.withColumn("block", F.floor(number)).join(F.broadcast(steps), "source").withColumn("slot", F.pmod(F.least("block", F.col("n_blocks") - 1) * F.col("step") + F.lit(seed), F.col("n_blocks")))
    joined = slotted.join(dealt, ["source", "slot"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "repeat_no", F.lit(seed)), "doc_id", "repeat_no")
    return joined.select("doc_id", "source", "repeat_no", "shard", F.row_number().over(local).alias("place"), "n_tokens")


def shares(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY, everything: bool = False) -> DataFrame:
    """One row per source of the targets: what it has, gives, its actual share of the mix, and whether its target is met.

    ``missing_share`` is how far the actual share stays below the target; a target is met if no more is missing than the
    greatest document of the mix. Targets are shares of all targets, so a source without documents, and one that may not be repeated
    often enough for a given ``total``, come out unmet. ``everything`` asks for as many tokens as all sources of the targets hold in one pass.
    """
    sized = cut(_sized(documents, targets, vocabulary))
    if everything:
        total = float(sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    placed, plan = _planned(sized, targets, total)
    drawn = placed.groupBy("source").agg(F.sum("copies").alias("n_copies"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_drawn"), F.max("n_tokens").alias("_greatest"))
    table = sized.sparkSession.createDataFrame([(q.source, q.weight, q.max_repeats, q.size) for q in plan], "source string, target_weight double, max_repeats int, n_available bigint")
    out = table.join(drawn, "source", "left").fillna(0, ["n_copies", "n_documents", "most_repeats", "n_drawn", "_greatest"])
    everyone = Window.partitionBy()  # one row per target source
    whole = F.greatest(F.sum("n_drawn").over(everyone), F.lit(int(total or 0)))
    share = F.coalesce(F.try_divide(F.col("n_drawn"), whole), F.lit(0.0))
    target = F.coalesce(F.try_divide("target_weight", F.sum("target_weight").over(everyone)), F.lit(0.0))
    missing = F.greatest(target - share, F.lit(0.0))
    met = missing * whole <= F.max("_greatest").over(everyone)
    shown = out.select("*", F.round(F.coalesce(F.try_divide(F.col("n_drawn"), F.sum("n_drawn").over(everyone)), F.lit(0.0)), 6).alias("actual_share"), F.round(missing, 6).alias("missing_share"), (met & ((F.col("n_drawn") > 0) | (F.col("target_weight") <= 0))).alias("is_met"))
    return shown.drop("_greatest")
