"""Preparing training rows: k-mer balance, random parts, label cleaning, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ranks import mixed, placed, with_rank
from strandline.operators.skew import split_join
from strandline.session import cut, shuffle_partitions


def kmer_counts(rows: DataFrame, kmer: str = "kmer") -> DataFrame:
    """Rows and share of each k-mer."""
    counts = rows.where(F.col(kmer).isNotNull()).groupBy(kmer).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).first()[0] or 1
    return counts.select(kmer, "n_rows", F.round(F.col("n_rows") / F.lit(total), 6).alias("share"))


def balanced(negatives: DataFrame, positives: DataFrame, total: int | None = None, kmer: str = "kmer", row_id: str = "row_id", seed: int = 1) -> DataFrame:
    """Negatives whose k-mers are mixed as those of the positives: of each k-mer up to ``ceil(total * share)`` rows in random order.

    ``total`` is the number of positives if it is not given. If the quotas give fewer, the rest comes from negatives of k-mers that the positives lack.
    """
    shares = positives.where(F.col(kmer).isNotNull()).groupBy(kmer).agg(F.count(F.lit(1)).alias("n"))
    n_positives = shares.agg(F.sum("n")).first()[0] or 0
    whole = max(1, n_positives)
    total = n_positives if total is None else total
    quotas = shares.select(kmer, F.ceil(F.col("n") * F.lit(total) / F.lit(whole)).alias("quota"))
    ranked = with_rank(negatives.where(F.col(kmer).isNotNull()), [kmer], [row_id], seed)
    matched = cut(ranked.join(quotas, kmer).where("rank <= quota").drop("rank", "quota"))
    lacking = total - matched.count()
    if lacking <= 0:
        return matched
    others = negatives.join(quotas.select(kmer), kmer, "left_anti").where(F.col(kmer).isNotNull())
    return matched.unionByName(random_rows(others, lacking, row_id, seed))


def _random_order(rows: DataFrame, row_id: str, seed: int) -> Column | None:
    """The integer hash of whole-number ids; other ids go by the engine's own hash."""
    return mixed(F.col(row_id), seed) if rows.schema[row_id].dataType.typeName() in ("byte", "short", "integer", "long") else None


def _ranked(rows: DataFrame, row_id: str, seed: int) -> DataFrame:
    order = _random_order(rows, row_id, seed)
    return with_rank(rows.withColumn("_all", F.lit(0)), ["_all"], [row_id], seed, order=order).drop("_all")


def random_rows(rows: DataFrame, n: int, row_id: str = "row_id", seed: int = 1) -> DataFrame:
    """``n`` rows in a random but repeatable order (all if there are fewer)."""
    return _ranked(rows, row_id, seed).where(F.col("rank") <= n).drop("rank")


def with_choice(rows: DataFrame, n: int, row_id: str = "row_id", seed: int = 1) -> DataFrame:
    """Adds ``chosen``: true for ``n`` random rows, false for the remainder."""
    return _ranked(rows, row_id, seed).withColumn("chosen", F.col("rank") <= n).drop("rank")


def halves(rows: DataFrame, row_id: str = "row_id", seed: int = 1) -> DataFrame:
    """Adds ``half``: 0 or 1, of equal size up to one row, in random order."""
    return _ranked(rows, row_id, seed).withColumn("half", (F.col("rank") % 2).cast("int")).drop("rank")


def shuffled_concat(first: DataFrame, second: DataFrame, chunk: int = 2_000_000, row_id: str = "row_id", seed: int = 1) -> DataFrame:
    """Both tables together, with ``chunk`` and ``place``: their rows in the order of ids are taken chunk by chunk, from the second in proportion, and shuffled inside a chunk.

    An empty first table leaves the second in one chunk.
    """
    one, two = placed(first, [F.col(row_id)], "_at"), placed(second, [F.col(row_id)], "_at")
    n, m = one.count(), two.count()
    size = round(m / n * chunk) + 1 if n else max(m, 1)
    both = one.withColumn("chunk", F.floor(F.col("_at") / chunk)).unionByName(two.withColumn("chunk", F.floor(F.col("_at") / size)))
    order = _random_order(first, row_id, seed)
    return placed(both.drop("_at"), [F.col("chunk"), F.xxhash64(row_id, F.lit(seed)) if order is None else order, F.col(row_id)])


def shuffled(rows: DataFrame, row_id: str = "row_id", seed: int = 1) -> DataFrame:
    """The rows in random order over the partitions and inside them."""
    return rows.withColumn("_h", F.xxhash64(row_id, F.lit(seed))).repartitionByRange(shuffle_partitions(rows.sparkSession), "_h").sortWithinPartitions("_h", row_id).drop("_h")


def mean_scores(scores: DataFrame) -> DataFrame:
    """``row_id, mean_prob, std_prob, n_rounds`` over the rounds of scoring; rows without a score stay away."""
    valid = scores.where(F.col("prob").isNotNull() & ~F.isnan("prob"))
    return valid.groupBy("row_id").agg(F.avg("prob").alias("mean_prob"), F.stddev_pop("prob").alias("std_prob"), F.count(F.lit(1)).alias("n_rounds"))


def cleaned(rows: DataFrame, scores: DataFrame, label: str = "label", least: float = 0.5) -> DataFrame:
    """Rows whose mean score agrees with their label: at least ``least`` for 1, below ``1 - least`` for 0."""
    joined = rows.join(mean_scores(scores).select("row_id", "mean_prob"), "row_id")
    return joined.where(F.when(F.col(label) == 1, F.col("mean_prob") >= least).otherwise(F.col("mean_prob") < 1 - least))


def kept_ratio(rows: DataFrame, kept: DataFrame, label: str = "label") -> DataFrame:
    """Share of the rows of each label that were kept."""
    before, after = (f.groupBy(label).agg(F.count(F.lit(1)).alias(n)) for f, n in ((rows, "n_rows"), (kept, "n_kept")))
    return before.join(after, label, "left").select(label, "n_rows", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.round(F.coalesce("n_kept", F.lit(0)) / F.col("n_rows"), 6).alias("ratio"))


def kmer_scorer(train: DataFrame, test: DataFrame, kmer: str = "kmer", label: str = "label") -> DataFrame:
    """``row_id, prob``: the share of label 1 among the training rows of the same k-mer, drawn to one half by one row of either label. Unknown k-mers have 0.5."""
    shares = train.groupBy(kmer).agg(((F.count_if(F.col(label) == 1) + 1) / (F.count(F.lit(1)) + 2)).alias("_share"))
    return split_join(test, shares, kmer, "left").select("row_id", F.coalesce("_share", F.lit(0.5)).alias("prob"))


def round_scores(rows: DataFrame, scorer, rounds: int = 3, seed: int = 1) -> DataFrame:
    """``row_id, prob``: each round halves the rows at random and scores each half by a model of the other."""
    scores = None
    for r in range(rounds):
        parts = cut(halves(rows, seed=seed + r))
        a, b = parts.where("half = 0").drop("half"), parts.where("half = 1").drop("half")
        both = scorer(a, b).select("row_id", "prob").unionByName(scorer(b, a).select("row_id", "prob"))
        scores = both if scores is None else scores.unionByName(both)
    return cut(scores)


def denoise(rows: DataFrame, scorer, rounds: int = 3, iterations: int = 10, least: float = 0.5, enough: float = 0.99, seed: int = 1, negatives: bool = True, balance: str | None = None) -> DataFrame:
    """Label cleaning: scores come from :func:`round_scores`; rows that disagree with their mean score go, until few do.

    ``scorer(train, test) -> row_id, prob``. ``negatives`` tells whether rows of label 0 are judged as well. With ``balance``, the name of a k-mer column,
    the next iteration's rows of label 0 are chosen from those that are left (of all first ones, if they are not judged) as :func:`balanced` does, as many as there are
    of label 1; if fewer are left they all stay. Stops when the mean share kept over the judged labels reaches ``enough`` or no row of label 1 is left. Every iteration is cut.
    """
    start = current = cut(rows)
    for i in range(iterations):
        kept = cleaned(current, round_scores(current, scorer, rounds, seed + 1000 * i), least=least).select(*rows.columns)
        kept = cut(kept if negatives else kept.where("label = 1").unionByName(current.where("label <> 1")))
        judged = lambda f: f if negatives else f.where("label = 1")
        ratio = kept_ratio(judged(current), judged(kept)).agg(F.avg("ratio")).first()[0]
        current = kept
        if balance:
            positives, left = kept.where("label = 1"), (kept if negatives else start).where("label = 0")
            n = positives.count()
            if n and n <= left.count():
                left = balanced(left, positives, n, balance, seed=seed + i).select(*rows.columns)
            current = cut(positives.unionByName(left)) if n else positives
        if ratio is None or ratio >= enough or current.isEmpty():
            break
    return current


def classification(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall, F1 and the mean of the last three."""
    yes = lambda l, p: F.count_if((F.col(label) == l) & (F.col(predicted) == p))
    counts = rows.agg(yes(1, 1).alias("tp"), yes(0, 1).alias("fp"), yes(1, 0).alias("fn"), yes(0, 0).alias("tn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    accuracy = F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return counts.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(n) for c, n in ((accuracy, "accuracy"), (precision, "precision"), (recall, "recall"), (f1, "f1"), ((precision + recall + f1) / 3, "mean_prf"))])


def with_average_rank(rows: DataFrame, column: str, into: str) -> DataFrame:
    """Adds the rank of a value among all, ties averaged.

    Counts by value are sorted by range and their prefix sums taken over the partitions, so no task ranks everything.
    """
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ordered = cut(counts.repartitionByRange(shuffle_partitions(rows.sparkSession), column).withColumn("_pid", F.spark_partition_id()))
    sums = ordered.groupBy("_pid").agg(F.sum("_n").alias("_here"))  # one row per partition
    prior = Window.partitionBy().orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_pid", F.coalesce(F.sum("_here").over(prior), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_pid").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranks = ordered.join(F.broadcast(sums), "_pid").select(column, (below + (F.col("_n") + 1) / 2).alias(into))
    return split_join(rows, ranks, column, "inner")


def regression(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Mean squared and absolute error, Pearson and Spearman correlation."""
    ranked = with_average_rank(with_average_rank(rows.select(label, predicted).dropna(), label, "_rl"), predicted, "_rp")
    error = F.col(predicted) - F.col(label)
    out = ranked.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.corr(label, predicted).alias("pearson"), F.corr("_rl", "_rp").alias("spearman"))
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


def cross_entropy(label: Column, probability: Column, least: float = 1e-7) -> Column:
    """Binary cross entropy of a probability, kept away from 0 and 1."""
    p = F.greatest(F.least(probability, F.lit(1 - least)), F.lit(least))
    return -(label * F.ln(p) + (1 - label) * F.ln(1 - p))
