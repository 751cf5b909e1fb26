"""Coverage, inventories, weights, histograms, bootstrap, probes and dashboard aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.functions.hashing import U64, joined_hash, uint64
from gaugewright.operators.ranking import ranking_metrics, ratio, running_counts, same, score_counts, slice_id

D = "double"


def coverage(df: DataFrame, keys: Sequence[str], low: int = 20) -> DataFrame:
    """Rows per key combination, nulls included, and whether they are too few."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumn("low_power", F.col("rows") < low)


def roll_up(counts: DataFrame, keys: Sequence[str], value: str = "rows") -> DataFrame:
    """Sums over fewer keys."""
    return counts.groupBy(*keys).agg(F.sum(value).alias(value))


def inventory(df: DataFrame, by: Sequence[str], target: str = "target", parent: str = "parent_id") -> DataFrame:
    """rows, unique parents and a map of counts per target."""
    per = df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("n_"))
    counts = per.groupBy(*by).agg(F.sum("n_").alias("rows"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(target).cast("string"), F.lit("null")).alias("k"), F.col("n_").alias("v"))))).alias("target_counts"))
    return same(counts, df.groupBy(*by).agg(F.count_distinct(parent).alias("unique_parents")), by)


def overview(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Minimum, median and maximum of each value."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[f.alias(f"{n}_{v}") for v in values for n, f in (("min", F.min(v)), ("median", F.percentile(F.col(v).cast(D), F.lit(0.5))), ("max", F.max(v)))])


def first_distinct(value: Column, k: int = 8) -> Column:
    """The first k distinct values in order, joined."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(value.cast("string"))), 1, k), ", ")


def pivot_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Counts per value in columns, 0 where there is none (A06). Values are given, so no pass over the data finds them."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0, list(values))


def option_list(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct().orderBy(column)


def group_table(df: DataFrame, column: str, target: str = "target", decision: str = "decision", score: str = "score") -> DataFrame:
    """n, accuracy, errors and mean score by group, largest first."""
    t, d = F.col(target), F.col(decision)
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg((t == d).cast("int").cast(D)).alias("accuracy"), F.count_if((t == 0) & (d == 1)).alias("false_positives"), F.count_if((t == 1) & (d == 0)).alias("false_negatives"), F.avg(F.col(score).cast(D)).alias("mean_score"))
    return out.orderBy(F.desc("n"), column)


def score_histogram(df: DataFrame, score: str = "score", correct: Column | None = None, bins: int = 10) -> DataFrame:
    """Counts of correct and wrong rows in equal bins of [0, 1], the last one closed, empty bins included."""
    b = F.least(F.floor(F.col(score).cast(D) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(b.alias("bin")).agg(F.count_if(correct).alias("correct"), F.count_if(~correct).alias("wrong"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").fillna(0, ["correct", "wrong"])


def balance_weights(df: DataFrame, target: str, group: str, name: str = "weight") -> DataFrame:
    """1 / (rows of the group x groups of the class), scaled to a mean of 1 (A36). Sums by group only; no window over rows."""
    sizes = df.groupBy(target, group).agg(F.count(F.lit(1)).alias("n_"))
    groups = sizes.groupBy(target).agg(F.count(F.lit(1)).alias("g_"))
    weights = same(sizes, groups, [target], small=True).withColumn("w_", F.lit(1.0) / (F.col("n_").cast(D) * F.col("g_").cast(D)))
    mean = weights.agg((F.sum(F.col("w_") * F.col("n_")) / F.sum("n_")).alias("mean_"))
    weights = weights.crossJoin(mean).select(target, group, (F.col("w_") / F.col("mean_")).alias(name))
    return same(df, weights, [target, group], small=True)


def weighted_bce(target: Column, score: Column, weight: Column) -> Column:
    """Weighted mean of the logistic loss."""
    loss = F.greatest(score, F.lit(0.0)) - score * target.cast(D) + F.log1p(F.exp(-F.abs(score)))
    return F.try_divide(F.sum(weight * loss), F.sum(weight))


def partial_auc_surrogate(df: DataFrame, target: str, score: str, alpha: float = 0.05, batch: Sequence[str] = ()) -> DataFrame:
    """batch, loss: mean softplus(negative - positive) over all positives and the hardest alpha share of negatives.

    The loss is defined on batches: pairs are formed within a batch, whose size the caller bounds. The hardest negatives
    are found by counts of the scores, so no window holds a batch, and equal scores are one row with a weight.
    """
    counts = running_counts(score_counts(df.withColumn("slice_", slice_id(batch)), ["slice_"], target, score), ["slice_"])
    need = F.ceil(F.col("total_neg") * F.lit(alpha))
    hard = counts.withColumn("w_", F.least(F.col("neg"), need - (F.col("fp") - F.col("neg")))).where("w_ > 0").select("slice_", F.col("score").alias("n_"), "w_")
    pairs = counts.where("pos > 0").select("slice_", F.col("score").alias("p_"), "pos").join(hard, "slice_")
    d, w = F.col("n_") - F.col("p_"), F.col("w_") * F.col("pos")
    loss = F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))
    out = pairs.groupBy("slice_").agg(F.try_divide(F.sum(w * loss), F.sum(w)).alias("loss"))
    if not batch:
        return out.drop("slice_")
    names = df.select(slice_id(batch).alias("slice_"), *batch).distinct()
    return names.join(out, "slice_", "left").drop("slice_")


def pair_ranking_loss(df: DataFrame, pair: str, target: str, score: str) -> DataFrame:
    """Mean softplus of authentic minus derived score over pairs."""
    both = df.groupBy(pair).agg(F.avg(F.when(F.col(target) == 1, F.col(score).cast(D))).alias("one"), F.avg(F.when(F.col(target) == 0, F.col(score).cast(D))).alias("zero")).where("one is not null and zero is not null")
    d = F.col("zero") - F.col("one")
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))).alias("loss"))


def subtype_losses(df: DataFrame, subtype: str, loss: Column) -> DataFrame:
    """Mean loss by subtype, overall mean and the worst subtype."""
    per = df.groupBy(subtype).agg(F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).alias("rows"))
    whole = df.agg(F.avg(loss).alias("overall_loss"))
    worst = per.agg(F.max_by(subtype, "mean_loss").alias("worst_subtype"))
    return per.crossJoin(whole).crossJoin(worst)


def _bootstrap(keys: Sequence[str], target: str, score: str, samples: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        pos, neg = pdf.loc[pdf[target] == 1, score].to_numpy(float), pdf.loc[pdf[target] == 0, score].to_numpy(float)
        found = []
        if len(pos) and len(neg):
            for _ in range(samples):
                found.append(average_precision(rng.choice(pos, len(pos)), rng.choice(neg, len(neg))))
        low, high = np.quantile(found, [0.025, 0.975]) if found else (None, None)
        return pd.DataFrame({**{k: pdf[k].iloc[:1].to_numpy() for k in keys}, "ci_low": [low], "ci_high": [high]})

    return run


def average_precision(pos: np.ndarray, neg: np.ndarray) -> float:
    scores = np.concatenate((pos, neg))
    labels = np.concatenate((np.ones(len(pos)), np.zeros(len(neg))))
    order = np.argsort(-scores, kind="stable")
    scores, labels = scores[order], labels[order]
    last = np.append(np.nonzero(np.diff(scores))[0], len(scores) - 1)
    tp = np.cumsum(labels)[last]
    return float((np.diff(np.append(0, tp)) / len(pos) * tp / (last + 1)).sum())


def bootstrap_intervals(df: DataFrame, keys: Sequence[str], target: str, score: str, samples: int = 200, seed: int = 0) -> DataFrame:
    """2.5 and 97.5 percentiles of average precision over class-wise resamples of each group.

    A group is one task's array of scores, so this is for report slices; ``poisson_bootstrap`` serves groups of any size.
    """
    fields = T.StructType([*[df.schema[k] for k in keys], T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType())])
    return df.select(*keys, target, F.col(score).cast(D).alias(score)).groupBy(*keys).applyInPandas(_bootstrap(keys, target, score, samples, seed), fields)


def poisson_bootstrap(df: DataFrame, cluster: Sequence[str], label: str, reference: str, candidate: str, samples: int = 100, seed: int = 0) -> DataFrame:
    """Interval of the candidate's gain in partial AUC over a reference under resampled clusters.

    A cluster's multiplicity in a replicate is Poisson(1) from its hash, the scalable form of drawing with replacement:
    rows are weighted, never copied between tasks. ``supports`` says whether the low end is above zero.
    """
    steps = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) if k else np.exp(-1.0) for k in range(7)])
    u = uint64(joined_hash(":", seed, F.col("replicate"), *[F.col(c) for c in cluster])).cast(D) / F.lit(float(1 << 64))
    times = sum((u >= F.lit(float(s))).cast("int") for s in steps)
    rows = df.select(*cluster, label, reference, candidate, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("replicate"))
    drawn = rows.withColumn("times_", times).where("times_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times_"))))
    long = drawn.select("replicate", label, F.explode(F.array(F.struct(F.lit("reference").alias("model"), F.col(reference).cast(D).alias("s")), F.struct(F.lit("candidate").alias("model"), F.col(candidate).cast(D).alias("s")))).alias("x")).select("replicate", label, "x.model", "x.s")
    per = ranking_metrics(long, ["replicate", "model"], label, "s", buckets=1).groupBy("replicate").agg((F.max(F.when(F.col("model") == "candidate", F.col("partial_auc"))) - F.max(F.when(F.col("model") == "reference", F.col("partial_auc")))).alias("delta"))
    p = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    return per.agg(F.avg("delta").alias("delta_mean"), p[0].alias("ci_low"), p[1].alias("ci_high")).withColumn("supports", F.col("ci_low") > 0)


def hash_folds(column: Column, folds: int, seed: int) -> Column:
    """Fold of a lineage by hash: deterministic and without a pass over the data."""
    return F.pmod(uint64(joined_hash(":", seed, column)), F.lit(folds).cast(U64)).cast("int")


def dashboard_slices(df: DataFrame, keys: Sequence[str], target: str = "target", decision: str = "decision", probability: str = "probability") -> DataFrame:
    """Confusion, mismatch and error rates, balanced accuracy with 0 for a missing class, mean probability."""
    t, d = F.col(target), F.col(decision)
    base = df.where(t.isin(0, 1)).groupBy(*keys).agg(F.count_if((t == 1) & (d == 1)).alias("tp"), F.count_if((t == 0) & (d == 0)).alias("tn"), F.count_if((t == 0) & (d == 1)).alias("fp"), F.count_if((t == 1) & (d == 0)).alias("fn"), F.avg(F.col(probability).cast(D)).alias("mean_probability"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return base.withColumns({
        "rows": tp + tn + fp + fn, "mismatch_rate": zero(ratio(fp + fn, tp + tn + fp + fn)), "fpr": zero(ratio(fp, fp + tn)), "fnr": zero(ratio(fn, fn + tp)),
        "balanced_accuracy": (zero(ratio(tp, tp + fn)) + zero(ratio(tn, tn + fp))) / F.lit(2.0),
    })


def mismatch_association(df: DataFrame, keys: Sequence[str], clean_wrong: str, wrong: str) -> DataFrame:
    """Phi, lift, newly wrong and recovered shares of transformed against clean mistakes."""
    a, b = F.col(clean_wrong), F.col(wrong)
    n = df.groupBy(*keys).agg(F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"))
    n11, n10, n01, n00 = (F.col(c).cast(D) for c in ("n11", "n10", "n01", "n00"))
    spread = F.sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00))
    return n.withColumns({
        "phi": F.try_divide(n11 * n00 - n10 * n01, spread), "lift": F.try_divide(F.try_divide(n11, n11 + n10), F.try_divide(n11 + n01, n11 + n10 + n01 + n00)),
        "newly_wrong_rate": F.try_divide(n01, n01 + n00), "recovered_rate": F.try_divide(n10, n10 + n11),
    })


def selected_totals(slices: DataFrame) -> DataFrame:
    """Totals of dashboard slices; balanced accuracy is null if a class is missing."""
    out = slices.agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])
    return out.withColumn("balanced_accuracy", (ratio("tp", F.col("tp") + F.col("fn")) + ratio("tn", F.col("tn") + F.col("fp"))) / F.lit(2.0))


def coverage_difference(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """missing, extra and duplicate counts of a bag comparison."""
    a = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("want"), F.lit(0).cast("long").alias("have"))
    b = actual.groupBy(*keys).agg(F.lit(0).cast("long").alias("want"), F.count(F.lit(1)).alias("have"))
    both = a.unionByName(b).groupBy(*keys).agg(F.sum("want").alias("want"), F.sum("have").alias("have"))
    return both.agg(F.count_if(F.expr("have = 0 and want > 0")).alias("missing"), F.count_if(F.expr("want = 0 and have > 0")).alias("extra"), F.count_if(F.expr("have > 1 and want > 0")).alias("duplicates"))


def numbered(df: DataFrame, slice_: Column, order: str, name: str = "place", buckets: int = 64) -> DataFrame:
    """df with slice_ and each row's place, from 0, by the numeric column ``order`` within its slice.

    Rows are numbered within quantile buckets of ``order`` and moved up by the counts of the buckets below, so that no task
    holds a whole slice; any cuts give the same places. Rows with equal ``order`` get places in no defined order.
    """
    cuts = df.agg(F.percentile_approx(F.col(order).cast(D), F.array(*[F.lit(k / buckets) for k in range(1, buckets)])).alias("c")).first()["c"] or []
    cut = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]).cast("array<double>")
    put = df.withColumns({"slice_": slice_, "b_": F.size(F.filter(cut, lambda x: x <= F.col(order).cast(D)))})
    counts = put.groupBy("slice_", "b_").agg(F.count(F.lit(1)).alias("n_"))
    below = counts.select("slice_", "b_", (F.sum("n_").over(Window.partitionBy("slice_").orderBy("b_")) - F.col("n_")).alias("below_"))
    own = put.withColumn("own_", F.row_number().over(Window.partitionBy("slice_", "b_").orderBy(order)) - 1)
    return own.join(below.hint("merge"), ["slice_", "b_"]).withColumn(name, F.col("below_") + F.col("own_")).drop("b_", "below_", "own_")


def best_match(left: DataFrame, right: DataFrame, tiers: Sequence[Sequence[str]], right_id: str, order: str) -> DataFrame:
    """The id of the first tier in which a row finds partners, picked in turn within the tier.

    Both sides are numbered within the tier's keys, left by ``order``, right by ``right_id`` (both numeric and unique), and
    meet by an equi-join on the partner's number; no side is gathered.
    """
    out, found = left, []
    for k, keys in enumerate(tiers):
        theirs = numbered(right, slice_id(keys), right_id)
        counts = theirs.groupBy("slice_").agg(F.count(F.lit(1)).alias("n_")).withColumnRenamed("slice_", "s_")
        mine = numbered(left.select(*dict.fromkeys([order, *keys])), slice_id(keys), order).join(counts, F.col("slice_") == F.col("s_"))
        picks = mine.select(F.col(order).alias("o_"), "slice_", F.pmod("place", "n_").alias("place"))
        pairs = picks.join(theirs.select("slice_", "place", F.col(right_id).alias(f"m{k}_")).hint("merge"), ["slice_", "place"]).select("o_", f"m{k}_")
        out = out.join(pairs, F.col(order) == F.col("o_"), "left").drop("o_")
        found.append(f"m{k}_")
    tier = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for k, c in enumerate(found)])
    return out.select(*left.columns, F.coalesce(*[F.col(c) for c in found]).alias("match"), tier.alias("match_tier"))


def monotonicity_violations(df: DataFrame, by: Sequence[str], order: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Rows whose value rises over the previous one."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).where(F.col(value) > F.col("previous") + F.lit(float(tolerance)))


def fill_to_target(groups: DataFrame, order: Sequence[Column | str], size: str, targets: Sequence[tuple[str, int]], rest: str) -> DataFrame:
    """Whole groups to pools in order until a pool's rows are reached, overshoot allowed.

    The pool boundaries depend on each other, so the group table (one row per group) is read once on the driver in blocks.
    """
    columns = groups.columns
    schema = T.StructType([*groups.schema.fields, T.StructField("pool", T.StringType())])
    rows, at, filled = [], 0, 0
    for r in groups.orderBy(*order).toLocalIterator():
        while at < len(targets) and filled >= targets[at][1]:
            at, filled = at + 1, 0
        rows.append((*[r[c] for c in columns], targets[at][0] if at < len(targets) else rest))
        filled += r[size]
    return groups.sparkSession.createDataFrame(rows, schema)
