"""Ranking and threshold metrics of sliced scores: confusion rates, ROC-AUC, average precision, partial AUC.

Everything starts from one pre-aggregation to (slice, score) counts, so equal scores cost one row and only counts are
shuffled. Running sums are taken in two levels, over buckets of score (``score_bucket``) and then within each, so that one
huge slice is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

D = "double"


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d in double precision, null where d is 0."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (n, d))
    return F.try_divide(n.cast(D), d.cast(D))


def confusion(label: Column, score: Column, threshold: float = 0.0) -> list[Column]:
    """tp, tn, fp, fn at score >= threshold; NaN scores are never positive."""
    hit = (score >= F.lit(float(threshold))) & ~F.isnan(score)
    return [
        F.count_if((label == 1) & hit).alias("tp"),
        F.count_if((label == 0) & ~hit).alias("tn"),
        F.count_if((label == 0) & hit).alias("fp"),
        F.count_if((label == 1) & ~hit).alias("fn"),
    ]


def threshold_rates() -> dict[str, Column]:
    """Rates over the columns tp, tn, fp, fn; undefined ones are null, the Matthews correlation is then 0."""
    tp, tn, fp, fn = (F.col(c).cast(D) for c in ("tp", "tn", "fp", "fn"))
    tpr, tnr = ratio(tp, tp + fn), ratio(tn, tn + fp)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": (tpr + tnr) / F.lit(2.0),
        "precision": ratio(tp, tp + fp),
        "recall": tpr,
        "specificity": tnr,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
        "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, spread), F.lit(0.0)),
        "prevalence": ratio(tp + fn, tp + tn + fp + fn),
        "predicted_positive_rate": ratio(tp + fp, tp + tn + fp + fn),
    }


def counted(which: Column, weight: str | None = None) -> Column:
    """Rows for which ``which`` holds; a row counts ``weight`` times."""
    return F.count_if(which) if weight is None else F.coalesce(F.sum(F.when(which, F.col(weight))), F.lit(0).cast("long"))


def score_counts(df: DataFrame, keys: Sequence[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """(keys, score, pos, neg) of the rows with a label of 0 or 1 and a finite score."""
    s = F.col(score).cast(D)
    fine = F.col(label).isin(0, 1) & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    return df.where(fine).groupBy(*keys, (s + F.lit(0.0)).alias("score")).agg(counted(F.col(label) == 1, weight).alias("pos"), counted(F.col(label) == 0, weight).alias("neg"))


def slice_id(keys: Sequence[str]) -> Column:
    """A 64-bit id of a slice, nulls told apart: keys of any width sort and hash as one number."""
    return F.xxhash64(*[x for k in keys for x in (F.col(k), F.col(k).isNull())]) if keys else F.lit(0).cast("long")


def score_bucket(score: Column, buckets: int) -> Column:
    """A monotone bucket number: ``buckets`` to a unit within [-1, 1], where probabilities lie, and an eighth of that to a unit of
    the logarithm beyond.
    """
    size = F.abs(score)
    place = F.when(size <= 1, size * F.lit(float(buckets))).otherwise(F.lit(float(buckets)) + F.ln(size) * F.lit(buckets / 8.0))
    return F.floor(F.signum(score) * place).cast("int")


def running_counts(counts: DataFrame, keys: Sequence[str], buckets: int = 64) -> DataFrame:
    """counts with tp, fp (rows of at least this score) and the slice's total_pos, total_neg.

    Each bucket gets one more row, before its own, that carries what the buckets above hold; so the second level needs no
    join, and no pass over the data finds the buckets' ends.
    """
    whole = Window.partitionBy(*keys, F.lit(0))
    if buckets <= 1:
        w = whole.orderBy(F.desc("score"))
        return counts.select("*", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(whole).alias("total_pos"), F.sum("neg").over(whole).alias("total_neg"))
    put = counts.select(*keys, score_bucket(F.col("score"), buckets).alias("b_"), "score", "pos", "neg")
    sums = put.groupBy(*keys, "b_").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    over = whole.orderBy(F.desc("b_"))
    heads = sums.select(*keys, "b_", F.lit(True).alias("head_"), F.lit(None).cast(D).alias("score"), (F.sum("bp").over(over) - F.col("bp")).alias("pos"), (F.sum("bn").over(over) - F.col("bn")).alias("neg"), F.sum("bp").over(whole).alias("total_pos"), F.sum("bn").over(whole).alias("total_neg"))
    none = F.lit(None).cast("long")
    rows = put.select(*keys, "b_", F.lit(False).alias("head_"), "score", "pos", "neg", none.alias("total_pos"), none.alias("total_neg"))
    inner = Window.partitionBy(*keys, "b_").orderBy(F.desc("head_"), F.desc("score"))
    out = heads.unionByName(rows).select(
        *keys, "head_", "score", "pos", "neg", F.sum("pos").over(inner).alias("tp"), F.sum("neg").over(inner).alias("fp"), F.max("total_pos").over(inner).alias("total_pos"), F.max("total_neg").over(inner).alias("total_neg")
    )
    return out.where("not head_").drop("head_")


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on keys with null equal to null, keys once; a cross join of one row without keys.

    Unless ``small`` says that one side is a report-sized table, the join is a sort-merge join: exploded rows look far
    smaller to the planner than they are, and a broadcast picked from such an estimate doesn't fit.
    """
    renamed = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    if keys and not small:
        renamed = renamed.hint("merge")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return (left.join(renamed, on, how) if keys else left.join(renamed, how="cross")).drop(*[f"r_{k}" for k in keys])


def roc_points(df: DataFrame, keys: Sequence[str], label: str, score: str, buckets: int = 64) -> DataFrame:
    """One row per slice and distinct score, from high to low: tp, fp, tpr, fpr, prev_tpr, prev_fpr, precision."""
    return count_points(score_counts(df, keys, label, score), keys, buckets)


def count_points(counts: DataFrame, keys: Sequence[str], buckets: int = 64) -> DataFrame:
    """roc_points of counts(keys, score, pos, neg)."""
    run = running_counts(counts, keys, buckets)
    tpr, fpr = ratio("tp", "total_pos"), ratio("fp", "total_neg")
    return run.select(
        *keys, "score", "pos", "neg", "tp", "fp", "total_pos", "total_neg", tpr.alias("tpr"), fpr.alias("fpr"),
        ratio(F.col("tp") - F.col("pos"), "total_pos").alias("prev_tpr"), ratio(F.col("fp") - F.col("neg"), "total_neg").alias("prev_fpr"), ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
    )


def ranking_aggregates(max_fpr: float = 0.05, fpr_limit: float = 0.05) -> list[Column]:
    """roc_auc, average_precision, partial_auc (normalised, no correction), tpr_at_fpr over roc_points."""
    two = (F.max("total_pos") > 0) & (F.max("total_neg") > 0)
    limit = F.lit(float(max_fpr))
    width = F.col("fpr") - F.col("prev_fpr")
    at_limit = F.col("prev_tpr") + (F.col("tpr") - F.col("prev_tpr")) * F.try_divide(limit - F.col("prev_fpr"), width)
    inside = F.when(F.col("fpr") <= limit, width * (F.col("tpr") + F.col("prev_tpr")) / F.lit(2.0)).when(F.col("prev_fpr") < limit, (limit - F.col("prev_fpr")) * (F.col("prev_tpr") + at_limit) / F.lit(2.0)).otherwise(F.lit(0.0))
    won = F.col("neg").cast(D) * ((F.col("tp") - F.col("pos")).cast(D) + F.col("pos").cast(D) / F.lit(2.0))
    return [
        F.when(two, ratio(F.sum(won), F.max("total_pos").cast(D) * F.max("total_neg").cast(D))).alias("roc_auc"),
        F.when(two, ratio(F.sum(F.col("pos") * F.col("precision")), F.max("total_pos"))).alias("average_precision"),
        F.when(two, F.sum(inside) / limit).alias("partial_auc"),
        F.when(two, F.coalesce(F.max(F.when(F.col("fpr") <= F.lit(float(fpr_limit)), F.col("tpr"))), F.lit(0.0))).alias("tpr_at_fpr"),
    ]


def ranking_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str, max_fpr: float = 0.05, fpr_limit: float = 0.05, buckets: int = 64) -> DataFrame:
    """keys, roc_auc, average_precision, partial_auc, tpr_at_fpr; null for slices of one class.

    Rows travel with a slice id instead of the keys; the keys come back at the end, one row per slice.
    """
    aggregates = ranking_aggregates(max_fpr, fpr_limit)
    if not keys:
        return roc_points(df, [], label, score, buckets).agg(*aggregates)
    sliced = df.withColumn("slice_", slice_id(keys))
    found = roc_points(sliced, ["slice_"], label, score, buckets).groupBy("slice_").agg(*aggregates)
    return slice_names(sliced, keys).join(found, "slice_").drop("slice_")


def slice_names(sliced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """slice_ and the keys of each slice: a hash aggregate, which first(struct) would not be."""
    return sliced.select("slice_", *keys).distinct()


RATES = ("accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "fpr", "fnr", "mcc", "prevalence", "predicted_positive_rate")
TWO_CLASS = ("accuracy", "balanced_accuracy", "precision", "specificity", "f1", "fpr", "mcc")


def metric_slices(df: DataFrame, keys: Sequence[str], label: str = "target", score: str = "score", threshold: float = 0.0, max_fpr: float = 0.05, buckets: int = 64) -> DataFrame:
    """Status, counts, threshold rates and ranking metrics of every slice; no keys gives one row.

    Slices of positives with finite scores are ``positive_only`` and keep recall, FNR and the predicted-positive rate;
    other slices of one class are ``negative_only`` and keep nothing; two classes with a non-finite score are
    ``unscorable_non_finite_scores``. Null keys make a slice. Undefined metrics are null.
    """
    s = F.col(score).cast(D)
    odd = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(odd).alias("odd_"), *confusion(F.col(label), s, threshold))
    status = F.when((F.col("negatives") == 0) & (F.col("odd_") == 0), "positive_only").when((F.col("negatives") == 0) | (F.col("positives") == 0), "negative_only").when(F.col("odd_") > 0, "unscorable_non_finite_scores").otherwise("ok")
    base = base.withColumns(threshold_rates()).withColumn("status", status)
    ranked = ranking_metrics(df, keys, label, score, max_fpr, buckets=buckets).drop("tpr_at_fpr")
    out = same(base, ranked, keys, "left", small=True) if keys else base.crossJoin(ranked)
    ok, pos = (F.col("status") == x for x in ("ok", "positive_only"))
    shown = {c: F.when(ok, F.col(c)) for c in (*TWO_CLASS, "roc_auc", "average_precision", "partial_auc", "tn", "fp")}
    shown |= {c: F.when(ok | pos, F.col(c)) for c in ("recall", "fnr", "predicted_positive_rate", "tp", "fn")}
    return out.withColumns(shown).select(*keys, "status", "rows", "positives", "negatives", "tp", "tn", "fp", "fn", *RATES, "roc_auc", "average_precision", "partial_auc")


def normalized_average_precision(ap: Column, prevalence: Column) -> Column:
    """0 at the prevalence, 1 at perfect ranking; null unless 0 <= prevalence < 1."""
    return F.when((prevalence >= 0) & (prevalence < 1), F.try_divide(ap - prevalence, F.lit(1.0) - prevalence))


def one_against_all(df: DataFrame, label: str, positive_group: str, base: Sequence[str], output: str) -> DataFrame:
    """Every group of positives together with all negatives of its base slice; ``output`` names the group."""
    positives = df.where((F.col(label) == 1) & F.col(positive_group).isNotNull()).withColumn(output, F.col(positive_group).cast("string"))
    groups = positives.select(*base, output).distinct()
    negatives = same(df.where(F.col(label) == 0), groups, base) if base else df.where(F.col(label) == 0).crossJoin(groups)
    return positives.unionByName(negatives)


def counts_against_all(df: DataFrame, label: str, score: str, positive_group: str, base: Sequence[str], output: str, weight: str | None = None) -> DataFrame:
    """base, output, score, pos, neg: what one_against_all would count, with the negatives counted once per base slice and only
    their counts given to every group.
    """
    s = F.col(score).cast(D) + F.lit(0.0)
    none, rows = F.lit(0).cast("long"), F.sum(weight) if weight else F.count(F.lit(1))
    one = df.where((F.col(label) == 1) & F.col(positive_group).isNotNull()).groupBy(*base, F.col(positive_group).cast("string").alias(output), s.alias("score")).agg(rows.alias("pos"), none.alias("neg"))
    groups = df.where((F.col(label) == 1) & F.col(positive_group).isNotNull()).select(*base, F.col(positive_group).cast("string").alias(output)).distinct()
    rest = df.where(F.col(label) == 0).groupBy(*base, s.alias("score")).agg(none.alias("pos"), rows.alias("neg"))
    given = same(rest, groups, base) if base else rest.crossJoin(groups)
    return one.unionByName(given.select(*one.columns)).groupBy(*base, output, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def comparison_metrics(df: DataFrame, positive_group: str, negative_group: str, base: Sequence[str] = (), label: str = "target", score: str = "score", threshold: float = 0.0) -> DataFrame:
    """Each positive group against all negatives and each negative group against all positives, with mean scores."""
    both = one_against_all(df, label, positive_group, base, "comparison_group").withColumn("direction", F.lit("positive_group"))
    flipped = df.withColumn("flip_", 1 - F.col(label))
    other = one_against_all(flipped, "flip_", negative_group, base, "comparison_group").drop("flip_").withColumn("direction", F.lit("negative_group"))
    rows = both.unionByName(other)
    keys = ["direction", *base, "comparison_group"]
    means = rows.groupBy(*keys).agg(F.avg(F.when(F.col(label) == 1, F.col(score))).alias("positive_mean"), F.avg(F.when(F.col(label) == 0, F.col(score))).alias("negative_mean"))
    return same(metric_slices(rows, keys, label, score, threshold), means, keys, "left", small=True)


def average_ranks(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, score, rank (average of ties, from the least), total of counts(keys, score, n): no task holds a whole slice."""
    run = running_counts(counts.select(*keys, "score", F.col("n").alias("pos"), F.lit(0).cast("long").alias("neg")), keys)
    return run.select(*keys, "score", (F.col("total_pos") - F.col("tp") + (F.col("pos") + 1).cast(D) / F.lit(2.0)).alias("rank"), F.col("total_pos").alias("total"))


def with_rank_percentile(df: DataFrame, keys: Sequence[str], score: str, name: str) -> DataFrame:
    """df with each row's average rank over the rows of its slice (W03); null scores have none and don't count."""
    sliced = df.withColumns({"slice_": slice_id(keys), "s_": F.col(score).cast(D) + F.lit(0.0)})
    counts = sliced.where("s_ is not null").groupBy("slice_", F.col("s_").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    ranks = average_ranks(counts, ["slice_"]).select(F.col("slice_").alias("rslice_"), F.col("score").alias("rscore_"), (F.col("rank") / F.col("total").cast(D)).alias(name))
    return sliced.join(ranks, (F.col("slice_") == F.col("rslice_")) & (F.col("s_") == F.col("rscore_")), "left").drop("slice_", "s_", "rslice_", "rscore_")


def threshold_at_fpr(df: DataFrame, keys: Sequence[str], label: str, score: str, fpr: float = 0.05) -> DataFrame:
    """keys, threshold: the (1 - fpr) quantile of the negatives' scores, next higher value; null scores are left out."""
    sliced = df.where((F.col(label) == 0) & F.col(score).isNotNull()).withColumn("slice_", slice_id(keys))
    counts = sliced.groupBy("slice_", (F.col(score).cast(D) + F.lit(0.0)).alias("score")).agg(F.count(F.lit(1)).alias("pos"), F.lit(0).cast("long").alias("neg"))
    run = running_counts(counts, ["slice_"]).select("slice_", "score", (F.col("total_pos") - F.col("tp") + F.col("pos")).alias("upto"), F.col("total_pos").alias("all_"))
    need = F.ceil(F.lit(1.0 - fpr) * (F.col("all_") - 1).cast(D) - F.lit(1e-9)) + 1
    found = run.where(F.col("upto") >= need).groupBy("slice_").agg(F.min("score").alias("threshold"))
    return slice_names(sliced, keys).join(found, "slice_").drop("slice_") if keys else found.drop("slice_")
