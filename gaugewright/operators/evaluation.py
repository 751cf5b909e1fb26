"""Evaluation tables over long feature rows and prediction rows: distributions, drift, degradation, directions, ledger.

Wide feature rows are unpivoted once into (keys, feature, value); every table below is then a few grouped passes over that
shape for all features together, never a loop over features.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.operators.ranking import average_ranks, count_points, counted, counts_against_all, metric_slices, normalized_average_precision, one_against_all, ranking_aggregates, ranking_metrics, ratio, running_counts, same, score_bucket, score_counts, slice_id, slice_names

D = "double"
WINDOW_COLUMNS = ("chronological_window", "generator_window", "release_window", "time_window", "window")


def long_features(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """keys, feature, value."""
    return df.select(*keys, *[F.col(f).cast(D).alias(f) for f in features]).unpivot(list(keys), list(features), "feature", "value")


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation, null for a constant side (corr divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def score_distributions(df: DataFrame, keys: Sequence[str], scores: Sequence[str], target: str = "target") -> DataFrame:
    """Count, mean, population deviation, median, 5th and 95th percentile of each score by slice and class."""
    rows = long_features(df, [*keys, target], scores).withColumnRenamed("feature", "score_column")
    rows = rows.withColumn("value", F.when(finite("value"), F.col("value")).otherwise(F.raise_error(F.lit("a score distribution holds a non-finite value")).cast(D)))
    return _distribution(rows, [*keys, target, "score_column"]).withColumn("class_name", F.when(F.col(target) == 1, "aigc").otherwise("authentic"))


def _distribution(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("standard_deviation"), p.alias("p_"))
    return out.select(*keys, "rows", "mean", "standard_deviation", F.col("p_")[1].alias("median"), F.col("p_")[0].alias("p05"), F.col("p_")[2].alias("p95"))


def stacked_slices(df: DataFrame, slices: dict[str, Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """Each row once per slice set: slice_type and the set's columns, others null (the grouping-set exploder of A09, K05)."""
    variants = [F.struct(F.lit(name).alias("slice_type"), *[(F.col(c) if c in own else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in columns]) for name, own in slices.items()]
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(*variants)).alias("s_")).select(*rest, "s_.*")


def distribution_tables(df: DataFrame, slices: dict[str, Sequence[str]], scores: Sequence[str], target: str = "target") -> DataFrame:
    """Named slice sets of score distributions in one shuffle."""
    columns = list(dict.fromkeys(c for own in slices.values() for c in own))
    return score_distributions(stacked_slices(df.select(*columns, target, *scores), slices, columns), ["slice_type", *columns], scores, target)


def metric_tables(df: DataFrame, slices: dict[str, Sequence[str]], label: str = "target", score: str = "score", threshold: float = 0.0) -> DataFrame:
    """Named slice sets of metric_slices in one pass."""
    columns = list(dict.fromkeys(c for own in slices.values() for c in own))
    return metric_slices(stacked_slices(df.select(*columns, label, score), slices, columns), ["slice_type", *columns], label, score, threshold)


def paired(df: DataFrame, keys: Sequence[str], score: str, condition: str = "condition", target: str = "target") -> DataFrame:
    """Transformed rows with the clean score of their parent (J03). Rows without one, or of another target, are kept with nulls."""
    clean = df.where(F.col(condition) == "clean").select(*keys, F.col(score).alias("clean_score"), F.col(target).alias("clean_target"))
    return same(df.where(F.col(condition) != "clean"), clean, keys, "left")


def pairing_violations(df: DataFrame, keys: Sequence[str], score: str, condition: str = "condition", target: str = "target") -> DataFrame:
    """rule, key of duplicate clean rows, unmatched transformed rows and disagreeing targets."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    twice = df.where(F.col(condition) == "clean").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_clean").alias("rule"), key.alias("key"))
    joined = paired(df, keys, score, condition, target)
    lone = joined.where(F.col("clean_target").isNull()).select(F.lit("unmatched_endpoint").alias("rule"), key.alias("key"))
    other = joined.where(F.col("clean_target") != F.col(target)).select(F.lit("target_mismatch").alias("rule"), key.alias("key"))
    return twice.unionByName(lone).unionByName(other)


def drift_aggregates(score: str, target: str, threshold: float = 0.0) -> list[Column]:
    s, c, t = F.col(score).cast(D), F.col("clean_score").cast(D), F.lit(float(threshold))
    was, now = (c >= t) == (F.col(target) == 1), (s >= t) == (F.col(target) == 1)
    share = lambda x: F.avg(x.cast("int").cast(D))
    return [
        F.count(F.lit(1)).alias("pairs"), F.avg(s - c).alias("mean_score_drift"), F.avg(F.abs(s - c)).alias("mean_absolute_score_drift"),
        share((c >= t) != (s >= t)).alias("prediction_flip_rate"), share(was & ~now).alias("correct_to_incorrect_rate"), share(~was & now).alias("incorrect_to_correct_rate"),
    ]


def endpoint_drift(df: DataFrame, keys: Sequence[str] = ("dataset_id", "parent_id"), by: Sequence[str] = ("dataset_id", "condition", "transform_family"), score: str = "logit", target: str = "target", threshold: float = 0.0) -> DataFrame:
    """Score and correctness changes against the clean endpoint."""
    return paired(df, keys, score, target=target).where(F.col("clean_score").isNotNull()).groupBy(*by).agg(*drift_aggregates(score, target, threshold))


def lineage_drift(df: DataFrame, keys: Sequence[str] = ("dataset_id", "lineage_id"), by: Sequence[str] = ("dataset_id", "condition", "transform_family"), score: str = "logit", target: str = "target", threshold: float = 0.0, endpoint: str = "endpoint_class") -> DataFrame:
    """Drift of transformed lineage peers with their Pearson correlation."""
    clean = df.where(F.col(endpoint) == "clean").select(*keys, F.col(score).alias("clean_score"))
    joined = same(df.where(F.col(endpoint) == "transformed"), clean, keys)
    return joined.groupBy(*by).agg(*drift_aggregates(score, target, threshold), pearson(F.col("clean_score").cast(D), F.col(score).cast(D)).alias("clean_transformed_pearson"))


def clean_drops(metrics: DataFrame, keys: Sequence[str], values: Sequence[str], condition: str = "condition") -> DataFrame:
    """Clean minus condition for each metric (A14, J09). A slice without a clean row raises when its rows are read."""
    clean = metrics.where(F.col(condition) == "clean").select(*keys, *[F.col(v).alias(f"clean_{v}") for v in values])
    joined = same(metrics.where(F.col(condition) != "clean"), clean.withColumn("has_clean_", F.lit(True)), keys, "left")
    absent = F.raise_error(F.concat(F.lit("no clean row for "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))).cast(D)
    drop = lambda v: F.when(F.col("has_clean_").isNull(), absent).otherwise(F.col(f"clean_{v}") - F.col(v))
    return joined.select(*keys, condition, *values, *[drop(v).alias(f"{v}_drop") for v in values])


def profiles(rows: DataFrame, key: Sequence[str], kept: Sequence[str], inputs: Sequence[str], distinct: bool = False) -> DataFrame:
    """kept, rows_ (the rows of a key and kept in order, as structs of ``inputs``; each once if ``distinct``), n_ (keys with just
    these rows). What is later made of the rows is then made once, whatever the number of equal keys. One exchange brings a key's
    rows together, by two hashes, before they are expanded to anything.
    """
    ids = [x for c in key for x in (F.col(c), F.col(c).isNull())]
    moved = rows.select(F.xxhash64(*ids).alias("k1_"), F.xxhash64(F.lit(1), *ids).alias("k2_"), *kept, *inputs).repartition("k1_", "k2_")
    gather = F.collect_set if distinct else F.collect_list
    each = moved.groupBy("k1_", "k2_", *kept).agg(F.sort_array(gather(F.struct(*inputs))).alias("rows_"))
    return each.groupBy(*kept, "rows_").agg(F.count(F.lit(1)).alias("n_"))


def feature_drift(rows: DataFrame, directions: DataFrame, by: Sequence[str] = ("view", "condition", "feature", "target", "transform_family", "official_transform"), medians: Sequence[str] = ("signed", "absolute", "within")) -> DataFrame:
    """Oriented condition-minus-clean drift of parents (A10, J01, J02). rows: parent_id, view, target, condition, feature, value and
    by, which includes view, feature and target. One exchange brings a parent's rows together; the medians are exact. Where the rows
    are made from narrower ones, ``drift_of_profiles`` moves only those.
    """
    parent = ["parent_id", "view", "target", "feature"]
    named = rows.join(F.broadcast(_local(directions)), ["view", "feature"]).withColumn("slice_", slice_id([*by, "direction"]))
    names = named.where(F.col("condition") != "clean").select("slice_", *by, "direction").distinct()
    # Numbers alone travel: two hashes of the parent, one of the slice.
    key = [x for c in parent for x in (F.col(c), F.col(c).isNull())]
    moved = named.select(F.xxhash64(*key).alias("k1_"), F.xxhash64(F.lit(1), *key).alias("k2_"), "slice_", F.col("parent_id").isNotNull().alias("has_"), (F.col("condition") == "clean").alias("clean_"), "value", F.col("direction").cast(D).alias("sign_"))
    order = Window.partitionBy("k1_", "k2_").orderBy("slice_")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = moved.withColumns({"clean_value": F.avg(F.when(F.col("clean_"), F.col("value"))).over(whole), "within": F.var_pop("value").over(whole), "first_": F.coalesce(F.lag("slice_").over(order) != F.col("slice_"), F.lit(True)) & F.col("has_")})
    fine = told.where(~F.col("clean_") & finite("value") & finite("clean_value") & finite("within"))
    signed = fine.select("slice_", "first_", "within", F.lit(1).cast("long").alias("n_"), (F.col("sign_") * (F.col("value") - F.col("clean_value")) + F.lit(0.0)).alias("signed"))
    return _drift_table(signed, names, medians)


def drift_of_profiles(parents: DataFrame, slots: Sequence[dict], conditions: Sequence[str], value: Callable[[dict, str], Column], medians: Sequence[str] = ("signed", "absolute", "within")) -> DataFrame:
    """feature_drift of rows that are made from ``profiles`` of parents: has_ (there is a parent), target, rows_, n_.

    Each slot is a view, feature and direction; value(slot, condition) is its value in the fields of rows_. Each row has all
    conditions or, where its value is null, none. A parent's clean mean, variance and first row come from sums over its rows.
    """
    own, n = ["has_", "target", "rows_", "n_"], len(conditions)
    lines = parents.select(*own, F.posexplode("rows_").alias("at_", "r_")).select(*own, "at_", "r_.*")
    values = lines.select(*own, "at_", *[F.array(*[value(s, c) for c in conditions]).alias(f"v{i}") for i, s in enumerate(slots)])
    all_ = lambda i: [F.col(f"v{i}")[k] for k in range(n)]
    means = values.withColumns({f"m{i}": sum(all_(i)[1:], all_(i)[0]) / float(n) for i in range(len(slots))})
    told = []
    for i in range(len(slots)):
        mean = F.col(f"m{i}")
        off = [(v - mean) * (v - mean) for v in all_(i)]
        clean = F.avg(F.col(f"v{i}")[list(conditions).index("clean")])
        told.append(F.struct(clean.alias("clean"), (F.avg(sum(off[1:], off[0]) / float(n)) + F.var_pop(mean)).alias("within"), F.min(F.when(mean.isNotNull(), F.col("at_"))).alias("first")))
    sums = means.groupBy(*own).agg(F.array(*told).alias("told_")).persist()
    number = lambda i, k: F.xxhash64(i, k, F.col("target"), F.col("target").isNull())
    others = [c for c in conditions if c != "clean"]
    rows = sums.select("has_", "target", "n_", "told_", F.posexplode("rows_").alias("at_", "r_")).select("has_", "target", "n_", "told_", "at_", "r_.*")
    made = [F.struct(F.lit(i).alias("i"), F.lit(float(s["direction"])).alias("sign"), F.col("told_")[i].alias("t"), F.array(*[value(s, c) for c in others]).alias("v")) for i, s in enumerate(slots)]
    each = rows.select("has_", "target", "n_", "at_", F.explode(F.array(*made)).alias("s")).where(finite("s.t.clean") & finite("s.t.within"))
    each = each.select("target", "n_", "s.i", "s.sign", "s.t.clean", "s.t.within", (F.col("has_") & (F.col("at_") == F.col("s.t.first"))).alias("first_"), F.posexplode("s.v").alias("k", "v")).where(finite("v"))
    signed = each.select(number(F.col("i"), F.col("k")).alias("slice_"), "first_", "within", "n_", (F.col("sign") * (F.col("v") - F.col("clean")) + F.lit(0.0)).alias("signed"))
    named = [F.struct(number(F.lit(i), F.lit(k)).alias("slice_"), *[F.lit(x).alias(c) for c, x in s.items()], F.lit(c).alias("condition")) for i, s in enumerate(slots) for k, c in enumerate(others)]
    names = sums.select("target").distinct().select("target", F.explode(F.array(*named)).alias("s")).select("s.*", "target")
    return _drift_table(signed, names, medians)


def _drift_table(signed: DataFrame, names: DataFrame, medians: Sequence[str]) -> DataFrame:
    """names (slice_ and what names a slice) with the slice's drift. signed: slice_, signed, within, first_ (of a parent in its slice), n_
    (so many equal rows).
    """
    out = names.join(F.broadcast(_drift_points(signed)), "slice_")
    others = {m: (n, v) for m, n, v in (("absolute", "absolute_drift_median", F.abs("signed")), ("within", "within_parent_transform_variance_median", F.col("within"))) if m in medians}
    if others:
        out = out.join(exact_medians(signed, "slice_", dict(others.values()), "n_"), "slice_")
    return (out if "signed" in medians else out.drop("signed_drift_median")).drop("slice_")


def _drift_points(signed: DataFrame, buckets: int = 64) -> DataFrame:
    """slice_ and its counts, moments and median of the column ``signed``.

    Sums by bucket of value are all that is exchanged for the moments, with deviations from the bucket's edge, so that nothing
    cancels. The values of the one or two buckets that hold the median's ranks are then counted one by one.
    """
    b = F.col("b_")
    put = signed.withColumn("b_", score_bucket(F.col("signed"), buckets))
    far = F.abs(b).cast(D)
    edge = F.signum(b.cast(D)) * F.when(far <= buckets, far / F.lit(float(buckets))).otherwise(F.exp((far - buckets) / F.lit(buckets / 8.0)))
    n, off = F.col("n_"), F.col("signed") - F.col("edge_")
    shifted = put.withColumn("edge_", edge)
    held = shifted.groupBy("slice_", "b_", "edge_").agg(
        F.sum(n).alias("count_"), F.sum(F.when(F.col("first_"), n).otherwise(F.lit(0))).alias("parents_"), F.sum(n * F.col("within")).alias("within_"),
        F.sum(n * F.abs("signed")).alias("size_"), F.sum(n * off).alias("d1_"), F.sum(n * off * off).alias("d2_"),
    )
    slice_ = Window.partitionBy("slice_")
    count, middle = F.col("count_"), F.col("edge_") + F.try_divide(F.col("d1_"), F.col("count_").cast(D))
    told = held.withColumns({"total_": F.sum(count).over(slice_), "mean_": ratio(F.sum(count * middle).over(slice_), F.sum(count).over(slice_)), "upto_": F.sum(count).over(slice_.orderBy("b_")), "m_": middle})
    away = F.col("m_") - F.col("mean_")
    spread = F.greatest(F.col("d2_") - F.col("d1_") * F.try_divide(F.col("d1_"), count.cast(D)), F.lit(0.0)) + count * away * away
    moments = told.groupBy("slice_").agg(
        F.sum("parents_").alias("paired_parents"), F.max("mean_").alias("signed_drift_mean"), F.sqrt(ratio(F.sum(spread), F.max("total_"))).alias("signed_drift_std"),
        ratio(F.sum("size_"), F.max("total_")).alias("absolute_drift_mean"), ratio(F.sum("within_"), F.max("total_")).alias("within_parent_transform_variance_mean"),
    )
    low, high = F.expr("(total_ + 1) div 2"), F.expr("total_ div 2 + 1")
    middles = told.where((F.col("upto_") >= low) & (F.col("upto_") - count < high)).select("slice_", "b_", (F.col("upto_") - count).alias("before_"), "total_")
    near = put.join(F.broadcast(middles), ["slice_", "b_"]).groupBy("slice_", "b_", "before_", "total_", "signed").agg(F.sum("n_").alias("n_"))
    last = F.col("before_") + F.sum("n_").over(Window.partitionBy("slice_", "b_").orderBy("signed"))
    ranked = near.withColumn("last_", last)
    at = lambda rank: F.max(F.when((rank > F.col("last_") - F.col("n_")) & (rank <= F.col("last_")), F.col("signed")))
    return moments.join(ranked.groupBy("slice_").agg(((at(low) + at(high)) / 2.0).alias("signed_drift_median")), "slice_")


def exact_medians(df: DataFrame, slice_: str, values: dict[str, Column], weight: str | None = None) -> DataFrame:
    """slice_ and the exact median of each value: counts by value, running counts, and the one or two values in the middle. A row
    counts ``weight`` times.
    """
    long = df.select(F.col(slice_), (F.col(weight) if weight else F.lit(1).cast("long")).alias("w_"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (v.cast(D) + F.lit(0.0)).alias("v")) for k, v in enumerate(values.values())])).alias("x"))
    counts = long.where(F.col("x.v").isNotNull()).groupBy(F.xxhash64(slice_, "x.k").alias("s_"), F.col(slice_).alias("own_"), F.col("x.k").alias("k"), F.col("x.v").alias("score")).agg(F.sum("w_").alias("pos"))
    names = counts.groupBy("s_", "own_", "k").agg(F.sum("pos").alias("n_"))
    run = running_counts(counts.select("s_", "score", "pos", F.lit(0).cast("long").alias("neg")), ["s_"])
    low, high = F.col("total_pos") - F.col("tp") + 1, F.col("total_pos") - F.col("tp") + F.col("pos")  # ranks, from the least
    at = lambda rank: F.max(F.when((rank >= low) & (rank <= high), F.col("score")))
    half = run.groupBy("s_").agg(at(F.expr("(total_pos + 1) div 2")).alias("a_"), at(F.expr("total_pos div 2 + 1")).alias("b_"))
    found = names.where("n_ > 0").join(half, "s_").groupBy("own_").agg(*[F.max(F.when(F.col("k") == k, (F.col("a_") + F.col("b_")) / 2.0)).alias(n) for k, n in enumerate(values)])
    return found.withColumnRenamed("own_", slice_)


def learned_directions(rows: DataFrame, keys: Sequence[str] = ("view", "feature"), target: str = "target", weight: str | None = None) -> DataFrame:
    """AP of value and of -value; the better sign, +1 on ties (M23). rows: the discovery phase's clean long rows, each of which
    counts ``weight`` times.
    """
    fine = rows.withColumn("own_", slice_id(keys))
    counts = score_counts(fine, ["own_"], target, "value", weight)
    run = running_counts(counts, ["own_"])
    # Read from below, the same running counts are those of the negated values.
    up, fp = F.col("total_pos") - F.col("tp") + F.col("pos"), F.col("total_neg") - F.col("fp") + F.col("neg")
    two = (F.max("total_pos") > 0) & (F.max("total_neg") > 0)
    ap_of = lambda t, f: F.when(two, ratio(F.sum(F.col("pos") * ratio(t, t + f)), F.max("total_pos")))
    found = run.groupBy("own_").agg(ap_of(F.col("tp"), F.col("fp")).alias("forward_auprc"), ap_of(up, fp).alias("reverse_auprc"))
    ap = slice_names(fine.withColumn("slice_", F.col("own_")), keys).withColumnRenamed("slice_", "own_").join(found, "own_", "left").drop("own_")
    times = F.col(weight) if weight else F.lit(1)
    prevalence = rows.groupBy(*keys).agg(ratio(F.sum(F.col(target) * times), F.sum(F.when(F.col(target).isNotNull(), times))).alias("positive_prevalence"))
    out = same(ap, prevalence, keys, small=True)
    best = F.greatest("forward_auprc", "reverse_auprc")
    return out.withColumns({"selected_auprc": best, "normalized_auprc": normalized_average_precision(best, F.col("positive_prevalence")), "direction": F.when(F.col("forward_auprc") >= F.col("reverse_auprc"), 1).otherwise(-1)})


def univariate_metrics(rows: DataFrame, directions: DataFrame, by: Sequence[str], min_group: int = 20, target: str = "target", parent: str = "parent_id", weight: str | None = None, parents: DataFrame | None = None) -> DataFrame:
    """Oriented AP, prevalence, gain, counts, low power and reversal of each feature in each group.

    ``directions`` is a table of the registry's size, a row per view and feature, and is broadcast; ``by`` includes view. A row
    counts ``weight`` times; as such rows name no parent, ``parents`` (``parents_of_profiles``) then has their numbers.
    """
    fine = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col(target).isNotNull()).join(F.broadcast(_local(directions)), ["view", "feature"])
    fine = fine.withColumns({"slice_": _slice(by), "oriented": F.col("value") * F.col("direction")})
    s = F.col("oriented").cast(D) + F.lit(0.0)
    counts = fine.groupBy("slice_", s.alias("score")).agg(counted(F.col(target) == 1, weight).alias("pos"), counted(F.col(target) == 0, weight).alias("neg"))
    return _univariate(slice_names(fine, [*by, "feature", "direction"]), counts, _parents(fine, by, parent) if parents is None else parents, min_group)


def _local(directions: DataFrame) -> DataFrame:
    """view, feature, direction, number_ of the registry's features: read once, as plans use them several times."""
    rows = directions.select("view", "feature", "direction").orderBy("view", "feature").collect()
    kinds = {f.name: f.dataType.simpleString() for f in directions.schema}
    return directions.sparkSession.createDataFrame([(*r, n) for n, r in enumerate(rows)], ", ".join(f"{c} {kinds[c]}" for c in ("view", "feature", "direction")) + ", number_ int")


def _slice(by: Sequence[str]) -> Column:
    return F.xxhash64(slice_id(by), F.col("number_"))


def _parents(fine: DataFrame, by: Sequence[str], parent: str) -> DataFrame:
    """slice_, parents: distinct parents of each feature and group. A parent's features lie side by side; so they become bits of a
    row's mask before anything moves, and equal masks are counted.
    """
    bit = F.expr("shiftleft(1L, cast(number_ % 60 as int))")
    rows = fine.where(F.col(parent).isNotNull()).select(slice_id(by).alias("by_"), F.expr("number_ div 60").alias("block_"), F.xxhash64(parent).alias("parent_"), bit.alias("bit_"))
    masks = rows.groupBy("by_", "block_", "parent_").agg(F.bit_or("bit_").alias("mask_")).groupBy("by_", "block_", "mask_").agg(F.count(F.lit(1)).alias("n_"))
    each = masks.select("by_", "block_", "mask_", "n_", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("at_")).where(F.expr("getbit(mask_, at_) = 1"))
    numbered = each.select(F.xxhash64("by_", (F.col("block_") * 60 + F.col("at_")).cast("int")).alias("slice_"), "n_")
    return numbered.groupBy("slice_").agg(F.sum("n_").alias("parents"))


def parents_of_profiles(parents: DataFrame, by: Sequence[str], features: Sequence[str], which: Column | None = None) -> DataFrame:
    """by, feature, parents: distinct parents of each feature and group. parents: ``profiles`` of parents; rows_ holds by and mask_,
    with a bit for each of ``features`` (63 at most) that the row has. ``which`` chooses rows.
    """
    rows = parents.select("rows_", "n_", F.explode("rows_").alias("r_")).select("rows_", "n_", "r_.*")
    rows = rows if which is None else rows.where(which)
    masks = rows.groupBy("rows_", "n_", *by).agg(F.bit_or("mask_").alias("mask_")).groupBy(*by, "mask_").agg(F.sum("n_").alias("n_"))
    bits = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(1 << k).cast("long").alias("bit")) for k, f in enumerate(features)])
    each = masks.select(*by, "mask_", "n_", F.explode(bits).alias("b_")).where(F.col("mask_").bitwiseAND(F.col("b_.bit")) != 0)
    return each.groupBy(*by, "b_.feature").agg(F.sum("n_").alias("parents"))


def feature_mask(features: Sequence[str], *needed: str) -> Column:
    """mask_ of ``parents_of_profiles``: a bit for each feature that is neither null nor NaN; none where a needed column is null."""
    there = F.lit(True)
    for c in needed:
        there = there & F.col(c).isNotNull()
    return sum((F.when(there & F.col(f).isNotNull() & ~F.isnan(f), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, f in enumerate(features)), F.lit(0).cast("long"))


def _univariate(names: DataFrame, counts: DataFrame, parents: DataFrame, min_group: int) -> DataFrame:
    """The table from its slices' names, counts(slice_, score, pos, neg) and parents (by slice_, or by some of its names)."""
    sizes = counts.groupBy("slice_").agg(F.sum("neg").alias("n_real"), F.sum("pos").alias("n_aigc"))
    # Not filtered but emptied, so that both uses of the counts read one exchange.
    odd = F.abs("score") == float("inf")
    finite_counts = counts.select("slice_", F.when(odd, F.lit(0.0)).otherwise(F.col("score")).alias("score"), *[F.when(odd, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in ("pos", "neg")])
    points = count_points(finite_counts, ["slice_"])
    ap = points.groupBy("slice_").agg(*ranking_aggregates()).select("slice_", F.col("average_precision").alias("oriented_auprc"))
    prevalence = ratio("n_aigc", F.col("n_real") + F.col("n_aigc"))
    out = same(names.join(sizes, "slice_").join(ap, "slice_", "left"), parents, [c for c in parents.columns if c != "parents"], "left", small=True).fillna(0, ["parents"]).drop("slice_").withColumn("positive_prevalence", prevalence)
    return out.withColumns({
        "auprc_gain": F.col("oriented_auprc") - F.col("positive_prevalence"),
        "normalized_auprc": normalized_average_precision(F.col("oriented_auprc"), F.col("positive_prevalence")),
        "low_power": F.least("n_real", "n_aigc") < min_group,
        "direction_reversal": F.coalesce(F.col("oriented_auprc") < F.col("positive_prevalence"), F.lit(False)),
    })


def generator_metrics(rows: DataFrame, directions: DataFrame, group: str = "generation_model", base: Sequence[str] = ("view", "dataset"), min_group: int = 20, target: str = "target", parent: str = "parent_id", weight: str | None = None, parents: DataFrame | None = None) -> DataFrame:
    """univariate_metrics of each generator's positives with all authentic rows of its dataset.

    Authentic rows are counted once per base slice; only their counts, and their number of parents, are given to every
    generator. A parent is either authentic or generated. With ``weight``, ``parents`` are ``profiles`` whose rows_ hold target,
    base (but view), group and mask_, the bits in the order of the features' names.
    """
    name, by = "comparison_generator", [*base, "comparison_generator"]
    fine = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).join(F.broadcast(_local(directions)), ["view", "feature"]).withColumn("oriented", F.col("value") * F.col("direction"))
    keyed = [*base, "feature", "direction", "number_"]
    counts = counts_against_all(fine, target, "oriented", group, keyed, name, weight).withColumn("slice_", _slice(by))
    made = fine.where((F.col(target) == 1) & F.col(group).isNotNull()).withColumn(name, F.col(group).cast("string"))
    named = made.withColumn("slice_", _slice(by)).select("slice_", *by, "feature", "direction", "number_").distinct()
    if parents is not None:
        features, dims = sorted(r[0] for r in directions.select("feature").distinct().collect()), [c for c in base if c != "view"]
        own = parents_of_profiles(parents, [*dims, group], features, (F.col(target) == 1) & F.col(group).isNotNull()).select(*dims, F.col(group).cast("string").alias(name), "feature", F.col("parents").alias("own_"))
        shared = parents_of_profiles(parents, dims, features, F.col(target) == 0).withColumnRenamed("parents", "shared_")
        both = same(same(named.select(*dims, name, "feature").distinct(), own, [*dims, name, "feature"], "left", small=True), shared, [*dims, "feature"], "left", small=True)
        return _univariate(named.drop("number_"), counts.select("slice_", "score", "pos", "neg"), both.select(*dims, name, "feature", (F.coalesce("own_", F.lit(0)) + F.coalesce("shared_", F.lit(0))).alias("parents")), min_group)
    own = _parents(made, by, parent).select(F.col("slice_"), F.col("parents").alias("own_"))
    shared = _parents(fine.where(F.col(target) == 0), base, parent).select(F.col("slice_").alias("base_"), F.col("parents").alias("shared_"))
    parents = named.withColumn("base_", _slice(base)).join(own, "slice_", "left").join(shared, "base_", "left").select("slice_", (F.coalesce("own_", F.lit(0)) + F.coalesce("shared_", F.lit(0))).alias("parents"))
    return _univariate(named.drop("number_"), counts.select("slice_", "score", "pos", "neg"), parents, min_group)


def generator_rows(rows: DataFrame, group: str = "generation_model", base: Sequence[str] = ("view", "dataset"), target: str = "target") -> DataFrame:
    """Each generator's positives with all authentic rows of its dataset."""
    return one_against_all(rows, target, group, base, "comparison_generator")


def window_column(df: DataFrame) -> str | None:
    """The first chronological column there is."""
    return next((c for c in WINDOW_COLUMNS if c in df.columns), None)


def chronological_metrics(rows: DataFrame, directions: DataFrame, min_group: int = 20) -> DataFrame | None:
    """Frozen directions by window over confirmation phases (A19); None without a window column."""
    name = window_column(rows)
    if name is None:
        return None
    kept = rows.where(F.col("phase").isin("confirmation", "final_confirmation") & F.col(name).isNotNull()).withColumn("chronological_window_", F.col(name).cast("string")).drop(name).withColumnRenamed("chronological_window_", "chronological_window")
    return univariate_metrics(kept, directions, ["phase", "view", "condition", "chronological_window"], min_group).withColumn("window_column", F.lit(name))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, spearman: Pearson of average ranks over rows where both are there; 0 for constant columns.

    Ranks come from counts by value, and pairs of values are counted before they meet their ranks.
    """
    both = df.where(F.col(x).isNotNull() & ~F.isnan(x) & F.col(y).isNotNull() & ~F.isnan(y)).withColumn("slice_", slice_id(keys))
    pairs = both.groupBy("slice_", F.col(x).cast(D).alias("x_"), F.col(y).cast(D).alias("y_")).agg(F.count(F.lit(1)).alias("n_"))

    def ranks(c: str) -> DataFrame:
        counts = pairs.groupBy("slice_", F.col(c).alias("score")).agg(F.sum("n_").alias("n"))
        return average_ranks(counts, ["slice_"]).select("slice_", F.col("score").alias(c), (F.col("rank") - (F.col("total") + 1).cast(D) / F.lit(2.0)).alias(f"r{c}"))

    joined = pairs.join(ranks("x_").hint("merge"), ["slice_", "x_"]).join(ranks("y_").hint("merge"), ["slice_", "y_"])
    total = lambda a, b: F.sum(F.col("n_") * F.col(a) * F.col(b))
    value = F.try_divide(total("rx_", "ry_"), F.sqrt(total("rx_", "rx_")) * F.sqrt(total("ry_", "ry_")))
    found = joined.groupBy("slice_").agg(F.coalesce(value, F.lit(0.0)).alias("spearman"))
    return slice_names(both, keys).join(found, "slice_").drop("slice_")


def shortcut_correlations(df: DataFrame, keys: Sequence[str], candidates: Sequence[str], nuisances: Sequence[str]) -> DataFrame:
    """Each candidate's strongest nuisance by absolute Spearman, first in order on ties."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.lit(n).alias("nuisance"), F.lit(k).alias("place"), F.col(c).cast(D).alias("x"), F.col(n).cast(D).alias("y")) for c in candidates for k, n in enumerate(nuisances)]
    long = df.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.*")
    rho = spearman(long, [*keys, "feature", "nuisance", "place"], "x", "y")
    best = rho.groupBy(*keys, "feature").agg(F.max(F.struct(F.abs("spearman").alias("size"), (-F.col("place")).alias("first"), "nuisance", "spearman")).alias("b"))
    return best.select(*keys, "feature", F.col("b.nuisance").alias("strongest_nuisance"), F.col("b.spearman").alias("nuisance_spearman"), F.col("b.size").alias("max_abs_nuisance_spearman"))


def auprc_drops(metrics: DataFrame, registry: DataFrame) -> DataFrame:
    """Clean minus condition AP for official single-step conditions (A15, J10), with the condition's parents, low_power and
    direction_reversal. metrics: what univariate_metrics gives by view and condition.
    """
    single = registry.where("official and step_count = 1").select(F.col("name").alias("condition"), F.col("family").alias("transform_family"), "severity")
    clean = metrics.where("condition = 'clean'").select("view", "feature", F.col("oriented_auprc").alias("clean_auprc"))
    out = metrics.drop("transform_family", "severity").join(F.broadcast(single), "condition").join(clean, ["view", "feature"])
    return out.select("view", "feature", "direction", "condition", "transform_family", "severity", "clean_auprc", F.col("oriented_auprc").alias("condition_auprc"), (F.col("clean_auprc") - F.col("oriented_auprc")).alias("auprc_drop"), "parents", "low_power", "direction_reversal")


def severity_areas(drops: DataFrame) -> DataFrame:
    """Normalised trapezoid area through (0, clean) and the severities (A16, W09); needs two positive distinct ones."""
    keys = ["view", "feature", "transform_family"]
    w = Window.partitionBy(*keys).orderBy("severity")
    x0, y0 = F.coalesce(F.lag("severity").over(w), F.lit(0.0)), F.coalesce(F.lag("condition_auprc").over(w), F.col("clean_auprc"))
    parts = drops.withColumn("area_", (F.col("severity") - x0) * (F.col("condition_auprc") + y0) / F.lit(2.0))
    out = parts.groupBy(*keys).agg(
        F.max("direction").alias("direction"), F.count(F.lit(1)).alias("severity_conditions"), F.max("severity").alias("max_severity"), F.max("clean_auprc").alias("clean_auprc"), F.sum("area_").alias("area_"),
        F.min("condition_auprc").alias("worst_condition_auprc"), F.max("auprc_drop").alias("worst_auprc_drop"), F.min("severity").alias("least_"), F.count_distinct("severity").alias("distinct_"),
    ).where("severity_conditions >= 2 and least_ > 0 and distinct_ = severity_conditions")
    area = F.col("area_") / F.col("max_severity")
    return out.withColumns({"normalized_severity_auprc_area": area, "normalized_severity_auprc_drop_area": F.col("clean_auprc") - area}).drop("area_", "least_", "distinct_")


def pair_interactions(metrics: DataFrame, registry: DataFrame) -> DataFrame:
    """A pair's drop beyond the sum of its single steps' drops."""
    singles = registry.where("step_count = 1").select("canonical_recipe", "name")
    pairs = registry.where("design = 'directed_medium_pair' and step_count = 2").select(F.col("name").alias("pair_condition"), F.col("operations")[0].alias("first_operation"), F.col("operations")[1].alias("second_operation"), F.col("step_recipes")[0].alias("r1"), F.col("step_recipes")[1].alias("r2"))
    for k, name in (("r1", "first_single_condition"), ("r2", "second_single_condition")):
        pairs = pairs.join(singles.select(F.col("canonical_recipe").alias(k), F.col("name").alias(name)), k).drop(k)
    m = metrics.select("view", "feature", "condition", F.col("oriented_auprc").alias("v"), "direction")
    value = lambda on, name: m.select("view", "feature", F.col("condition").alias(on), F.col("v").alias(name))
    out = m.select("view", "feature", "direction", F.col("condition").alias("pair_condition"), F.col("v").alias("pair_auprc")).join(F.broadcast(pairs), "pair_condition")
    out = out.join(m.where("condition = 'clean'").select("view", "feature", F.col("v").alias("clean_auprc")), ["view", "feature"])
    out = out.join(value("first_single_condition", "first_single_auprc"), ["view", "feature", "first_single_condition"]).join(value("second_single_condition", "second_single_auprc"), ["view", "feature", "second_single_condition"])
    drop = lambda c: F.col("clean_auprc") - F.col(c)
    out = out.withColumns({"first_single_auprc_drop": drop("first_single_auprc"), "second_single_auprc_drop": drop("second_single_auprc"), "pair_auprc_drop": drop("pair_auprc")})
    return out.withColumn("interaction_excess_auprc_drop", F.col("pair_auprc_drop") - F.col("first_single_auprc_drop") - F.col("second_single_auprc_drop"))


def order_sensitivity(interactions: DataFrame, registry: DataFrame) -> DataFrame:
    """A then B against B then A, by reversed recipe."""
    pairs = registry.where("design = 'directed_medium_pair'")
    turned = pairs.select(F.col("name").alias("ab"), F.col("reversed_recipe").alias("r")).join(pairs.select(F.col("name").alias("ba"), F.col("canonical_recipe").alias("r")), "r").where("ab < ba").drop("r")
    pick = ["view", "feature", "pair_condition", "pair_auprc", "interaction_excess_auprc_drop"]
    a = interactions.select(*pick, "direction", F.col("first_operation").alias("operation_a"), F.col("second_operation").alias("operation_b")).withColumnsRenamed({"pair_condition": "ab", "pair_auprc": "auprc_a_then_b", "interaction_excess_auprc_drop": "interaction_excess_a_then_b"})
    b = interactions.select(*pick).withColumnsRenamed({"pair_condition": "ba", "pair_auprc": "auprc_b_then_a", "interaction_excess_auprc_drop": "interaction_excess_b_then_a"})
    out = a.join(F.broadcast(turned), "ab").join(b, ["view", "feature", "ba"]).withColumnsRenamed({"ab": "condition_a_then_b", "ba": "condition_b_then_a"})
    delta = F.col("auprc_a_then_b") - F.col("auprc_b_then_a")
    return out.withColumns({"auprc_a_then_b_minus_b_then_a": delta, "absolute_order_sensitivity": F.abs(delta)})


def robustness_summary(metrics: DataFrame, registry: DataFrame, values: Sequence[str] = ("roc_auc", "average_precision"), by: str = "dataset_id") -> DataFrame:
    """Clean, macro mean and worst condition by ROC-AUC over official conditions of status ok."""
    official = registry.where("official").select(F.col("name").alias("condition"))
    fine = metrics.where("status = 'ok' and condition <> 'clean'").join(F.broadcast(official), "condition")
    macro = fine.groupBy(by).agg(F.count(F.lit(1)).alias("official_conditions"), *[F.avg(v).alias(f"macro_{v}") for v in values], F.min_by("condition", F.struct("roc_auc", "condition")).alias("worst_condition"), *[F.min_by(v, F.struct("roc_auc", "condition")).alias(f"worst_{v}") for v in values])
    clean = metrics.where("condition = 'clean'").select(by, *[F.col(v).alias(f"clean_{v}") for v in values])
    return clean.join(macro, by, "full_outer").fillna(0, ["official_conditions"])


def compact_summary(metrics: DataFrame, name: str = "comparison_group", k: int = 5) -> DataFrame:
    """Counts below chance and the k weakest and strongest groups."""
    fine = metrics.where("roc_auc is not null")
    counts = fine.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("roc_auc") < 0.5).alias("below_chance"))
    top = lambda order, kind: fine.orderBy(order, name).limit(k).select(F.lit(kind).alias("kind"), name, "roc_auc")
    return top(F.asc("roc_auc"), "weakest").unionByName(top(F.desc("roc_auc"), "strongest")).crossJoin(counts)


#: Thresholds of the ledger's rules on normalised AP and nuisance correlation.
LEDGER = {"strong": 0.20, "chance": 0.10, "specialist": 0.40, "keep_generator": 0.16, "nuisance": 0.75, "gap": 0.20}


# What the ledger says about each decision, and about itself.
LEDGER_BASIS = {
    "shortcut": "Strong separation is coupled to preprocessing or a preregistered nuisance.",
    "chance": "Aggregate confirmation AUPRC is too close to its prevalence baseline.",
    "specialist": "Powered generator groups disagree materially.",
    "fragile": "Clean separation does not survive the worst official transform.",
    "keep": "The feature clears clean, powered-group, and official-transform screens.",
    "rest": "Evidence is insufficient for the other preregistered categories.",
}
LEDGER_NOTE = "Exploratory normalized-AUPRC thresholds, where 0 is the prevalence baseline; not a competition acceptance criterion."


def decision_ledger(transforms: DataFrame, datasets: DataFrame, generators: DataFrame, correlations: DataFrame, official: DataFrame, canonical: str = "canonical_128", native: str = "native_capped") -> DataFrame:
    """One decision per feature from four metric tables (A24), with its basis, by decision and then from the most robust on;
    features without all the evidence are left out.
    """
    at = lambda df, view: df.where(F.col("view") == view)
    clean = transforms.where("condition = 'clean'")
    base = at(clean, canonical).select("feature", F.col("oriented_auprc").alias("clean_auprc"), F.col("normalized_auprc").alias("clean_normalized"))
    base = base.join(at(clean, native).select("feature", F.col("oriented_auprc").alias("native_auprc"), F.col("normalized_auprc").alias("native_normalized")), "feature")
    names = official.where("official and name <> 'clean'").select(F.col("name").alias("condition"))
    order = F.struct("normalized_auprc", "condition")
    worst = at(transforms, canonical).join(F.broadcast(names), "condition").groupBy("feature").agg(F.min("normalized_auprc").alias("worst_transform_normalized"), F.min_by("oriented_auprc", order).alias("worst_transform_auprc"), F.min_by("condition", order).alias("worst_condition"))
    data = at(datasets, canonical).where("not low_power").groupBy("feature").agg(F.min("normalized_auprc").alias("worst_dataset_normalized"))
    own = at(generators, canonical)
    powered = own.where("not low_power").groupBy("feature").agg(F.max("normalized_auprc").alias("best_generator_normalized"), F.min("normalized_auprc").alias("worst_generator_normalized"), F.count_if("direction_reversal").alias("powered_reversals"), F.count(F.lit(1)).alias("powered_groups"))
    weak = own.where("low_power").groupBy("feature").agg(F.count_if("direction_reversal").alias("underpowered_reversals"), F.count(F.lit(1)).alias("underpowered_groups"))
    corr = at(correlations, canonical).select("feature", "strongest_nuisance", "max_abs_nuisance_spearman")
    out = base.join(worst, "feature").join(data, "feature").join(powered, "feature").join(weak, "feature", "left").join(corr, "feature").fillna(0, ["underpowered_reversals", "underpowered_groups"])
    c, gap = F.col, F.col("clean_normalized") - F.col("native_normalized")
    t = {k: F.lit(v) for k, v in LEDGER.items()}
    strong = c("clean_normalized") >= t["strong"]
    basis = (
        F.when(strong & ((F.abs(gap) > t["gap"]) | (c("max_abs_nuisance_spearman") >= t["nuisance"])), "shortcut")
        .when(c("clean_normalized") < t["chance"], "chance")
        .when((c("best_generator_normalized") >= t["specialist"]) & ((c("worst_generator_normalized") < t["chance"]) | (c("powered_reversals") > 0)), "specialist")
        .when(strong & (c("worst_transform_normalized") < t["chance"]), "fragile")
        .when(strong & (c("worst_transform_normalized") >= t["chance"]) & (c("worst_dataset_normalized") >= t["chance"]) & (c("worst_generator_normalized") >= t["keep_generator"]) & (c("powered_reversals") == 0), "keep")
        .otherwise("rest")
    )
    told = F.create_map(*[F.lit(x) for pair in LEDGER_BASIS.items() for x in pair])
    decided = out.withColumn("basis_", basis).withColumns({"decision": F.when(F.col("basis_").isin("chance", "rest"), "discard").otherwise(F.col("basis_")), "decision_basis": F.element_at(told, F.col("basis_")), "rule_note": F.lit(LEDGER_NOTE)})
    return decided.drop("basis_").withColumns({
        "preprocessing_gap": gap, "confidence": F.when(c("underpowered_reversals") > 0, "low").otherwise("medium"),
        "provisional": (c("underpowered_groups") > 0) | (c("powered_groups") < 3),
    }).orderBy("decision", F.desc("worst_transform_normalized"), F.desc("clean_normalized"))


def robustness_frontier(metrics: DataFrame, name: str, value: str, condition: str = "condition") -> DataFrame:
    """Clean against worst condition of each row's ``name``, and whether no other is as good in both and better in one."""
    clean = metrics.where(F.col(condition) == "clean").select(name, F.col(value).alias("clean_value"))
    worst = metrics.groupBy(name).agg(F.min(value).alias("worst_value"))
    both = clean.join(worst, name)
    front = pareto_front(both, [], "clean_value", "worst_value", name).select(F.col(name).alias("front_")).withColumn("pareto", F.lit(True))
    return both.join(front, F.col(name) == F.col("front_"), "left").drop("front_").fillna(False, ["pareto"])


def extreme_failures(df: DataFrame, by: Sequence[str], target: str = "target", score: str = "pred", per_type: int = 5, unique: str = "parent_id") -> DataFrame:
    """The k highest-scored negatives and lowest-scored positives of each group, ranked."""
    kind = F.when(F.col(target) == 0, "false_positive").otherwise("false_negative")
    order = F.when(F.col(target) == 0, -F.col(score).cast(D)).otherwise(F.col(score).cast(D))
    w = Window.partitionBy(*by, "error_type").orderBy("order_", unique)
    return df.withColumns({"error_type": kind, "order_": order}).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_type).drop("order_")


def feature_effects(rows: DataFrame, keys: Sequence[str], target: str = "target", eps: float = 1e-12) -> DataFrame:
    """Separation AUC, rank-biserial and robust effect of each feature (M24). Null keys are dropped, as in the scopes."""
    fine = rows.where(finite("value"))
    for k in keys:
        fine = fine.where(F.col(k).isNotNull())
    auc = ranking_metrics(fine, [*keys, "feature"], target, "value").select(*keys, "feature", "roc_auc")
    p = lambda q, t=None: F.percentile(F.when(F.col(target) == t, F.col("value")) if t is not None else F.col("value"), F.lit(q))
    stats = fine.groupBy(*keys, "feature").agg((p(0.5, 1) - p(0.5, 0)).alias("median_difference"), (p(0.75) - p(0.25)).alias("iqr"), F.count(F.lit(1)).alias("rows"))
    out = same(stats, auc, [*keys, "feature"], "left")
    return out.withColumns({"separation_auc": F.greatest(F.col("roc_auc"), 1.0 - F.col("roc_auc")), "rank_biserial": 2.0 * F.col("roc_auc") - 1.0, "robust_effect": F.col("median_difference") / (F.col("iqr") + F.lit(eps))})


def paired_effects(rows: DataFrame, pair: str, by: Sequence[str], target: str = "target") -> DataFrame:
    """Median difference, positive share and direction consistency of pairs."""
    both = rows.groupBy(pair, *by, "feature").agg(F.avg(F.when(F.col(target) == 1, F.col("value"))).alias("one"), F.avg(F.when(F.col(target) == 0, F.col("value"))).alias("zero")).where("one is not null and zero is not null")
    out = both.withColumn("delta", F.col("one") - F.col("zero")).groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("pairs"), F.percentile("delta", F.lit(0.5)).alias("median_delta"), F.avg((F.col("delta") > 0).cast("int").cast(D)).alias("positive_fraction"))
    return out.withColumn("direction_consistency", F.greatest("positive_fraction", 1.0 - F.col("positive_fraction")))


def pareto_front(df: DataFrame, by: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """Rows no other row of the group dominates (J16): one ordered pass instead of a pairwise join."""
    w = Window.partitionBy(*by, F.lit(0)).orderBy(F.desc(x))
    best = df.groupBy(*by, x).agg(F.max(y).alias("top_"))
    above = best.withColumn("before_", F.max("top_").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return same(df, above.select(*by, x, "top_", "before_"), [*by, x]).where((F.col(y) == F.col("top_")) & (F.col("before_").isNull() | (F.col(y) > F.col("before_")))).drop("top_", "before_")
