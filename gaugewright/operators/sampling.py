"""Deterministic sampling and assignment: hash order, exact quotas, cohorts, counterbalanced chains.

Ranks within strata are windows over (stratum, hash, unique key); ``rank <= k`` gets Spark's window group limit, so each
task keeps only its own k smallest rows of a stratum before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.hashing import joined_hash, sample_order, stable_hash
from gaugewright.functions.scalars import squeezed
from gaugewright.operators.ranking import same


def stratum(target: Column, model: Column, subtype: Column, positive: str = "aigc:", negative: str = "authentic:") -> Column:
    """aigc:<model> or authentic:<subtype>."""
    return F.when(target == 1, F.concat(F.lit(positive), model.cast("string"))).otherwise(F.concat(F.lit(negative), subtype.cast("string")))


def selection_stratum(target: Column, model: Column, source: Column) -> Column:
    """generated:<squeezed model> or authentic:<source>."""
    return F.when(target == 1, F.concat(F.lit("generated:"), squeezed(model))).otherwise(F.concat(F.lit("authentic:"), F.lower(F.trim(source))))


def ranked(df: DataFrame, strata: Sequence[str], *order: Column | str, name: str = "rank") -> DataFrame:
    """Row number within strata."""
    w = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    return df.withColumn(name, F.row_number().over(w.orderBy(*order)))


def head_per_stratum(df: DataFrame, strata: Sequence[str], limit: int | Column, *order: Column | str, name: str = "rank") -> DataFrame:
    """The first rows of each stratum."""
    return ranked(df, strata, *order, name=name).where(F.col(name) <= limit)


def proportional_quotas(counts: DataFrame, within: Sequence[str], key: str, n: str, total: str) -> DataFrame:
    """quota by largest remainder, ties by the key's text (X11). ``total`` is a column of counts, one value per group."""
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    ideal = F.col(n).cast("double") * F.col(total).cast("double") / F.sum(n).over(w).cast("double")
    base = counts.withColumn("ideal_", ideal).withColumn("floor_", F.floor("ideal_").cast("long"))
    left = F.col(total) - F.sum("floor_").over(w)
    place = F.row_number().over(w.orderBy((F.col("ideal_") - F.col("floor_")).desc(), F.col(key).cast("string")))
    return base.withColumn("left_", left).withColumn("place_", place).withColumn("quota", F.col("floor_") + F.when(F.col("place_") <= F.col("left_"), 1).otherwise(0)).drop("ideal_", "floor_", "left_", "place_")


def balanced_quotas(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Near-equal quotas, shortages redistributed: units in order of (level, key), the first ``total`` of them.

    The level up to which every key fills up is found from sums over keys alone: with keys sorted by count, a level L
    uses sum(min(count, L)) units; what is left goes one each to the first keys by name that have more.
    """
    fine = counts.where(F.col(n) > 0)
    w = Window.partitionBy(F.lit(0)).orderBy(n, key).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    placed = fine.select(key, n, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("below_"), (F.count(F.lit(1)).over(whole) - F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(n, key)) + 1).alias("keys_"))
    level = placed.where(F.col("below_") + F.col(n) * F.col("keys_") >= total).agg(F.min(F.floor((F.lit(total) - F.col("below_")) / F.col("keys_")).cast("long")).alias("candidate_"), F.min(F.struct(n, key, "below_", "keys_")).alias("at_"))
    level = level.select(F.coalesce(F.floor((F.lit(total) - F.col("at_.below_")) / F.col("at_.keys_")).cast("long"), F.lit(1 << 62)).alias("level_"))
    out = fine.crossJoin(level).withColumn("base_", F.least(F.col(n), F.col("level_")).cast("long"))
    more = F.col(n) > F.col("level_")
    rest = F.lit(total) - F.sum("base_").over(whole)
    place = F.sum(F.when(more, 1).otherwise(0)).over(Window.partitionBy(F.lit(0)).orderBy(key))
    return out.withColumn("rest_", rest).withColumn("place_", place).select(key, n, (F.col("base_") + F.when(more & (F.col("place_") <= F.col("rest_")), 1).otherwise(0)).alias("quota"))


def limit_records(df: DataFrame, maximum: int, seed: int, dataset: str = "dataset_id", parent: str = "parent_id", target: str = "target", stratum_col: str = "stratum") -> DataFrame:
    """An exact sample of each dataset that keeps the mix of classes and then of strata."""
    sizes = df.groupBy(dataset, target, stratum_col).agg(F.count(F.lit(1)).alias("n_"))
    by_target = sizes.groupBy(dataset, target).agg(F.sum("n_").alias("n_"))
    whole = F.sum("n_").over(Window.partitionBy(dataset))
    by_target = by_target.withColumn("total_", F.least(whole, F.lit(maximum)))
    quotas = proportional_quotas(by_target, [dataset], target, "n_", "total_").select(dataset, target, F.col("quota").alias("total_"))
    per = proportional_quotas(same(sizes, quotas, [dataset, target]), [dataset, target], stratum_col, "n_", "total_").select(dataset, target, stratum_col, F.col("quota").alias("quota_"))
    joined = same(df, per, [dataset, target, stratum_col])
    return head_per_stratum(joined, [dataset, target, stratum_col], F.col("quota_"), sample_order(seed, F.col(dataset), F.col(parent)), parent, name="sample_rank").drop("quota_")


def round_robin(df: DataFrame, group: str, order: Column, group_order: Column, limit: int | None = None, unique: str = "parent_id", name: str = "cohort_rank") -> DataFrame:
    """Interleave groups: one row of each in turn."""
    first = df.withColumn("turn_", F.row_number().over(Window.partitionBy(group).orderBy(order, unique))).withColumn("group_order_", group_order)
    # The global order is by (turn, group): the place follows from how many groups reach each turn, so no global window over rows is needed.
    turns = first.groupBy("turn_").agg(F.count(F.lit(1)).alias("n_"))
    before = turns.select("turn_", (F.sum("n_").over(Window.partitionBy(F.lit(0)).orderBy("turn_")) - F.col("n_")).alias("before_"))
    out = first.join(before, "turn_").withColumn(name, (F.col("before_") + F.row_number().over(Window.partitionBy("turn_").orderBy("group_order_", group))).cast("int")).drop("turn_", "before_", "group_order_")
    return out if limit is None else out.where(F.col(name) <= limit)


def select_rows(manifest: DataFrame, policies: DataFrame, seed: str) -> DataFrame:
    """Hash-ordered selection per (source, phase, stratum) under per-source limits (X14). policies: source_id, row_limit."""
    base = manifest.join(policies.select("source_id", "row_limit"), "source_id")
    base = base.withColumn("selection_stratum", selection_stratum(F.col("target"), F.col("generation_model"), F.col("source_dataset")))
    base = base.withColumn("selection_hash", stable_hash(seed, F.col("source_id"), F.col("phase"), F.col("selection_stratum"), F.col("parent_id")))
    out = ranked(base, ["source_id", "phase", "selection_stratum"], "selection_hash", "parent_id", name="selection_rank")
    return out.where(F.col("row_limit").isNull() | (F.col("selection_rank") <= F.col("row_limit"))).drop("row_limit")


def diversity_cohorts(selected: DataFrame, seed: str, few: int = 10, many: int = 100, total: int | None = None) -> DataFrame:
    """Few- and many-generator cohorts: disjoint generators, equal sizes, interleaved by generator.

    selected: parent_id, generation_model, positives of the discovery phase only. Too few generators give no row.
    """
    base = selected.withColumn("generator_id", squeezed(F.col("generation_model")))
    makers = base.select("generator_id").distinct().withColumn("maker_hash_", stable_hash(seed, "generator", F.col("generator_id")))
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("maker_hash_", "generator_id"))
    makers = makers.withColumn("place_", order).withColumn("makers_", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    cohort = F.when(F.col("place_") <= few, "few_generators").when(F.col("place_") <= few + many, "many_generators")
    makers = makers.where(F.col("makers_") >= few + many).withColumn("diversity_cohort", cohort).where("diversity_cohort is not null").select("generator_id", "diversity_cohort")
    pool = base.join(makers, "generator_id")
    sizes = pool.groupBy("diversity_cohort").agg(F.count(F.lit(1)).alias("n_")).agg(F.min("n_").alias("equal_"))
    if total is not None:
        sizes = sizes.withColumn("equal_", F.least("equal_", F.lit(total)))
    out = None
    for name, count in (("few_generators", few), ("many_generators", many)):
        own = pool.where(F.col("diversity_cohort") == name)
        own = round_robin(own, "generator_id", stable_hash(seed, name, F.col("generator_id"), F.col("parent_id")), stable_hash(seed, name, F.col("generator_id")))
        own = own.crossJoin(sizes).where(F.col("cohort_rank") <= F.col("equal_")).withColumn("cohort_generator_count", F.lit(count)).withColumnRenamed("equal_", "cohort_image_count")
        out = own if out is None else out.unionByName(own)
    return out


def assigned_index(base_seed: int, dataset: Column, parent: Column, length: int, bank: int) -> Column:
    """Recipe index of a parent at a chain length."""
    from gaugewright.functions.hashing import U64, uint64

    return F.pmod(uint64(joined_hash(":", base_seed, dataset, parent, f"assigned-chain-length-{length}")), F.lit(bank).cast(U64)).cast("int")


def hash_places(df: DataFrame, within: Sequence[str], order: Column, unique: str, name: str) -> DataFrame:
    """Each row's place, from 0, by a hexadecimal hash and then ``unique`` within its group.

    Rows are numbered within 256 hash ranges and moved up by the counts of the ranges below, so no task holds a group.
    """
    put = df.withColumns({"h_": order, "hr_": F.substring(order, 1, 2)})
    counts = put.groupBy(*within, "hr_").agg(F.count(F.lit(1)).alias("n_"))
    below = counts.select(*within, "hr_", (F.sum("n_").over(Window.partitionBy(*within).orderBy("hr_")) - F.col("n_")).alias("below_"))
    own = put.withColumn("own_", F.row_number().over(Window.partitionBy(*within, "hr_").orderBy("h_", unique)) - 1)
    return same(own, below, [*within, "hr_"]).withColumn(name, F.col("below_") + F.col("own_")).drop("h_", "hr_", "below_", "own_")


def cyclic_assignment(df: DataFrame, within: Sequence[str], values: Sequence, order: Column, unique: str, name: str) -> DataFrame:
    """Each of ``values`` equally often, +-1, within groups: hash order and cyclic fill."""
    pick = F.array(*[F.lit(v) for v in values])
    return hash_places(df, within, order, unique, "cyc_").withColumn(name, F.element_at(pick, (F.pmod("cyc_", F.lit(len(values))) + 1).cast("int"))).drop("cyc_")


def uniform_chains(records: DataFrame, variants: dict[str, Sequence[str]], base_seed: int, lengths: Sequence[int] = (1, 2, 3, 4, 5, 6), dataset: str = "dataset_id", parent: str = "parent_id", target: str = "target", stratum_col: str = "sampling_stratum") -> DataFrame:
    """Counterbalanced chains (X19): length per record, family per position and variant per family are +-1 equal in strata.

    Adds transform_step_count and steps: array<struct<position, family, variant>>.
    """
    within, families = [dataset, target, stratum_col], list(variants)
    rows = cyclic_assignment(records, within, lengths, joined_hash(":", base_seed, F.col(dataset), F.col(parent), "chain-length"), parent, "transform_step_count")
    steps = rows.select(dataset, parent, target, stratum_col, F.explode(F.sequence(F.lit(1), F.col("transform_step_count"))).alias("position"))
    steps = cyclic_assignment(steps, [*within, "position"], families, joined_hash(":", base_seed, F.col(dataset), F.col(parent), F.col("position"), "family"), parent, "family")
    steps = hash_places(steps, [*within, "position", "family"], joined_hash(":", base_seed, F.col(dataset), F.col(parent), F.col("position"), "severity"), parent, "place_")
    banks = F.create_map(*[x for f, v in variants.items() for x in (F.lit(f), F.array(*[F.lit(i) for i in v]))])
    bank = banks[F.col("family")]
    steps = steps.withColumn("variant", F.element_at(bank, (F.pmod(F.col("place_"), F.size(bank)) + 1).cast("int")))
    chains = steps.groupBy(dataset, parent).agg(F.sort_array(F.collect_list(F.struct("position", "family", "variant"))).alias("steps"))
    return same(rows, chains, [dataset, parent], "left")


def chain_steps(chains: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per step of a chain."""
    return chains.select(*keep, F.explode("steps").alias("s")).select(*keep, F.col("s.position").alias("step_position"), F.col("s.family").alias("transform_family"), F.col("s.variant").alias("transform_variant"))


def public_chains(chains: DataFrame, internal: Sequence[str] = ("steps",)) -> DataFrame:
    """Without internal columns."""
    return chains.drop(*internal)


def sampled_condition(parent: Column, epoch: Column | int, seed: int, clean_share: float, conditions: Sequence[str]) -> Column:
    """clean with the given share, else one of the conditions, whatever the label."""
    from gaugewright.functions.hashing import U64

    digest = joined_hash(":", seed, parent, epoch if isinstance(epoch, Column) else F.lit(epoch))
    draw = F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(float(1 << 64))
    pick = F.pmod(F.conv(F.substring(digest, 17, 16), 16, 10).cast(U64), F.lit(len(conditions)).cast(U64)).cast("int")
    return F.when(draw < F.lit(clean_share), "clean").otherwise(F.element_at(F.array(*[F.lit(c) for c in conditions]), pick + 1))


def capped_quota(df: DataFrame, label: str, model: str, order: Column | str, unique: str, per_model: int, per_label: int) -> DataFrame:
    """At most per_model rows of each model and per_label of each label, in order."""
    capped = head_per_stratum(df, [label, model], per_model, order, unique, name="model_rank")
    return head_per_stratum(capped, [label], per_label, order, unique, name="label_rank")


def spread_tokens(count: Column, wanted: int, parent: Column, seed: int) -> Column:
    """Evenly spread token indices, rotated by the parent's hash."""
    from gaugewright.functions.hashing import U64, uint64

    n = F.least(count, F.lit(wanted))
    turn = F.pmod(uint64(joined_hash(":", seed, parent)), F.greatest(count, F.lit(1)).cast(U64)).cast("int")
    return F.when(count > 0, F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(F.floor(i * count / n).cast("int") + turn, count)))).otherwise(F.array().cast("array<int>"))


def content_distinct(df: DataFrame, digest: str, strata: str, priority: str, quota: int) -> DataFrame:
    """First row of each content digest by (stratum, priority), then a quota per stratum (U06, global form)."""
    first = head_per_stratum(df, [digest], 1, strata, priority, name="digest_rank")
    return head_per_stratum(first, [strata], quota, priority, digest, name="quota_rank")


def cyclic_pairing(left: DataFrame, right: DataFrame, within: Sequence[str], left_order: Sequence[Column | str], right_order: Sequence[Column | str]) -> DataFrame:
    """Each left row with a right row of its group, rights reused in turn (W13, J22's pick)."""
    lw, rw = Window.partitionBy(*within), Window.partitionBy(*within)
    a = left.withColumn("place_", F.row_number().over(lw.orderBy(*left_order)) - 1)
    b = right.withColumn("at_", F.row_number().over(rw.orderBy(*right_order)) - 1)
    sizes = right.groupBy(*within).agg(F.count(F.lit(1)).alias("n_"))
    a = same(a, sizes, within).withColumn("at_", F.pmod(F.col("place_"), F.col("n_")))
    return same(a, b, [*within, "at_"]).drop("place_", "n_", "at_")


def balanced_batches(manifest: DataFrame, batches: int, real: int, native: int, derived: int = 0, seed: int = 0, epoch: int = 0) -> DataFrame:
    """batch, slot, parent_id, sample_kind of an epoch's batches.

    A batch holds ``derived`` derived rows with their sources, ``native`` generated rows and authentic ones up to ``real``, each
    row once. Every kind has a stream: its groups (generator_family, of authentic rows source_dataset) take turns, and a
    group's rows follow each other in hash order of seed and epoch, from a new start in each cycle. Authentic rows that the
    batch has as sources are passed over. A kind without rows that is asked for raises.
    """
    counts = {"dda": derived, "native_aigc": native, "authentic": real - derived}
    found = {r["sample_kind"]: r["count"] for r in manifest.groupBy("sample_kind").count().collect()}
    lacking = [k for k, n in counts.items() if n > 0 and not found.get(k)]
    if lacking or counts["authentic"] < 0:
        raise ValueError(f"no rows of {', '.join(lacking)}" if lacking else "fewer authentic rows than derived ones")
    made = _stream(manifest, "dda", "generator_family", batches, derived, 0, seed, epoch)
    sources = made.select("batch", F.col("source_parent_id").alias("parent_id"), F.lit("authentic").alias("sample_kind"), F.lit(0).alias("part"), "turn")
    own = _stream(manifest, "authentic", "source_dataset", batches, counts["authentic"], derived, seed, epoch)
    own = own.join(sources.select("batch", "parent_id"), ["batch", "parent_id"], "left_anti")
    rows = [sources]
    for part, (df, n) in enumerate(((made, derived), (_stream(manifest, "native_aigc", "generator_family", batches, native, 0, seed, epoch), native), (own, counts["authentic"])), 1):
        once = df.groupBy("batch", "parent_id", "sample_kind").agg(F.min("turn").alias("turn"))
        kept = once.withColumn("k_", F.row_number().over(Window.partitionBy("batch").orderBy("turn"))).where(F.col("k_") <= n)
        rows.append(kept.select("batch", "parent_id", "sample_kind", F.lit(part).alias("part"), "turn"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    slot = F.row_number().over(Window.partitionBy("batch").orderBy(joined_hash(":", seed, F.lit(epoch), F.col("batch"), F.col("part"), F.col("parent_id")))) - 1
    return out.withColumn("slot", slot).select("batch", "slot", "parent_id", "sample_kind")


def _stream(manifest: DataFrame, kind: str, group: str, batches: int, count: int, spare: int, seed: int, epoch: int) -> DataFrame:
    """batch, turn and the rows of a kind's stream: count rows of each batch and, at most, ``spare`` to fall back on."""
    rows = manifest.where(F.col("sample_kind") == kind).withColumn("g_", F.coalesce(F.col(group).cast("string"), F.lit("")))
    rows = hash_places(rows, ["g_"], joined_hash(":", seed, F.lit(epoch), F.lit(kind), F.col("parent_id")), "parent_id", "place_")
    sizes = rows.groupBy("g_").agg(F.count(F.lit(1)).alias("n_"))
    groups = sizes.withColumn("at_", F.row_number().over(Window.orderBy("g_")) - 1).crossJoin(sizes.agg(F.count(F.lit(1)).alias("of_")))  # a row for each group
    turns = manifest.sparkSession.range(batches).select(F.col("id").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(max(0, count + spare - 1)))).alias("slot_")) if count + spare else manifest.sparkSession.range(0).select(F.col("id").alias("batch"), F.col("id").cast("int").alias("slot_"))
    turns = turns.withColumn("turn", F.col("batch") * F.lit(count) + F.col("slot_"))
    placed = turns.crossJoin(F.broadcast(groups.agg(F.count(F.lit(1)).alias("of2_")))).withColumn("at_", F.pmod("turn", F.greatest("of2_", F.lit(1))))
    placed = placed.join(F.broadcast(groups.select("at_", "g_", "n_", "of_")), "at_").withColumn("round_", F.expr("turn div of_"))
    cycle = F.expr("round_ div n_")
    start = F.conv(F.substring(joined_hash(":", seed, F.lit(epoch), F.lit(kind), F.col("g_"), cycle), 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("place_", F.pmod(F.col("round_") + start, F.col("n_")))
    chosen = rows.select("g_", "place_", "parent_id", "sample_kind", "source_parent_id")
    return placed.select("batch", "turn", "g_", "place_").join(chosen.hint("merge"), ["g_", "place_"]).select("batch", "turn", "parent_id", "sample_kind", "source_parent_id")
