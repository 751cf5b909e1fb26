"""Constraint rules: each gives a violations table (rule, key, detail); ``assert_clean`` raises when one isn't empty.

Rules run on the whole table before any filter, since a filter could hide a leak.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.scalars import forbidden_demo, forbidden_label, squeezed


class RuleViolation(ValueError):
    """A table broke a rule."""


def violations(df: DataFrame, rule: str, bad: Column, key: Column, detail: Column | None = None) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(True))).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def row_rules(df: DataFrame, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """All row rules in one pass: a rule that is true or null is broken."""
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule"), key.cast("string").alias("key")).withColumn("detail", F.lit(""))


def union(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def assert_clean(found: DataFrame, what: str = "table", show: int = 10) -> None:
    """An action that raises with the first violations."""
    rows = found.orderBy("rule", "key").limit(show).collect()
    if rows:
        raise RuleViolation(f"{what}: " + "; ".join(f"{r['rule']} at {r['key']} {r['detail']}".strip() for r in rows))


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise RuleViolation(f"missing columns: {', '.join(missing)}")


def empty_table(df: DataFrame, rule: str = "empty_table") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(rule).alias("rule"), F.lit("").alias("key"), F.lit("no row").alias("detail"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], rule: str = "duplicate_key") -> DataFrame:
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), F.col("n").cast("string").alias("detail"))


def group_leakage(df: DataFrame, groups: Sequence[str], sides: Sequence[str], rule: str = "leakage") -> DataFrame:
    """Groups on more than one side, e.g. a lineage in two splits (C11). Minimum and maximum, so no set is built."""
    side = F.concat_ws(":", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in sides])
    return union(
        df.where(F.col(g).isNotNull()).groupBy(F.col(g).cast("string").alias("g")).agg(F.min(side).alias("a"), F.max(side).alias("b")).where("a <> b").select(F.lit(f"{rule}_{g}").alias("rule"), F.col("g").alias("key"), F.concat_ws(" / ", "a", "b").alias("detail"))
        for g in groups
    )


def overlap(a: DataFrame, b: DataFrame, column: Column, rule: str) -> DataFrame:
    """Values that both tables hold."""
    both = a.select(column.alias("v")).distinct().join(b.select(column.alias("v")).distinct(), "v", "left_semi")
    return both.select(F.lit(rule).alias("rule"), F.col("v").cast("string").alias("key"), F.lit("").alias("detail"))


def unknown_values(df: DataFrame, column: str, allowed: Sequence, rule: str | None = None) -> DataFrame:
    """Distinct values beyond an enum, nulls included."""
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
    return per.select(F.lit(rule or f"unknown_{column}").alias("rule"), F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("key"), F.col("n").cast("string").alias("detail"))


# Enumerations and field names of the tables and documents that the rules are about.
PHASES = ("discovery", "confirmation", "final_confirmation")
SPLITS = ("train", "val", "test")
POOLS = ("memory", "capacity", "detector", "authentic_null", "none")
KINDS = ("authentic", "native_aigc", "dda")
INDEX_COLUMNS = ("parent_id", "target", "phase", "dataset", "split", "label", "generator_family", "generation_model", "source_dataset", "source_member", "local_path", "width", "height", "mode", "format", "bytes")
TRAINING_COLUMNS = ("parent_id", "lineage_id", "split", "training_pool", "label", "sample_kind", "generator_family", "generation_model", "source_dataset", "local_path")
POLICY_FIELDS = (
    "source_id", "dataset", "purpose", "selected", "source_url", "revision", "file_list", "file_list_sha256", "content_sha256", "license_name", "license_url", "license_decision",
    "underlying_image_license_name", "underlying_image_license_url", "underlying_image_license_decision", "reviewer", "review_date",
)
EVIDENCE_FIELDS = ("source_url", "revision", "file_list", "file_list_sha256", "content_sha256", "license_name", "license_url", "underlying_image_license_name", "underlying_image_license_url", "reviewer", "review_date")
DECISION_FIELDS = ("license_decision", "underlying_image_license_decision")
DECISIONS = ("pending", "allowlisted", "rejected")
AUTHENTIC_LABELS = ("authentic", "real")
NATIVE_LABELS = ("aigc", "fake", "full_synthetic")
DERIVED_LABELS = ("dda", "dda_aligned", "dual_data_aligned")
FORBIDDEN_TOKENS = ("tamper", "edited", "composite", "partial", "inpaint", "photoshop")
LEAKAGE_GROUPS = ("lineage_id", "master_id", "prompt_group_id", "duplicate_group_id")


def expansion_index_rules(df: DataFrame) -> DataFrame:
    """Columns, rows, nulls, label and target agreement, phases, unique parents, generators on one side only."""
    require_columns(df, INDEX_COLUMNS)
    key = F.col("parent_id")
    rows = row_rules(df, key, {
        "null_field": F.greatest(*[F.col(c).isNull() for c in ("parent_id", "target", "phase", "label", "local_path")]),
        "bad_target": ~F.coalesce(F.col("target").isin(0, 1), F.lit(False)),
        "label_target_mismatch": (F.col("target") == 1) != F.lower("label").isin("aigc", "generated", "fake"),
        "bad_phase": ~F.coalesce(F.col("phase").isin(*PHASES), F.lit(False)),
        "forbidden_label": forbidden_label(F.col("label")),
        "demo_row": forbidden_demo(F.col("local_path"), F.col("dataset")),
    })
    made = df.where("target = 1")
    generator = squeezed(F.col("generation_model"))
    return union([empty_table(df), rows, duplicate_keys(df, ["parent_id"], "duplicate_parent"), overlap(made.where("phase = 'discovery'"), made.where("phase <> 'discovery'"), generator, "generator_overlap")])


def legacy_index_rules(df: DataFrame) -> DataFrame:
    """No demo rows, unique paths, both phases present."""
    rows = row_rules(df, F.col("local_path"), {"demo_row": forbidden_demo(F.col("local_path"), F.col("dataset"))})
    want = df.sparkSession.createDataFrame([("discovery",), ("confirmation",)], "phase string")
    absent = want.join(df.select("phase").distinct(), "phase", "left_anti").select(F.lit("missing_phase").alias("rule"), F.col("phase").alias("key"), F.lit("").alias("detail"))
    return union([rows, duplicate_keys(df, ["local_path"], "duplicate_path"), absent])


def config_problems(config: Mapping) -> list[str]:
    """What is wrong with an expansion config (a driver-side document); an empty list lets it pass.

    Whatever is absent or of another type than expected counts as wrong.
    """
    part = lambda name: config[name] if isinstance(config.get(name), Mapping) else {}
    acquisition, final, sources = part("acquisition"), part("final_confirmation"), config.get("sources")
    demands = {
        "schema_version is not 1": config.get("schema_version") == 1,
        "selection_seed is empty": bool(str(config.get("selection_seed") if config.get("selection_seed") is not None else "").strip()),
        "acquisition does not default to dry_run": acquisition.get("default_mode") == "dry_run",
        "acquisition does not require an allowlist of all selected sources": acquisition.get("require_all_selected_sources_allowlisted") is True,
        "final_confirmation is not sealed": final.get("phase") == "final_confirmation" and final.get("sealed") is True,
        "final_confirmation lacks a list of generators": isinstance(final.get("generator_ids"), list),
        "no source": isinstance(sources, list) and bool(sources),
    }
    found = [problem for problem, met in demands.items() if not met]
    ids = []
    for n, source in enumerate(sources if isinstance(sources, list) else []):
        source = source if isinstance(source, Mapping) else {}
        name = str(source.get("source_id") or "").strip()
        ids.append(name)
        found += [f"source {name or n} lacks {f}" for f in POLICY_FIELDS if f not in source]
        found += [f"source {n} has an empty id"] * (not name)
        found += [f"source {name or n} has an unknown {f}" for f in DECISION_FIELDS if source.get(f) not in DECISIONS]
    return found + [f"source {i} occurs twice" for i in sorted({i for i in ids if i and ids.count(i) > 1})]


def license_gate(config: Mapping) -> list[dict]:
    """A decision for each source. Only ``allowlisted`` for both licences with all evidence and sound digests opens it."""
    problems = config_problems(config)
    if problems:
        raise RuleViolation("; ".join(problems))
    out = []
    for source in config["sources"]:
        missing = [f for f in EVIDENCE_FIELDS if source[f] in (None, "")]
        unsound = [f for f in ("file_list_sha256", "content_sha256") if f not in missing and not re.fullmatch("[0-9a-f]{64}", str(source[f]).strip().lower())]
        complete = not missing and not unsound
        out.append(
            {k: source[k] for k in ("source_id", "dataset", *DECISION_FIELDS)}
            | {"selected": bool(source["selected"]), "metadata_complete": complete, "missing_fields": ",".join(missing), "invalid_hash_fields": ",".join(unsound)}
            | {"acquisition_allowed": complete and all(source[f] == "allowlisted" for f in DECISION_FIELDS)}
        )
    return out


def assert_gate(config: Mapping) -> None:
    """Every selected source may be acquired."""
    shut = [g for g in license_gate(config) if g["selected"] and not g["acquisition_allowed"]]
    if shut:
        raise RuleViolation("not to be acquired: " + ", ".join(f"{g['source_id']} ({g['license_decision']})" for g in shut))


def manifest_rules(df: DataFrame, policies: DataFrame, sealed_generators: Sequence[str] = ()) -> DataFrame:
    """Provenance, one revision per source, labels, demo rows, phases, sealing, generator overlap. policies: source_id, revision."""
    joined = df.join(policies.select("source_id", F.col("revision").alias("want_")), "source_id", "left")
    rows = row_rules(joined, F.col("parent_id"), {
        "unknown_source": F.col("want_").isNull(),
        "revision_mismatch": F.coalesce(F.col("want_") != F.col("revision"), F.col("want_").isNotNull()),
        "forbidden_label": forbidden_label(F.col("label")),
        "demo_row": forbidden_demo(F.col("local_path"), F.col("dataset")),
        "bad_phase": ~F.coalesce(F.col("phase").isin(*PHASES), F.lit(False)),
        "unsealed_generator": (F.col("target") == 1) & squeezed(F.col("generation_model")).isin(*(sealed_generators or ("",))) & (F.col("phase") != "final_confirmation"),
    })
    made = df.where("target = 1")
    return union([rows, duplicate_keys(df, ["parent_id"], "duplicate_parent"), overlap(made.where("phase = 'discovery'"), made.where("phase <> 'discovery'"), squeezed(F.col("generation_model")), "generator_overlap")])


def audit_summary(df: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counts for the record."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("parent_id").alias("parents"), F.count_if(F.col("target") == 1).alias("positives")).crossJoin(found.agg(F.count(F.lit(1)).alias("violations"), F.count_distinct("rule").alias("rules_broken")))


def withheld(df: DataFrame, opened: bool) -> DataFrame:
    """Final confirmation rows stay out unless it was opened."""
    return df if opened else df.where(F.coalesce(F.col("phase") != "final_confirmation", F.lit(True)))


def normalized_manifest(df: DataFrame) -> DataFrame:
    """A training manifest with stripped ids, stripped and case-folded enumerations, and ``target`` by label."""
    require_columns(df, TRAINING_COLUMNS)
    if "source_parent_id" not in df.columns:
        df = df.withColumn("source_parent_id", F.lit(None).cast("string"))
    text = lambda c: F.trim(F.col(c).cast("string"))
    groups = [g for g in LEAKAGE_GROUPS if g in df.columns]
    out = df.withColumns({c: text(c) for c in ("parent_id", "source_parent_id", *groups)} | {c: F.lower(text(c)) for c in ("split", "training_pool", "sample_kind", "label")})
    return out.withColumn("target", F.when(F.col("label").isin(*AUTHENTIC_LABELS), 0).when(F.col("label").isin(*NATIVE_LABELS, *DERIVED_LABELS), 1))


def training_manifest_rules(df: DataFrame) -> DataFrame:
    """Nulls, enums, pools by split, known labels, kinds by label, demo rows, authentic-only pools, derived rows in the
    detector pool only, groups on one side, pairs.
    """
    df = normalized_manifest(df)
    pool, split, kind, label = (F.col(c) for c in ("training_pool", "split", "sample_kind", "label"))
    expected = F.when(label.isin(*AUTHENTIC_LABELS), "authentic").when(label.isin(*DERIVED_LABELS), "dda").otherwise("native_aigc")
    demo = F.lower("generation_model").contains("dall-e advanced") & F.col("source_dataset").rlike("(?i)COCO.*val2017")
    rows = row_rules(df, F.col("parent_id"), {
        "null_field": F.greatest(*[F.col(c).isNull() for c in TRAINING_COLUMNS], *[F.col(c) == "" for c in ("parent_id", "lineage_id")]),
        "bad_split": ~F.coalesce(split.isin(*SPLITS), F.lit(False)),
        "bad_pool": ~F.coalesce(pool.isin(*POOLS), F.lit(False)),
        "bad_kind": ~F.coalesce(kind.isin(*KINDS), F.lit(False)),
        "pool_outside_train": (split != "train") & (pool != "none"),
        "train_without_pool": (split == "train") & (pool == "none"),
        "forbidden_label": forbidden_label(label, FORBIDDEN_TOKENS),
        "unknown_label": F.col("target").isNull(),
        "label_kind_mismatch": kind != expected,
        "demo_row": F.coalesce(demo, F.lit(False)),
        "generated_in_authentic_pool": pool.isin("memory", "capacity", "authentic_null") & (kind != "authentic"),
        "derived_outside_detector": (kind == "dda") & (pool != "detector"),
    })
    named = df.withColumns({g: F.nullif(F.col(g), F.lit("")) for g in LEAKAGE_GROUPS if g in df.columns})
    leaks = group_leakage(named, [g for g in LEAKAGE_GROUPS if g in df.columns], ["split", "training_pool"])
    return union([empty_table(df), rows, duplicate_keys(df, ["parent_id"], "duplicate_parent"), leaks, pair_rules(df)])


def pair_rules(df: DataFrame) -> DataFrame:
    """A derived row's source is there, authentic, of the same lineage and with it in the train split's detector pool;
    sources have one derivative.
    """
    made = df.where("sample_kind = 'dda'")
    source = df.select(F.col("parent_id").alias("source_parent_id"), F.col("sample_kind").alias("k_"), F.col("lineage_id").alias("l_"), F.col("split").alias("s_"), F.col("training_pool").alias("p_"))
    joined = made.join(source, "source_parent_id", "left")
    lost = F.col("k_").isNull()
    apart = (F.col("s_") != F.col("split")) | (F.col("p_") != F.col("training_pool")) | (F.col("s_") != "train") | (F.col("p_") != "detector")
    rows = row_rules(joined, F.col("parent_id"), {
        "pair_source_missing": lost,
        "pair_source_not_authentic": ~lost & (F.coalesce(F.col("k_"), F.lit("")) != "authentic"),
        "pair_other_lineage": ~lost & F.coalesce(F.col("l_") != F.col("lineage_id"), F.lit(False)),
        "pair_other_side": ~lost & F.coalesce(apart, F.lit(False)),
    })
    return union([rows, duplicate_keys(made.where(F.col("source_parent_id").isNotNull()), ["source_parent_id"], "pair_source_reused")])


def load_subset(df: DataFrame, splits: Sequence[str] | None = None, pools: Sequence[str] | None = None, rules: Callable[[DataFrame], DataFrame] = training_manifest_rules) -> DataFrame:
    """The whole manifest is checked by an action first, then filtered; never one plan. Unknown splits and pools raise."""
    wanted = {}
    for column, asked, known in (("split", splits, SPLITS), ("training_pool", pools, POOLS)):
        if asked is not None:
            wanted[column] = [str(x).strip().lower() for x in asked]
            if not set(wanted[column]) <= set(known):
                raise RuleViolation(f"unknown {column}: {', '.join(sorted(set(wanted[column]) - set(known)))}")
    assert_clean(rules(df), "training manifest")
    out = normalized_manifest(df)
    for column, values in wanted.items():
        out = out.where(F.col(column).isin(*values))
    return out


def evaluation_record_rules(df: DataFrame, dataset: str = "dataset_id", parent: str = "parent_id", target: str = "target", path: str = "image_path") -> DataFrame:
    """C14: required values, binary targets, unique parents per dataset."""
    rows = row_rules(df, F.concat_ws("|", F.col(dataset).cast("string"), F.col(parent).cast("string")), {
        "null_field": F.greatest(*[F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in (dataset, parent, path)]),
        "bad_target": ~F.coalesce(F.col(target).isin(0, 1), F.lit(False)),
    })
    return union([empty_table(df), rows, duplicate_keys(df, [dataset, parent], "duplicate_parent")])


def counterbalance_rules(df: DataFrame, within: Sequence[str], column: str, values: Sequence) -> DataFrame:
    """Counts of the values, zeros included, differ by one at most in every group."""
    v = df.sparkSession.createDataFrame([(x,) for x in values], f"{column} {df.schema[column].dataType.simpleString()}")
    groups = df.select(*within).distinct().crossJoin(F.broadcast(v))
    counts = df.groupBy(*within, column).agg(F.count(F.lit(1)).alias("n"))
    both = groups.join(counts, [*within, column], "left").fillna(0, ["n"]).groupBy(*within).agg((F.max("n") - F.min("n")).alias("spread"))
    return both.where("spread > 1").select(F.lit(f"unbalanced_{column}").alias("rule"), F.concat_ws("|", *[F.col(w).cast("string") for w in within]).alias("key"), F.col("spread").cast("string").alias("detail"))


def source_label_rules(df: DataFrame) -> DataFrame:
    """Fixed splits and binary labels of curated labels."""
    return union([unknown_values(df, "split", SPLITS), unknown_values(df, "label", ("authentic", "aigc", "real", "fake"))])


def single_value(df: DataFrame, column: str, expected: str | None, rule: str = "provenance") -> DataFrame:
    """C17: one value in the column, and it is the expected one."""
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    many = per.agg(F.count(F.lit(1)).alias("k")).where("k <> 1").select(F.lit(f"{rule}_values").alias("rule"), F.lit(column).alias("key"), F.col("k").cast("string").alias("detail"))
    other = per.where(~F.coalesce(F.col(column) == F.lit(expected), F.lit(False))).select(F.lit(f"{rule}_mismatch").alias("rule"), F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("key"), F.col("n").cast("string").alias("detail"))
    return union([many, other])


def population_rules(parts: Mapping[str, DataFrame], lineage: str, pure: Mapping[str, int], target: str = "target") -> DataFrame:
    """Populations share no lineage, and some hold one class only."""
    names = list(parts)
    found = [overlap(parts[a], parts[b], F.col(lineage), f"shared_{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    found += [violations(parts[n], f"impure_{n}", F.col(target) != t, F.col(lineage)) for n, t in pure.items()]
    return union(found)


def gate_rules(aucs: DataFrame, limit: float = 0.55, value: str = "probe_auc") -> DataFrame:
    """Shortcut probes stay near chance."""
    return violations(aucs, "protocol_gate", F.col(value) > limit, F.lit(value), F.col(value))


def prediction_rules(predictions: DataFrame, endpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C20: one prediction per endpoint, none else, the same datasets."""
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    lost = endpoints.join(predictions, list(keys), "left_anti").select(F.lit("missing_prediction").alias("rule"), name.alias("key"), F.lit("").alias("detail"))
    more = predictions.join(endpoints, list(keys), "left_anti").select(F.lit("extra_prediction").alias("rule"), name.alias("key"), F.lit("").alias("detail"))
    return union([lost, more, duplicate_keys(predictions, list(keys), "duplicate_prediction")])


def cache_rules(cache: DataFrame, index: DataFrame, key: str, cached_hash: str, index_hash: str) -> DataFrame:
    """The cache holds the index's parents and was made from its bytes."""
    a, b = cache.select(key).distinct(), index.select(key).distinct()
    found = [a.join(b, key, "left_anti").select(F.lit("not_in_index").alias("rule"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail")), b.join(a, key, "left_anti").select(F.lit("not_in_cache").alias("rule"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))]
    if cached_hash != index_hash:
        found.append(cache.sparkSession.createDataFrame([("hash_mismatch", cached_hash, index_hash)], "rule string, key string, detail string"))
    return union(found)


def uniform_runs(runs: Sequence[Mapping], fields: Sequence[str]) -> list[str]:
    """Fields in which the configs of a suite differ."""
    return [f for f in fields if len({repr(r.get(f)) for r in runs}) > 1]
