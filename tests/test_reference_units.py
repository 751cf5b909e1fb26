"""Operators against hand-computed values and NumPy."""

import json
import os
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewright.plans import catalog
from gaugewright.functions import codecs, hashing, kernels, scalars
from gaugewright.operators import aggregates, evaluation, images, ranking, recipes, reliability, retrieval, rules, sampling
from gaugewright.sources import readers, sinks
from gaugewright.streaming import metrics as streaming


def one(df):
    return df.first().asDict()


def test_binary_micro_case(spark):
    df = spark.createDataFrame([(0, -2.0), (0, -1.0), (0, 1.0), (1, 2.0)], "target int, score double")
    r = one(ranking.metric_slices(df, []))
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (1, 2, 1, 0)
    assert r["accuracy"] == 0.75 and r["balanced_accuracy"] == pytest.approx((2 / 3 + 1) / 2) and r["precision"] == 0.5 and r["f1"] == pytest.approx(2 / 3)
    assert r["roc_auc"] == 1.0 and r["status"] == "ok"


def test_status_dispatch(spark):
    rows = [("p", 1, 1.0), ("n", 0, 1.0), ("x", 1, float("nan")), ("x", 0, 1.0), ("q", 1, float("inf")), (None, 1, 2.0), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, target int, score double")
    got = {r.g: r for r in ranking.metric_slices(df, ["g"]).collect()}
    assert {k: r.status for k, r in got.items()} == {"p": "positive_only", "n": "negative_only", "x": "unscorable_non_finite_scores", "q": "negative_only", None: "ok"}
    assert got["p"].recall == 1.0 and got["p"].precision is None and got["n"].fpr is None and got["x"].tp is None
    assert ranking.metric_slices(df.where("score > 9e9 and g = 'none'"), ["g"]).count() == 0


def numpy_metrics(y, s, max_fpr=0.05):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    last = np.append(np.nonzero(np.diff(s))[0], len(s) - 1)
    tp, fp = np.cumsum(y)[last], np.cumsum(1 - y)[last]
    tpr, fpr = np.append(0, tp / y.sum()), np.append(0, fp / (1 - y).sum())
    auc = np.trapezoid(tpr, fpr)
    ap = (np.diff(np.append(0, tp)) / y.sum() * tp / (tp + fp)).sum()
    inside = fpr <= max_fpr
    x, t = np.append(fpr[inside], max_fpr), np.append(tpr[inside], np.interp(max_fpr, fpr, tpr))
    return auc, ap, np.trapezoid(t, x) / max_fpr


@pytest.mark.parametrize("buckets", [1, 64, 1000])
@pytest.mark.parametrize("parts", [1, 4, 17])
def test_ranking_metrics_whatever_the_partitions(spark, parts, buckets):
    rng = np.random.default_rng(parts)
    rows = [(f"s{k % 3}", int(rng.random() < 0.3), float(np.round(rng.normal(k % 3, 2), 1))) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, target int, score double").repartition(parts)
    for r in ranking.ranking_metrics(df, ["g"], "target", "score", buckets=buckets).collect():
        y, s = (np.array([x[k] for x in rows if x[0] == r.g]) for k in (1, 2))
        assert (r.roc_auc, r.average_precision, r.partial_auc) == pytest.approx(numpy_metrics(y.astype(int), s.astype(float)), abs=1e-12)


CASE = [("real-a", 0, -2.0, 1.0), ("real-b", 0, -1.0, -0.5), ("fake-a", 1, 2.0, 0.2), ("fake-b", 1, 1.0, -1.0)]


def predictions(spark):
    rows = [("d", p, t, c, "clean" if c == "clean" else "jpeg", x) for p, t, a, b in CASE for c, x in (("clean", a), ("jpeg_q30", b))]
    return spark.createDataFrame(rows, "dataset_id string, parent_id string, target int, condition string, transform_family string, logit double")


def test_paired_drift(spark):
    df = predictions(spark)
    r = one(evaluation.endpoint_drift(df))
    assert r["prediction_flip_rate"] == 0.5 and r["correct_to_incorrect_rate"] == 0.5 and r["pairs"] == 4
    assert evaluation.pairing_violations(df, ["dataset_id", "parent_id"], "logit").count() == 0
    lone = df.where("not (parent_id = 'real-a' and condition = 'clean')")
    assert [r.rule for r in evaluation.pairing_violations(lone, ["dataset_id", "parent_id"], "logit").collect()] == ["unmatched_endpoint"]
    m = ranking.metric_slices(df, ["dataset_id", "condition"], score="logit")
    assert evaluation.clean_drops(m, ["dataset_id"], ["roc_auc"]).first().roc_auc_drop > 0


def test_feature_drift(spark):
    rows = [(f"p{t}{k}", "v", t, c, "luma_mean", 0.1 * k + (0.2 if c != "clean" else 0.0), "jpeg", True) for t in (0, 1) for k in range(3) for c in ("clean", "jpeg_q90")]
    df = spark.createDataFrame(rows, "parent_id string, view string, target int, condition string, feature string, value double, transform_family string, official_transform boolean")
    signs = spark.createDataFrame([("v", "luma_mean", 1)], "view string, feature string, direction int")
    got = evaluation.feature_drift(df, signs).collect()
    assert len(got) == 2
    for r in got:
        assert r.signed_drift_mean == pytest.approx(0.2) and r.within_parent_transform_variance_mean == pytest.approx(0.01) and r.paired_parents == 3


def test_drift_of_profiles_equals_drift_of_rows(spark):
    # Parents of one and of several rows, equal ones, null, zero and non-finite values.
    lines = [(f"p{k}", k % 2, float(k % 3), x) for k in range(12) for x in ((1.5, float(k % 4)) if k % 5 == 0 else (float(k % 4),))] + [("n", 0, 1.0, None), ("i", 1, 1.0, float("inf")), ("i", 1, 1.0, 2.0), (None, 1, 2.0, 3.0)]
    base = spark.createDataFrame(lines, "parent_id string, target int, step double, x double")
    scale = {"clean": 0.0, "jpeg_q90": 0.5, "blur": -2.0}
    made = lambda c: F.col("x") * (1.0 + F.lit(scale[c]) * F.col("step"))
    rows = base.select("parent_id", "target", F.lit("v").alias("view"), F.lit("x").alias("feature"), F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), made(c).alias("value")) for c in scale])).alias("e")).select("*", "e.*").drop("e")
    signs = spark.createDataFrame([("v", "x", -1)], "view string, feature string, direction int")
    want = evaluation.feature_drift(rows, signs, ["view", "condition", "feature", "target"])
    parents = evaluation.profiles(base.withColumn("has_", F.col("parent_id").isNotNull()), ["parent_id"], ["has_", "target"], ["step", "x"])
    assert parents.count() < base.count() and parents.agg(F.sum("n_")).first()[0] == 15
    got = evaluation.drift_of_profiles(parents, [{"view": "v", "feature": "x", "direction": -1}], list(scale), lambda slot, c: made(c))
    show = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*want.columns).collect())
    assert show(got) == show(want)
    signed = [r for r in rows.where("condition = 'blur' and target = 0 and value is not null").join(rows.where("condition = 'clean'").groupBy("parent_id").agg(F.avg("value").alias("c")), "parent_id").select((F.col("c") - F.col("value")).alias("d")).toPandas()["d"]]
    r = got.where("condition = 'blur' and target = 0").first()
    assert (r.signed_drift_mean, r.signed_drift_median, r.signed_drift_std) == pytest.approx((np.mean(signed), np.median(signed), np.std(signed)))


def test_counted_lines_give_the_metrics_of_rows(spark, sf):
    t, names = catalog.Tables(spark, sf), sorted(catalog.FEATURES)
    signs = evaluation.learned_directions(t.clean_features.where("phase = 'discovery'")).persist()
    counted = t.feature_counts("confirmation", ("dataset", "generation_model")).persist()
    lines = t.feature_inputs("confirmation").withColumn("mask_", evaluation.feature_mask(names, "step"))
    parents = evaluation.profiles(lines, ["parent_id"], [], ["target", "dataset", "generation_model", "mask_"], distinct=True).persist()
    rows, clean = t.features.where("phase = 'confirmation'"), t.clean_features.where("phase = 'confirmation'")
    show = lambda df, like: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.select(*like.columns).collect())
    pairs = [
        (evaluation.learned_directions(t.expanded(t.feature_counts("discovery", clean=True), clean=True), weight="n_"), signs),
        (evaluation.univariate_metrics(t.expanded(counted), signs, ["view", "condition"], weight="n_", parents=evaluation.parents_of_profiles(parents, [], names)), evaluation.univariate_metrics(rows, signs, ["view", "condition"])),
        (evaluation.univariate_metrics(t.expanded(counted, clean=True), signs, ["view", "dataset"], weight="n_", parents=evaluation.parents_of_profiles(parents, ["dataset"], names)), evaluation.univariate_metrics(clean, signs, ["view", "dataset"])),
        (evaluation.generator_metrics(t.expanded(counted, clean=True), signs, weight="n_", parents=parents), evaluation.generator_metrics(clean, signs)),
    ]
    for got, want in pairs:
        assert show(got, want) == show(want, want)
    spark.catalog.clearCache()


def shuffled_records(spark, run) -> int:
    """Records that all stages of run() write for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (lambda s: [s.apply(k) for k in range(s.size())])(store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None))}
    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("name", ["a10_feature_drift"])
def test_rows_move_before_they_are_expanded(spark, sf, name):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    moved = shuffled_records(spark, lambda: catalog.QUERIES[name](spark, sf).collect())
    spark.catalog.clearCache()
    assert 0 < moved < 32 * lines  # half the lines under 8 conditions, in 2 views, with 4 features


def test_severity_area_and_interactions(spark):
    values = {"clean": 0.9, "blur_sigma0.5": 0.8, "blur_sigma1": 0.7, "blur_sigma2": 0.6, "color_jitter_minus20": 0.5, "color_jitter_plus20": 0.5}
    metrics = spark.createDataFrame([("v", "f", c, x, 1, 9, False, False) for c, x in values.items()], "view string, feature string, condition string, oriented_auprc double, direction int, parents int, low_power boolean, direction_reversal boolean")
    registry = recipes.condition_frame(spark, "all")
    drops = evaluation.auprc_drops(metrics, registry)
    assert sorted(round(r.auprc_drop, 6) for r in drops.where("transform_family = 'gaussian_blur'").collect()) == [0.1, 0.2, 0.3]
    area = evaluation.severity_areas(drops).collect()
    assert [(r.transform_family, round(r.normalized_severity_auprc_area, 6), round(r.normalized_severity_auprc_drop_area, 6)) for r in area] == [("gaussian_blur", 0.725, 0.175)]
    a, b = "directed-pair__jpeg-q70-sub2__then__blur-s1-pad-pillow", "directed-pair__blur-s1-pad-pillow__then__jpeg-q70-sub2"
    pairs = spark.createDataFrame([("v", "f", c, x, 1, 9, False, False) for c, x in {"clean": 0.9, "jpeg_q70": 0.8, "blur_sigma1": 0.85, a: 0.65, b: 0.75}.items()], metrics.schema)
    found = evaluation.pair_interactions(pairs, registry)
    assert {r.pair_condition: round(r.interaction_excess_auprc_drop, 6) for r in found.collect()} == {a: 0.1, b: 0.0}
    order = evaluation.order_sensitivity(found, registry).collect()
    assert len(order) == 1 and round(order[0].absolute_order_sensitivity, 6) == 0.1


def test_separated_effects(spark):
    rows = [("d", t, "x", float(10 * t + k)) for t in (0, 1) for k in range(4)]
    r = one(evaluation.feature_effects(spark.createDataFrame(rows, "dataset string, target int, feature string, value double"), ["dataset"]))
    assert r["separation_auc"] == 1.0 and r["rank_biserial"] == 1.0


def test_ledger_rules(spark):
    cases = {"keep": (0.5, 0.5, 0.3, 0.3, 0.5, 0.3, 0.1), "shortcut": (0.5, 0.1, 0.3, 0.3, 0.5, 0.3, 0.1), "discard": (0.05, 0.05, 0.3, 0.3, 0.3, 0.3, 0.1), "specialist": (0.3, 0.3, 0.3, 0.3, 0.6, 0.05, 0.1), "fragile": (0.3, 0.3, 0.05, 0.3, 0.3, 0.2, 0.1)}
    t, d, g, c = [], [], [], []
    for name, (clean, native, worst, data, best, least, nuisance) in cases.items():
        t += [(name, "canonical_128", "clean", 0.9, clean), (name, "native_capped", "clean", 0.9, native), (name, "canonical_128", "jpeg_q50", 0.7, worst)]
        d.append((name, "canonical_128", data, False))
        g += [(name, "canonical_128", x, False, False) for x in (best, least, best)]
        c.append((name, "canonical_128", "meta", nuisance))
    frames = [spark.createDataFrame(x, s) for x, s in ((t, "feature string, view string, condition string, oriented_auprc double, normalized_auprc double"), (d, "feature string, view string, normalized_auprc double, low_power boolean"), (g, "feature string, view string, normalized_auprc double, low_power boolean, direction_reversal boolean"), (c, "feature string, view string, strongest_nuisance string, max_abs_nuisance_spearman double"))]
    got = {r.feature: (r.decision, r.provisional) for r in evaluation.decision_ledger(*frames, recipes.condition_frame(spark, "core")).collect()}
    assert got == {name: (name, False) for name in cases}


def test_pareto_front_equals_pairwise(spark):
    rng = np.random.default_rng(0)
    rows = [(k, int(x), int(y)) for k, (x, y) in enumerate(rng.integers(0, 9, (60, 2)))]
    df = spark.createDataFrame(rows, "id int, x int, y int")
    want = {i for i, x, y in rows if not any(a >= x and b >= y and (a > x or b > y) for _, a, b in rows)}
    assert {r.id for r in evaluation.pareto_front(df, [], "x", "y", "id").collect()} == want


# sampling


def test_exact_stratified_sample(spark):
    rows = [(f"d{d}", f"p{d}{t}{s}{k}", t, f"s{s}") for d in (0, 1) for t in (0, 1) for s in (0, 1) for k in range(5)]
    df = spark.createDataFrame(rows, "dataset_id string, parent_id string, target int, stratum string")
    got = sampling.limit_records(df, 12, 7)
    assert {r["count"] for r in got.groupBy("dataset_id").count().collect()} == {12}
    assert {r["count"] for r in got.groupBy("dataset_id", "target").count().collect()} == {6}
    assert {r["count"] for r in got.groupBy("dataset_id", "target", "stratum").count().collect()} == {3}
    again = sampling.limit_records(df.repartition(17), 12, 7)
    assert got.exceptAll(again).count() == 0
    assert got.exceptAll(sampling.limit_records(df, 12, 8)).count() > 0


def test_uniform_chains_are_counterbalanced(spark):
    df = spark.createDataFrame([("d", f"p{k}", 1, "s") for k in range(120)], "dataset_id string, parent_id string, target int, sampling_stratum string")
    chains = sampling.uniform_chains(df, recipes.family_variants(), 3).persist()
    assert {r["count"] for r in chains.groupBy("transform_step_count").count().collect()} == {20}
    steps = sampling.chain_steps(chains, ["dataset_id", "target", "sampling_stratum"])
    assert rules.counterbalance_rules(steps, ["step_position"], "transform_family", list(recipes.CHAIN_FAMILIES)).count() == 0
    assert sampling.public_chains(chains).columns == ["dataset_id", "parent_id", "target", "sampling_stratum", "transform_step_count"]


def test_balanced_quotas_equal_the_loop(spark):
    rng = np.random.default_rng(4)
    for _ in range(6):
        counts = {f"k{i}": int(n) for i, n in enumerate(rng.integers(0, 9, 6))}
        total = int(rng.integers(1, max(2, sum(counts.values()))))
        if sum(counts.values()) < total:
            continue
        want = dict.fromkeys([k for k, n in counts.items() if n], 0)
        while sum(want.values()) < total:
            for k in sorted(want):
                if want[k] < counts[k] and sum(want.values()) < total:
                    want[k] += 1
        df = spark.createDataFrame(list(counts.items()), "k string, n long")
        assert {r.k: r.quota for r in sampling.balanced_quotas(df, "k", "n", total).collect()} == want


def test_stable_hash_escapes_like_json(spark):
    import hashlib

    values = ["plain", 'q"uote', "back\\slash", "line\nbreak", "é", "日本", "😀", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", hashing.stable_hash("s", F.col("v")).alias("h")).collect():
        assert r.h == hashlib.sha256(json.dumps(["s", r.v], ensure_ascii=True, separators=(",", ":")).encode()).hexdigest()


def test_fill_to_target_overshoots_by_whole_groups(spark):
    df = spark.createDataFrame([("a", 4), ("b", 3), ("c", 5), ("d", 1)], "g string, n long")
    got = {r.g: r.pool for r in aggregates.fill_to_target(df, ["g"], "n", [("one", 5), ("two", 4)], "rest").collect()}
    assert got == {"a": "one", "b": "one", "c": "two", "d": "rest"}


# recipes


def test_recipe_banks():
    sizes = {p: len(recipes.conditions(p)) for p in recipes.PROFILES}
    assert sizes == {"core": 20, "color_factorial": 32, "directed_pairs": 50, "realistic": 32, "covering32": 52, "all": 106}
    assert {k: len(v) for k, v in recipes.chain_banks().items()} == {1: 15, 2: 30, 3: 10}
    names = [r["name"] for r in recipes.conditions("all")]
    assert len(set(names)) == len(names)
    assert recipes.canonical_recipe([{"a": 1.0}]) == '[{"a":1}]'
    assert recipes.radical_inverse(6, 2) == 0.375


# rules


def training_rows(spark, **change):
    base = dict(parent_id="p", lineage_id="l", split="train", training_pool="detector", label="authentic", sample_kind="authentic", generator_family="none", generation_model="none", source_dataset="s", local_path="x", source_parent_id=None)
    rows = [base, base | {"parent_id": "q", "label": "dda", "sample_kind": "dda", "source_parent_id": "p"}, base | {"parent_id": "r", "lineage_id": "m", "split": "test", "training_pool": "none"}]
    rows[1] |= change
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in base))


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({}, None), ({"parent_id": "p"}, "duplicate_parent"), ({"split": "nope"}, "bad_split"), ({"training_pool": "memory"}, "derived_outside_detector"), ({"label": "authentic"}, "label_kind_mismatch"), ({"source_parent_id": "zz"}, "pair_source_missing"),
        ({"lineage_id": "m"}, "leakage_lineage_id"), ({"label": "tampered"}, "forbidden_label"), ({"local_path": None}, "null_field"), ({"label": "photo"}, "unknown_label"), ({"generation_model": None}, "null_field"),
        ({"label": " DDA_aligned ", "split": "Train "}, None), ({"generation_model": "DALL-E advanced 3", "source_dataset": "coco-val2017"}, "demo_row"), ({"source_parent_id": " "}, "pair_source_missing"), ({"source_parent_id": "r"}, "pair_other_side"),
    ],
)
def test_training_manifest_fails_closed(spark, change, rule):
    found = {r.rule for r in rules.training_manifest_rules(training_rows(spark, **change)).collect()}
    assert (not found) if rule is None else rule in found
    if rule:
        with pytest.raises(rules.RuleViolation):
            rules.load_subset(training_rows(spark, **change), splits=["train"])


def expansion_config(**source):
    policy = {f: "x" for f in rules.POLICY_FIELDS} | {"source_id": "s", "selected": True, "file_list_sha256": "a" * 64, "content_sha256": "b" * 64, "license_decision": "allowlisted", "underlying_image_license_decision": "allowlisted"}
    final = {"phase": "final_confirmation", "sealed": True, "generator_ids": []}
    return {"schema_version": 1, "selection_seed": "s", "acquisition": {"default_mode": "dry_run", "require_all_selected_sources_allowlisted": True}, "final_confirmation": final, "sources": [policy | source]}


@pytest.mark.parametrize(
    ("path", "value"),
    [
        ("schema_version", 2), ("selection_seed", " "), ("selection_seed", None), ("acquisition.default_mode", "download"), ("acquisition.require_all_selected_sources_allowlisted", "yes"), ("final_confirmation.phase", "discovery"),
        ("final_confirmation.sealed", False), ("final_confirmation.generator_ids", None), ("sources", []), ("acquisition", None), ("sources", [{}]), ("sources", "s"),
    ],
)
def test_expansion_config_fails_closed(path, value):
    config = expansion_config()
    assert rules.config_problems(config) == []
    at = config
    *outer, last = path.split(".")
    for k in outer:
        at = at[k]
    at[last] = value
    assert rules.config_problems(config)
    with pytest.raises(rules.RuleViolation):
        rules.assert_gate(config)


@pytest.mark.parametrize(
    ("change", "allowed"),
    [
        ({}, True), ({"license_decision": "pending"}, False), ({"underlying_image_license_decision": "rejected"}, False), ({"content_sha256": "zz"}, False), ({"reviewer": ""}, False), ({"revision": None}, False), ({"content_sha256": " " + "B" * 64}, True),
    ],
)
def test_license_gate(change, allowed):
    config = expansion_config(**change)
    assert [g["acquisition_allowed"] for g in rules.license_gate(config)] == [allowed]
    if allowed:
        rules.assert_gate(config)
    else:
        with pytest.raises(rules.RuleViolation):
            rules.assert_gate(config)
        rules.assert_gate(expansion_config(selected=False, **change))


@pytest.mark.parametrize("word", ["allow", "approved", "allowed", "", None])
def test_license_gate_knows_three_words(word):
    with pytest.raises(rules.RuleViolation):
        rules.license_gate(expansion_config(license_decision=word))


# reliability and retrieval


def test_reliability_availability(spark):
    rows = [(float(k % 2), t, 3.0 * t * (1 - k % 2) + 0.1 * (k % 5)) for t in (0, 1) for k in range(40)]
    df = spark.createDataFrame(rows, "q double, target int, logit double")
    edges = spark.createDataFrame([([1.0],)], "edges_q array<double>")
    cells = reliability.assign_cells(df, edges, ["q"])
    table = reliability.reliability_table(cells, cells.where("target = 0"), ["cell_q"], "logit", "target", F.col("cell_q") == 0, reliability.cell_grid(edges, ["q"]), prior=0.5)
    got = {r.cell_q: r.availability for r in table.collect()}
    assert 0 <= got[1] < got[0] <= 1 and got[0] > 0.5
    assert one(reliability.occupancy_overlap(cells.where("q = 0"), cells.where("q = 1"), ["cell_q"]))["overlap"] == 0.0


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e3, 1e7, 1e12])
def test_ranking_at_every_scale(spark, scale):
    rng = np.random.default_rng(3)
    score = np.round(rng.normal(size=400), 2) * scale - 0.7 * scale
    target = (rng.random(400) < 0.4).astype(int)
    df = spark.createDataFrame(list(zip(target.tolist(), score.tolist(), strict=True)), "target int, score double")
    got = one(ranking.ranking_metrics(df, [], "target", "score"))
    pos, neg = score[target == 1], score[target == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert got["average_precision"] == pytest.approx(aggregates.average_precision(pos, neg), abs=1e-12)


def test_score_buckets_are_monotone(spark):
    values = sorted([0.0, -0.0, 1.0, -1.0, 1e-300, 1e300, -1e300, 0.999999, 1.0000001, -1.0000001, *[s * 10.0**k * m for s in (1, -1) for k in range(-12, 13) for m in (1, 1.5, 9.99)]])
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", ranking.score_bucket(F.col("x"), 64).alias("b")).collect()
    found = [r.b for r in sorted(rows, key=lambda r: r.x)]
    assert found == sorted(found) and len(set(found)) > 40


def test_spearman_and_ranks(spark):
    rng = np.random.default_rng(8)
    rows = [(k % 3, float(x), float(x // 3 + y)) for k, (x, y) in enumerate(rng.integers(0, 12, (200, 2)))] + [(7, 1.0, float(k)) for k in range(4)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r.g: r.spearman for r in evaluation.spearman(df, ["g"], "x", "y").collect()}
    frame = pd.DataFrame(rows, columns=["g", "x", "y"])
    for g, part in frame.groupby("g"):
        want = 0.0 if part.x.nunique() == 1 else np.corrcoef(part.x.rank(), part.y.rank())[0, 1]
        assert got[g] == pytest.approx(want, abs=1e-12)
    shown = {(r.g, r.x): r.p for r in ranking.with_rank_percentile(df, ["g"], "x", "p").collect()}
    for g, part in frame.groupby("g"):
        assert all(shown[g, x] == pytest.approx(p) for x, p in zip(part.x, part.x.rank(pct=True), strict=True))


def test_best_match_in_turn(spark):
    left = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else "c", i % 3) for i in range(200)], "i long, k string, m int")
    right = spark.createDataFrame([(i, "ab"[i % 2], i % 2) for i in range(13)], "j long, k string, m int")
    tiers = [["k", "m"], ["k"], []]
    got = {r.i: (r.match, r.match_tier) for r in aggregates.best_match(left, right, tiers, "j", "i").collect()}
    rows, others = left.toPandas(), right.toPandas()
    for i, row in rows.iterrows():
        for tier, keys in enumerate(tiers):
            same = lambda d, keys=keys, row=row: d[np.logical_and.reduce([d[k] == row[k] for k in keys])] if keys else d
            partners = same(others)
            if len(partners):
                place = int((same(rows).i < row.i).sum())
                assert got[row.i] == (int(partners.j.iloc[place % len(partners)]), tier)
                break


def test_clean_drops_need_a_clean_row(spark):
    m = spark.createDataFrame([("d", "jpeg_q30", 0.5), ("e", "clean", 0.9)], "dataset_id string, condition string, roc_auc double")
    with pytest.raises(Exception, match="no clean row for d"):
        evaluation.clean_drops(m, ["dataset_id"], ["roc_auc"]).collect()


def test_robustness_frontier(spark):
    rows = [("a", "clean", 0.9), ("a", "x", 0.2), ("b", "clean", 0.8), ("b", "x", 0.6), ("c", "clean", 0.7), ("c", "x", 0.5)]
    got = {r.name: (r.clean_value, r.worst_value, r.pareto) for r in evaluation.robustness_frontier(spark.createDataFrame(rows, "name string, condition string, value double"), "name", "value").collect()}
    assert got == {"a": (0.9, 0.2, True), "b": (0.8, 0.6, True), "c": (0.7, 0.5, False)}


def test_registry_says_how_steps_are_done(spark):
    r = {x.name: x for x in recipes.condition_frame(spark, "all").collect()}
    assert r["clean"].ordered_operations == "clean" and r["clean"].interpolation_json == "[]"
    both = r["crop_80__resize_0.5__jpeg_q50"]
    assert (both.interpolation_json, both.padding_json, both.seed_policy_json) == ('["bicubic", "lanczos", "lanczos"]', "[]", "[]")
    assert r["blur_sigma1"].padding_json == '["pillow_default"]' and r["noise_sigma0.05"].seed_policy_json.startswith('["sha256(')
    with pytest.raises(KeyError):
        recipes.condition_frame(spark, "core", ["nope"])


def test_top_k_blocks_equal_dense(spark, monkeypatch):
    rng = np.random.default_rng(2)
    q, p = rng.normal(size=(20, 6)), rng.normal(size=(9, 6))
    frame = lambda x: spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id int, embedding array<double>")
    for limit in (4_000_000, 12):
        monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", limit)
        got = retrieval.top_k(frame(q), frame(p), 3, "id", "id").collect()
        cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T
        want = {(i, int(j), r + 1) for i in range(20) for r, j in enumerate(np.argsort(-cos[i])[:3])}
        assert {(r.query, r.prototype, r["rank"]) for r in got} == want


def test_diversity_of_orthonormal_prototypes(spark):
    eye = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "prototype_id int, embedding array<double>")
    assert one(retrieval.diversity(eye))["diversity"] == pytest.approx(0.0)


def test_nuisance_probe_sees_a_shortcut(spark):
    rows = [(k % 2, f"l{k}", float(k % 2) + 0.01 * (k % 7), float(k % 5)) for k in range(60)]
    df = spark.createDataFrame(rows, "target int, lineage_id string, width double, height double")
    assert one(reliability.nuisance_probe(df, ["width", "height"], "lineage_id"))["probe_auc"] > 0.95


# kernels


def test_feature_profiles():
    assert (len(kernels.profile("expanded_v2")), len(kernels.profile("frozen_v1"))) == (82, 53)


def test_filters_match_direct_sums():
    rng = np.random.default_rng(1)
    x = rng.random((20, 17))
    pad = np.pad(x, 1, mode="symmetric")
    direct = sum(np.outer([1, 2, 1], [-1, 0, 1])[i, j] * pad[i : i + 20, j : j + 17] for i in range(3) for j in range(3)) / 8
    assert np.allclose(kernels.sobel(x)[0], direct)
    assert np.allclose(kernels.box(x, 3), sum(pad[i : i + 20, j : j + 17] for i in range(3) for j in range(3)) / 9)
    assert np.allclose(kernels.gaussian(np.ones((9, 9)), 2.0), 1.0)
    b = kernels.cosine_basis()
    assert np.allclose(b @ b.T, np.eye(8))
    assert np.isclose(sum((v**2).sum() for v in kernels.haar(x[:, :16])), (x[:, :16] ** 2).sum())


def test_features_respond_to_signal(spark):
    rng = np.random.default_rng(3)
    base = np.clip(0.5 + 0.1 * rng.normal(size=(64, 64, 3)), 0, 1)
    blocky = np.kron(rng.random((8, 8)), np.ones((8, 8)))
    assert kernels.wavelet_noise(kernels.noisy(np.full((64, 64, 3), 0.5), 0.05, 1) @ kernels.LUMA) > kernels.wavelet_noise(kernels.noisy(np.full((64, 64, 3), 0.5), 0.01, 1) @ kernels.LUMA)
    assert kernels.block_excess(blocky) == 1.0
    assert np.array_equal(kernels.noisy(base, 0.1, 5), kernels.noisy(base, 0.1, 5))
    rows = [(64, 64, [float(v) for v in base.ravel()], "a", 1234), (64, 64, [0.5] * (64 * 64 * 3), "b", 1)]
    df = spark.createDataFrame(rows, "height int, width int, pixels array<double>, name string, bytes long")
    got = {r.name: r.asDict() for r in images.image_features(df, ["name"], metadata=["bytes"]).collect()}
    assert len(got["a"]) == 79 and got["b"]["luma_std"] == pytest.approx(0) and got["a"]["meta_bytes_per_pixel"] == pytest.approx(1234 / 4096)
    assert all(np.isfinite(v) for r in got.values() for k, v in r.items() if k != "name")
    assert images.quality_vectors(df, ["name"]).count() == 2


def test_codecs_are_gated():
    if not codecs.available():
        with pytest.raises(codecs.CodecMissing):
            codecs.apply_step(np.zeros((16, 16, 3)), "jpeg", {"quality": 70, "subsampling": 2}, 0)
    out = codecs.apply_recipe(np.full((16, 16, 3), 0.5), [recipes.step("gaussian_noise 0.05")], "p", 1)
    assert out.shape == (16, 16, 3) and np.array_equal(out, codecs.apply_recipe(np.full((16, 16, 3), 0.5), [recipes.step("gaussian_noise 0.05")], "p", 1))


# sources and sinks


def test_csv_and_zip_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,path,label,gen\na,x.png,real,NIL\nb,y.png,fake,flux\nc,z.png,fake,flux\n")
    spec = readers.DatasetSpec("d", "csv", str(tmp_path), "m.csv", columns={"parent_id": "id", "image_path": "path", "label": "label", "generation_model": "gen"}, label_map={"real": 0, "fake": 1}, value_maps={"generation_model": {"NIL": "none"}}, expected_rows=3)
    got = readers.load_datasets(spark, [spec])
    assert {(r.parent_id, r.target, r.generation_model) for r in got.collect()} == {("a", 0, "none"), ("b", 1, "flux"), ("c", 1, "flux")}
    with pytest.raises(rules.RuleViolation):
        readers.load_datasets(spark, [spec, spec])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name in ("real/a.png", "fake/b.jpg", "__MACOSX/real/a.png", "fake/readme.txt"):
            z.writestr(name, name)
    spec = readers.DatasetSpec("z", "zip_class_folders", str(tmp_path), classes={"real": 0, "fake": 1}, expected_counts={"real": 1, "fake": 1})
    assert {r.target for r in readers.load_datasets(spark, [spec]).collect()} == {0, 1}
    assert {(r.member, bytes(r.content)) for r in readers.zip_payloads(spark, str(tmp_path)).collect()} == {("real/a.png", b"real/a.png"), ("fake/b.jpg", b"fake/b.jpg")}
    os.makedirs(tmp_path / "tree/real/deep")
    (tmp_path / "tree/real/deep/q.PNG").write_bytes(b"1")
    spec = readers.DatasetSpec("t", "class_folders", str(tmp_path / "tree"), classes={"real": 0})
    assert readers.load_datasets(spark, [spec]).first().target == 0
    assert set(readers.adapters()) == {"csv", "class_folders", "zip_class_folders"}


def test_index_dispatch_and_optional_tables(spark, tmp_path):
    (tmp_path / "legacy.csv").write_text("dataset,split,label,local_path,width\nd,train_a,fake,p.png,10\nd,validation,real,q.png,10\nd,test,tampered,r.png,10\n")
    got = {r.local_path: (r.target, r.phase) for r in readers.read_index(spark, str(tmp_path / "legacy.csv")).collect()}
    assert got == {"p.png": (1, "discovery"), "q.png": (0, "confirmation")}
    schema = spark.range(1).schema
    assert readers.read_or_empty(spark, str(tmp_path / "absent"), schema).count() == 0
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.jsonl").write_text('{"sample_id":"x","model":"m","condition":"clean","probability_ai":0.5,"threshold":0.5,"decision":1}\n')
    assert readers.prediction_shards(spark, str(tmp_path / "s")).first().decision == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", float("nan"))], "image_path string, pred double")
    with pytest.raises(rules.RuleViolation):
        sinks.write_submission(df, str(tmp_path / "s"))
    sinks.write_submission(df.limit(1), str(tmp_path / "s"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "s")).collect()] == [{"image_path": "a", "pred": 0.5}]
    assert json.loads(sinks.json_rows(df, df.columns).orderBy("value").collect()[1].value) == {"image_path": "b", "pred": None}
    first = sinks.write_with_sidecar(df, str(tmp_path / "t"), df.columns)
    assert first == sinks.write_with_sidecar(df.repartition(7), str(tmp_path / "u"), df.columns) and first["rows"] == 2
    sinks.receipt(spark, str(tmp_path / "once"), {"a": 1})
    with pytest.raises(rules.RuleViolation):
        sinks.receipt(spark, str(tmp_path / "once"), {"a": 1})
    scores = spark.createDataFrame([(0, 0, 0.1, "g"), (0, 1, 0.9, "g"), (1, 0, 0.2, "h"), (1, 1, 0.8, "h")], "target int, decision int, score double, source string")
    page = sinks.error_report(scores, ["source"])
    assert "0.5000" in page and page.count("<table>") == 4
    assert "| a |" in sinks.markdown([{"a": 1.0}], ["a"])
    old = spark.createDataFrame([("k", "1")], "key string, sha string")
    with pytest.raises(rules.RuleViolation):
        sinks.save_new(old, spark.createDataFrame([("k", "2")], old.schema), "key", "sha", str(tmp_path / "n"))


def test_scalars(spark):
    row = spark.createDataFrame([("  A  b\tC ", "Foo--Bar! 9", "x/y/Pic.tar.JPG", 0.5)], "a string, b string, c string, d double").select(
        scalars.squeezed(F.col("a")).alias("a"), scalars.slug(F.col("b")).alias("b"), scalars.stem(F.col("c")).alias("c"), scalars.suffix(F.col("c")).alias("s"), scalars.number_token(F.col("d")).alias("d"),
        scalars.is_image_member(F.col("c")).alias("i"), scalars.rounded(F.lit(2.5)).alias("r"), scalars.softplus(F.lit(0.0)).alias("p"),
    ).first()
    assert tuple(row)[:7] == ("a b c", "foo-bar-9", "Pic.tar", ".jpg", "0p5", True, 2.0) and row.p == pytest.approx(np.log(2))


# streaming


def test_streaming_confusion_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{k % 6}:10:00", k % 2, float(k % 3 - 1), "a") for k in range(60)]
    df = spark.createDataFrame(rows, "t string, target int, score double, g string").select(F.to_timestamp("t").alias("ts"), "target", "score", "g")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.windowed_confusion(stream, ["g"], late="1 day").writeStream.format("memory").queryName("confusion").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    batch = streaming.windowed_confusion(df, ["g"], late="1 day")
    assert batch.exceptAll(spark.table("confusion")).count() == 0 and spark.table("confusion").count() == 6
    counts = streaming.binned_counts(df, ["g"], -2.0, 2.0)
    exact, near = one(ranking.ranking_metrics(df, ["g"], "target", "score")), one(streaming.binned_ranking(counts, ["g"]))
    assert near["roc_auc"] == pytest.approx(exact["roc_auc"], abs=0.01)


def test_streaming_prototypes_buffer_and_move(spark):
    model = streaming.StreamingPrototypes(2, seed=1)
    batch = lambda x: spark.createDataFrame([(v,) for v in x], "embedding array<double>")
    model.update(batch([[1.0, 0.0]]))
    assert model.centres is None
    model.update(batch([[0.0, 1.0], [1.0, 0.1], [0.1, 1.0]]))
    assert len(model.centres) == 2 and sum(model.mass) == 4


def test_entry_and_oracles_agree_in_names():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
