"""Queries for ranking, threshold, dashboard and inventory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.operators import aggregates as A
from gaugewright.operators import evaluation as E
from gaugewright.operators import ranking as R
from gaugewright.plans.catalog import LINES, SCORES, Tables, query, ranking_sql, rounded

RATES = list(R.RATES)
RANKED = ["roc_auc", "average_precision", "partial_auc"]
THRESHOLD = 1500.0


def slices_sql(source: str, keys: list[str], score: str = "score", threshold: float = THRESHOLD, with_: str = SCORES) -> str:
    k = ", ".join(keys)
    t = f"{threshold}::DOUBLE"
    on = " AND ".join(f"b.{x} IS NOT DISTINCT FROM r.{x}" for x in keys)
    ok = "status = 'ok'"
    two = "status IN ('ok', 'positive_only')"
    return f"""WITH {with_}, {ranking_sql(source, keys, score=score)},
b AS (SELECT {k}, count(*)::BIGINT AS rows, count_if(target = 1)::BIGINT AS positives, count_if(target = 0)::BIGINT AS negatives, count_if(target = 1 AND {score} >= {t})::DOUBLE AS tp, count_if(target = 0 AND {score} < {t})::DOUBLE AS tn,
  count_if(target = 0 AND {score} >= {t})::DOUBLE AS fp, count_if(target = 1 AND {score} < {t})::DOUBLE AS fn FROM {source} GROUP BY {k}),
m AS (SELECT *, CASE WHEN negatives = 0 THEN 'positive_only' WHEN positives = 0 THEN 'negative_only' ELSE 'ok' END AS status,
  (tp + tn) / rows AS accuracy, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2.0::DOUBLE AS balanced_accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity,
  2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, fp / nullif(fp + tn, 0) AS fpr, fn / nullif(fn + tp, 0) AS fnr, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc,
  (tp + fn) / rows AS prevalence, (tp + fp) / rows AS predicted_positive_rate FROM b)
SELECT {', '.join('b.' + x + '::BIGINT AS quality' if x == 'quality' else 'b.' + x for x in keys)}, status, rows, positives, negatives, CASE WHEN {two} THEN tp::BIGINT END AS tp, CASE WHEN {ok} THEN tn::BIGINT END AS tn, CASE WHEN {ok} THEN fp::BIGINT END AS fp, CASE WHEN {two} THEN fn::BIGINT END AS fn,
  {', '.join(f"CASE WHEN {two if c in ('recall', 'fnr', 'predicted_positive_rate') else 'true' if c == 'prevalence' else ok} THEN round({c}, 6) END AS {c}" for c in RATES)}, {rounded(RANKED)}
FROM m b LEFT JOIN ranked r ON {on}"""


@query("m16_metric_slices", slices_sql("scores", ["lang"]))
def metric_slices(t: Tables):
    """How well text length separates toxic documents, by language."""
    return R.metric_slices(t.scores, ["lang"], threshold=THRESHOLD)


@query("m14_one_class_slices", slices_sql("scores", ["lang", "quality"]))
def one_class_slices(t: Tables):
    """Slices with one class keep what is defined for them."""
    return R.metric_slices(t.scores, ["lang", "quality"], threshold=THRESHOLD)


@query("m05_roc_auc", f"WITH {SCORES}, {ranking_sql('scores', ['source'])} SELECT source, round(roc_auc, 6) AS roc_auc FROM ranked")
def roc_auc(t: Tables):
    return R.ranking_metrics(t.scores, ["source"], "target", "score").select("source", "roc_auc")


@query("m06_average_precision", f"WITH {LINES}, {ranking_sql('lines', ['status'], score='l_extendedprice')} SELECT status, round(average_precision, 6) AS average_precision FROM ranked")
def average_precision(t: Tables):
    return R.ranking_metrics(t.lines, ["status"], "target", "l_extendedprice").select("status", "average_precision")


@query("m09_partial_auc", f"WITH {LINES}, {ranking_sql('lines', ['time_window'], score='l_quantity', max_fpr=0.1)} SELECT time_window, round(partial_auc, 6) AS partial_auc, round(tpr_at_fpr, 6) AS tpr_at_fpr FROM ranked")
def partial_auc(t: Tables):
    """Normalised partial AUC and TPR at the FPR limit."""
    return R.ranking_metrics(t.lines, ["time_window"], "target", "l_quantity", max_fpr=0.1, fpr_limit=0.1).select("time_window", "partial_auc", "tpr_at_fpr")


@query(
    "m08_normalized_ap",
    f"WITH {SCORES}, {ranking_sql('scores', ['lang'])}, p AS (SELECT lang, avg(target::DOUBLE) AS q FROM scores GROUP BY lang) SELECT r.lang, round(average_precision, 6) AS average_precision, round((average_precision - q) / (1 - q), 6) AS normalized_ap FROM ranked r JOIN p ON r.lang = p.lang",
)
def normalized_ap(t: Tables):
    ap = R.ranking_metrics(t.scores, ["lang"], "target", "score").select("lang", "average_precision")
    prevalence = t.scores.groupBy("lang").agg(F.avg(F.col("target").cast("double")).alias("q"))
    return ap.join(prevalence, "lang").select("lang", "average_precision", R.normalized_average_precision(F.col("average_precision"), F.col("q")).alias("normalized_ap"))


COMPARED = f"""WITH {SCORES},
a AS (SELECT 'positive_group' AS direction, source AS comparison_group, target, score FROM scores WHERE target = 1 UNION ALL SELECT 'positive_group', g.source, s.target, s.score FROM scores s CROSS JOIN (SELECT DISTINCT source FROM scores WHERE target = 1) g WHERE s.target = 0),
z AS (SELECT 'negative_group' AS direction, lang AS comparison_group, target, score FROM scores WHERE target = 0 UNION ALL SELECT 'negative_group', g.lang, s.target, s.score FROM scores s CROSS JOIN (SELECT DISTINCT lang FROM scores WHERE target = 0) g WHERE s.target = 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM z), {ranking_sql('u', ['direction', 'comparison_group'])},
c AS (SELECT direction, comparison_group, count(*)::BIGINT AS rows, count_if(target = 1)::BIGINT AS positives, avg(score) FILTER (WHERE target = 1) AS positive_mean, avg(score) FILTER (WHERE target = 0) AS negative_mean FROM u GROUP BY ALL)
SELECT c.direction, c.comparison_group, rows, positives, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(positive_mean, 6) AS positive_mean, round(negative_mean, 6) AS negative_mean
FROM c JOIN ranked r ON c.direction = r.direction AND c.comparison_group = r.comparison_group"""


@query("m17_comparison_slices", COMPARED)
def comparison(t: Tables):
    """Each source's positives against all negatives and each language's negatives against all positives."""
    return R.comparison_metrics(t.scores, "source", "lang", threshold=THRESHOLD).select("direction", "comparison_group", "rows", "positives", "roc_auc", "average_precision", "positive_mean", "negative_mean")


@query(
    "m20_threshold_at_fpr",
    f"""WITH {SCORES}, o AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score) AS i, count(*) OVER (PARTITION BY lang) AS n FROM scores WHERE target = 0),
t AS (SELECT lang, min(score) AS threshold FROM o WHERE i >= ceil(0.95::DOUBLE * (n - 1) - 1e-9) + 1 GROUP BY lang)
SELECT t.lang, threshold, round(count_if(s.target = 0 AND s.score >= threshold)::DOUBLE / count_if(s.target = 0), 6) AS fpr, round(count_if(s.target = 1 AND s.score >= threshold)::DOUBLE / nullif(count_if(s.target = 1), 0), 6) AS tpr FROM t JOIN scores s ON t.lang = s.lang GROUP BY t.lang, threshold""",
)
def at_fpr(t: Tables):
    """Threshold at an authentic FPR of 5 % and the rates at it."""
    cut = R.threshold_at_fpr(t.scores, ["lang"], "target", "score")
    hit = F.col("score") >= F.col("threshold")
    n = t.scores.join(cut, "lang").groupBy("lang", "threshold").agg(F.count_if((F.col("target") == 0) & hit).alias("fp"), F.count_if(F.col("target") == 0).alias("n"), F.count_if((F.col("target") == 1) & hit).alias("tp"), F.count_if(F.col("target") == 1).alias("p"))
    return n.select("lang", "threshold", R.ratio("fp", "n").alias("fpr"), R.ratio("tp", "p").alias("tpr"))


EFFECT_ROWS = "e AS (" + " UNION ALL ".join(f"SELECT status, '{c}' AS feature, target, {c} AS value FROM lines" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")"


@query(
    "m24_feature_effects",
    f"""WITH {LINES}, {EFFECT_ROWS}, {ranking_sql('e', ['status', 'feature'], score='value')},
q AS (SELECT status, feature, quantile_cont(value, 0.5) FILTER (WHERE target = 1) - quantile_cont(value, 0.5) FILTER (WHERE target = 0) AS d, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, count(*)::BIGINT AS rows FROM e GROUP BY ALL)
SELECT q.status, q.feature, rows, round(roc_auc, 6) AS roc_auc, round(greatest(roc_auc, 1 - roc_auc), 6) AS separation_auc, round(2 * roc_auc - 1, 6) AS rank_biserial, round(d, 6) AS median_difference, round(iqr, 6) AS iqr, round(d / (iqr + 1e-12), 6) AS robust_effect
FROM q JOIN ranked r ON q.status = r.status AND q.feature = r.feature""",
)
def effects(t: Tables):
    rows = E.long_features(t.lines, ["status", "target"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return E.feature_effects(rows, ["status"])


@query(
    "m26_dashboard_slices",
    f"""WITH {SCORES}, b AS (SELECT source, count_if(target = 1 AND score >= 1500)::DOUBLE AS tp, count_if(target = 0 AND score < 1500)::DOUBLE AS tn, count_if(target = 0 AND score >= 1500)::DOUBLE AS fp, count_if(target = 1 AND score < 1500)::DOUBLE AS fn, avg(1 / (1 + exp(-(score - 1500) / 1000))) AS mp FROM scores GROUP BY source)
SELECT source, tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, (tp + tn + fp + fn)::BIGINT AS rows, round((fp + fn) / (tp + tn + fp + fn), 6) AS mismatch_rate, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fnr,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy, round(mp, 6) AS mean_probability FROM b""",
)
def dashboard(t: Tables):
    """Dashboard slices; a missing class counts as 0."""
    rows = t.scores.withColumns({"decision": F.when(F.col("score") >= THRESHOLD, 1).otherwise(0), "probability": F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("score") - THRESHOLD) / 1000.0))})
    return A.dashboard_slices(rows, ["source"])


@query(
    "m27_mismatch_association",
    f"""WITH {SCORES}, w AS (SELECT lang, (target = 1) <> (score >= 1500) AS a, (target = 1) <> (score >= 2500) AS b FROM scores), n AS (SELECT lang, count_if(a AND b)::DOUBLE AS n11, count_if(a AND NOT b)::DOUBLE AS n10, count_if(NOT a AND b)::DOUBLE AS n01, count_if(NOT a AND NOT b)::DOUBLE AS n00 FROM w GROUP BY lang)
SELECT lang, n11::BIGINT AS n11, n10::BIGINT AS n10, n01::BIGINT AS n01, n00::BIGINT AS n00, round((n11 * n00 - n10 * n01) / nullif(sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)), 0), 6) AS phi,
  round((n11 / nullif(n11 + n10, 0)) / nullif((n11 + n01) / (n11 + n10 + n01 + n00), 0), 6) AS lift, round(n01 / nullif(n01 + n00, 0), 6) AS newly_wrong_rate, round(n10 / nullif(n10 + n11, 0), 6) AS recovered_rate FROM n""",
)
def association(t: Tables):
    wrong = lambda x: (F.col("target") == 1) != (F.col("score") >= x)
    return A.mismatch_association(t.scores.withColumns({"a": wrong(THRESHOLD), "b": wrong(2500.0)}), ["lang"], "a", "b")


@query(
    "m28_selected_totals",
    f"""WITH {SCORES}, b AS (SELECT count_if(target = 1 AND score >= 1500)::DOUBLE AS tp, count_if(target = 0 AND score < 1500)::DOUBLE AS tn, count_if(target = 0 AND score >= 1500)::DOUBLE AS fp, count_if(target = 1 AND score < 1500)::DOUBLE AS fn FROM scores)
SELECT tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM b""",
)
def totals(t: Tables):
    rows = t.scores.withColumns({"decision": F.when(F.col("score") >= THRESHOLD, 1).otherwise(0), "probability": F.lit(0.5)})
    return A.selected_totals(A.dashboard_slices(rows, ["source"]))


@query(
    "a08_score_distributions",
    f"""WITH {SCORES} SELECT lang, target::BIGINT AS target, 'score' AS score_column, count(*)::BIGINT AS rows, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS standard_deviation, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.95), 6) AS p95,
  CASE WHEN target = 1 THEN 'aigc' ELSE 'authentic' END AS class_name FROM scores GROUP BY lang, target""",
)
def distributions(t: Tables):
    return E.score_distributions(t.scores, ["lang"], ["score"])


SETS = {"language": ["lang"], "source": ["source"], "language_quality": ["lang", "quality"], "all": []}


@query(
    "a09_distribution_sets",
    f"WITH {SCORES}, x AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS slice_type, {'lang' if 'lang' in c else 'NULL::VARCHAR'} AS lang, {'source' if 'source' in c else 'NULL::VARCHAR'} AS source, {'quality' if 'quality' in c else 'NULL'}::BIGINT AS quality, target, score FROM scores" for n, c in SETS.items())
    + ") SELECT slice_type, lang, source, quality, target::BIGINT AS target, count(*)::BIGINT AS rows, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.95), 6) AS p95 FROM x GROUP BY ALL",
)
def distribution_sets(t: Tables):
    """Several slice sets in one shuffle."""
    return E.distribution_tables(t.scores, SETS, ["score"]).select("slice_type", "lang", "source", "quality", "target", "rows", "mean", "p95")


@query("a01_coverage", "SELECT lang, source, count(*)::BIGINT AS rows, count(*) < 20 AS low_power FROM documents GROUP BY lang, source")
def coverage(t: Tables):
    return A.coverage(t.documents, ["lang", "source"])


@query("a50_roll_up", "SELECT lang, count(*)::BIGINT AS rows FROM documents GROUP BY lang")
def roll_up(t: Tables):
    return A.roll_up(A.coverage(t.documents, ["lang", "source"]), ["lang"])


@query("a03_inventory", f"WITH {SCORES} SELECT lang, count(*)::BIGINT AS rows, count(DISTINCT doc_id)::BIGINT AS unique_parents, count_if(target = 0)::BIGINT AS n0, count_if(target = 1)::BIGINT AS n1 FROM scores GROUP BY lang")
def inventory(t: Tables):
    out = A.inventory(t.scores, ["lang"], parent="doc_id")
    get = lambda k: F.coalesce(F.try_element_at("target_counts", F.lit(k)), F.lit(0))
    return out.select("lang", "rows", "unique_parents", get("0").alias("n0"), get("1").alias("n1"))


@query("a04_overview", "SELECT p_brand, count(*)::BIGINT AS rows, min(p_size)::BIGINT AS min_p_size, round(quantile_cont(p_size::DOUBLE, 0.5), 6) AS median_p_size, max(p_size)::BIGINT AS max_p_size FROM part GROUP BY p_brand")
def overview(t: Tables):
    return A.overview(t.part, ["p_brand"], ["p_size"])


@query("a05_first_distinct", "SELECT p_brand, array_to_string(list_slice(list_sort(list_distinct(list(p_size::VARCHAR))), 1, 8), ', ') AS sizes FROM part GROUP BY p_brand")
def first_distinct(t: Tables):
    return t.part.groupBy("p_brand").agg(A.first_distinct(F.col("p_size")).alias("sizes"))


@query("a06_pivot_counts", "SELECT l_shipmode_year AS y, count_if(l_linestatus = 'F')::BIGINT AS F, count_if(l_linestatus = 'O')::BIGINT AS O FROM (SELECT year(l_shipdate)::VARCHAR AS l_shipmode_year, l_linestatus FROM lineitem) GROUP BY 1")
def pivot(t: Tables):
    return A.pivot_counts(t.lineitem.select(F.year("l_shipdate").cast("string").alias("y"), "l_linestatus"), ["y"], "l_linestatus", ["F", "O"])


@query(
    "a34_group_table",
    f"WITH {SCORES} SELECT source, count(*)::BIGINT AS n, round(avg(((target = 1) = (score >= 1500))::INT::DOUBLE), 6) AS accuracy, count_if(target = 0 AND score >= 1500)::BIGINT AS false_positives, count_if(target = 1 AND score < 1500)::BIGINT AS false_negatives, round(avg(score), 6) AS mean_score FROM scores GROUP BY source",
)
def group_table(t: Tables):
    return A.group_table(t.scores.withColumn("decision", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)), "source")


@query(
    "a35_score_histogram",
    f"WITH {SCORES}, p AS (SELECT target, 1 / (1 + exp(-(score - 1500) / 1000)) AS p FROM scores), h AS (SELECT least(floor(p * 10), 9)::BIGINT AS bin, (target = 1) = (p >= 0.5) AS ok FROM p) SELECT b.bin, coalesce(count_if(ok), 0)::BIGINT AS correct, coalesce(count_if(NOT ok), 0)::BIGINT AS wrong FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN h ON b.bin = h.bin GROUP BY b.bin",
)
def histogram(t: Tables):
    rows = t.scores.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("score") - THRESHOLD) / 1000.0)))
    return A.score_histogram(rows, "p", (F.col("target") == 1) == (F.col("p") >= 0.5))


@query(
    "a36_balance_weights",
    f"WITH {SCORES}, g AS (SELECT target, source, count(*)::DOUBLE AS n FROM scores GROUP BY ALL), k AS (SELECT target, count(*)::DOUBLE AS c FROM g GROUP BY target), w AS (SELECT g.target, source, n, 1 / (n * c) AS w FROM g JOIN k ON g.target = k.target), m AS (SELECT sum(w * n) / sum(n) AS mean FROM w) SELECT s.doc_id, round(w.w / m.mean, 6) AS weight FROM scores s JOIN w ON s.target = w.target AND s.source = w.source CROSS JOIN m",
)
def weights(t: Tables):
    return A.balance_weights(t.scores, "target", "source").select("doc_id", "weight")


@query(
    "a51_objectives",
    f"WITH {SCORES}, x AS (SELECT target::DOUBLE AS y, (score - 1500) / 1000 AS z, CASE WHEN target = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM scores) SELECT round(sum(w * (greatest(z, 0) - z * y + ln(1 + exp(-abs(z))))) / sum(w), 6) AS weighted_bce FROM x",
)
def objectives(t: Tables):
    return t.scores.agg(A.weighted_bce(F.col("target"), (F.col("score") - 1500.0) / 1000.0, F.when(F.col("target") == 1, 2.0).otherwise(1.0)).alias("weighted_bce"))


@query(
    "a51_partial_auc_surrogate",
    f"WITH {SCORES}, b AS (SELECT *, score / 1000 AS s, doc_id // 256 AS batch FROM scores), n AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY s DESC) AS r, ceil(count(*) OVER (PARTITION BY batch) * 0.05::DOUBLE) AS k FROM b WHERE target = 0), l AS (SELECT n.batch, round(avg(greatest(n.s - p.s, 0) + ln(1 + exp(-abs(n.s - p.s)))), 6) AS loss FROM n JOIN b p ON n.batch = p.batch WHERE n.r <= n.k AND p.target = 1 GROUP BY n.batch) SELECT x.batch::BIGINT AS batch, loss FROM (SELECT DISTINCT batch FROM b) x LEFT JOIN l ON x.batch = l.batch",
)
def surrogate(t: Tables):
    """The objective of each batch of up to 256 neighbouring ids."""
    return A.partial_auc_surrogate(t.scores.withColumns({"s": F.col("score") / 1000.0, "batch": F.expr("doc_id div 256")}), "target", "s", batch=["batch"])


@query(
    "a52_subtype_losses",
    f"WITH {SCORES}, p AS (SELECT source, avg(abs(score - 1500)) AS m, count(*) AS n FROM scores GROUP BY source) SELECT source, round(m, 6) AS mean_loss, n::BIGINT AS rows, round((SELECT avg(abs(score - 1500)) FROM scores), 6) AS overall_loss, (SELECT max_by(source, m) FROM p) AS worst_subtype FROM p",
)
def subtype_losses(t: Tables):
    return A.subtype_losses(t.scores, "source", F.abs(F.col("score") - 1500.0))


@query("a56_option_list", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def options(t: Tables):
    return A.option_list(t.documents, "source")


@query(
    "w03_percent_rank",
    f"WITH {SCORES} SELECT doc_id, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS percentile FROM scores",
)
def percent_rank(t: Tables):
    return R.with_rank_percentile(t.scores, [], "score", "percentile").select("doc_id", "percentile")


@query("a28_bootstrap")
def bootstrap(t: Tables):
    return A.bootstrap_intervals(t.scores, ["lang"], "target", "score", samples=50)


@query("a29_paired_bootstrap")
def paired_bootstrap(t: Tables):
    rows = t.scores.select("doc_id", "target", "score", (F.col("score") * F.when(F.col("quality") == 1, 1.0).otherwise(-1.0)).alias("other"))
    return A.poisson_bootstrap(rows, ["doc_id"], "target", "score", "other", samples=20)
