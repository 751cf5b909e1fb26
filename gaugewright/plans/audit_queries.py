"""Queries for audits over derived manifests, several score columns, chain lengths, endpoint metadata and dual retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.operators import aggregates as A
from gaugewright.operators import evaluation as E
from gaugewright.operators import ranking as R
from gaugewright.operators import retrieval as V
from gaugewright.operators import rules as C
from gaugewright.operators.ranking import same
from gaugewright.plans.catalog import ENDPOINTS, LINES, SCORES, Tables, query, ranking_sql


def _index(t: Tables):
    """Documents as an expansion index with planted faults: some labels, phases and paths are wrong."""
    d = t.documents
    n = F.col("doc_id")
    made = F.pmod(n, F.lit(2)) == 1
    return d.select(
        n.cast("string").alias("parent_id"), F.when(made, 1).otherwise(0).alias("target"), F.when(F.pmod(n, F.lit(3)) == 0, "discovery").when(F.pmod(n, F.lit(101)) == 7, "other").otherwise("confirmation").alias("phase"),
        F.lit("docs").alias("dataset"), F.lit("train").alias("split"), F.when(F.pmod(n, F.lit(97)) == 5, "tampered").when(made, "aigc").otherwise("authentic").alias("label"), F.col("lang").alias("generator_family"),
        F.concat_ws("-", "source", F.when(F.pmod(n, F.lit(3)) == 0, "a").otherwise("b")).alias("generation_model"), F.col("source").alias("source_dataset"), F.lit("m").alias("source_member"), F.concat(F.lit("/x/"), n.cast("string")).alias("local_path"),
        F.lit(10).alias("width"), F.lit(10).alias("height"), F.lit("RGB").alias("mode"), F.lit("PNG").alias("format"), F.col("n_chars").alias("bytes"),
    )


@query(
    "c01_expansion_index",
    """SELECT 'bad_phase' AS rule, doc_id::VARCHAR AS key, '' AS detail FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 101 = 7 UNION ALL SELECT 'forbidden_label', doc_id::VARCHAR, '' FROM documents WHERE doc_id % 97 = 5
UNION ALL SELECT 'label_target_mismatch', doc_id::VARCHAR, '' FROM documents WHERE doc_id % 97 = 5 AND doc_id % 2 = 1""",
)
def expansion_index(t: Tables):
    """Violations of an expansion index."""
    return C.expansion_index_rules(_index(t))


@query("c06_manifest_audit", "SELECT rule, count(*)::BIGINT AS n FROM (SELECT 'revision_mismatch' AS rule FROM documents WHERE source <> 'src1' AND doc_id % 50 = 9 UNION ALL SELECT 'unknown_source' FROM documents WHERE source = 'src1' UNION ALL SELECT 'bad_phase' FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 101 = 7 UNION ALL SELECT 'forbidden_label' FROM documents WHERE doc_id % 97 = 5) GROUP BY rule")
def manifest_audit(t: Tables):
    """Counts of a manifest's violations."""
    rows = _index(t).withColumn("source_id", F.col("source_dataset")).withColumn("revision", F.when(F.pmod(F.col("parent_id").cast("long"), F.lit(50)) == 9, "r2").otherwise("r1"))
    policies = rows.select("source_id").distinct().where("source_id <> 'src1'").withColumn("revision", F.lit("r1"))
    return C.manifest_rules(rows, policies).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("c09_withheld", "SELECT doc_id::VARCHAR AS parent_id FROM documents WHERE doc_id % 5 <> 0")
def withheld(t: Tables):
    """Final rows stay out."""
    rows = t.documents.select(F.col("doc_id").cast("string").alias("parent_id"), F.when(F.pmod("doc_id", F.lit(5)) == 0, "final_confirmation").otherwise("discovery").alias("phase"))
    return C.withheld(rows, False).select("parent_id")


@query(
    "c10_training_manifest",
    """SELECT rule, count(*)::BIGINT AS n FROM (SELECT 'bad_split' AS rule FROM documents WHERE doc_id % 41 = 3 UNION ALL SELECT 'pool_outside_train' FROM documents WHERE doc_id % 41 = 3 OR (doc_id % 41 <> 3 AND doc_id % 10 = 1) UNION ALL SELECT 'label_kind_mismatch' FROM documents WHERE doc_id % 13 = 2) GROUP BY rule""",
)
def training_manifest(t: Tables):
    """Counts of a training manifest's violations."""
    n = F.col("doc_id")
    rows = t.documents.select(
        n.cast("string").alias("parent_id"), n.cast("string").alias("lineage_id"), F.when(F.pmod(n, F.lit(41)) == 3, "nope").when(F.pmod(n, F.lit(10)) == 1, "test").otherwise("train").alias("split"), F.lit("detector").alias("training_pool"),
        F.when(F.pmod(n, F.lit(13)) == 2, "aigc").otherwise("authentic").alias("label"), F.lit("authentic").alias("sample_kind"), F.lit("none").alias("generator_family"), F.lit("none").alias("generation_model"), F.col("source").alias("source_dataset"),
        F.lit("p").alias("local_path"), F.lit(None).cast("string").alias("source_parent_id"),
    )
    return C.training_manifest_rules(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("c16_label_values", "SELECT 'unknown_split' AS rule, source AS key, count(*)::VARCHAR AS detail FROM documents GROUP BY source UNION ALL SELECT 'unknown_label', lang, count(*)::VARCHAR FROM documents GROUP BY lang")
def label_values(t: Tables):
    """Values beyond an enum, with their counts."""
    return C.source_label_rules(t.documents.select(F.col("source").alias("split"), F.col("lang").alias("label")))


@query("c17_single_hash", "SELECT 'provenance_values' AS rule, 'lang' AS key, count(DISTINCT lang)::VARCHAR AS detail FROM documents UNION ALL SELECT 'provenance_mismatch', lang, count(*)::VARCHAR FROM documents WHERE lang <> 'en' GROUP BY lang")
def single_hash(t: Tables):
    return C.single_value(t.documents, "lang", "en")


@query("c18_populations", "SELECT 'shared_null_val' AS rule, source AS key, '' AS detail FROM (SELECT source FROM documents WHERE lang = 'de' INTERSECT SELECT source FROM documents WHERE lang = 'fr')")
def populations(t: Tables):
    """Populations that share a lineage."""
    part = lambda x: t.documents.where(F.col("lang") == x).select("source", F.lit(0).alias("target"))
    return C.population_rules({"null": part("de"), "val": part("fr")}, "source", {"null": 0})


@query("c21_cache_parents", "SELECT 'not_in_cache' AS rule, doc_id::VARCHAR AS key, '' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'hash_mismatch', 'a', 'b'")
def cache_parents(t: Tables):
    """Cache and index hold the same parents, made from the same bytes."""
    return C.cache_rules(t.labels, t.documents, "doc_id", "a", "b")


@query("m19_chain_metrics", f"WITH {ENDPOINTS}, e AS (SELECT *, length(condition) % 3 AS steps FROM endpoints), {ranking_sql('e', ['dataset_id', 'steps'], score='logit')} SELECT dataset_id, steps::BIGINT AS steps, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(partial_auc, 6) AS partial_auc FROM ranked")
def chain_metrics(t: Tables):
    """Metrics by dataset and chain length."""
    rows = t.endpoints.withColumn("steps", F.char_length("condition") % 3)
    return R.ranking_metrics(rows, ["dataset_id", "steps"], "target", "logit").drop("tpr_at_fpr")


BRANCHES = ("l_quantity", "l_extendedprice", "l_discount")


@query("m25_branch_auc", f"WITH {LINES}, e AS (" + " UNION ALL ".join(f"SELECT status, '{c}' AS feature, target, {c} AS value FROM lines" for c in BRANCHES) + f"), {ranking_sql('e', ['feature', 'status'], score='value')} SELECT feature, status, round(roc_auc, 6) AS roc_auc FROM ranked")
def branches(t: Tables):
    """One AUC per score column, all columns in one pass."""
    return R.ranking_metrics(E.long_features(t.lines, ["status", "target"], BRANCHES), ["feature", "status"], "target", "value").select("feature", "status", "roc_auc")


@query("m12_combined_metrics", f"WITH {SCORES}, {ranking_sql('scores', [])} SELECT round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(partial_auc, 6) AS partial_auc, round(tpr_at_fpr, 6) AS tpr_at_fpr FROM ranked")
def combined(t: Tables):
    """No keys: one row."""
    return R.ranking_metrics(t.scores, [], "target", "score")


@query("a02_low_power", "SELECT p_brand, p_type, count(*)::BIGINT AS rows, count(*) < 5 AS low_power FROM part GROUP BY ALL")
def low_power(t: Tables):
    return A.coverage(t.part, ["p_brand", "p_type"], 5)


@query("a49_distinct_summary", "SELECT lang, count(DISTINCT source)::BIGINT AS sources, count(DISTINCT md5(text))::BIGINT AS texts FROM documents GROUP BY lang")
def distinct_summary(t: Tables):
    """Distinct counts per cohort."""
    return t.documents.groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct(F.md5("text")).alias("texts"))


@query("a51_pair_ranking", "WITH p AS (SELECT user_id, avg(value / 100) FILTER (WHERE event_type = 'purchase') AS one, avg(value / 100) FILTER (WHERE event_type = 'view') AS zero FROM events GROUP BY user_id) SELECT count(*)::BIGINT AS pairs, round(avg(greatest(zero - one, 0) + ln(1 + exp(-abs(zero - one)))), 6) AS loss FROM p WHERE one IS NOT NULL AND zero IS NOT NULL")
def pair_ranking(t: Tables):
    """Ranking loss over pairs."""
    rows = t.events.where("event_type in ('purchase', 'view')").select("user_id", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("target"), (F.col("value") / 100.0).alias("s"))
    return A.pair_ranking_loss(rows, "user_id", "target", "s")


@query("j07_aligned_runs", f"WITH {ENDPOINTS} SELECT a.dataset_id, count(*)::BIGINT AS pairs, round(avg(b.logit - a.logit), 6) AS mean_delta FROM endpoints a JOIN endpoints b ON a.dataset_id = b.dataset_id AND a.parent_id = b.parent_id WHERE a.condition = 'clean' AND b.condition = 'jpeg_q50' GROUP BY a.dataset_id")
def aligned_runs(t: Tables):
    """Two runs aligned one to one."""
    e = t.endpoints
    a = e.where("condition = 'clean'").select("dataset_id", "parent_id", F.col("logit").alias("a"))
    b = e.where("condition = 'jpeg_q50'").select("dataset_id", "parent_id", F.col("logit").alias("b"))
    return same(a, b, ["dataset_id", "parent_id"]).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("b") - F.col("a")).alias("mean_delta"))


@query("j24_clean_to_transformed", f"WITH {ENDPOINTS}, w AS (SELECT dataset_id, parent_id, condition, (target = 1) <> (logit >= 0) AS wrong FROM endpoints) SELECT t.condition, count_if(NOT c.wrong AND t.wrong)::BIGINT AS newly_wrong, count_if(c.wrong AND NOT t.wrong)::BIGINT AS recovered FROM w t JOIN w c ON t.dataset_id = c.dataset_id AND t.parent_id = c.parent_id AND c.condition = 'clean' WHERE t.condition <> 'clean' GROUP BY t.condition")
def transitions(t: Tables):
    """Mistakes won and lost against the clean endpoint."""
    wrong = (F.col("target") == 1) != (F.col("logit") >= 0)
    w = t.endpoints.select("dataset_id", "parent_id", "condition", wrong.alias("wrong"))
    both = same(w.where("condition <> 'clean'"), w.where("condition = 'clean'").select("dataset_id", "parent_id", F.col("wrong").alias("was")), ["dataset_id", "parent_id"])
    return both.groupBy("condition").agg(F.count_if(~F.col("was") & F.col("wrong")).alias("newly_wrong"), F.count_if(F.col("was") & ~F.col("wrong")).alias("recovered"))


@query("p15_endpoint_metadata", f"WITH {ENDPOINTS} SELECT DISTINCT condition, CASE WHEN condition = 'clean' THEN 'clean' ELSE 'transformed' END AS endpoint_class, (transform_family = 'clean') = (condition = 'clean') AS consistent FROM endpoints")
def endpoint_metadata(t: Tables):
    """Endpoint class and its consistency."""
    clean = F.col("condition") == "clean"
    return t.endpoints.select("condition", F.when(clean, "clean").otherwise("transformed").alias("endpoint_class"), ((F.col("transform_family") == "clean") == clean).alias("consistent")).distinct()


@query("w04_group_distinct", f"WITH {SCORES}, g AS (SELECT target, count(DISTINCT source) AS n FROM scores GROUP BY target) SELECT doc_id, n::BIGINT AS groups FROM scores s JOIN g ON s.target = g.target")
def group_distinct(t: Tables):
    """A distinct count beside each row (W04): per group, then joined back."""
    rows = t.scores
    return same(rows.select("doc_id", "target"), rows.groupBy("target").agg(F.count_distinct("source").alias("groups")), ["target"], small=True).select("doc_id", "groups")


@query(
    "v04_dual_retrieval",
    """WITH p AS (SELECT vec_id, label % 2 AS target, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM p WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query, p.target, list_cosine_similarity(q.e, p.e) AS c, row_number() OVER (PARTITION BY q.vec_id, p.target ORDER BY list_cosine_similarity(q.e, p.e) DESC, p.vec_id) AS r FROM q JOIN p ON q.vec_id <> p.vec_id QUALIFY r <= 3), w AS (SELECT *, exp(c / 0.1::DOUBLE - max(c / 0.1::DOUBLE) OVER (PARTITION BY query, target)) AS x FROM s), n AS (SELECT query, target, x / sum(x) OVER (PARTITION BY query, target) AS w FROM w)
SELECT query, target::BIGINT AS target, round(max(w), 6) AS max_attention, round(-sum(w * ln(w)) / ln(3), 6) AS relative_entropy FROM n GROUP BY query, target""",
)
def dual(t: Tables):
    """Neighbours and attention among the rows of each class, for the stated query set."""
    every = t.embeddings
    out = None
    for target in (0, 1):
        near = V.top_k(every.where("vec_id % 100 = 0"), every.where(f"label % 2 = {target}"), 3, "vec_id", "vec_id", others=True)
        part = V.attention(near, 64, 3, 0.1).groupBy("query").agg(F.first("max_attention").alias("max_attention"), F.first("relative_entropy").alias("relative_entropy")).withColumn("target", F.lit(target))
        out = part if out is None else out.unionByName(part)
    return out


@query("v12_disagreements", "SELECT p_partkey, round(abs(p_size - p_retailprice), 6) AS abs_a_b, abs(p_size - p_partkey)::DOUBLE AS abs_a_c, round(abs(p_retailprice - p_partkey), 6) AS abs_b_c FROM part")
def disagreements(t: Tables):
    """Differences of each pair of branches."""
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), F.col("p_partkey").cast("double").alias("c"))
    return rows.withColumns(V.disagreements(["a", "b", "c"])).drop("a", "b", "c")


@query("x24_hash_choice", "SELECT doc_id FROM documents ORDER BY sha256('24|' || doc_id::VARCHAR), doc_id LIMIT 30")
def hash_choice(t: Tables):
    """A seeded choice as hash order and limit."""
    return t.documents.select("doc_id").orderBy(F.sha2(F.concat(F.lit("24|"), F.col("doc_id").cast("string")), 256), "doc_id").limit(30)
