"""Queries for projections, predicates, joins, windows, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugewright.functions import scalars as X
from gaugewright.operators import aggregates as A
from gaugewright.operators import evaluation as E
from gaugewright.operators import rules as C
from gaugewright.operators import sampling as S
from gaugewright.operators.ranking import same
from gaugewright.operators.recipes import condition_frame
from gaugewright.plans.catalog import LINES, SCORES, Tables, query
from gaugewright.sources.readers import canonical, mapped_targets, remapped


@query("p01_canonical_projection", "SELECT 'docs' AS dataset_id, 'docs-' || substr(sha256('docs:' || source || '/' || doc_id::VARCHAR), 1, 20) AS parent_id, source || '/' || doc_id::VARCHAR AS image_path, 1::BIGINT AS target, lang AS generation_model, 'unknown' AS generator_family, 'docs' AS source_dataset, 'none' AS authentic_subtype FROM documents")
def canonical_rows(t: Tables):
    """Canonical columns with class-dependent defaults."""
    rows = t.documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("image_path"), F.lit(1).alias("target"), F.col("lang").alias("generation_model"))
    return canonical(rows, "docs").drop("lineage_id")


@query("p02_label_map", "SELECT doc_id, CASE quality WHEN 0 THEN 1 ELSE 0 END::BIGINT AS target FROM labels")
def label_map(t: Tables):
    """Targets by label; unmapped labels raise."""
    return t.labels.select("doc_id", mapped_targets(F.col("quality"), {"0": 1, "1": 0}).alias("target"))


@query("p03_value_remap", "SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END AS lang FROM documents")
def value_remap(t: Tables):
    return t.documents.select("doc_id", remapped(F.col("lang"), {"en": "english", "de": "german"}).alias("lang"))


@query("p05_in_filters", "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2', 'src3')")
def in_filters(t: Tables):
    """Conjunctive IN lists, pushed to the scan."""
    return t.documents.where(F.col("lang").isin("de", "fr") & F.col("source").isin("src1", "src2", "src3")).select("doc_id")


@query("p07_phase_of_split", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'discovery' ELSE 'confirmation' END AS phase FROM lineitem")
def phase(t: Tables):
    split = F.when(F.col("l_linestatus") == "O", "train_full").otherwise("validation")
    return t.lineitem.select("l_orderkey", "l_linenumber", X.phase_of_split(split).alias("phase"))


@query("p08_forbidden_rows", "SELECT page_id FROM pages WHERE NOT (regexp_matches(lower(url), 'th.*ing') OR contains(lower(url), 'demo'))")
def forbidden(t: Tables):
    """Case-blind substring and pattern predicates."""
    return t.pages.where(~(F.col("url").rlike("(?i)th.*ing") | F.lower("url").contains("demo"))).select("page_id")


@query("p10_numeric_coercion", "SELECT page_id, round(try_cast(regexp_extract(url, '/([^/?#]*)(\\?.*|#.*)?$', 1) AS DOUBLE), 6) AS n FROM pages")
def coercion(t: Tables):
    return t.pages.select("page_id", X.numeric(F.regexp_extract("url", r"/([^/?#]*)(\?.*|#.*)?$", 1)).alias("n"))


@query("p11_derived_columns", "SELECT p_partkey, round(p_size::DOUBLE * (p_retailprice / 7), 3) AS megapixels, round(p_size::DOUBLE / nullif(p_retailprice / 7, 0), 6) AS aspect_ratio, round(p_retailprice / 1024.0::DOUBLE, 6) AS kilobytes FROM part")
def derived(t: Tables):
    out = t.part.select("p_partkey", *[c.alias(n) for n, c in X.display_columns(F.col("p_size"), F.col("p_retailprice") / 7.0, F.col("p_retailprice")).items()])
    return out.withColumn("megapixels", F.round(F.col("megapixels") * 1e6, 3))


@query("p12_nuisance_columns", "SELECT p_partkey, round(ln(1 + p_size::DOUBLE), 6) AS log_width, round(ln(1 + p_retailprice), 6) AS log_height, round(p_size::DOUBLE / nullif(p_retailprice, 0), 6) AS aspect FROM part")
def nuisance(t: Tables):
    c = X.nuisance_columns(F.col("p_size"), F.col("p_retailprice"), F.col("p_size"))
    return t.part.select("p_partkey", *[c[k].alias(k) for k in ("log_width", "log_height", "aspect")])


@query("p13_score_kind", f"WITH {SCORES} SELECT doc_id, round(1 / (1 + exp(-greatest(least((score - 1500) / 10, 80), -80))), 6) AS probability FROM scores")
def score_kind(t: Tables):
    """Logits become probabilities, clipped."""
    return t.scores.select("doc_id", X.sigmoid((F.col("score") - 1500.0) / 10.0).alias("probability"))


@query("p14_outcomes", f"WITH {SCORES} SELECT doc_id, CASE WHEN target = 1 AND score >= 1500 THEN 'TP' WHEN target = 0 AND score < 1500 THEN 'TN' WHEN target = 0 THEN 'FP' ELSE 'FN' END AS outcome, abs(score - 1500) AS decision_margin FROM scores")
def outcomes(t: Tables):
    return t.scores.select("doc_id", X.outcome(F.col("target"), F.when(F.col("score") >= 1500.0, 1).otherwise(0)).alias("outcome"), F.abs(F.col("score") - 1500.0).alias("decision_margin"))


@query("p17_strata", f"WITH {SCORES} SELECT doc_id, CASE WHEN target = 1 THEN 'aigc:' || source ELSE 'authentic:' || lang END AS st FROM scores")
def strata(t: Tables):
    return t.scores.select("doc_id", S.stratum(F.col("target"), F.col("source"), F.col("lang")).alias("st"))


@query("p19_name_normalization", "SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '  X', '\\s+', ' ', 'g'))) AS name, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def names(t: Tables):
    """Squeezed names and slugs."""
    return t.part.select("p_partkey", X.squeezed(F.concat(F.lit("  "), "p_name", F.lit("  X"))).alias("name"), X.slug(F.col("p_type")).alias("slug"))


@query("p21_path_classification", "SELECT page_id, string_split(url, '/')[3] AS host, CASE WHEN len(string_split(url, '/')) >= 4 THEN string_split(url, '/')[4] END AS family, regexp_matches(url, '(?i)\\.(png|jpg)$') AS is_image FROM pages")
def paths(t: Tables):
    """Path components by position."""
    part = lambda k: F.try_element_at(F.split("url", "/"), F.lit(k))
    return t.pages.select("page_id", part(3).alias("host"), part(4).alias("family"), F.col("url").rlike(r"(?i)\.(png|jpg)$").alias("is_image"))


@query("p23_integrity_predicate", "SELECT o_orderkey, o_totalprice > 10000 AND o_custkey > 0 AND o_custkey / o_totalprice < 0.01 AS invalid FROM orders")
def integrity(t: Tables):
    return t.orders.select("o_orderkey", X.implausible_compression(F.col("o_totalprice"), F.col("o_custkey")).alias("invalid"))


@query("p25_sanitized", f"WITH {LINES} SELECT parent_id, round(coalesce(l_discount / nullif(l_tax, 0), 0), 6) AS ratio FROM lines")
def sanitized(t: Tables):
    """Non-finite values to 0."""
    return t.lines.select("parent_id", X.finite_or(F.try_divide("l_discount", "l_tax"), 0.0).alias("ratio"))


@query(
    "p27_gallery_filter",
    f"WITH {SCORES}, p AS (SELECT doc_id, source, target, list(CASE WHEN target = 1 AND score >= k THEN 'TP' WHEN target = 0 AND score < k THEN 'TN' WHEN target = 0 THEN 'FP' ELSE 'FN' END) AS o FROM scores CROSS JOIN (VALUES (500.0::DOUBLE), (1500.0::DOUBLE), (4000.0::DOUBLE)) v(k) GROUP BY ALL) SELECT doc_id FROM p WHERE target = 0 AND list_contains(o, 'FP') AND contains(source, '1')",
)
def gallery(t: Tables):
    """Truth, any matching outcome, and a text search."""
    found = F.array(*[X.outcome(F.col("target"), F.when(F.col("score") >= k, 1).otherwise(0)) for k in (500.0, 1500.0, 4000.0)])
    rows = t.scores.withColumn("outcomes", found)
    return rows.where((F.col("target") == 0) & F.exists("outcomes", lambda o: o == "FP") & F.col("source").contains("1")).select("doc_id")


@query("p29_string_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source <> 'src0'")
def string_filter(t: Tables):
    return t.documents.where("lang = 'en' AND source <> 'src0'").select("doc_id")


@query("p30_export_predicate", f"WITH {LINES} SELECT parent_id FROM lines WHERE phase = 'confirmation' OR (phase = 'discovery' AND status = 'F')")
def export_predicate(t: Tables):
    return t.lines.where((F.col("phase") == "confirmation") | ((F.col("phase") == "discovery") & (F.col("status") == "F"))).select("parent_id")


@query("p31_held_out", f"WITH {SCORES} SELECT 'train' AS part, doc_id FROM scores WHERE source <> 'src1' UNION ALL SELECT 'val', doc_id FROM scores WHERE target = 0 OR source = 'src1'")
def held_out(t: Tables):
    """Training without a generator; validation of negatives and that generator."""
    rows = t.scores
    return rows.where("source <> 'src1'").select(F.lit("train").alias("part"), "doc_id").unionByName(rows.where("target = 0 or source = 'src1'").select(F.lit("val").alias("part"), "doc_id"))


@query("p33_prefix_strip", "SELECT DISTINCT replace(source, 'src', '') AS scope FROM documents WHERE starts_with(source, 'src1')")
def prefix_strip(t: Tables):
    return t.documents.where(F.col("source").startswith("src1")).select(F.regexp_replace("source", "^src", "").alias("scope")).distinct()


@query("j01_many_to_one", "SELECT l.l_orderkey, l.l_linenumber::BIGINT AS l_linenumber, o.o_custkey, c.c_nationkey::BIGINT AS c_nationkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey")
def many_to_one(t: Tables):
    """Hash equi-joins; AQE picks broadcast or sort-merge from sizes."""
    return t.lineitem.select("l_orderkey", "l_linenumber").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select("l_orderkey", "l_linenumber", "o_custkey", "c_nationkey")


@query("j02_left_join", "SELECT d.doc_id, l.quality::BIGINT AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join(t: Tables):
    """Left join with a total-coverage check by its nulls."""
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("j08_coverage_violations", "SELECT 'unlabelled' AS rule, d.doc_id::VARCHAR AS key, '' AS detail FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def coverage_violations(t: Tables):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return C.violations(joined, "unlabelled", F.col("quality").isNull(), F.col("doc_id"))


@query("j17_pivot_join", "WITH b AS (SELECT lang, count(*)::BIGINT AS rows FROM documents GROUP BY lang), p AS (SELECT lang, count_if(source = 'src0')::BIGINT AS src0, count_if(source = 'src1')::BIGINT AS src1 FROM documents GROUP BY lang) SELECT b.lang, rows, src0, src1 FROM b JOIN p ON b.lang = p.lang")
def pivot_join(t: Tables):
    base = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    return base.join(A.pivot_counts(t.documents.where("source in ('src0', 'src1')"), ["lang"], "source", ["src0", "src1"]), "lang")


@query(
    "j22_best_match",
    """WITH b AS (SELECT s_nationkey AS k, list(s_suppkey ORDER BY s_suppkey) AS p FROM supplier GROUP BY s_nationkey), w AS (SELECT list(s_suppkey ORDER BY s_suppkey) AS p FROM supplier),
c AS (SELECT c_custkey, c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, row_number() OVER (ORDER BY c_custkey) - 1 AS j FROM customer)
SELECT c_custkey, CASE WHEN b.p IS NOT NULL THEN b.p[(i % len(b.p) + 1)::INT] ELSE w.p[(j % len(w.p) + 1)::INT] END AS match, CASE WHEN b.p IS NOT NULL THEN 0 ELSE 1 END::BIGINT AS match_tier FROM c LEFT JOIN b ON c.k = b.k CROSS JOIN w""",
)
def best_match(t: Tables):
    """A partner of the own nation, else any, in turn."""
    left = t.customer.select("c_custkey", F.col("c_nationkey").alias("k"))
    right = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("k"))
    return A.best_match(left, right, [["k"], []], "s_suppkey", "c_custkey").select("c_custkey", "match", "match_tier")


@query("j25_condition_product", "SELECT item_id, c AS condition FROM benchmark CROSS JOIN (VALUES ('clean'), ('jpeg_q90'), ('jpeg_q70')) v(c)")
def product(t: Tables):
    """Records times conditions, lazily."""
    names = F.explode(F.array(*[F.lit(c) for c in ("clean", "jpeg_q90", "jpeg_q70")]))
    return t.benchmark.select("item_id", names.alias("condition"))


@query("j27_semi_join", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi(t: Tables):
    return t.documents.select("doc_id").join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("j29_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti(t: Tables):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("w07_first_then_rest", "WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT doc_id, source FROM r ORDER BY k > 1, n_chars DESC, doc_id LIMIT 8")
def first_then_rest(t: Tables):
    """One of each, then the remainder."""
    r = S.ranked(t.documents.select("doc_id", "source", "n_chars"), ["source"], F.desc("n_chars"), "doc_id", name="k")
    return r.orderBy(F.col("k") > 1, F.desc("n_chars"), "doc_id").limit(8).select("doc_id", "source")


@query("w11_rises", "SELECT user_id, event_id, previous, value FROM (SELECT user_id, event_id, round(value, 6) AS value, round(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS previous FROM events) WHERE value > previous + 90")
def rises(t: Tables):
    """Rows that rise over their predecessor."""
    return A.monotonicity_violations(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 90.0).select("user_id", "event_id", "previous", "value")


@query("o02_mixed_sort", "SELECT p_partkey, p_brand, p_size::BIGINT AS p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 50")
def mixed_sort(t: Tables):
    """Total order with a unique last key."""
    return t.part.orderBy("p_brand", F.desc("p_size"), "p_partkey").limit(50).select("p_partkey", "p_brand", "p_size")


@query("o03_absolute_top", "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def absolute_top(t: Tables):
    return t.customer.orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("o04_hardest", f"WITH {SCORES} SELECT doc_id, score FROM scores ORDER BY abs(score - 1500), doc_id LIMIT 25")
def hardest(t: Tables):
    return t.scores.orderBy(F.abs(F.col("score") - 1500.0), "doc_id").limit(25).select("doc_id", "score")


@query("o06_extreme_row", "SELECT source, min_by(doc_id, (n_chars, doc_id)) AS shortest, max_by(doc_id, (n_chars, -doc_id)) AS longest FROM documents GROUP BY source")
def extreme_row(t: Tables):
    """Row of a minimum or maximum without a sort."""
    return t.documents.groupBy("source").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("shortest"), F.max_by("doc_id", F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("d"))).alias("longest"))


@query("o08_first_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 72")
def first_rows(t: Tables):
    return t.documents.orderBy("doc_id").limit(72).select("doc_id")


@query("o09_listed_order", "SELECT lang, n::BIGINT AS n, row_number() OVER (ORDER BY list_position(['fr', 'en', 'es', 'de'], lang))::BIGINT AS place FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def listed_order(t: Tables):
    counts = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*[F.lit(x) for x in ("fr", "en", "es", "de")])
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.array_position(listed, F.col("lang")))))


@query("u02_aligned_union", "SELECT c_custkey AS id, c_nationkey::BIGINT AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey::BIGINT, NULL FROM supplier")
def aligned_union(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


@query("u03_intersect", "SELECT c_nationkey::BIGINT AS nation FROM customer INTERSECT SELECT s_nationkey::BIGINT FROM supplier")
def intersect(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.select(F.col("s_nationkey").alias("nation")))


@query("u04_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_(t: Tables):
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id"))


@query("u05_distinct_first", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def distinct_first(t: Tables):
    """First row of a key, determined."""
    return S.head_per_stratum(t.documents.select("source", "doc_id"), ["source"], 1, "doc_id").select("source", "doc_id")


@query("u07_exact_coverage", "WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM labels) SELECT (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b))::BIGINT AS missing, (SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a))::BIGINT AS extra, 0::BIGINT AS duplicates")
def exact_coverage(t: Tables):
    return A.coverage_difference(t.documents.where("lang = 'en'").select("doc_id"), t.labels.select("doc_id"), ["doc_id"])


@query("c11_group_leakage", "WITH g AS (SELECT md5(text) AS g, min(lang || ':' || source) AS a, max(lang || ':' || source) AS b FROM documents GROUP BY 1) SELECT 'leakage_g' AS rule, g AS key, a || ' / ' || b AS detail FROM g WHERE a <> b")
def leakage(t: Tables):
    """Copies of a text on several sides (C11)."""
    return C.group_leakage(t.documents.select(F.md5("text").alias("g"), "lang", "source"), ["g"], ["lang", "source"])


@query("c14_evaluation_records", "SELECT 'bad_target' AS rule, d.lang || '|' || d.doc_id::VARCHAR AS key, '' AS detail FROM documents d WHERE n_chars % 7 = 3 UNION ALL SELECT 'duplicate_parent', 'x', '1' WHERE false")
def record_rules(t: Tables):
    rows = t.documents.select(F.col("lang").alias("dataset_id"), F.col("doc_id").alias("parent_id"), F.col("source").alias("image_path"), F.when(F.pmod("n_chars", F.lit(7)) == 3, 2).otherwise(1).alias("target"))
    return C.evaluation_record_rules(rows)


@query("c15_counterbalance", "WITH n AS (SELECT lang, source, count(d.doc_id) AS n FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents) LEFT JOIN documents d USING (lang, source) GROUP BY ALL) SELECT 'unbalanced_source' AS rule, lang AS key, (max(n) - min(n))::VARCHAR AS detail FROM n GROUP BY lang HAVING max(n) - min(n) > 1")
def counterbalance(t: Tables):
    """Counts within groups differ by one at most."""
    return C.counterbalance_rules(t.documents.select("lang", "source"), ["lang"], "source", [f"src{i}" for i in range(20)])


@query("c20_prediction_rules", "SELECT 'missing_prediction' AS rule, doc_id::VARCHAR AS key, '' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def prediction_rules(t: Tables):
    return C.prediction_rules(t.labels.select("doc_id"), t.documents.select("doc_id"), ["doc_id"])


@query("f07_json_fields", "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events")
def json_fields(t: Tables):
    """Fields of JSON text."""
    return t.events.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref"))


@query("f10_math", "SELECT c_custkey, round(ln(abs(c_acctbal) + 1), 6) AS l, round(sqrt(abs(c_acctbal)), 6) AS s, round(atan2(c_acctbal, 10.0::DOUBLE), 6) AS a, round(round_even(c_acctbal, 0), 6) AS r, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c FROM customer")
def math(t: Tables):
    x = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.log1p(F.abs(x)).alias("l"), F.sqrt(F.abs(x)).alias("s"), F.atan2(x, F.lit(10.0)).alias("a"), X.rounded(x).alias("r"), F.floor(x).alias("f"), F.ceil(x).alias("c"))


@query("f13_right_bins", "SELECT p_partkey, len(list_filter([5, 10, 20, 35], lambda e: e <= p_size))::BIGINT AS b, greatest(least(floor((p_size - 1) / 4.9::DOUBLE), 9), 0)::BIGINT AS w FROM part")
def bins(t: Tables):
    """Right-sided search and fixed-width bins with a closed end."""
    return t.part.select("p_partkey", X.bin_right(F.col("p_size"), F.array(*[F.lit(e) for e in (5, 10, 20, 35)])).alias("b"), X.bin_fixed(F.col("p_size"), 1.0, 50.0, 10).alias("w"))


@query("f15_base64", "SELECT nation.n_nationkey::BIGINT AS n_nationkey, to_base64(encode(n_name)) AS b, n_name AS back FROM nation")
def base64(t: Tables):
    return t.nation.select("n_nationkey", F.base64(F.encode("n_name", "UTF-8")).alias("b"), F.decode(F.unbase64(F.base64(F.encode("n_name", "UTF-8"))), "UTF-8").alias("back"))


@query("f05_formats", "SELECT c_custkey, lpad(c_custkey::VARCHAR, 6, '0') AS padded, c_custkey::VARCHAR || ',' || c_nationkey::VARCHAR AS cell FROM customer")
def formats(t: Tables):
    """Padding and composite keys."""
    return t.customer.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("padded"), X.cell_text(F.col("c_custkey"), F.col("c_nationkey")).alias("cell"))


@query("f17_latest", "SELECT event_type, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS latest FROM events GROUP BY event_type")
def latest(t: Tables):
    return t.events.groupBy("event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("latest"))


@query("a54_registry_counts", "SELECT family, official, rows::BIGINT AS rows FROM (VALUES ('clean', true, 1), ('jpeg', true, 4), ('gaussian_blur', true, 3), ('resize', true, 2), ('gaussian_noise', true, 3), ('color_jitter', true, 2), ('center_crop', true, 1), ('composition', false, 90)) v(family, official, rows)")
def registry_counts(t: Tables):
    """Conditions by family."""
    return condition_frame(t.spark, "all").groupBy("family", "official").agg(F.count(F.lit(1)).alias("rows"))


@query("a21_spearman", f"WITH {LINES}, r AS (SELECT status, rank() OVER (PARTITION BY status ORDER BY l_quantity) + (count(*) OVER (PARTITION BY status, l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY status ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY status, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lines) SELECT status, round(corr(a, b), 6) AS spearman FROM r GROUP BY status")
def spearman(t: Tables):
    return E.spearman(t.lines, ["status"], "l_quantity", "l_extendedprice")


@query("j02_null_safe_keys", "WITH a AS (SELECT CASE WHEN c_nationkey > 20 THEN NULL ELSE c_nationkey END::BIGINT AS k, count(*)::BIGINT AS n FROM customer GROUP BY 1), b AS (SELECT CASE WHEN s_nationkey > 20 THEN NULL ELSE s_nationkey END::BIGINT AS k, count(*)::BIGINT AS m FROM supplier GROUP BY 1) SELECT a.k, n, m FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def null_keys(t: Tables):
    """Joins in which a null key is a group of its own."""
    k = lambda c: F.when(F.col(c) > 20, F.lit(None)).otherwise(F.col(c)).alias("k")
    return same(t.customer.select(k("c_nationkey")).groupBy("k").agg(F.count(F.lit(1)).alias("n")), t.supplier.select(k("s_nationkey")).groupBy("k").agg(F.count(F.lit(1)).alias("m")), ["k"])
