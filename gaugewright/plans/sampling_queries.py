"""Queries for hashing, deterministic sampling, quotas, cohorts and assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.functions import hashing as H
from gaugewright.operators import sampling as S
from gaugewright.operators.recipes import CHAIN_FAMILIES, condition_frame, family_variants
from gaugewright.plans.catalog import Tables, query

U64 = "('0x' || substr({}, 1, 16))::UBIGINT"


@query("x01_stable_hash", """SELECT doc_id, sha256('["seed","' || doc_id::VARCHAR || '","' || source || '"]') AS h FROM documents""")
def stable_hash(t: Tables):
    return t.documents.select("doc_id", H.stable_hash("seed", F.col("doc_id"), F.col("source")).alias("h"))


@query("x02_seed32", f"SELECT doc_id, ({U64.format("sha256('7:' || source || doc_id::VARCHAR)")} % 4294967296)::BIGINT AS seed FROM documents")
def seed32(t: Tables):
    return t.documents.select("doc_id", H.seed32(7, F.concat("source", F.col("doc_id").cast("string"))).alias("seed"))


@query("x03_step_seed", f"SELECT doc_id, ({U64.format("sha256('7:' || doc_id::VARCHAR || ':noise:1')")} % 4294967296)::BIGINT AS seed FROM documents")
def step_seed(t: Tables):
    return t.documents.select("doc_id", H.step_seed(7, F.col("doc_id"), F.lit("noise"), F.lit(1)).alias("seed"))


@query("x04_hash_split", f"SELECT doc_id, {U64.format("sha256('11:' || source || ':' || doc_id::VARCHAR)")} % 5 = 0 AS in_test FROM documents")
def hash_split(t: Tables):
    return t.documents.select("doc_id", H.in_fifth(11, F.col("source"), F.col("doc_id")).alias("in_test"))


@query("x05_priority", "SELECT doc_id, substr(sha256('3:' || source || ':' || doc_id::VARCHAR), 1, 32) AS priority FROM documents")
def priority(t: Tables):
    return t.documents.select("doc_id", H.priority128(3, F.col("source"), F.col("doc_id")).alias("priority"))


@query("x06_sample_order", "SELECT doc_id, sha256('5' || chr(0) || lang || chr(0) || doc_id::VARCHAR) AS k FROM documents")
def sample_order(t: Tables):
    return t.documents.select("doc_id", H.sample_order(5, F.col("lang"), F.col("doc_id")).alias("k"))


@query("x07_derived_parent", "SELECT page_id, 'pages-' || substr(sha256('pages:' || url), 1, 20) AS parent_id FROM pages")
def derived_parent(t: Tables):
    return t.pages.select("page_id", H.derived_parent_id(F.lit("pages"), F.col("url")).alias("parent_id"))


@query("x08_row_digest", "SELECT doc_id, substr(sha256(doc_id::VARCHAR || '|' || lang || '|' || source), 1, 20) AS row_id FROM documents")
def row_digest(t: Tables):
    return t.documents.select("doc_id", H.row_digest(F.col("doc_id"), F.col("lang"), F.col("source")).alias("row_id"))


@query("x09_content_digest", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_digest(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    "x10_ordered_digest",
    """WITH h AS (SELECT sha256(doc_id::VARCHAR || chr(0) || lang) AS h FROM documents), r AS (SELECT substr(h, 1, 3) AS r, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY r)) AS digest, sum(n)::BIGINT AS rows FROM r""",
)
def ordered_digest(t: Tables):
    return H.ordered_digest(t.documents, ["doc_id", "lang"])


QUOTAS = "c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), i AS (SELECT lang, n, n * 101.0::DOUBLE / sum(n) OVER () AS ideal FROM c), f AS (SELECT *, floor(ideal) AS fl, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, lang) AS place, 101 - sum(floor(ideal)) OVER () AS rest FROM i)"


@query("x11_proportional_quotas", f"WITH {QUOTAS} SELECT lang, n::BIGINT AS n, (fl + CASE WHEN place <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM f")
def proportional(t: Tables):
    counts = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.lit(101))
    return S.proportional_quotas(counts, [], "lang", "n", "total").select("lang", "n", F.col("quota").cast("long").alias("quota"))


@query(
    "x13_balanced_quotas",
    "WITH c AS (SELECT source, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY source), u AS (SELECT source, n, unnest(range(n)) AS level FROM c), k AS (SELECT source, row_number() OVER (ORDER BY level, source) AS place FROM u) SELECT c.source, c.n::BIGINT AS n, (SELECT count(*) FROM k WHERE k.source = c.source AND place <= 137)::BIGINT AS quota FROM c",
)
def balanced(t: Tables):
    """Near-equal quotas with shortages dealt on (X13), from counts alone."""
    counts = t.documents.where("lang <> 'en'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.balanced_quotas(counts, "source", "n", 137)


@query(
    "x12_stratified_sample",
    """WITH r AS (SELECT d.doc_id, d.lang, l.quality AS target, d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT lang, target, source, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT lang, target, sum(n) AS n FROM s GROUP BY ALL),
ti AS (SELECT *, least(40, sum(n) OVER (PARTITION BY lang)) AS total, n::DOUBLE * least(40, sum(n) OVER (PARTITION BY lang)) / sum(n) OVER (PARTITION BY lang) AS ideal FROM t),
tq AS (SELECT lang, target, floor(ideal) + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY ideal - floor(ideal) DESC, target::VARCHAR) <= total - sum(floor(ideal)) OVER (PARTITION BY lang) THEN 1 ELSE 0 END AS q FROM ti),
si AS (SELECT s.*, tq.q AS total, s.n::DOUBLE * tq.q / sum(s.n) OVER (PARTITION BY s.lang, s.target) AS ideal FROM s JOIN tq ON s.lang = tq.lang AND s.target = tq.target),
sq AS (SELECT lang, target, source, floor(ideal) + CASE WHEN row_number() OVER (PARTITION BY lang, target ORDER BY ideal - floor(ideal) DESC, source) <= total - sum(floor(ideal)) OVER (PARTITION BY lang, target) THEN 1 ELSE 0 END AS q FROM si),
o AS (SELECT r.*, row_number() OVER (PARTITION BY lang, target, source ORDER BY sha256('9' || chr(0) || lang || chr(0) || doc_id::VARCHAR), doc_id) AS sample_rank FROM r)
SELECT o.doc_id, o.lang, o.target::BIGINT AS target, o.source, o.sample_rank::BIGINT AS sample_rank FROM o JOIN sq ON o.lang = sq.lang AND o.target = sq.target AND o.source = sq.source WHERE sample_rank <= q""",
)
def stratified(t: Tables):
    """Exact sample of 40 per language that keeps classes and sources."""
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", F.col("quality").alias("target")), "doc_id")
    return S.limit_records(rows, 40, 9, dataset="lang", parent="doc_id", stratum_col="source").select("doc_id", "lang", "target", "source", "sample_rank")


STRATUM = "SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'discovery' ELSE 'confirmation' END AS phase, 'generated:' || lang AS st FROM documents"


@query(
    "x14_select_rows",
    f"""WITH s AS ({STRATUM}), h AS (SELECT *, sha256('["sel","' || source || '","' || phase || '","' || st || '","' || doc_id::VARCHAR || '"]') AS selection_hash FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY source, phase, st ORDER BY selection_hash, doc_id::VARCHAR) AS k FROM h) SELECT doc_id, st AS selection_stratum, k::BIGINT AS selection_rank FROM r WHERE k <= 3""",
)
def select_rows(t: Tables):
    """Hash-ordered selection under limits."""
    rows = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("parent_id"), F.col("source").alias("source_id"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "discovery").otherwise("confirmation").alias("phase"), F.lit(1).alias("target"), F.col("lang").alias("generation_model"), F.col("source").alias("source_dataset"))
    policies = rows.select("source_id").distinct().withColumn("row_limit", F.lit(3))
    return S.select_rows(rows, policies, "sel").select("doc_id", "selection_stratum", "selection_rank")


@query(
    "w05_round_robin",
    """WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('rr|' || doc_id::VARCHAR), doc_id) AS turn, sha256('rr|' || source) AS g FROM documents) SELECT doc_id, source, row_number() OVER (ORDER BY turn, g, source)::BIGINT AS cohort_rank FROM o QUALIFY cohort_rank <= 100""",
)
def round_robin(t: Tables):
    """Sources in turn."""
    return S.round_robin(t.documents.select("doc_id", "source"), "source", H.joined_hash("|", "rr", F.col("doc_id")), H.joined_hash("|", "rr", F.col("source")), 100, unique="doc_id").select("doc_id", "source", "cohort_rank")


@query(
    "x15_diversity_cohorts",
    """WITH b AS (SELECT p_partkey, p_partkey::VARCHAR AS parent_id, lower(p_brand) AS g FROM part), m AS (SELECT DISTINCT g, sha256('["d","generator","' || g || '"]') AS h FROM b), k AS (SELECT g, row_number() OVER (ORDER BY h, g) AS place FROM m),
c AS (SELECT g, CASE WHEN place <= 3 THEN 'few_generators' ELSE 'many_generators' END AS cohort FROM k WHERE place <= 11), p AS (SELECT b.*, cohort FROM b JOIN c ON b.g = c.g), e AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM p GROUP BY cohort)),
o AS (SELECT *, row_number() OVER (PARTITION BY cohort, g ORDER BY sha256('["d","' || cohort || '","' || g || '","' || parent_id || '"]'), parent_id) AS turn, sha256('["d","' || cohort || '","' || g || '"]') AS gh FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY turn, gh, g) AS cohort_rank FROM o) SELECT p_partkey, cohort AS diversity_cohort, cohort_rank::BIGINT AS cohort_rank FROM r, e WHERE cohort_rank <= e.n""",
)
def cohorts(t: Tables):
    """Few- and many-generator cohorts of equal size."""
    rows = t.part.select("p_partkey", F.col("p_partkey").cast("string").alias("parent_id"), F.col("p_brand").alias("generation_model"))
    return S.diversity_cohorts(rows, "d", few=3, many=8).select("p_partkey", "diversity_cohort", "cohort_rank")


@query("x16_assigned_recipe", f"SELECT doc_id, ({U64.format("sha256('1:' || lang || ':' || doc_id::VARCHAR || ':assigned-chain-length-2')")} % 30)::BIGINT AS spec_index FROM documents")
def assigned(t: Tables):
    return t.documents.select("doc_id", S.assigned_index(1, F.col("lang"), F.col("doc_id"), 2, 30).alias("spec_index"))


def chains_sql(final: str) -> str:
    k = "sha256('4:' || lang || ':' || doc_id::VARCHAR || "
    fam = "[" + ", ".join(f"'{f}'" for f in CHAIN_FAMILIES) + "]"
    bank = "CASE family " + " ".join(f"WHEN '{f}' THEN [{', '.join(repr(x) for x in v)}]" for f, v in family_variants().items()) + " END"
    return f"""WITH r AS (SELECT doc_id, lang, source, (row_number() OVER (PARTITION BY lang, source ORDER BY {k}':chain-length'), doc_id) - 1) % 6 + 1 AS n FROM documents),
s AS (SELECT *, unnest(range(1, n + 1)) AS position FROM r), f AS (SELECT *, {fam}[((row_number() OVER (PARTITION BY lang, source, position ORDER BY {k}':' || position::VARCHAR || ':family'), doc_id) - 1) % 6 + 1)::INT] AS family FROM s),
v AS (SELECT *, {bank} AS bank, row_number() OVER (PARTITION BY lang, source, position, family ORDER BY {k}':' || position::VARCHAR || ':severity'), doc_id) - 1 AS place FROM f) {final}"""


@query("x19_uniform_chains", chains_sql("SELECT doc_id, n::BIGINT AS transform_step_count, position::BIGINT AS step_position, family AS transform_family, bank[(place % len(bank) + 1)::INT] AS transform_variant FROM v"))
def chains(t: Tables):
    """Counterbalanced chains, one row per step."""
    rows = t.documents.select("doc_id", "lang", "source", F.lit(1).alias("target"))
    out = S.uniform_chains(rows, family_variants(), 4, dataset="lang", parent="doc_id", stratum_col="source")
    return S.chain_steps(out, ["doc_id", "transform_step_count"])


@query(
    "x22_sampled_condition",
    f"""WITH h AS (SELECT doc_id, sha256('2:' || doc_id::VARCHAR || ':0') AS h FROM documents) SELECT doc_id, CASE WHEN {U64.format("h")}::DOUBLE / 18446744073709551616.0::DOUBLE < 0.25 THEN 'clean' ELSE ['jpeg_q90', 'jpeg_q70', 'blur_sigma1'][(('0x' || substr(h, 17, 16))::UBIGINT % 3 + 1)::INT] END AS condition FROM h""",
)
def sampled(t: Tables):
    return t.documents.select("doc_id", S.sampled_condition(F.col("doc_id"), 0, 2, 0.25, ["jpeg_q90", "jpeg_q70", "blur_sigma1"]).alias("condition"))


@query(
    "x25_capped_quota",
    "WITH m AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS a FROM documents), l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS b FROM m WHERE a <= 4) SELECT doc_id, lang, source, a::BIGINT AS model_rank, b::BIGINT AS label_rank FROM l WHERE b <= 30",
)
def capped(t: Tables):
    return S.capped_quota(t.documents.select("doc_id", "lang", "source", "n_chars"), "lang", "source", "n_chars", "doc_id", 4, 30).select("doc_id", "lang", "source", "model_rank", "label_rank")


@query(
    "x26_spread_tokens",
    f"""WITH h AS (SELECT doc_id, ({U64.format("sha256('6:' || doc_id::VARCHAR)")} % greatest(n_chars, 1)::UBIGINT)::BIGINT AS t, n_chars AS c, least(n_chars, 5) AS n FROM documents) SELECT doc_id, array_to_string(list_sort([((i * c // n) + t) % c for i in range(n)]), ',') AS tokens FROM h""",
)
def spread(t: Tables):
    tokens = F.transform(F.array_sort(S.spread_tokens(F.col("n_chars").cast("int"), 5, F.col("doc_id"), 6)), lambda x: x.cast("string"))
    return t.documents.select("doc_id", F.array_join(tokens, ",").alias("tokens"))


@query(
    "u06_content_distinct",
    "WITH d AS (SELECT doc_id, source, md5(text) AS digest, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS r FROM documents), q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, digest) AS k FROM d WHERE r = 1) SELECT doc_id, source, k::BIGINT AS quota_rank FROM q WHERE k <= 20",
)
def content_distinct(t: Tables):
    return S.content_distinct(t.documents.select("doc_id", "source", F.md5("text").alias("digest")), "digest", "source", "doc_id", 20).select("doc_id", "source", "quota_rank")


@query(
    "w13_cyclic_pairing",
    "WITH a AS (SELECT c_custkey, c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS p FROM customer), b AS (SELECT s_suppkey, s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS p, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT a.c_custkey, b.s_suppkey FROM a JOIN b ON a.k = b.k AND a.p % b.n = b.p",
)
def pairing(t: Tables):
    """Customers with suppliers of their nation, in turn (W13, J22's pick)."""
    a = t.customer.select("c_custkey", F.col("c_nationkey").alias("k"))
    b = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("k"))
    return S.cyclic_pairing(a, b, ["k"], ["c_custkey"], ["s_suppkey"]).select("c_custkey", "s_suppkey")


@query("o05_smallest_per_stratum", "SELECT doc_id, lang, k::BIGINT AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('o' || doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 7")
def smallest(t: Tables):
    """The k smallest priorities of each stratum; tasks keep k each before the shuffle."""
    return S.head_per_stratum(t.documents.select("doc_id", "lang"), ["lang"], 7, F.sha2(F.concat(F.lit("o"), F.col("doc_id").cast("string")), 256), "doc_id")


#: The registry spelt out in SQL: steps with their tokens and JSON, conditions as lists of steps.
REGISTRY_SQL = """WITH lv(k, p, j) AS (VALUES ('L', '0p8', '0.8'), ('H', '1p2', '1.2'), ('O', '1', '1.0')),
st(k, op, tok, js) AS (
  SELECT 'j' || q, 'jpeg', 'jpeg-q' || q || '-sub2', '{"operation":"jpeg","parameters":{"quality":' || q || ',"subsampling":2}}' FROM (VALUES ('90'), ('70'), ('50'), ('30')) t(q)
  UNION ALL SELECT 'b' || j, 'gaussian_blur', 'blur-s' || p || '-pad-pillow', '{"operation":"gaussian_blur","parameters":{"padding":"pillow_default","sigma":' || j || '}}' FROM (VALUES ('0p5', '0.5'), ('1', '1.0'), ('2', '2.0'), ('1', '1')) t(p, j)
  UNION ALL SELECT 'r' || j, 'resize', 'resize-s' || p || '-down-lanczos-up-lanczos', '{"operation":"resize","parameters":{"down_interpolation":"lanczos","scale":' || j || ',"up_interpolation":"lanczos"}}' FROM (VALUES ('0p5', '0.5'), ('0p25', '0.25')) t(p, j)
  UNION ALL SELECT 'n' || j, 'gaussian_noise', 'noise-s' || p || '-seed-parent', '{"operation":"gaussian_noise","parameters":{"seed":"sha256(base_seed,parent_id,step_token,occurrence)","sigma":' || j || '}}' FROM (VALUES ('0p02', '0.02'), ('0p05', '0.05'), ('0p1', '0.1')) t(p, j)
  UNION ALL SELECT 'c' || a.k || b.k || c.k, 'color_jitter', 'color-b' || a.p || '-c' || b.p || '-s' || c.p || '-order-bcs', '{"operation":"color_jitter","parameters":{"brightness":' || a.j || ',"contrast":' || b.j || ',"operation_order":"brightness_contrast_saturation","saturation":' || c.j || '}}' FROM lv a, lv b, lv c
  UNION ALL VALUES ('x', 'center_crop', 'crop-r0p8-up-bicubic', '{"operation":"center_crop","parameters":{"retain":0.8,"up_interpolation":"bicubic"}}'), ('s', 'unsharp_mask', 'sharpen-r2-p150-t3-pad-pillow', '{"operation":"unsharp_mask","parameters":{"padding":"pillow_default","percent":150,"radius":2.0,"threshold":3}}')
), core(name, family, severity, design, ks) AS (VALUES ('clean', 'clean', 0.0, 'single', []::VARCHAR[]), ('jpeg_q90', 'jpeg', 10, 'single', ['j90']), ('jpeg_q70', 'jpeg', 30, 'single', ['j70']), ('jpeg_q50', 'jpeg', 50, 'single', ['j50']), ('jpeg_q30', 'jpeg', 70, 'single', ['j30']),
  ('blur_sigma0.5', 'gaussian_blur', 0.5, 'single', ['b0.5']), ('blur_sigma1', 'gaussian_blur', 1, 'single', ['b1.0']), ('blur_sigma2', 'gaussian_blur', 2, 'single', ['b2.0']), ('resize_0.5', 'resize', 0.5, 'single', ['r0.5']), ('resize_0.25', 'resize', 0.75, 'single', ['r0.25']),
  ('noise_sigma0.02', 'gaussian_noise', 0.02, 'single', ['n0.02']), ('noise_sigma0.05', 'gaussian_noise', 0.05, 'single', ['n0.05']), ('noise_sigma0.10', 'gaussian_noise', 0.1, 'single', ['n0.1']), ('color_jitter_minus20', 'color_jitter', -0.2, 'single', ['cLLL']), ('color_jitter_plus20', 'color_jitter', 0.2, 'single', ['cHHH']), ('center_crop_80', 'center_crop', 0.2, 'single', ['x']),
  ('resize_0.5__jpeg_q70', 'composition', 2, 'legacy_composition', ['r0.5', 'j70']), ('crop_80__resize_0.5__jpeg_q50', 'composition', 3, 'legacy_composition', ['x', 'r0.5', 'j50']), ('blur_1__resize_0.5__jpeg_q70', 'composition', 3, 'legacy_composition', ['b1', 'r0.5', 'j70']), ('noise_0.02__jpeg_q70', 'composition', 2, 'legacy_composition', ['n0.02', 'j70'])),
med(k) AS (VALUES ('j70'), ('b1'), ('r0.5'), ('n0.05'), ('cHHH'), ('x')),
inv AS (SELECT i, b, list_sum([((i // pow(b, d)::BIGINT) % b) / pow(b, d + 1) for d in range(6)]) AS v FROM range(1, 33) t(i), (VALUES (2), (3), (5), (7), (11), (13)) u(b)),
lev AS (SELECT i, b, floor(v * len(levels))::INT AS pick, levels FROM inv JOIN (VALUES (1, 13, ['', 'x']), (2, 5, ['', 'r0.5', 'r0.25']), (3, 11, ['', 'cLLL', 'cLLH', 'cLHL', 'cLHH', 'cHLL', 'cHLH', 'cHHL', 'cHHH']), (4, 3, ['', 'b0.5', 'b1.0', 'b2.0']), (5, 7, ['', 'n0.02', 'n0.05', 'n0.1']), (6, 2, ['', 'j90', 'j70', 'j50', 'j30'])) w(o, b, levels) USING (b)),
cov AS (SELECT i, list(levels[pick + 1] ORDER BY CASE b WHEN 13 THEN 1 WHEN 5 THEN 2 WHEN 11 THEN 3 WHEN 3 THEN 4 WHEN 7 THEN 5 ELSE 6 END) FILTER (WHERE pick > 0) AS ks FROM lev GROUP BY i),
made(prefix, design, ks) AS (
  SELECT 'color-factorial-axial', 'color_axial', [k] FROM (VALUES ('cLOO'), ('cHOO'), ('cOLO'), ('cOHO'), ('cOOL'), ('cOOH')) t(k)
  UNION ALL SELECT 'color-factorial-corner', 'color_corner', [k] FROM (VALUES ('cLLH'), ('cLHL'), ('cLHH'), ('cHLL'), ('cHLH'), ('cHHL')) t(k)
  UNION ALL SELECT 'directed-pair', 'directed_medium_pair', [a.k, b.k] FROM med a, med b WHERE a.k <> b.k
  UNION ALL SELECT 'realistic', 'preregistered_realistic_chain', ks FROM (VALUES (['x', 'r0.5', 'j50']), (['cHLH', 'r0.5', 'j70']), (['b1', 'n0.02', 'j70']), (['n0.02', 'b1', 'j70']), (['r0.5', 's', 'j70']), (['s', 'r0.5', 'j70']), (['j90', 'r0.5', 'j50']), (['j90', 'n0.02', 'j50']), (['j90', 'b1', 'j50']), (['x', 'cLHL', 'j70']), (['x', 'r0.5', 'cHLH', 'j50']), (['x', 'r0.5', 's', 'j50'])) t(ks)
  UNION ALL SELECT 'cover32-' || lpad(i::VARCHAR, 2, '0'), 'halton_covering_bank', ks FROM cov),
every AS (SELECT name, NULL AS prefix, family, severity::DOUBLE AS severity, design, ks FROM core UNION ALL SELECT NULL, prefix, 'composition', len(ks)::DOUBLE, design, ks FROM made),
step AS (SELECT row_number() OVER () AS n, * FROM every), part AS (SELECT n, generate_subscripts(ks, 1) AS pos, unnest(ks) AS k FROM step),
told AS (SELECT n, string_agg(tok, '__then__' ORDER BY pos) AS toks, '[' || string_agg(js, ',' ORDER BY pos) || ']' AS recipe FROM part JOIN st USING (k) GROUP BY n)
SELECT coalesce(name, prefix || '__' || toks) AS name, family, severity, family <> 'composition' AS official, design, len(ks)::BIGINT AS step_count, coalesce(recipe, '[]') AS ordered_recipe_json, sha256(coalesce(recipe, '[]')) AS recipe_sha256 FROM step LEFT JOIN told USING (n)"""


@query("i11_condition_frame", REGISTRY_SQL)
def registry(t: Tables):
    """All conditions with recipes and digests."""
    return condition_frame(t.spark, "all").select("name", "family", "severity", "official", "design", "step_count", "ordered_recipe_json", "recipe_sha256")
