"""Queries for vector retrieval, quality cells, reliability and model probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.operators import reliability as Q
from gaugewright.operators import retrieval as V
from gaugewright.plans.catalog import LINES, Tables, query

#: The stated query set: every id divisible by 100, against all rows but itself.
TOP = """p AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM p WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query, p.vec_id AS prototype, list_cosine_similarity(q.e, p.e) AS cosine FROM q JOIN p ON q.vec_id <> p.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, prototype) AS rank FROM s QUALIFY rank <= 4)"""


def _top(t: Tables):
    every = t.embeddings
    return V.top_k(every.where("vec_id % 100 = 0"), every, 4, "vec_id", "vec_id", others=True)


@query("v01_normalize", "SELECT vec_id, round(list_aggregate([x::DOUBLE / sqrt(list_aggregate([y::DOUBLE * y::DOUBLE for y in embedding], 'sum')) for x in embedding], 'sum'), 6) AS total FROM embeddings")
def normalize(t: Tables):
    return t.embeddings.select("vec_id", F.aggregate(V.normalized(F.col("embedding")), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("v02_top_k", f"WITH {TOP} SELECT query, prototype, round(cosine, 6) AS cosine, rank::BIGINT AS rank FROM t")
def top(t: Tables):
    """Exact top-4 cosine of the stated query set against all rows."""
    return _top(t)


ATTENTION = f"{TOP}, e AS (SELECT *, exp(cosine / 8.0::DOUBLE - max(cosine / 8.0::DOUBLE) OVER (PARTITION BY query)) AS x FROM t), w AS (SELECT *, x / sum(x) OVER (PARTITION BY query) AS weight FROM e)"


@query("v03_attention", f"WITH {ATTENTION} SELECT query, round(max(weight), 6) AS max_attention, round(-sum(weight * ln(weight)), 6) AS entropy, round(-sum(weight * ln(weight)) / ln(4), 6) AS relative_entropy FROM w GROUP BY query")
def attention(t: Tables):
    """Softmax attention over neighbours."""
    return V.attention(_top(t), 64, 4).groupBy("query").agg(F.first("max_attention").alias("max_attention"), F.first("entropy").alias("entropy"), F.first("relative_entropy").alias("relative_entropy"))


@query(
    "v03_reference",
    f"WITH {ATTENTION}, u AS (SELECT vec_id, generate_subscripts(e, 1) AS d, unnest(e) / sqrt(list_aggregate([y * y for y in e], 'sum')) AS x FROM p), r AS (SELECT query, d, sum(weight * u.x) AS x FROM w JOIN u ON w.prototype = u.vec_id GROUP BY ALL) SELECT query, round(sum(x), 6) AS total, round(sum(x * x), 6) AS squares FROM r GROUP BY query",
)
def reference(t: Tables):
    weighted = V.attention(_top(t), 64, 4)
    ref = V.attended_reference(weighted, t.embeddings, "vec_id")
    total = F.aggregate("reference", F.lit(0.0), lambda a, x: a + x)
    return ref.select("query", total.alias("total"), V.dot(F.col("reference"), F.col("reference")).alias("squares"))


@query("v05_residual_statistics", "WITH x AS (SELECT label::BIGINT AS label, (generate_subscripts(embedding, 1) - 1)::BIGINT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, dim, round(avg(x), 6) AS signed_mean, round(stddev_pop(x), 6) AS deviation, round(quantile_cont(abs(x), 0.95), 6) AS upper FROM x GROUP BY label, dim")
def residuals(t: Tables):
    return V.residual_statistics(t.embeddings, "label", "embedding")


@query("v06_score_pool", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(avg(value) FILTER (WHERE r <= ceil(n * 0.1::DOUBLE)), 6) AS top_mean, round(max(value), 6) AS maximum FROM r GROUP BY event_type")
def pool(t: Tables):
    return V.score_pool(t.events, ["event_type"], "value")


@query("v07_kmeans_prototypes", "SELECT range AS prototype_id, 64::BIGINT AS dim FROM range(8)")
def prototypes(t: Tables):
    """Dictionary of centres (V07, V08): their number and size here, their cost in the tests."""
    return V.fit_prototypes(t.embeddings, "embedding", 8).select("prototype_id", F.size("embedding").alias("dim"))


@query("v10_diversity", "WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), g AS (SELECT list_cosine_similarity(a.e, b.e) - CASE WHEN a.vec_id = b.vec_id THEN 1 ELSE 0 END AS x FROM p a CROSS JOIN p b) SELECT round(sqrt(sum(x * x)), 6) AS diversity FROM g")
def diversity(t: Tables):
    """|G - I| through dimension pairs instead of prototype pairs."""
    return V.diversity(t.embeddings, prototype_id="vec_id")


@query("a46_usage", f"WITH {TOP}, h AS (SELECT prototype, count(*) AS hits FROM t WHERE rank = 1 GROUP BY prototype) SELECT p.vec_id AS prototype, coalesce(hits, 0)::BIGINT AS hits, round(coalesce(hits, 0)::DOUBLE / (SELECT sum(hits) FROM h), 6) AS share, hits IS NULL AS dead FROM p LEFT JOIN h ON p.vec_id = h.prototype")
def usage(t: Tables):
    return V.usage(_top(t).where("rank = 1"), t.embeddings, "vec_id")


@query(
    "a44_coverage_tails",
    f"WITH {TOP}, e AS (SELECT query, 1 - max(cosine) AS err FROM t GROUP BY query), l AS (SELECT e.*, x.label FROM e JOIN embeddings x ON e.query = x.vec_id), c AS (SELECT quantile_cont(err, 0.95) AS q FROM l WHERE label < 5), r AS (SELECT label, (err > q)::INT::DOUBLE AS tail FROM l, c WHERE label >= 5), sub AS (SELECT label, avg(tail) AS f, count(*) AS n FROM r GROUP BY label) SELECT label::BIGINT AS label, round(f, 6) AS tail_fraction, n::BIGINT AS rows, round((SELECT avg(tail) FROM r), 6) AS overall_fraction, round((SELECT max(f) FROM sub), 6) AS worst_fraction FROM sub",
)
def tails(t: Tables):
    """Share of reconstruction errors beyond the reference quantile."""
    err = _top(t).groupBy("query").agg((1.0 - F.max("cosine")).alias("err")).join(t.embeddings.select(F.col("vec_id").alias("query"), "label"), "query")
    return V.coverage_tails(err, "err", "label", F.col("label") < 5)


@query("a45_select_capacity", "WITH c AS (SELECT p_size AS size, p_partkey % 7 AS topk, p_retailprice AS loss FROM part), n AS (SELECT * FROM c WHERE loss <= (SELECT min(loss) FROM c) * 1.05::DOUBLE) SELECT size::BIGINT AS size, topk, round(loss, 6) AS loss FROM n ORDER BY size, topk, loss LIMIT 1")
def capacity(t: Tables):
    return V.select_capacity(t.part.select(F.col("p_size").alias("size"), F.pmod("p_partkey", F.lit(7)).alias("topk"), F.col("p_retailprice").alias("loss")), "size", "topk", "loss", 0.05)


COLUMNS = ["l_quantity", "l_extendedprice"]
EDGES = """qq AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q1, min(l_quantity) AS lo1, max(l_quantity) AS hi1, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q2, min(l_extendedprice) AS lo2, max(l_extendedprice) AS hi2 FROM lines),
ed AS (SELECT list_filter(list_sort(list_distinct(q1)), lambda x: x > lo1 AND x < hi1) AS e1, list_filter(list_sort(list_distinct(q2)), lambda x: x > lo2 AND x < hi2) AS e2 FROM qq)"""
CELLS = f"{LINES}, {EDGES}, cells AS (SELECT l.*, len(list_filter(e1, lambda x: x <= l_quantity))::BIGINT AS cell_l_quantity, len(list_filter(e2, lambda x: x <= l_extendedprice))::BIGINT AS cell_l_extendedprice FROM lines l, ed), grid AS (SELECT unnest(range(len(e1) + 1)) AS cell_l_quantity, g AS cell_l_extendedprice FROM ed, (SELECT unnest(range(len(e2) + 1)) AS g FROM ed))"


def _cells(t: Tables):
    edges = Q.quantile_edges(t.lines, COLUMNS, 4).persist()
    return Q.assign_cells(t.lines, edges, COLUMNS), Q.cell_grid(edges, COLUMNS)


@query("i16_quality_cells", f"WITH {CELLS} SELECT cell_l_quantity, cell_l_extendedprice, count(*)::BIGINT AS rows FROM cells GROUP BY ALL")
def cells(t: Tables):
    """Quantile cells."""
    return _cells(t)[0].groupBy("cell_l_quantity", "cell_l_extendedprice").agg(F.count(F.lit(1)).alias("rows"))


@query("i17_cell_grid", f"WITH {CELLS} SELECT cell_l_quantity, cell_l_extendedprice FROM grid")
def grid(t: Tables):
    return _cells(t)[1]


def shrunk(where: str) -> str:
    return f"(SELECT g.cell_l_quantity, g.cell_l_extendedprice, coalesce(n, 0) AS rows, (coalesce(n, 0) * coalesce(m, 0) + 20 * gm) / (coalesce(n, 0) + 20) AS mean, CASE WHEN n IS NULL THEN gv ELSE (n * (s + m * m) + 20 * (gv + gm * gm)) / (n + 20) - pow((n * m + 20 * gm) / (n + 20), 2) END AS variance FROM grid g LEFT JOIN (SELECT cell_l_quantity, cell_l_extendedprice, count(*) AS n, avg(l_discount) AS m, var_pop(l_discount) AS s FROM cells WHERE {where} GROUP BY ALL) c USING (cell_l_quantity, cell_l_extendedprice) CROSS JOIN (SELECT avg(l_discount) AS gm, var_pop(l_discount) AS gv FROM cells WHERE {where}))"


@query("a37_shrunk_statistics", f"WITH {CELLS} SELECT cell_l_quantity, cell_l_extendedprice, rows::BIGINT AS rows, round(mean, 6) AS mean, round(variance, 6) AS variance FROM {shrunk('target = 0')}")
def statistics(t: Tables):
    """Empirical-Bayes cell statistics."""
    c, g = _cells(t)
    return Q.shrunk_statistics(c.where("target = 0"), ["cell_l_quantity", "cell_l_extendedprice"], "l_discount", g)


TABLE = f"{CELLS}, u AS {shrunk("target = 0 AND phase = 'discovery'")}, z AS {shrunk("target = 0 AND phase = 'confirmation'")}, o AS {shrunk("target = 1 AND phase = 'confirmation'")}, ref AS (SELECT (avg(l_discount) FILTER (WHERE target = 1) - avg(l_discount) FILTER (WHERE target = 0)) / sqrt((var_pop(l_discount) FILTER (WHERE target = 1) + var_pop(l_discount) FILTER (WHERE target = 0)) / 2) AS d FROM cells WHERE status = 'F' AND phase = 'confirmation'), tab AS (SELECT z.cell_l_quantity, z.cell_l_extendedprice, u.mean AS m_null, u.variance AS v_null, (o.mean - z.mean) / sqrt((o.variance + z.variance) / 2) AS dp, CASE WHEN ref.d > 0 THEN greatest(least((o.mean - z.mean) / sqrt((o.variance + z.variance) / 2) / ref.d, 1), 0) ELSE 0 END AS availability FROM z JOIN o USING (cell_l_quantity, cell_l_extendedprice) JOIN u USING (cell_l_quantity, cell_l_extendedprice) CROSS JOIN ref)"


def _table(t: Tables):
    c, g = _cells(t)
    held = c.where("phase = 'confirmation'")
    return c, Q.reliability_table(held, c.where("phase = 'discovery' and target = 0"), ["cell_l_quantity", "cell_l_extendedprice"], "l_discount", "target", F.col("status") == "F", g)


@query("a39_reliability_table", f"WITH {TABLE} SELECT cell_l_quantity, cell_l_extendedprice, round(m_null, 6) AS m_null, round(dp, 6) AS d_prime, round(availability, 6) AS availability FROM tab")
def table(t: Tables):
    """d-prime and availability per cell."""
    return _table(t)[1].select("cell_l_quantity", "cell_l_extendedprice", "m_null", "d_prime", "availability")


@query("a40_fused_scores", f"WITH {TABLE} SELECT c.parent_id, c.target::BIGINT AS target, round(availability * (l_discount - m_null) / sqrt(v_null), 6) AS fused FROM cells c JOIN tab USING (cell_l_quantity, cell_l_extendedprice)")
def fused(t: Tables):
    """Availability times z."""
    c, tab = _table(t)
    return Q.fused_scores(c, tab, ["cell_l_quantity", "cell_l_extendedprice"], "l_discount").select("parent_id", "target", "fused")


@query("a42_occupancy_overlap", f"WITH {CELLS}, a AS (SELECT cell_l_quantity AS x, cell_l_extendedprice AS y, count(*)::DOUBLE / (SELECT count(*) FROM cells WHERE status = 'F') AS p FROM cells WHERE status = 'F' GROUP BY ALL), b AS (SELECT cell_l_quantity AS x, cell_l_extendedprice AS y, count(*)::DOUBLE / (SELECT count(*) FROM cells WHERE status = 'O') AS p FROM cells WHERE status = 'O' GROUP BY ALL) SELECT round(sum(least(a.p, b.p)), 6) AS overlap FROM a JOIN b USING (x, y)")
def overlap(t: Tables):
    c, _ = _cells(t)
    return Q.occupancy_overlap(c.where("status = 'F'"), c.where("status = 'O'"), ["cell_l_quantity", "cell_l_extendedprice"])


@query("a41_availability_audit")
def audit(t: Tables):
    """Predicted availability against measured d-prime."""
    c, tab = _table(t)
    return Q.availability_audit(c.where("phase = 'confirmation'"), tab, ["cell_l_quantity", "cell_l_extendedprice"], "l_discount", "target")


@query("a27_nuisance_probe")
def probe(t: Tables):
    """Out-of-fold nuisance probe."""
    return Q.nuisance_probe(t.lines.persist(), ["l_quantity", "l_tax"], "l_orderkey")


@query("a25_family_ablation")
def ablation(t: Tables):
    """Families fitted on discovery rows, scored on confirmation rows."""
    rows = t.lines.persist()
    out = Q.family_ablation(rows, {"price": ["l_quantity", "l_extendedprice"], "rates": ["l_discount", "l_tax"]}, F.col("phase") == "discovery", ["time_window"])
    return out.select("baseline", "time_window", "rows", "roc_auc", "average_precision")
