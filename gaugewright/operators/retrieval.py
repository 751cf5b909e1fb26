"""Vector retrieval: exact top-k cosine against prototypes, attention over them, coverage, k-means dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

D = "double"
#: Queries go to every task, in blocks of at most this many numbers.
BLOCK_NUMBERS = 4_000_000


def normalized(vector: Column) -> Column:
    """v / |v| in double precision; the zero vector stays."""
    v = F.transform(vector, lambda x: x.cast(D))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast(D) * y.cast(D)), F.lit(0.0), lambda s, x: s + x)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _nearest(unit: np.ndarray, names: np.ndarray, k: int, others: bool, types: tuple[pa.DataType, pa.DataType]):
    """Each query's k nearest of this task's rows, found batch by batch."""

    def run(batches):
        best = (np.empty(0, np.int64), np.empty(0), None)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                x = _unit(np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1))
                for q in range(0, len(unit), 4096):
                    s = unit[q : q + 4096] @ x.T
                    if others:
                        s[names[q : q + 4096, None] == keys[None, :]] = -np.inf
                    bound = np.partition(s, len(keys) - min(k, len(keys)), axis=1)[:, len(keys) - min(k, len(keys))]
                    who, which = np.nonzero((s >= bound[:, None]) & (s > -np.inf))
                    best = merged(best, (who + q, s[who, which], keys[which]), k)
        who, score, key = best
        if key is not None and len(who):
            yield pa.RecordBatch.from_arrays([pa.array(names[who]).cast(types[0]), pa.array(key).cast(types[1]), pa.array(score)], names=["query", "prototype", "cosine"])

    def merged(a, b, k):
        who, score = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        key = b[2] if a[2] is None else np.concatenate((a[2], b[2]))
        order = np.lexsort((key, -score, who))
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = order[place < k]
        return who[place < k], score[keep], key[keep]

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, vector: str = "embedding", others: bool = False) -> DataFrame:
    """query, prototype, cosine, rank of the k nearest rows of each query by cosine, ties by id.

    The queries are the bounded side: they go out in blocks of BLOCK_NUMBERS numbers, and every block is a pass over all
    rows, which never move. Each task gives its k best per query, and these meet in one exchange. With ``others`` a row of
    the query's own id doesn't count. Null vectors have no neighbours and are none.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kinds = queries.sparkSession, (queries.schema[query_id].dataType, rows.schema[row_id].dataType)
    asked = queries.where(F.col(vector).isNotNull()).select(query_id, F.col(vector).cast("array<double>").alias("v"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-(size["n"] or 0) * (size["d"] or 0) // BLOCK_NUMBERS))
    schema = T.StructType([T.StructField("query", kinds[0]), T.StructField("prototype", kinds[1]), T.StructField("cosine", T.DoubleType())])
    every = rows.where(F.col(vector).isNotNull()).select(row_id, F.col(vector).cast("array<double>").alias("v"))
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b).collect()
        if block:
            unit, names = _unit(np.array([r["v"] for r in block])), np.array([r[0] for r in block])
            out = out.unionByName(every.mapInArrow(_nearest(unit, names, k, others, (to_arrow_type(kinds[0]), to_arrow_type(kinds[1]))), schema))
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "prototype")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def attention(neighbours: DataFrame, dim: int, k: int, temperature: float | None = None) -> DataFrame:
    """Softmax weights of each query's neighbours, maximum weight and entropy in nats and relative to log k."""
    scale = F.lit(1.0 / (temperature if temperature is not None else float(np.sqrt(dim))))
    w = Window.partitionBy("query")
    e = F.exp(F.col("cosine") * scale - F.max(F.col("cosine") * scale).over(w))
    rows = neighbours.withColumn("e_", e).withColumn("weight", F.col("e_") / F.sum("e_").over(w)).drop("e_")
    per = rows.groupBy("query").agg(F.max("weight").alias("max_attention"), (-F.sum(F.col("weight") * F.log("weight"))).alias("entropy"))
    return rows.join(per.withColumn("relative_entropy", F.col("entropy") / F.lit(float(np.log(max(2, k))))), "query")


def attended_reference(weighted: DataFrame, prototypes: DataFrame, prototype_id: str, vector: str = "embedding") -> DataFrame:
    """query, reference: the weighted mean of the neighbours' unit vectors, by dimension."""
    unit = prototypes.select(F.col(prototype_id).alias("prototype"), normalized(F.col(vector)).alias("u"))
    parts = weighted.join(unit, "prototype").select("query", "weight", F.posexplode("u").alias("d", "x")).groupBy("query", "d").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    return parts.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("reference"))


def residual_statistics(df: DataFrame, image: str, vector: str, quantile: float = 0.95) -> DataFrame:
    """Mean, population deviation and quantile of |x| by image and dimension."""
    return df.select(image, F.posexplode(vector).alias("dim", "x")).groupBy(image, "dim").agg(F.avg(F.col("x").cast(D)).alias("signed_mean"), F.stddev_pop(F.col("x").cast(D)).alias("deviation"), F.percentile(F.abs(F.col("x").cast(D)), F.lit(quantile)).alias("upper"))


def score_pool(df: DataFrame, by: Sequence[str], score: str, fraction: float = 0.1) -> DataFrame:
    """Mean, population deviation, mean of the top share and maximum of each group's scores."""
    w = Window.partitionBy(*by)
    s = F.col(score).cast(D)
    rows = df.withColumn("n_", F.count(F.lit(1)).over(w)).withColumn("r_", F.row_number().over(w.orderBy(F.desc(score))))
    return rows.groupBy(*by).agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("deviation"), F.avg(F.when(F.col("r_") <= F.ceil(F.col("n_") * F.lit(fraction)), s)).alias("top_mean"), F.max(s).alias("maximum"))


def fit_prototypes(df: DataFrame, vector: str, k: int, seed: int = 0, weight: str | None = None) -> DataFrame:
    """prototype_id, embedding: k-means centres of unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).select(array_to_vector(normalized(F.col(vector))).alias("features"), *([weight] if weight else []))
    model = KMeans(k=k, seed=seed, weightCol=weight, maxIter=20).fit(rows) if weight else KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    return df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prototype_id int, embedding array<double>")


def fit_dual_prototypes(df: DataFrame, vector: str, target: str, k: int, seed: int = 0) -> DataFrame:
    """A dictionary for each class."""
    return fit_prototypes(df.where(F.col(target) == 0), vector, k, seed).withColumn("target", F.lit(0)).unionByName(fit_prototypes(df.where(F.col(target) == 1), vector, k, seed).withColumn("target", F.lit(1)))


def diversity(prototypes: DataFrame, vector: str = "embedding", prototype_id: str = "prototype_id") -> DataFrame:
    """Frobenius norm of G - I over unit prototypes (V10): |U U' - I|^2 = |U' U|^2 - 2 |U|^2 + K, by dimension pairs."""
    unit = prototypes.select(prototype_id, normalized(F.col(vector)).alias("u"))
    cell = unit.select(F.posexplode("u").alias("i", "x"), "u").select("i", "x", F.posexplode("u").alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    squares = cell.agg(F.sum(F.col("g") * F.col("g")).alias("s"))
    norms = unit.agg(F.count(F.lit(1)).alias("k"), F.sum(dot(F.col("u"), F.col("u"))).alias("t"))
    return squares.crossJoin(norms).select(F.sqrt(F.greatest(F.col("s") - 2.0 * F.col("t") + F.col("k"), F.lit(0.0))).alias("diversity"))


def usage(neighbours: DataFrame, prototypes: DataFrame, prototype_id: str) -> DataFrame:
    """Hits of every prototype, unused ones included, and its share."""
    hits = neighbours.groupBy("prototype").agg(F.count(F.lit(1)).alias("hits"))
    every = prototypes.select(F.col(prototype_id).alias("prototype")).join(hits, "prototype", "left").fillna(0, ["hits"])
    return every.crossJoin(neighbours.agg(F.count(F.lit(1)).alias("all_"))).withColumn("share", F.try_divide(F.col("hits").cast(D), F.col("all_").cast(D))).withColumn("dead", F.col("hits") == 0).drop("all_")


def coverage_tails(df: DataFrame, error: str, subtype: str, reference: Column, quantile: float = 0.95) -> DataFrame:
    """Share of errors above the reference rows' quantile, overall and by subtype, and the worst."""
    limit = df.where(reference).agg(F.percentile(F.col(error).cast(D), F.lit(quantile)).alias("limit_"))
    rows = df.where(~reference).crossJoin(F.broadcast(limit)).withColumn("tail_", (F.col(error) > F.col("limit_")).cast("int").cast(D))
    per = rows.groupBy(subtype).agg(F.avg("tail_").alias("tail_fraction"), F.count(F.lit(1)).alias("rows"))
    return per.crossJoin(rows.agg(F.avg("tail_").alias("overall_fraction"))).crossJoin(per.agg(F.max("tail_fraction").alias("worst_fraction")))


def select_capacity(candidates: DataFrame, size: str, topk: str, loss: str, tolerance: float = 0.01) -> DataFrame:
    """The smallest (size, top-k) within the tolerance of the least loss."""
    best = candidates.agg(F.min(loss).alias("best_"))
    near = candidates.crossJoin(F.broadcast(best)).where(F.col(loss) <= F.col("best_") * F.lit(1.0 + tolerance))
    return near.agg(F.min(F.struct(size, topk, loss)).alias("m")).select("m.*")


def disagreements(names: Sequence[str]) -> dict[str, Column]:
    """Absolute differences of each pair of branch scores."""
    return {f"abs_{a}_{b}": F.abs(F.col(a) - F.col(b)) for i, a in enumerate(names) for b in names[i + 1 :]}
