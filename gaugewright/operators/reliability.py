"""Quality cells and reliability: quantile binning, shrunk cell statistics, availability, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.scalars import bin_right
from gaugewright.operators.evaluation import spearman
from gaugewright.operators.ranking import same

D = "double"


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """One row: for each column the distinct interior quantiles strictly between its extremes (I16)."""
    q = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    got = df.agg(*[x for c in columns for x in (F.percentile(F.col(c).cast(D), q).alias(f"q_{c}"), F.min(F.col(c).cast(D)).alias(f"lo_{c}"), F.max(F.col(c).cast(D)).alias(f"hi_{c}"))])

    def inner(c):
        return F.array_sort(F.array_distinct(F.filter(f"q_{c}", lambda e: (e > F.col(f"lo_{c}")) & (e < F.col(f"hi_{c}"))))).alias(f"edges_{c}")

    return got.select(*[inner(c) for c in columns])


def assign_cells(df: DataFrame, edges: DataFrame, columns: Sequence[str], prefix: str = "cell_") -> DataFrame:
    """Cell coordinates by right-sided search of the edges (I16)."""
    return df.crossJoin(F.broadcast(edges)).withColumns({f"{prefix}{c}": bin_right(F.col(c).cast(D), F.col(f"edges_{c}")) for c in columns}).drop(*[f"edges_{c}" for c in columns])


def cell_grid(edges: DataFrame, columns: Sequence[str], prefix: str = "cell_") -> DataFrame:
    """Every cell there can be (I17); edges is one row."""
    out = edges
    for c in columns:
        out = out.withColumn(f"{prefix}{c}", F.explode(F.sequence(F.lit(0), F.size(f"edges_{c}"))))
    return out.select(*[f"{prefix}{c}" for c in columns])


def shrunk_statistics(df: DataFrame, cells: Sequence[str], value: str, grid: DataFrame, prior: float = 20.0, floor: float = 1e-6) -> DataFrame:
    """Mean and variance of each cell with ``prior`` pseudo-rows of the whole population; empty cells are global.

    First and second moments are shrunk, so the variance holds the distance between the means too.
    """
    v = F.col(value).cast(D)
    whole = df.agg(F.avg(v).alias("gm"), F.greatest(F.var_pop(v), F.lit(floor)).alias("gv"))
    per = df.groupBy(*cells).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    out = same(grid, per, cells, "left", small=True).crossJoin(F.broadcast(whole))
    n, p = F.coalesce(F.col("n"), F.lit(0)).cast(D), F.lit(float(prior))
    mean = (n * F.coalesce("m", F.lit(0.0)) + p * F.col("gm")) / (n + p)
    m, s = F.coalesce("m", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    second = (n * (s + m * m) + p * (F.col("gv") + F.col("gm") * F.col("gm"))) / (n + p)
    variance = F.when(n == 0, F.col("gv")).otherwise(second - mean * mean)
    return out.select(*cells, F.coalesce("n", F.lit(0)).alias("rows"), mean.alias("mean"), F.greatest(variance, F.lit(floor)).alias("variance"))


def d_prime(m1: Column, v1: Column, m0: Column, v0: Column) -> Column:
    """Signed separation of two classes."""
    return F.try_divide(m1 - m0, F.sqrt((v1 + v0) / F.lit(2.0)))


def reliability_table(df: DataFrame, null: DataFrame, cells: Sequence[str], score: str, target: str, clean: Column, grid: DataFrame, prior: float = 20.0) -> DataFrame:
    """Per cell (A39): m_null, v_null of the authentic population ``null`` for normalisation; d_prime of the validation
    rows ``df``; availability = d_prime over that of the clean validation rows, in [0, 1], 0 if the latter isn't positive.
    """
    fit = lambda rows, *names: shrunk_statistics(rows, cells, score, grid, prior).select(*cells, *[F.col(x).alias(n) for x, n in zip(("mean", "variance", "rows"), names, strict=True)])
    own = fit(null, "m_null", "v_null", "null_rows")
    zero = fit(df.where(F.col(target) == 0), "m0", "v0", "authentic_rows")
    one = fit(df.where(F.col(target) == 1), "m1", "v1", "positive_rows")
    s, t = F.col(score).cast(D), F.col(target)
    ref = df.where(clean).agg(*[f(F.when(t == k, s)).alias(f"{n}{k}c") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_pop))])
    ref = ref.select(d_prime(F.col("m1c"), F.greatest("v1c", F.lit(1e-6)), F.col("m0c"), F.greatest("v0c", F.lit(1e-6))).alias("d_clean"))
    out = same(same(own, zero, cells, small=True), one, cells, small=True).crossJoin(F.broadcast(ref)).withColumn("d_prime", d_prime(F.col("m1"), F.col("v1"), F.col("m0"), F.col("v0")))
    share = F.when(F.col("d_clean") > 0, F.col("d_prime") / F.col("d_clean")).otherwise(F.lit(0.0))
    return out.withColumn("availability", F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def fused_scores(df: DataFrame, table: DataFrame, cells: Sequence[str], score: str) -> DataFrame:
    """z against the cell's authentic population, availability, and their product."""
    out = same(df, table.select(*cells, "m_null", "v_null", "availability"), cells, "left", small=True)
    z = (F.col(score).cast(D) - F.col("m_null")) / F.sqrt("v_null")
    return out.withColumn("z", z).withColumn("fused", F.coalesce("availability", F.lit(0.0)) * F.coalesce("z", F.lit(0.0))).drop("m_null", "v_null")


def availability_audit(df: DataFrame, table: DataFrame, cells: Sequence[str], score: str, target: str, least: int = 5) -> DataFrame:
    """Spearman of predicted availability with d-prime measured on held-out rows, over cells with enough of each class."""
    s, t = F.col(score).cast(D), F.col(target)
    per = df.groupBy(*cells).agg(F.count_if(t == 0).alias("n0"), F.count_if(t == 1).alias("n1"), *[f(F.when(t == k, s)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("mean", F.avg), ("var", F.var_pop))])
    per = per.where((F.col("n0") >= least) & (F.col("n1") >= least)).withColumn("measured", d_prime(F.col("mean1"), F.col("var1"), F.col("mean0"), F.col("var0")))
    joined = same(per, table.select(*cells, "availability"), cells, small=True).withColumn("all_", F.lit(1))
    return spearman(joined, ["all_"], "availability", "measured").join(joined.groupBy("all_").agg(F.count(F.lit(1)).alias("cells")), "all_").drop("all_")


def occupancy_overlap(a: DataFrame, b: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Sum over cells of the smaller of both shares."""
    share = lambda df, name: df.groupBy(*cells).agg(F.count(F.lit(1)).alias("n_")).crossJoin(df.agg(F.count(F.lit(1)).alias("all_"))).select(*cells, (F.col("n_").cast(D) / F.col("all_")).alias(name))
    both = same(share(a, "pa"), share(b, "pb"), cells, small=True)
    return both.agg(F.coalesce(F.sum(F.least("pa", "pb")), F.lit(0.0)).alias("overlap"))


def stacker(train: DataFrame, columns: Sequence[str], target: str = "target", strength: float = 1.0):
    """L2 logistic regression over score and quality columns (A43); the penalty is on the summed loss, so 1 / (C n)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = train.count()
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="raw_"),
            StandardScaler(inputCol="raw_", outputCol="features_", withMean=True),
            LogisticRegression(featuresCol="features_", labelCol=target, regParam=1.0 / (strength * max(1, n)), elasticNetParam=0.0, standardization=False, probabilityCol="probability_", rawPredictionCol="margin_", predictionCol="predicted_"),
        ]
    ).fit(train)


def balanced_logistic(train: DataFrame, columns: Sequence[str], target: str = "target", strength: float = 1.0):
    """Median imputation, standardisation, class-balanced logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    counts = {r[target]: r["count"] for r in train.groupBy(target).count().collect()}
    n, k = sum(counts.values()), max(1, len(counts))
    weight = F.lit(0.0)
    for value, c in counts.items():
        weight = F.when(F.col(target) == value, F.lit(n / (k * c))).otherwise(weight)
    filled = [f"f_{c}" for c in columns]
    stages = [
        Imputer(inputCols=list(columns), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="raw_"),
        StandardScaler(inputCol="raw_", outputCol="features_", withMean=True),
        LogisticRegression(featuresCol="features_", labelCol=target, weightCol="weight_", regParam=1.0 / (strength * max(1, n)), elasticNetParam=0.0, standardization=False, probabilityCol="probability_", rawPredictionCol="margin_", predictionCol="predicted_"),
    ]
    return Pipeline(stages=stages).fit(train.withColumn("weight_", weight))


def family_ablation(features: DataFrame, families: dict[str, Sequence[str]], train: Column, by: Sequence[str], target: str = "target") -> DataFrame:
    """Fit each family's columns on the training rows and score all others, by condition."""
    from pyspark.ml.functions import vector_to_array

    from gaugewright.operators.ranking import metric_slices

    out = None
    for name, columns in families.items():
        model = balanced_logistic(features.where(train), columns, target)
        scored = model.transform(features.where(~train)).select(*by, target, vector_to_array("margin_")[1].alias("score"))
        part = metric_slices(scored, by, target, "score").withColumn("baseline", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def nuisance_probe(df: DataFrame, columns: Sequence[str], lineage: str, target: str = "target", folds: int = 3, seed: int = 0) -> DataFrame:
    """Out-of-fold AUC of nuisance columns with folds by lineage hash; max(auc, 1 - auc)."""
    from pyspark.ml.functions import vector_to_array

    from gaugewright.operators.aggregates import hash_folds
    from gaugewright.operators.ranking import ranking_metrics

    rows = df.withColumn("fold_", hash_folds(F.col(lineage), folds, seed))
    out = None
    for k in range(folds):
        model = balanced_logistic(rows.where(F.col("fold_") != k), columns, target)
        part = model.transform(rows.where(F.col("fold_") == k)).select(target, vector_to_array("margin_")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    auc = ranking_metrics(out, [], target, "score").select("roc_auc")
    return auc.select(F.greatest("roc_auc", 1.0 - F.col("roc_auc")).alias("probe_auc"))
