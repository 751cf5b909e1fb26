"""An extension: confusion counts and binned ranking over a stream of scores, and incremental prototypes.

Counts merge, so slices stay exact with a watermark; ranking metrics don't, so a stream gets them from score bins and they
are approximate by the bins' width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.ranking import confusion, ranking_aggregates, ratio, running_counts
from gaugewright.session import shared_folder


def windowed_confusion(stream: DataFrame, keys: Sequence[str], ts: str = "ts", every: str = "1 hour", late: str = "2 hours", label: str = "target", score: str = "score", threshold: float = 0.0) -> DataFrame:
    """tp, tn, fp, fn of each slice and tumbling window; rows later than the watermark are left out by Spark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("window"), *keys).agg(*confusion(F.col(label), F.col(score).cast("double"), threshold)).select("window.start", "window.end", *keys, "tp", "tn", "fp", "fn")


def binned_counts(stream: DataFrame, keys: Sequence[str], low: float, high: float, bins: int = 200, label: str = "target", score: str = "score") -> DataFrame:
    """Mergeable state of a ranking metric: (keys, bin centre, pos, neg)."""
    width = (high - low) / bins
    b = F.greatest(F.least(F.floor((F.col(score) - low) / F.lit(width)), F.lit(bins - 1)), F.lit(0))
    return stream.groupBy(*keys, (b * F.lit(width) + F.lit(low + width / 2)).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def binned_ranking(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Approximate ranking metrics of binned counts (a batch table, e.g. a stream's memory or Parquet sink)."""
    run = running_counts(counts, keys, 1)
    points = run.select(*keys, "pos", "neg", "tp", "fp", "total_pos", "total_neg", ratio("tp", "total_pos").alias("tpr"), ratio("fp", "total_neg").alias("fpr"), ratio(F.col("tp") - F.col("pos"), "total_pos").alias("prev_tpr"), ratio(F.col("fp") - F.col("neg"), "total_neg").alias("prev_fpr"), ratio("tp", F.col("tp") + F.col("fp")).alias("precision"))
    return points.groupBy(*keys).agg(*ranking_aggregates())


class StreamingPrototypes:
    """Weighted mini-batch k-means for foreachBatch (V08): rows are held back until there are k, then centres move.

    Rows held back are written below ``folder`` (by default one in the session's shared folder), as a micro-batch's source
    may be gone later. A micro-batch that is given again under its id, as after a failure, counts once.
    """

    def __init__(self, k: int, vector: str = "embedding", weight: str | None = None, seed: int = 0, folder: str | None = None) -> None:
        self.k, self.vector, self.weight, self.seed, self.folder = k, vector, weight, seed, folder
        self.centres: list[list[float]] | None = None
        self.mass = [0.0] * k
        self.held: list[str] = []
        self.seen: set[int] = set()

    def update(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Assignments and sums are distributed; the driver holds k centres."""
        from gaugewright.operators.retrieval import dot, fit_prototypes, normalized

        if batch_id is not None and batch_id in self.seen:
            return
        w = F.col(self.weight) if self.weight else F.lit(1.0)
        rows = batch.where(F.col(self.vector).isNotNull()).select(normalized(F.col(self.vector)).alias("v"), w.cast("double").alias("w"))
        if self.centres is None:
            spark = batch.sparkSession
            self.folder = self.folder or shared_folder(spark, "prototypes")
            path = f"{self.folder}/held-{len(self.held) if batch_id is None else batch_id}"
            rows.write.mode("overwrite").parquet(path)
            if path not in self.held:
                self.held.append(path)
            rows = spark.read.schema(rows.schema).parquet(*self.held)
            if rows.limit(self.k).count() < self.k:
                self._done(batch_id)
                return
            self.centres = [r["embedding"] for r in fit_prototypes(rows.withColumnRenamed("v", "embedding"), "embedding", self.k, self.seed).orderBy("prototype_id").collect()]
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.centres])
        scores = F.transform(centres, lambda c: dot(F.col("v"), c) - dot(c, c) / 2.0)
        near = rows.withColumn("c", F.array_position(scores, F.array_max(scores)).cast("int") - 1)
        sums = near.select("c", "w", F.posexplode("v").alias("d", "x")).groupBy("c", "d").agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.sum("w").alias("w")).collect()
        for r in sums:
            old = self.mass[r["c"]]
            self.centres[r["c"]][r["d"]] = (self.centres[r["c"]][r["d"]] * old + r["x"]) / (old + r["w"])
        for c, m in {r["c"]: r["w"] for r in sums if r["d"] == 0}.items():
            self.mass[c] += m
        self._done(batch_id)

    def _done(self, batch_id: int | None) -> None:
        """Ids come in order and only the last may come again; so a few are enough."""
        if batch_id is not None:
            self.seen = {x for x in self.seen if x > batch_id - 100} | {batch_id}
