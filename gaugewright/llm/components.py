"""Connected components of a link table by alternating large-star and small-star rounds, all in DataFrames.

Each round is written to the shared folder, so lineage stays short and a lost executor costs one round. Nothing is
collected but a row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.common import remove_path, work_path


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str, tuple]:
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    state = back.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return back, path, tuple(state)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link to another one.

    Null ends and loops are ignored; repeated and reversed links count once; no link gives an empty result.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b").distinct()
    now, path, state = _written(e, "links")
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.withColumnRenamed("m", "b")).distinct()
        before, old, was = now, path, state
        now, path, state = _written(small, "links")
        remove_path(before.sparkSession, old)
        if state == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


class UnionFind:
    """Local union by smallest root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """True if x and y were apart until now."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.up[y] = x
        return True
