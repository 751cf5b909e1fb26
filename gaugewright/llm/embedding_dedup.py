"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors are one vertex with a count. Centres come from a sample of at most ``sample_rows`` distinct vectors (those
of the least hash); every vector then has a home cell, that of the centre of largest cosine. A vector also visits
another cell where it lies so near the plane between the two centres that a vector beyond may be within the angle: if x
is in cell c, y in cell d and their angle is at most a, then x (c - d) / |c - d| <= sin a. Of two cells the one of
smaller number visits, so each pair meets once and none is lost, whatever the centres are: the result is exact. There
are n / ``block_rows`` cells, 2 at least and ``max_cells`` at most. How many visits there are depends on the data's structure; without any, every
block of a cell meets every vector.

Cells of more than ``block_rows`` vectors are cut into blocks; a block's vectors are multiplied with each other, with
those of the cell's later blocks and with the visitors, in double precision. Tasks emit a count for each vector with
links and spanning links, never pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
different dimensions never link; repeated rows are vectors of their own that link; rows without id link and have the
smallest id of their group, null if there is none; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm.common import materialize
from gaugewright.llm.components import connected_components

CHUNK = 1024
SLACK = 1e-9


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centres; empty cells get a random vector."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), x[rng.choice(len(x), k)])
    return centres


def _rows(batch: pa.RecordBatch, column: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, unit vectors) of a batch's vectors."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths())
    out = []
    for dim in np.unique(sizes):
        at = np.nonzero(sizes == dim)[0]
        out.append((int(dim), at, unit_rows(np.asarray(lists.take(pa.array(at)).flatten()), int(dim))))
    return out


def _placed(centres: dict[int, np.ndarray], reach: float, homes_only: bool, names: list[str]):
    """(rep, n, dim, cell, visit, v) of each vector at home and, unless homes_only, where it visits."""

    def run(batches):
        for batch in batches:
            rows, dims, cells, visits = [], [], [], []
            for dim, at, x in _rows(batch, 2):
                c = centres.get(dim)
                near = x @ c.T if c is not None else np.ones((len(x), 1))
                home = near.argmax(axis=1)
                rows.append(at)
                cells.append(home)
                visits.append(np.zeros(len(at), bool))
                dims.append(np.full(len(at), dim))
                if c is not None and not homes_only:
                    apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-30))
                    own = near[np.arange(len(x)), home]
                    away = (own[:, None] - near) / apart[home] <= reach + SLACK
                    away &= np.arange(len(c))[None, :] > home[:, None]
                    who, where = np.nonzero(away)
                    rows.append(at[who])
                    cells.append(where)
                    visits.append(np.ones(len(who), bool))
                    dims.append(np.full(len(who), dim))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(dims).astype(np.int32)), pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(visits)), batch.column(2).take(take)],
                    names=names,
                )

    return run


class _Block:
    """One block's vectors, their link counts and groups."""

    def __init__(self, level: float) -> None:
        self.level, self.ids, self.n, self.x = level, [], [], []
        self.links, self.label, self.matrix, self.weights = None, None, None, None

    def add(self, ids, n, x) -> None:
        self.ids += ids
        self.n.append(n)
        self.x.append(x)

    def close(self):
        """Products within the block."""
        self.matrix, self.weights = np.concatenate(self.x), np.concatenate(self.n).astype(np.float64)
        size = len(self.matrix)
        self.links, self.label = np.zeros(size), np.arange(size)
        for a in range(0, size, CHUNK):
            part = self.matrix[a : a + CHUNK] @ self.matrix[a:].T >= self.level
            local = np.arange(len(part))
            part[local, local] = False
            part[:, : len(part)] = np.triu(part[:, : len(part)], 1)
            if part.any():
                self.links[a : a + CHUNK] += part @ self.weights[a:]
                self.links[a:] += self.weights[a : a + CHUNK] @ part
                for i in np.nonzero(part.any(axis=1))[0]:
                    yield from self.joined(self.ids[a + i], int(self.label[a + i]), np.nonzero(part[i])[0] + a)

    def joined(self, one, label: int | None, found: np.ndarray):
        """Spanning links of one vector with what it was found to link to."""
        labels, first = np.unique(self.label[found], return_index=True)
        for other, at in zip(labels, first, strict=True):
            if other != label:
                yield one, self.ids[found[at]]
        if label is not None:
            labels = np.union1d(labels, [label])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def visited(self, ids, n, x):
        """(counts of the visitors, spanning links)."""
        part = x @ self.matrix.T >= self.level
        if not part.any():
            return None, []
        self.links += n.astype(np.float64) @ part
        links = []
        for i in np.nonzero(part.any(axis=1))[0]:
            links += self.joined(ids[i], None, np.nonzero(part[i])[0])
        return part @ self.weights, links


def _products(level: float, names: list[str]):
    def run(batches):
        group, block, open_, kind = None, None, False, None

        def rows(ids, counts, links):
            at = [(i, int(c), None) for i, c in zip(ids, counts, strict=True) if c] + [(a, 0, b) for a, b in links]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in at], kind), pa.array([r[1] for r in at], pa.int64()), pa.array([r[2] for r in at], kind)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            ids, n = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            key = np.stack([np.asarray(batch.column(k)) for k in (2, 3, 4)], axis=1) if batch.num_rows else np.empty((0, 3))
            visit = np.asarray(batch.column(5).to_numpy(zero_copy_only=False), bool)
            cuts = np.nonzero((np.diff(key, axis=0) != 0).any(axis=1) | (np.diff(visit.astype(np.int8)) != 0))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if a == b:
                    continue
                if (now := tuple(key[a])) != group:
                    if block is not None and block.ids:  # hashes may leave a block empty
                        links = list(block.close()) if open_ else []
                        yield rows(block.ids, block.links, links)
                    group, block, open_ = now, _Block(level), True
                for s in range(a, b, CHUNK):
                    e = min(b, s + CHUNK)
                    x = unit_rows(np.asarray(batch.column(6).slice(s, e - s).flatten()), int(now[0]))
                    if not visit[s]:
                        block.add(ids[s:e], n[s:e], x)
                        continue
                    if open_:
                        if not block.ids:
                            continue
                        links, open_ = list(block.close()), False
                        if links:
                            yield rows([], [], links)
                    counts, links = block.visited(ids[s:e], n[s:e], x)
                    if counts is not None:
                        yield rows(ids[s:e], counts, links)
        if block is not None and block.ids:
            links = list(block.close()) if open_ else []
            yield rows(block.ids, block.links, links)

    return run


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block_rows: int = 4096, sample_rows: int = 8192, max_cells: int = 1024) -> DataFrame:
    """id_col, n_links, component_id, kept of every vector."""
    kind = vectors.schema[id_col].dataType
    # Single precision travels as it is; products are in double precision.
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    numbers = T.ArrayType(T.FloatType() if single else T.DoubleType())
    v = F.col("v")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(numbers).alias("v")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    keyed = rows.where("fine").select("id", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"), "v")
    classes = materialize(keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "vectors")
    total = classes.count()
    k = min(max_cells, max(-(-total // block_rows), 2))
    centres: dict[int, np.ndarray] = {}
    if total:
        sample = classes.orderBy("k1", "k2").limit(sample_rows).select("v").toArrow()
        for dim in np.unique(np.asarray(sample["v"].combine_chunks().value_lengths())) if sample.num_rows else []:
            lists = sample["v"].combine_chunks()
            x = unit_rows(np.asarray(lists.take(pa.array(np.nonzero(np.asarray(lists.value_lengths()) == dim)[0])).flatten()), int(dim))
            centres[int(dim)] = spherical_kmeans(x, min(k, len(x)))
    reach = math.sqrt(1 - cosine * cosine)
    shape = T.StructType([T.StructField("rep", kind), T.StructField("n", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("visit", T.BooleanType()), T.StructField("v", numbers)])
    base = classes.select("rep", "n", "v")
    homes = base.mapInArrow(_placed(centres, reach, True, shape.names), shape).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = homes.select(F.col("dim").alias("bdim"), F.col("cell").alias("bcell"), F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    placed = base.mapInArrow(_placed(centres, reach, False, shape.names), shape)
    placed = placed.join(blocks, (F.col("dim") == F.col("bdim")) & (F.col("cell") == F.col("bcell")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    to = F.when(F.col("blocks") == 0, F.array().cast("array<int>")).when(F.col("visit"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.sequence(own, F.col("blocks") - 1))
    dealt = placed.withColumn("own", F.when(F.col("blocks") > 0, own)).select("rep", "n", "dim", "cell", F.explode(to).alias("block"), "visit", "own", "v")
    dealt = dealt.select("rep", "n", "dim", "cell", "block", (F.col("visit") | (F.col("block") != F.col("own"))).alias("visit"), "v")
    result = T.StructType([T.StructField("rep", kind), T.StructField("links", T.LongType()), T.StructField("other", kind)])
    out = dealt.repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "visit").mapInArrow(_products(cosine, result.names), result)
    out = materialize(out, "products")
    parts = connected_components(out.where("other is not null"), "rep", "other")
    links = out.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "lrep")
    known = classes.select("k1", "k2", "rep", "n").join(links, F.col("rep") == F.col("lrep"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    keys = rows.select("id", F.when(F.col("fine"), F.xxhash64("v")).alias("k1"), F.when(F.col("fine"), F.xxhash64(F.lit(1), "v")).alias("k2"))
    joined = keys.join(known, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir):
    """Links and groups of every vector by cosine of at least 0.9."""
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON r.vec_id = l.a
), component AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM component c
"""
