"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

Every document becomes ``STATISTICS`` numbers. They are standardised with the training rows' means and deviations, and
``features`` cosines of random projections approximate a Gaussian kernel on them; the standardised statistics and a
constant are features too. Each task sums its part of the normal equations, the parts are summed by row of the matrix,
and the driver solves one system of fixed size. The ridge score is calibrated by pooling adjacent violators over
``BINS`` bins of the training rows' scores, so what the driver gets never grows with the data.

Defined cases: null and empty texts have statistics of zero and are scored like any other; labels that are null or
belong to no document are skipped; a document with several labels counts once for each; without any usable label every
score is 0.5; texts of any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm.common import crc32_mod3, discard, materialize, small_batches, utf8_views

#: Sizes and lengths; shares of bytes by class; lines, their repetition and how many end a sentence; variety of words; the
#: commonest letter of European prose; marks of markup, tables and garbled text; short and long words; entropy; punctuation.
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_spread", "lower", "upper", "digit", "blank", "mark", "high",
    "log_lines", "line_bytes", "repeated_lines", "distinct_words", "letter_e", "odd_marks", "bars", "ended_lines",
    "short_words", "long_words", "byte_entropy", "marked_words", "stops", "commas",
)
BINS = 2000
LOW, HIGH = -0.5, 1.5

_CLASS = np.full(256, 4, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[128:] = 5
_ODD = np.frombuffer(b"#$%&*@^~<>{}[]\\=+_`", np.uint8)


def statistics(raw: bytes) -> np.ndarray:
    """The statistics of one text, in the order of STATISTICS."""
    out = np.zeros(len(STATISTICS), np.float64)
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    n = len(data)
    share = np.bincount(_CLASS, weights=counts, minlength=6) / n
    words = raw.split()
    lines = raw.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    p = counts[counts > 0] / n
    w = max(1, len(words))
    distinct = set(words)
    filled = [x for x in lines if x.strip()]
    out[:] = (
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), share[0], share[1], share[2], share[3], share[4], share[5],
        np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(filled)) / max(1, len(filled)), len(distinct) / w,
        counts[ord("e")] / n, counts[_ODD].sum() / n, counts[ord("|")] / n, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in filled) / max(1, len(filled)),
        (sizes <= 2).mean(), (sizes >= 12).mean(), float(-(p * np.log2(p)).sum()), sum(x[-1] in b"#$%&*" for x in words) / w,
        counts[ord(".")] / w, counts[ord(",")] / w,
    )
    return out


def _statistics(batches):
    for batch in batches:
        rows = [statistics(bytes(v or b"")) for v in utf8_views(batch.column(1))]
        flat = pa.array(np.concatenate(rows) if rows else np.empty(0), pa.float64())
        ends = pa.array(np.arange(0, (len(rows) + 1) * len(STATISTICS), len(STATISTICS)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, x: array<double> of STATISTICS."""
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return docs.select(id_col, text_col).mapInArrow(_statistics, schema)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.projection + self.phase)
        return np.hstack((waves, z, np.ones((len(x), 1))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def pooled(at: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: places and values of its blocks."""
    blocks: list[list[float]] = []
    for x, p, n in zip(at.tolist(), positives.tolist(), counts.tolist(), strict=True):
        blocks.append([x * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(batches) -> np.ndarray:
    return np.concatenate([np.asarray(b.column("x").flatten()).reshape(-1, len(STATISTICS)) for b in batches])


def _partial(model: QualityModel):
    """(r, row): this task's share of the normal equations, one row for each feature; the last entry is the target's."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                a = model.design(_matrix([batch]))
                y = np.asarray(batch.column("y").to_numpy(zero_copy_only=False), np.float64)
                part = a.T @ np.column_stack((a, y))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["r", "row"])

    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"r": pdf["r"].iloc[:1], "row": [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)]})


def _binned(model: QualityModel):
    def run(batches):
        for batch in batches:
            raw = model.raw(_matrix([batch])) if batch.num_rows else np.empty(0)
            bins = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int32)), batch.column("y").cast(pa.int32())], names=["bin", "y"])

    return run


def _scores(model: QualityModel):
    def run(batches):
        for batch in batches:
            score = model.score(_matrix([batch])) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=[batch.schema.names[0], "score"])

    return run


def fit_quality(train: DataFrame, features: int = 256, ridge: float = 1e-3, width: float = 4.0, seed: int = 7) -> QualityModel:
    """train: x (array<double> of STATISTICS), y (0 or 1). ``width`` is the Gaussian kernel's, in deviations."""
    d = len(STATISTICS)
    ask = [f(F.col("x")[k]).alias(f"{n}{k}") for k in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = train.agg(F.count(F.lit(1)).alias("n"), *ask).first()
    rng = np.random.default_rng(seed)
    projection, phase = rng.normal(0, 1 / width, (d, features)), rng.uniform(0, 2 * np.pi, features)
    if not got["n"]:
        return QualityModel(np.zeros(d), np.ones(d), projection, phase, np.zeros(features + d + 1), (np.array([0.0]), np.array([0.5])))
    mean = np.array([got[f"m{k}"] for k in range(d)])
    scale = np.array([got[f"s{k}"] for k in range(d)])
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), projection, phase, np.zeros(features + d + 1), (np.array([0.0]), np.array([0.5])))
    sums = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))])
    rows = train.mapInArrow(_partial(model), sums).groupBy("r").applyInPandas(_summed, sums).collect()
    normal = np.zeros((features + d + 1, features + d + 2))
    for r in rows:
        normal[r["r"]] = r["row"]
    penalty = ridge * got["n"] * np.eye(len(normal))
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(normal[:, :-1] + penalty + 1e-9 * np.eye(len(normal)), normal[:, -1])
    bins = train.mapInArrow(_binned(model), T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("y", T.IntegerType())]))
    table = bins.groupBy("bin").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    at = LOW + (np.array([r["bin"] for r in table]) + 0.5) * (HIGH - LOW) / BINS
    model.knots = pooled(at, np.array([float(r["p"]) for r in table]), np.array([float(r["n"]) for r in table]))
    return model


def score_quality(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """id_col, score in [0, 1]."""
    return stats.select(id_col, "x").mapInArrow(_scores(model), T.StructType([stats.schema[id_col], T.StructField("score", T.DoubleType())]))


def op8_quality(spark, sf_dir):
    """Quality score of every document, learned from the labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("quality").isin(0, 1)).where(crc32_mod3() != 1).select("doc_id", F.col("quality").cast("int").alias("y"))
    stats = materialize(document_statistics(docs), "statistics")
    train = materialize(stats.join(labels, "doc_id").select("x", "y"), "train")
    model = fit_quality(train)
    discard(train)
    out = score_quality(stats, model)
    return out.select("doc_id", (crc32_mod3() == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
