"""What the operators share: the working folder, materialised steps, Arrow batches as bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that the contracts call white space: [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (tests), a temporary folder of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="gaugewright-")
        where = _OWN["dir"]
    return where.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gaugewright/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._work_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete materialised steps that nothing lazy reads any more."""
    for df in frames:
        remove_path(df.sparkSession, df._work_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a work folder through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows for this session, unless it has been set below: a batch of whole documents
    is held several times over, by the executor and by its Python workers.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def utf8_views(column: pa.Array) -> Iterator[memoryview | None]:
    """The UTF-8 bytes of each string, without copies; None for null."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.offset or column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
    else:
        valid = None
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    view = memoryview(data) if data is not None else memoryview(b"")
    for i in range(len(column)):
        yield None if valid is not None and not valid[i] else view[at[i] : at[i + 1]]


def crc32_mod3(doc_id="doc_id"):
    """crc32(doc_id as text) mod 3; 1 marks the held-out third."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
