"""Session defaults for local runs; a cluster's own settings always win."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; only where that is unset in local mode, below a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _OWN.setdefault("dir", _OWN.get("dir") or tempfile.mkdtemp(prefix="gaugewright-"))
    return f"{where.rstrip('/')}/gaugewright/{name}-{uuid.uuid4().hex}"


def local_session(app: str = "gaugewright", cores: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
