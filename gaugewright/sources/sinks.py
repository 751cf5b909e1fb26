"""Sinks: named tables, digests, submissions, reports, receipts."""

from __future__ import annotations

import hashlib
import html
import json
import math
import os
import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.functions.hashing import ordered_digest
from gaugewright.functions.scalars import finite_or
from gaugewright.operators.rules import RuleViolation, assert_clean


def write_tables(tables: Mapping[str, DataFrame], root: str, kind: str = "parquet") -> dict[str, str]:
    """Each named table below root, as Parquet or gzipped CSV (K01, K04, K05). Spark's commit protocol makes each atomic."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root}/{name}"
        writer = df.write.mode("overwrite")
        if kind == "csv":
            writer.option("header", True).option("compression", "gzip").csv(paths[name])
        else:
            writer.option("compression", "zstd").parquet(paths[name])
    return paths


def write_with_sidecar(df: DataFrame, path: str, columns: Sequence[str], more: Mapping | None = None) -> dict:
    """A table and a JSON row beside it: rows, order-free digest, what the caller adds."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.parquet(path)
    d = ordered_digest(back, list(columns)).first()
    record = {"rows": d["rows"], "sha256": d["digest"], **(more or {})}
    df.sparkSession.createDataFrame([(json.dumps(safe(record), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.json")
    return record


def write_after(rules: DataFrame, df: DataFrame, path: str) -> None:
    """Nothing is written unless the rules' violations table is empty; the check is an action of its own."""
    assert_clean(rules, path)
    df.write.mode("overwrite").parquet(path)


def safe(value):
    """NaN and infinities as null, all the way down."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, Mapping):
        return {str(k): safe(v) for k, v in value.items()}
    return [safe(v) for v in value] if isinstance(value, list | tuple) else value


def json_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON object per row, non-finite numbers null."""
    shown = [finite_or(F.col(c), None).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in columns]
    return df.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("value"))


def write_submission(df: DataFrame, path: str) -> None:
    """Objects of exactly image_path and pred, pred in [0, 1]."""
    if df.columns != ["image_path", "pred"]:
        raise RuleViolation("a submission has image_path and pred, in this order")
    bad = df.where(F.col("image_path").isNull() | ~F.coalesce(F.col("pred").between(0, 1), F.lit(False)))
    assert_clean(bad.select(F.lit("bad_row").alias("rule"), F.coalesce("image_path", F.lit("null")).alias("key"), F.lit("").alias("detail")), "submission")
    json_rows(df, df.columns).write.mode("overwrite").text(path)


def markdown(rows: Sequence[Mapping], columns: Sequence[str], digits: int = 4) -> str:
    """A table of report-sized rows."""
    show = lambda v: "n/a" if v is None or isinstance(v, float) and not math.isfinite(v) else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows]]) + "\n"


def markdown_report(tables: Mapping[str, DataFrame], limit: int = 200) -> str:
    """Sections of aggregated tables; each is read up to ``limit`` rows and says so if there are more."""
    parts = []
    for name, df in tables.items():
        rows = df.limit(limit + 1).collect()
        parts.append(f"## {name}\n\n" + markdown([r.asDict() for r in rows[:limit]], df.columns) + (f"\n(first {limit} rows)\n" if len(rows) > limit else ""))
    return "\n".join(parts)


def error_report(scores: DataFrame, groups: Sequence[str], title: str = "Errors", hardest: int = 20) -> str:
    """A self-contained HTML page: headline, group tables, histogram, hardest rows.

    scores: target, decision, score in [0, 1], and the group columns. Only aggregates and ``hardest`` rows are read.
    """
    from gaugewright.operators.aggregates import group_table, score_histogram

    right = F.col("target") == F.col("decision")
    head = scores.agg(F.count(F.lit(1)).alias("rows"), F.avg(right.cast("int").cast("double")).alias("accuracy"), F.count_if(~right).alias("errors")).first().asDict()
    cell = lambda v: html.escape("n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v))
    grid = lambda rows, columns: "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in columns) + "</tr>" for r in rows) + "</table>"
    parts = [f"<h1>{html.escape(title)}</h1>", grid([head], list(head))]
    for g in groups:
        t = group_table(scores, g)
        parts += [f"<h2>{html.escape(g)}</h2>", grid(t.limit(100).collect(), t.columns)]
    h = score_histogram(scores, "score", right)
    parts += ["<h2>scores</h2>", grid(h.orderBy("bin").collect(), h.columns)]
    worst = scores.where(~right).orderBy(F.abs(F.col("score") - 0.5).desc(), *groups).limit(hardest)
    parts += ["<h2>largest errors</h2>", grid(worst.collect(), worst.columns)]
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>" + html.escape(title) + "</title></head><body>" + "".join(parts) + "</body></html>"


def replace_file(path: str, text: str) -> None:
    """Write beside, then rename (K13); for small files of the driver."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        f.write(text)
    os.replace(temp, path)


def receipt(spark: SparkSession, path: str, record: Mapping) -> None:
    """A one-time mark through Spark's file system: a second call raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        raise RuleViolation(f"{path}: already opened")
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(safe(dict(record)), sort_keys=True).encode()))
    out.close()


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file of the driver through Spark's file system: written beside its place, then renamed."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    place, beside = Path(path), Path(f"{path}.tmp")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    out.write(bytearray(content))
    out.close()
    fs.delete(place, False)
    fs.rename(beside, place)


def changed_contents(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Violations: keys whose content differs from what was saved under them."""
    joined = new.select(key, F.col(digest).alias("new_")).join(old.select(key, F.col(digest).alias("old_")), key)
    return joined.where(F.col("old_") != F.col("new_")).select(F.lit("content_changed").alias("rule"), F.col(key).cast("string").alias("key"), F.concat_ws(" / ", "old_", "new_").alias("detail"))


def save_new(old: DataFrame, new: DataFrame, key: str, digest: str, path: str) -> None:
    """Append keys that aren't saved yet; a changed content raises before anything is written."""
    assert_clean(changed_contents(old, new, key, digest), path)
    new.join(old.select(key), key, "left_anti").write.mode("append").parquet(path)


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """Every double with null for NaN and infinities."""
    return df.withColumns({f.name: finite_or(F.col(f.name), None) for f in df.schema if isinstance(f.dataType, T.DoubleType)}) if any(isinstance(f.dataType, T.DoubleType) for f in df.schema) else df


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    """An optional column carried through where it is there."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
