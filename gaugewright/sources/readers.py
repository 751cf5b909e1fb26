"""Sources: declared schemas, adapter registry, dataset specs, folders, archives, shards."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.functions.hashing import derived_parent_id
from gaugewright.functions.scalars import IMAGE_SUFFIXES, file_name, is_image_member, phase_of_split
from gaugewright.operators.rules import INDEX_COLUMNS, RuleViolation, assert_clean, evaluation_record_rules, require_columns

_TYPES = {"target": T.IntegerType(), "width": T.IntegerType(), "height": T.IntegerType(), "bytes": T.LongType()}
INDEX_SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in INDEX_COLUMNS])
CANONICAL = ("dataset_id", "parent_id", "lineage_id", "image_path", "target", "generator_family", "generation_model", "source_dataset", "authentic_subtype")


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names alone."""
    return spark.read.option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV, plain or gzipped, with a declared schema (all strings otherwise) and pruned columns."""
    names = header(spark, path)
    types = {f.name: f.dataType for f in schema} if schema is not None else {}
    full = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    df = spark.read.schema(full).option("header", True).csv(path)
    return df if columns is None else df.select(*columns)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index by its header: an expansion selection as it is, a legacy one with derived parent, target and phase."""
    df = read_csv(spark, path, INDEX_SCHEMA)
    if {"parent_id", "target", "phase"} <= set(df.columns):
        return df
    target = F.when(F.lower("label").isin("aigc", "generated", "fake"), 1).when(F.lower("label").isin("authentic", "real"), 0)
    return df.withColumns({"parent_id": derived_parent_id(F.col("dataset"), F.col("local_path")), "target": target, "phase": phase_of_split(F.col("split"))}).where(F.col("target").isNotNull())


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """The table, or one without rows where nothing is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).format(kind).load(path) if there else spark.createDataFrame([], schema)


@dataclass(frozen=True)
class DatasetSpec:
    """A declared dataset."""

    dataset_id: str
    adapter: str
    root: str = ""
    manifest: str = ""
    columns: Mapping[str, str] = field(default_factory=dict)
    filters: Mapping[str, Sequence[str]] = field(default_factory=dict)
    label_map: Mapping[str, int] = field(default_factory=dict)
    value_maps: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    classes: Mapping[str, int] = field(default_factory=dict)
    class_metadata: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    expected_counts: Mapping[str, int] = field(default_factory=dict)
    expected_rows: int | None = None
    expected_target_counts: Mapping[str, int] = field(default_factory=dict)


def load_spec(path: str) -> DatasetSpec:
    """A spec from JSON; unknown adapters and bad maps are errors."""
    with open(path) as f:
        raw = json.load(f)
    if raw.get("schema_version") != 1:
        raise RuleViolation(f"{path}: schema_version isn't 1")
    known = {k: raw[k] for k in DatasetSpec.__dataclass_fields__ if k in raw}
    if not known.get("dataset_id") or known.get("adapter") not in ADAPTERS:
        raise RuleViolation(f"{path}: needs a dataset_id and one of the adapters {', '.join(adapters())}")
    return DatasetSpec(**known)


ADAPTERS: dict[str, Callable[[SparkSession, DatasetSpec], DataFrame]] = {}


def adapter(name: str):
    """Register a source adapter."""

    def put(f):
        if name in ADAPTERS:
            raise ValueError(f"there is an adapter {name} already")
        ADAPTERS[name] = f
        return f

    return put


def adapters() -> tuple[str, ...]:
    return tuple(sorted(ADAPTERS))


def mapped_targets(label: Column, labels: Mapping[str, int]) -> Column:
    """Targets by label; an unmapped one is an error."""
    out = F.lit(None).cast("int")
    for k, v in labels.items():
        out = F.when(label.cast("string") == F.lit(k), F.lit(int(v))).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("no target for label "), F.coalesce(label.cast("string"), F.lit("null")))).cast("int"))


def remapped(value: Column, mapping: Mapping[str, str]) -> Column:
    """Values replaced by a map."""
    out = value
    for k, v in mapping.items():
        out = F.when(value == F.lit(k), F.lit(v)).otherwise(out)
    return out


def canonical(df: DataFrame, dataset_id: str) -> DataFrame:
    """The canonical columns, with defaults that depend on the class."""
    have = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    made = F.col("target") == 1
    path = F.col("image_path")
    parent = F.coalesce(have("parent_id"), derived_parent_id(F.lit(dataset_id), path))
    return df.select(
        F.lit(dataset_id).alias("dataset_id"), parent.alias("parent_id"), F.coalesce(have("lineage_id"), parent).alias("lineage_id"), path, F.col("target").cast("int").alias("target"),
        F.coalesce(have("generator_family"), F.when(made, "unknown").otherwise("authentic")).alias("generator_family"), F.coalesce(have("generation_model"), F.when(made, "unknown").otherwise("none")).alias("generation_model"),
        F.coalesce(have("source_dataset"), F.lit(dataset_id)).alias("source_dataset"), F.coalesce(have("authentic_subtype"), F.when(made, "none").otherwise("authentic")).alias("authentic_subtype"),
    )


@adapter("csv")
def csv_records(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """Mapped, filtered, relabelled CSV rows."""
    raw = read_csv(spark, f"{spec.root}/{spec.manifest}" if spec.root else spec.manifest)
    require_columns(raw, [*spec.columns.values(), *spec.filters])
    for c, values in spec.filters.items():
        raw = raw.where(F.col(c).isin(*values))
    df = raw.select(*[remapped(F.col(src), spec.value_maps.get(dst, {})).alias(dst) for dst, src in spec.columns.items()])
    label = "label" if "label" in df.columns else "target"
    return canonical(df.withColumn("target", mapped_targets(F.col(label), spec.label_map)), spec.dataset_id)


def _classed(df: DataFrame, spec: DatasetSpec, member: Column) -> DataFrame:
    """Rows of the declared classes: their target and metadata; counts are checked."""
    hit = F.lit(None).cast("string")
    for name in spec.classes:
        hit = F.when(member.startswith(f"{name}/") | member.contains(f"/{name}/"), F.lit(name)).otherwise(hit)
    out = df.withColumn("class_", hit).where(F.col("class_").isNotNull())
    target = F.lit(None).cast("int")
    for name, t in spec.classes.items():
        target = F.when(F.col("class_") == name, F.lit(int(t))).otherwise(target)
    out = out.withColumn("target", target)
    for c in ("generator_family", "generation_model", "source_dataset", "authentic_subtype"):
        value = F.lit(None).cast("string")
        for name, meta in spec.class_metadata.items():
            if c in meta:
                value = F.when(F.col("class_") == name, F.lit(meta[c])).otherwise(value)
        out = out.withColumn(c, value)
    if spec.expected_counts:
        found = {r["class_"]: r["count"] for r in out.groupBy("class_").count().collect()}
        wrong = {k: (v, found.get(k, 0)) for k, v in spec.expected_counts.items() if found.get(k, 0) != v}
        if wrong:
            raise RuleViolation(f"{spec.dataset_id}: class counts {wrong}")
    return out


@adapter("class_folders")
def class_folder_records(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """Image files below class folders; contents are never read."""
    files = list_files(spark, spec.root, recursive=True)
    member = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    return canonical(_classed(files.where(is_image_member(F.col("path"))), spec, member).withColumnRenamed("path", "image_path"), spec.dataset_id)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, bytes, compressed of every archive's central directory."""
    schema = "archive string, member string, bytes long, compressed long"

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    rows = [(name, i.filename, i.file_size, i.compress_size) for i in z.infolist()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["archive", "member", "bytes", "compressed"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, schema)


def zip_payloads(spark: SparkSession, path: str, members: Column | None = None) -> DataFrame:
    """archive, member, content of the image members."""
    schema = "archive string, member string, content binary"

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i.filename]), pa.array([z.read(i)], pa.binary())], names=["archive", "member", "content"])

    out = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, schema).where(is_image_member(F.col("member")))
    return out if members is None else out.where(members)


@adapter("zip_class_folders")
def zip_records(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """Image members of archives by class folder; equal members in two archives are an error."""
    found = zip_members(spark, spec.root).where(is_image_member(F.col("member")))
    twice = found.groupBy("member").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise RuleViolation(f"{spec.dataset_id}: {twice[0]['member']} is in several archives")
    return canonical(_classed(found, spec, F.col("member")).withColumn("image_path", F.concat_ws("!", "archive", "member")), spec.dataset_id)


def load_datasets(spark: SparkSession, specs: Sequence[DatasetSpec]) -> DataFrame:
    """All datasets as one table: unique ids, expected rows and targets, validated."""
    ids = [s.dataset_id for s in specs]
    if len(set(ids)) != len(ids):
        raise RuleViolation("dataset ids repeat")
    out = None
    for spec in specs:
        part = ADAPTERS[spec.adapter](spark, spec)
        if spec.expected_rows is not None or spec.expected_target_counts:
            counts = {str(r["target"]): r["count"] for r in part.groupBy("target").count().collect()}
            if spec.expected_rows is not None and sum(counts.values()) != spec.expected_rows:
                raise RuleViolation(f"{spec.dataset_id}: {sum(counts.values())} rows, {spec.expected_rows} expected")
            if any(counts.get(str(k), 0) != v for k, v in spec.expected_target_counts.items()):
                raise RuleViolation(f"{spec.dataset_id}: target counts {counts}")
        out = part if out is None else out.unionByName(part)
    assert_clean(evaluation_record_rules(out), "evaluation records")
    return out


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, bytes of the files below a folder, sorted by readers of the result."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", F.col("length").alias("bytes"))


def image_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return list_files(spark, path, recursive).where(is_image_member(F.col("path"))).orderBy("path")


def image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, bytes of decodable images."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"))
    plain = lambda c: F.regexp_replace(c, r"^[a-z]+:/*", "/")
    sizes = list_files(spark, path).select(plain(F.col("path")).alias("p"), "bytes")
    return images.join(sizes, plain(F.col("origin")) == F.col("p")).select(F.col("p").alias("path"), "width", "height", "channels", "bytes", F.upper(F.regexp_extract(file_name(F.col("p")), r"\.([^.]*)$", 1)).alias("format"))


SHARD = ("sample_id string, model string, condition string, probability_ai double, threshold double, decision int, condition_parameters map<string,string>")


def prediction_shards(spark: SparkSession, root: str, pattern: str = "*/*.jsonl") -> DataFrame:
    """JSON-lines shards per model and condition, missing ones skipped, with their file."""
    return spark.read.schema(SHARD).option("ignoreMissingFiles", True).option("pathGlobFilter", pattern.rsplit("/", 1)[-1]).option("recursiveFileLookup", True).json(root).withColumn("shard", F.input_file_name())


def manifest_samples(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The samples array of a nested JSON manifest."""
    doc = T.StructType([T.StructField("samples", T.ArrayType(schema))])
    return spark.read.schema(doc).option("multiLine", True).json(path).select(F.explode("samples").alias("s")).select("s.*")


def aligned_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name, missing columns null."""
    return a.unionByName(b, allowMissingColumns=True)


def suffixes() -> tuple[str, ...]:
    return IMAGE_SUFFIXES
