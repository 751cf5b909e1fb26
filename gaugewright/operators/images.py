"""Feature extraction over image columns: height int, width int, pixels array<double> (RGB in [0, 1], row by row).

Records are expanded by conditions and views lazily, then each row goes through one Arrow-fed pass of NumPy kernels; no
image copy is ever shuffled or stored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.functions import kernels as K
from gaugewright.functions.codecs import analysis_view, apply_recipe

D = T.DoubleType()


def _pixels(batch: pa.RecordBatch):
    """(row, RGB array) of each row; columns height, width, pixels come first."""
    heights, widths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    lists = batch.column(2)
    for i, (h, w) in enumerate(zip(heights, widths, strict=True)):
        yield i, np.asarray(lists[i].values, np.float64).reshape(h, w, 3)


def _mapped(df: DataFrame, keep: Sequence[str], fields: list[T.StructField], compute, height: str, width: str, pixels: str, extra: Sequence[str] = ()) -> DataFrame:
    """keep and the struct fields that compute(rgb, {column: value}) gives for each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*keep, *[f.name for f in fields]]

    def run(batches):
        for batch in batches:
            rest = batch.select(list(range(3, batch.num_columns))).to_pylist()
            found = [compute(rgb, rest[i]) for i, rgb in _pixels(batch)]
            own = [batch.column(3 + k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)]], names=names)

    schema = T.StructType([*[df.schema[c] for c in keep], *fields])
    more = [c for c in extra if c not in keep]
    return df.select(height, width, pixels, *keep, *more).mapInArrow(run, schema)


def image_features(df: DataFrame, keep: Sequence[str], profile: str = "expanded_v2", codecs: bool = False, height: str = "height", width: str = "width", pixels: str = "pixels", metadata: Sequence[str] = ()) -> DataFrame:
    """keep and one double per feature of the profile; the four codec probes only with ``codecs``."""
    names = [n for n in K.profile(profile) if codecs or K.FEATURES[n][0] != "self_consistency"]
    compute = lambda rgb, row: list(K.extract(rgb, {k: v for k, v in row.items() if v is not None}, names).values())
    return _mapped(df, keep, [T.StructField(n, D) for n in names], compute, height, width, pixels, metadata)


def quality_vectors(df: DataFrame, keep: Sequence[str], height: str = "height", width: str = "width", pixels: str = "pixels") -> DataFrame:
    """keep, q_log_min, q_noise, q_block, q_hf."""
    return _mapped(df, keep, [T.StructField(n, D) for n in ("q_log_min", "q_noise", "q_block", "q_hf")], lambda rgb, row: K.quality_vector(rgb @ K.LUMA), height, width, pixels)


def signal_profiles(df: DataFrame, keep: Sequence[str], height: str = "height", width: str = "width", pixels: str = "pixels") -> DataFrame:
    """keep, scalar map, radial profile and cosine bands of each picture."""
    fields = [T.StructField("scalars", T.MapType(T.StringType(), D)), T.StructField("radial", T.ArrayType(D)), T.StructField("cosine_bands", T.ArrayType(D))]

    def compute(rgb, row):
        luma = rgb @ K.LUMA
        a, radial = K.spectrum_profile(luma)
        b, bands = K.cosine_profile(luma)
        return list((a | b | K.patch_noise(luma)).items()), [r[2] for r in radial], [r[1] for r in bands]

    return _mapped(df, keep, fields, compute, height, width, pixels)


def profile_rows(profiles: DataFrame, keep: Sequence[str], column: str, position: str, value: str) -> DataFrame:
    """One row per position of a profile (A31's input)."""
    return profiles.select(*keep, F.posexplode(column).alias(position, value))


def endpoints(records: DataFrame, conditions: DataFrame, views: Sequence[str] = ("canonical_128", "native_capped")) -> DataFrame:
    """Records x conditions x views, lazily (J25, J26, I22). conditions: name, family, official, ordered_recipe_json - registry-sized."""
    return records.crossJoin(F.broadcast(conditions.select(F.col("name").alias("condition"), F.col("family").alias("transform_family"), F.col("official").alias("official_transform"), "ordered_recipe_json"))).withColumn("view", F.explode(F.array(*[F.lit(v) for v in views])))


def extracted(rows: DataFrame, keep: Sequence[str], base_seed: int, parent: str = "parent_id", profile: str = "expanded_v2") -> DataFrame:
    """Features of every endpoint: recipe, view, kernels in one pass (I08, I09, I22). Codec steps need the image library."""
    names = K.profile(profile)

    def compute(rgb, row):
        changed = apply_recipe(rgb, json.loads(row["ordered_recipe_json"]), str(row[parent]), base_seed)
        return list(K.extract(analysis_view(changed, row["view"]), row, names).values())

    return _mapped(rows, keep, [T.StructField(n, D) for n in names], compute, "height", "width", "pixels", [parent, "view", "ordered_recipe_json"])


def feature_registry(spark) -> DataFrame:
    """name, family, role, profile of every feature."""
    first = set(K.profile("frozen_v1"))
    rows = [(n, f, "nuisance" if f == "nuisance" else "candidate", "frozen_v1" if n in first else "expanded_v2") for n, (f, _) in K.FEATURES.items()]
    return spark.createDataFrame(rows, "name string, family string, role string, profile string")


def views_pending(df: DataFrame) -> DataFrame:
    """Pictures below 16 pixels a side, which only the image library can enlarge."""
    return df.where(F.least("height", "width") < 16)
