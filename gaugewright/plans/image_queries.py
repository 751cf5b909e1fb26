"""Queries for array kernels, over pictures made of embedding blocks, and for the streaming extension's batch side."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.operators import images as I
from gaugewright.operators.aggregates import overview
from gaugewright.plans.catalog import SCORES, Tables, query
from gaugewright.sources.sinks import json_rows
from gaugewright.streaming import metrics as M


def _pictures(t: Tables):
    """Twelve vectors of 64 numbers make a picture of 16 x 16 x 3."""
    v = t.embeddings.withColumn("picture", F.floor(F.col("vec_id") / 12).cast("long"))
    whole = v.groupBy("picture").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows")).where(F.size("rows") == 12)
    pixels = F.transform(F.flatten(F.transform("rows", lambda r: r["embedding"])), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-4.0 * x.cast("double"))))
    return whole.select("picture", F.lit(16).alias("height"), F.lit(16).alias("width"), pixels.alias("pixels"))


@query("i22_image_features")
def features(t: Tables):
    """Scalar features of pictures, without the codec probes (2.11, I22)."""
    return I.image_features(_pictures(t), ["picture"])


@query("i15_quality_vectors")
def quality(t: Tables):
    return I.quality_vectors(_pictures(t), ["picture"])


@query("i18_signal_profiles")
def profiles(t: Tables):
    """Radial and cosine profiles, a row per bin."""
    found = I.signal_profiles(_pictures(t), ["picture"])
    return I.profile_rows(found, ["picture"], "cosine_bands", "band", "energy_ratio")


@query("a31_band_medians")
def medians(t: Tables):
    """Median energy of each band."""
    found = I.signal_profiles(_pictures(t), ["picture"])
    return overview(I.profile_rows(found, ["picture"], "cosine_bands", "band", "energy_ratio"), ["band"], ["energy_ratio"])


@query(
    "k07_json_rows",
    f"""WITH {SCORES} SELECT '{{"doc_id":' || doc_id::VARCHAR || ',"target":' || target::VARCHAR || ',"source":"' || source || '"}}' AS value FROM scores""",
)
def rows_as_json(t: Tables):
    return json_rows(t.scores, ["doc_id", "target", "source"])


@query(
    "s14_windowed_confusion",
    """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS start, event_type, count_if(user_id % 2 = 1 AND value >= 50)::BIGINT AS tp, count_if(user_id % 2 = 0 AND value < 50)::BIGINT AS tn, count_if(user_id % 2 = 0 AND value >= 50)::BIGINT AS fp, count_if(user_id % 2 = 1 AND value < 50)::BIGINT AS fn FROM events GROUP BY ALL""",
)
def windowed(t: Tables):
    """The streaming extension's aggregate on a batch table (2.14)."""
    rows = t.events.withColumn("target", F.pmod("user_id", F.lit(2)).cast("int"))
    out = M.windowed_confusion(rows, ["event_type"], every="1 day", score="value", threshold=50.0)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "tp", "tn", "fp", "fn")
