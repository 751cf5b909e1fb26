"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

Defined cases: null and empty texts are one empty line and stay as they are; lines whose key has fewer than
``min_chars`` code points always stay; a row without id passes unchanged and counts as no document; rows that share
an id are one document; an empty table gives an empty result; further columns pass through untouched.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm.common import BLANKS, materialize, small_batches, utf8_views

KEY, LIST, LINES, DROPPED = "__gw_key", "__gw_drop", "n_lines", "n_dropped"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of the normalised line; None for one too short to count."""
    line = line.strip(BLANKS)
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.lower())  # bytes.lower() touches A-Z alone


def _keys(min_chars: int):
    def run(batches):
        for batch in batches:
            ids, rows, keys = batch.column(0), [], []
            for i, view in enumerate(utf8_views(batch.column(1))):
                if view is not None and len(view) >= min_chars:
                    found = {k for line in bytes(view).split(b"\n") if (k := line_key(line, min_chars))}
                    rows.extend([i] * len(found))
                    keys.extend(found)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary())], names=["id", KEY])

    return run


def _reassemble(min_chars: int, text_col: str):
    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(text_col)
            drops = batch.column(batch.num_columns - 1)
            texts, lines, dropped = [], [], []
            for i, view in enumerate(utf8_views(batch.column(at))):
                if view is None:
                    texts.append(None)
                    lines.append(1)
                    dropped.append(0)
                    continue
                raw = bytes(view)
                if not drops[i].is_valid:
                    texts.append(raw)
                    lines.append(raw.count(b"\n") + 1)
                    dropped.append(0)
                    continue
                gone = set(drops[i].as_py())
                every = raw.split(b"\n")
                kept = [x for x in every if line_key(x, min_chars) not in gone]
                texts.append(b"\n".join(kept))
                lines.append(len(every))
                dropped.append(len(every) - len(kept))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, pa.binary()).cast(batch.column(at).type)
            names = batch.schema.names[:-1] + [f"__gw_{LINES}", f"__gw_{DROPPED}"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs without the lines that at least ``min_docs`` documents hold, but for the smallest id's.

    Returns all columns of docs, text_col replaced, and ``n_lines`` (before) and ``n_dropped``; columns of those names
    that docs has are replaced. Each document's distinct keys are 16 bytes a row; they are counted with partial sums,
    so one very common line is a single row per task. Only the final join moves texts.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (LINES, DROPPED)]
    id_type = docs.schema[id_col].dataType
    keys = T.StructType([T.StructField("id", id_type), T.StructField(KEY, T.BinaryType())])
    held = materialize(docs.select(id_col, text_col).where(F.col(id_col).isNotNull()).mapInArrow(_keys(min_chars), keys).distinct(), "lines")
    shared = held.groupBy(KEY).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select(KEY, "first")
    shared = materialize(shared, "shared")  # so that both sides are exchanged for the join, and a hot key's rows can be split
    gone = held.join(shared, KEY).where(F.col("id") > F.col("first")).groupBy("id").agg(F.collect_list(KEY).alias(LIST)).withColumnRenamed("id", "__gw_id")
    joined = docs.select(*keep).join(gone, F.col(id_col) == F.col("__gw_id"), "left").select(*keep, LIST)
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"__gw_{LINES}", T.LongType()), T.StructField(f"__gw_{DROPPED}", T.LongType())])
    done = joined.mapInArrow(_reassemble(min_chars, text_col), out)
    return done.withColumnsRenamed({f"__gw_{LINES}": LINES, f"__gw_{DROPPED}": DROPPED})


def op3_line_dedup(spark, sf_dir):
    """The contract's digest of every document after line dedup."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT d.doc_id, d.pos, d.line, s.first IS NOT NULL AND d.doc_id > s.first AS gone FROM keyed d LEFT JOIN shared s ON d.k = s.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
