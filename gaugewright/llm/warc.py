r"""WARC: write captures as request, response (or revisit) and metadata records, read archives, assemble transactions.

Writing: every capture becomes a response or revisit record, a request record and a metadata record; the latter two
name the first in WARC-Concurrent-To. Spark's text writer puts "\r\n\r\n" after each record, which is just what WARC asks
for, so archives go wherever Spark can write. Files are gzipped and hold at most ``records_per_file`` records.

Reading: each file is parsed by Content-Length, never by searching, so payloads may hold anything. Transaction assembly
groups the records by the id they are concurrent to and emits one nested row per capture.

Deduplication: of captures with equal payloads of at least ``min_revisit`` bytes, the one with the largest page_id
keeps the payload; the others become revisit records that refer to it. Ties of page_id (repeated rows) all keep it.

Defined cases: a null payload is an empty one; a null url is written as urn:unknown and read as null; CR and LF in urls
are percent-encoded; a null page_id is written as "null" and read as null, and never dedups others; repeated rows are
captures of their own; an empty table gives an empty archive and an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm.common import work_path

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"

RECORDS = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to_record", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def revisits(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """page_id, refers_to of the pages whose payload a page of larger id holds as well. Moves digests, not payloads."""
    seen = pages.select("page_id", _payload(F.col("html")).alias("p")).select("page_id", F.sha1("p").alias("digest"), F.octet_length("p").alias("bytes"))
    seen = seen.where((F.col("bytes") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "digest")
    last = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    return seen.join(last, "digest").where(F.col("page_id") < F.col("refers_to")).select("page_id", "refers_to").distinct()


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], mime: str, block: Column) -> Column:
    """A whole record but for the two newlines that end it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Record-ID: "), record_id, F.lit(CRLF))]
    lines += [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in headers]
    lines.append(F.concat(F.lit(f"Content-Type: {mime}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block))
    return F.concat(*lines)


def _urn(column: Column | str) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.col(column) if isinstance(column, str) else column, F.lit(">"))


def write_warc(pages: DataFrame, path: str, min_revisit: int = 1000, records_per_file: int = 6000) -> None:
    """Write page_id, url, html as gzipped archives under path."""
    again = revisits(pages, min_revisit).withColumnsRenamed({"page_id": "__gw_id"})
    rows = pages.select("page_id", "url", _payload(F.col("html")).alias("payload")).join(again, F.col("page_id") == F.col("__gw_id"), "left").drop("__gw_id")
    rows = rows.withColumns({"a": F.expr("uuid()"), "b": F.expr("uuid()"), "c": F.expr("uuid()")})
    uri = F.replace(F.replace(F.coalesce("url", F.lit("urn:unknown")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("refers_to").isNotNull()
    target = ("WARC-Target-URI", uri)
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload")))
    near = ("WARC-Concurrent-To", _urn("a"))
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    response = _record("response", _urn("a"), [target, digest], "application/http; msgtype=response", F.concat(status, F.col("payload")))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    again_record = _record("revisit", _urn("a"), [target, digest, profile], "application/http; msgtype=response", status)
    path_part = F.regexp_replace(uri, r"^[a-zA-Z]+://[^/]*", "")
    host = F.regexp_extract(uri, r"^[a-zA-Z]+://([^/]*)", 1)
    request = _record("request", _urn("b"), [target, near], "application/http; msgtype=request", F.concat(F.lit("GET "), path_part, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(CRLF + CRLF)))
    fields = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("\r\npayload-length: "), F.octet_length("payload").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nrefers-to-page: "), F.col("refers_to").cast("string"))).otherwise(F.lit("")), F.lit(CRLF),
    )
    metadata = _record("metadata", _urn("c"), [target, near], "application/warc-fields", fields)
    records = rows.select(F.explode(F.array(F.when(revisit, again_record).otherwise(response), request, metadata)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(data: bytes):
    """(headers, block) of each record in an archive's bytes, gzipped (one member or many) or plain."""
    if data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest:
            z = zlib.decompressobj(31)
            parts.append(z.decompress(rest))
            rest = z.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8").split(CRLF)
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _parsed(batches):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RECORDS)
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for headers, block in parse_records(content.as_py()):
                kind, fields, payload = headers["warc-type"], None, None
                if kind == "metadata":
                    fields = [(k, v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8").split(CRLF) if x)]
                elif kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    held += len(payload)
                rows.append((kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), headers.get("warc-payload-digest"), fields, payload))
                if held > 4_000_000 and kind != "response":
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record under path (RECORDS); a file is parsed in one piece, files are bounded by the writer."""
    return _files(spark, path).mapInArrow(_parsed, RECORDS)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")


RESPONSE = T.StructType([RECORDS[c] for c in ("type", "target_uri", "payload_digest", "refers_to_record", "payload")])
CAPTURES = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("response", RESPONSE),
        T.StructField("request", T.StructType([RECORDS["record_id"]])),
        T.StructField("metadata", T.StructType([RECORDS["record_id"], RECORDS["fields"]])),
    ]
)


def _transactions(whole: bool):
    """Joins what one file holds of each transaction; gives those that are whole, or those that lack a part."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(CAPTURES)
        for batch in _parsed(batches):
            found: dict[str, dict] = {}
            for r in batch.to_pylist():
                own = r["type"] in ("response", "revisit")
                one = found.setdefault(r["record_id"] if own else r["concurrent_to"] or r["record_id"], dict.fromkeys(CAPTURES.names))
                part = "response" if own else r["type"] if r["type"] in ("request", "metadata") else None
                if part and one[part] is None:
                    one[part] = {f.name: r[f.name] for f in CAPTURES[part].dataType}
            rows = [v | {"capture_id": k} for k, v in found.items() if whole == all(v[p] is not None for p in ("response", "request", "metadata"))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata, target_uri.

    Requests and metadata join their response or revisit by WARC-Concurrent-To. A transaction whose records lie
    together is joined where its file is parsed; the parts of the others meet in a shuffle. Records that are
    concurrent to nothing in the archive make a row of their own with a null response.
    """
    files = _files(spark, path)
    parts = [F.first(c, ignorenulls=True).alias(c) for c in ("response", "request", "metadata")]
    scattered = files.mapInArrow(_transactions(False), CAPTURES).groupBy("capture_id").agg(*parts)
    return files.mapInArrow(_transactions(True), CAPTURES).unionByName(scattered).withColumn("target_uri", F.nullif(F.col("response.target_uri"), F.lit("urn:unknown")))


def op2_warc(spark, sf_dir):
    """Writes every page to archives in the shared folder, reads them back and assembles the captures."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = work_path(spark, "warc")
    write_warc(pages, path)
    captures = read_captures(spark, path)
    field = lambda name: F.try_element_at("metadata.fields", F.lit(name))
    page_type = pages.schema["page_id"].dataType
    return captures.select(
        F.nullif(field("page-id"), F.lit("null")).cast(page_type).alias("page_id"),
        F.when(F.col("response.type") == "response", F.octet_length("response.payload")).otherwise(field("payload-length")).cast("long").alias("payload_bytes"),
        F.when(F.col("response.type") == "response", F.sha1("response.payload")).otherwise(F.substr("response.payload_digest", F.lit(6))).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("refers-to-page").cast(page_type).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""
