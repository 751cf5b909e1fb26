"""Queries that write a source or sink to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.operators.rules import RuleViolation
from gaugewright.plans.catalog import ENDPOINTS, Tables, query
from gaugewright.session import shared_folder
from gaugewright.sources import readers as R
from gaugewright.sources import sinks as W


def _csv(t: Tables, df, name: str) -> str:
    return W.write_tables({name: df}, shared_folder(t.spark, "io"), "csv")[name]


@query("s03_csv_round_trip", "SELECT p_partkey, p_size::BIGINT AS p_size, round(p_retailprice, 6) AS p_retailprice FROM part")
def csv_round_trip(t: Tables):
    """Gzipped CSV, declared types, pruned columns."""
    path = _csv(t, t.part, "part")
    return R.read_csv(t.spark, path, t.part.schema, ["p_partkey", "p_size", "p_retailprice"])


@query("s02_csv_header", "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS name, unnest([0, 1, 2])::BIGINT AS place")
def csv_header(t: Tables):
    """Column names without rows."""
    names = R.header(t.spark, _csv(t, t.nation, "nation"))
    return t.spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, place int")


@query(
    "s01_index_dispatch",
    """SELECT 'documents-' || substr(sha256('documents:' || source || '/' || doc_id::VARCHAR), 1, 20) AS parent_id, source || '/' || doc_id::VARCHAR AS local_path, CASE WHEN lang = 'en' THEN 1 ELSE 0 END::BIGINT AS target, CASE WHEN doc_id % 3 = 0 THEN 'confirmation' ELSE 'discovery' END AS phase FROM documents WHERE lang IN ('en', 'de')""",
)
def index_dispatch(t: Tables):
    """A legacy index by its header: parents, targets and phases are derived, other labels left out."""
    d = t.documents
    label = F.when(F.col("lang") == "en", "AIGC").when(F.col("lang") == "de", "Real").otherwise("other")
    split = F.when(F.pmod("doc_id", F.lit(3)) == 0, "Validation_1").otherwise("train_full")
    legacy = d.select(F.lit("documents").alias("dataset"), split.alias("split"), label.alias("label"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("local_path"))
    return R.read_index(t.spark, _csv(t, legacy, "index")).select("parent_id", "local_path", "target", "phase")


@query("s05_optional_table", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def optional_table(t: Tables):
    """A table that isn't there has no rows."""
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())])
    absent = R.read_or_empty(t.spark, shared_folder(t.spark, "absent"), schema)
    there = R.read_or_empty(t.spark, W.write_tables({"nation": t.nation.select("n_nationkey", "n_name")}, shared_folder(t.spark, "io"))["nation"], schema)
    return absent.unionByName(there)


@query(
    "s08_csv_adapter",
    """SELECT 'docs' AS dataset_id, doc_id::VARCHAR AS parent_id, source || '/' || doc_id::VARCHAR AS image_path, CASE WHEN lang = 'en' THEN 1 ELSE 0 END::BIGINT AS target, CASE WHEN source = 'src1' THEN 'first' ELSE source END AS generation_model FROM documents WHERE lang IN ('en', 'fr')""",
)
def csv_adapter(t: Tables):
    """A declared dataset through the registry: mapped, filtered, relabelled, counted, validated."""
    path = _csv(t, t.documents.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "lang", F.col("source").alias("gen")), "manifest")
    root, manifest = path.rsplit("/", 1)
    columns = {"parent_id": "id", "image_path": "path", "label": "lang", "generation_model": "gen"}
    rows = t.documents.where(F.col("lang").isin("en", "fr")).count()
    spec = R.DatasetSpec("docs", "csv", root, manifest, columns=columns, filters={"lang": ["en", "fr"]}, label_map={"en": 1, "fr": 0}, value_maps={"generation_model": {"src1": "first"}}, expected_rows=rows)
    return R.load_datasets(t.spark, [spec]).select("dataset_id", "parent_id", "image_path", "target", "generation_model")


@query("s13_image_listing", "SELECT n_regionkey::VARCHAR || '/' || n_nationkey::VARCHAR || '.png' AS path, octet_length(encode(n_name))::BIGINT AS bytes, sha256(n_name) AS sha256, CASE WHEN n_regionkey = 0 THEN 0 WHEN n_regionkey = 1 THEN 1 END::BIGINT AS target FROM nation")
def image_listing(t: Tables):
    """Image files of class folders: sorted listing, digests, targets of the declared classes."""
    from gaugewright.functions.hashing import file_digest

    root = shared_folder(t.spark, "images")
    for r in t.nation.collect():  # a table of 25 rows
        W.put_file(t.spark, f"{root}/{r['n_regionkey']}/{r['n_nationkey']}.png", r["n_name"].encode())
        W.put_file(t.spark, f"{root}/{r['n_regionkey']}/{r['n_nationkey']}.txt", b"no image")
    short = lambda c: F.regexp_extract(c, "([^/]+/[^/]+)$", 1)
    files = R.image_files(t.spark, root).select(short(F.col("path")).alias("path"), "bytes")
    digests = file_digest(t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)).select(short(F.col("path")).alias("path"), "sha256")
    classed = R.load_datasets(t.spark, [R.DatasetSpec("tree", "class_folders", root, classes={"0": 0, "1": 1})]).select(short(F.col("image_path")).alias("path"), "target")
    return files.join(digests, "path").join(classed, "path", "left")


@query(
    "s10_archive_members",
    "SELECT n_regionkey::VARCHAR || '/' || n_name || '.png' AS member, octet_length(encode(n_name))::BIGINT AS bytes, n_name AS content FROM nation",
)
def archive_members(t: Tables):
    """Members of archives by their central directories, and their contents."""
    import io
    import zipfile

    root, held = shared_folder(t.spark, "archives"), {}
    for r in t.nation.orderBy("n_nationkey").collect():  # a table of 25 rows
        held.setdefault(r["n_regionkey"], []).append(r["n_name"])
    for region, names in held.items():
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(f"{region}/{n}.png", n)
            z.writestr(f"__MACOSX/{region}/x.png", "no image")
        W.put_file(t.spark, f"{root}/{region}.zip", raw.getvalue())
    content = R.zip_payloads(t.spark, root).select("member", F.col("content").cast("string").alias("content"))
    return R.zip_members(t.spark, root).select("member", "bytes").join(content, "member")


@query(
    "s19_prediction_shards",
    f"WITH {ENDPOINTS} SELECT parent_id AS sample_id, dataset_id AS model, condition, round(1 / (1 + exp(-logit / 1000)), 6) AS probability_ai, 0.5::DOUBLE AS threshold, (logit >= 0)::BIGINT AS decision FROM endpoints",
)
def prediction_shards(t: Tables):
    """JSON-lines shards by model and condition."""
    root = shared_folder(t.spark, "shards")
    rows = t.endpoints.select(F.col("parent_id").alias("sample_id"), F.col("dataset_id").alias("model"), "condition", (1.0 / (1.0 + F.exp(-F.col("logit") / 1000.0))).alias("probability_ai"), F.lit(0.5).alias("threshold"), (F.col("logit") >= 0).cast("int").alias("decision"))
    rows.withColumns({"m": F.col("model"), "c": F.col("condition")}).write.partitionBy("m", "c").json(root)
    return R.prediction_shards(t.spark, root, "*.json").select(*rows.columns)


@query("s20_manifest_samples", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def nested_manifest(t: Tables):
    """The samples array of one JSON document."""
    path = f"{shared_folder(t.spark, 'manifest')}/manifest.json"
    document = t.nation.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(F.struct("n_nationkey", "n_name")).alias("samples"))).alias("j")).first()["j"]
    W.put_file(t.spark, path, document.encode())
    return R.manifest_samples(t.spark, path, T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())]))


@query("s21_index_union", "SELECT p_partkey AS id, p_name AS name, NULL::BIGINT AS nation FROM part UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def index_union(t: Tables):
    """Two indexes of different columns, each written and read."""
    root = shared_folder(t.spark, "io")
    paths = W.write_tables({"a": t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "b": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))}, root)
    return R.aligned_union(t.spark.read.parquet(paths["a"]), t.spark.read.parquet(paths["b"]))


@query(
    "k02_sidecar",
    """WITH h AS (SELECT sha256(doc_id::VARCHAR || chr(0) || lang) AS h FROM documents), r AS (SELECT substr(h, 1, 3) AS r, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1), d AS (SELECT sha256(string_agg(d, chr(10) ORDER BY r)) AS digest, sum(n)::BIGINT AS rows FROM r) SELECT '{"rows": ' || rows::VARCHAR || ', "sha256": "' || digest || '", "source": "documents"}' AS value FROM d""",
)
def sidecar(t: Tables):
    """The JSON record beside a table: rows and digest."""
    path = f"{shared_folder(t.spark, 'io')}/selection"
    W.write_with_sidecar(t.documents.select("doc_id", "lang"), path, ["doc_id", "lang"], {"source": "documents"})
    return t.spark.read.text(f"{path}.json")


@query("k04_named_tables", "SELECT 'nation' AS name, count(*)::BIGINT AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def named_tables(t: Tables):
    """Several named tables below one root, written twice: each replaces the one before."""
    tables, root = {"nation": t.nation, "region": t.region, "supplier": t.supplier}, shared_folder(t.spark, "io")
    W.write_tables(tables, root)
    paths = W.write_tables(tables, root)
    parts = [t.spark.read.parquet(p).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, p in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k06_submission", """SELECT '{"image_path":"' || doc_id::VARCHAR || '.png","pred":' || CASE WHEN quality = 1 THEN '0.75' ELSE '0.25' END || '}' AS value FROM labels""")
def submission(t: Tables):
    """Objects of exactly image_path and pred."""
    path = shared_folder(t.spark, "submission")
    W.write_submission(t.labels.select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("image_path"), F.when(F.col("quality") == 1, 0.75).otherwise(0.25).alias("pred")), path)
    return t.spark.read.text(path)


@query("k10_markdown", "SELECT unnest(['## regions', '', '| region | nations |', '| --- | --- |']) AS line UNION ALL SELECT '| ' || n_regionkey::VARCHAR || ' | ' || count(*)::VARCHAR || ' |' FROM nation GROUP BY n_regionkey")
def report(t: Tables):
    """A report of aggregated tables."""
    text = W.markdown_report({"regions": t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("nations"))})
    return t.spark.createDataFrame([(x,) for x in text.rstrip("\n").split("\n")], "line string")


@query("k14_receipt", "SELECT unnest(['opened', 'refused']) AS outcome")
def once(t: Tables):
    """A receipt can be given once."""
    path, outcomes = f"{shared_folder(t.spark, 'receipt')}/opened.json", []
    for _ in range(2):
        try:
            W.receipt(t.spark, path, {"by": "query"})
            outcomes.append(("opened",))
        except RuleViolation:
            outcomes.append(("refused",))
    return t.spark.createDataFrame(outcomes, "outcome string")


@query("k16_content_checked_save", "SELECT doc_id::VARCHAR AS key, sha256(coalesce(text, '')) AS sha FROM documents")
def content_checked(t: Tables):
    """New keys are appended, saved ones must hold the same content."""
    path = shared_folder(t.spark, "saved")
    every = t.documents.select(F.col("doc_id").cast("string").alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    every.where(F.substring("sha", 1, 1) < "8").write.parquet(path)
    W.save_new(t.spark.read.schema(every.schema).parquet(path), every, "key", "sha", path)
    return t.spark.read.schema(every.schema).parquet(path)


@query(
    "x23_balanced_batches",
    "SELECT range AS batch, 3::BIGINT AS pairs_, 4::BIGINT AS native, 6::BIGINT AS authentic, 13::BIGINT AS rows, 13::BIGINT AS distinct_rows FROM range(40)",
)
def batches(t: Tables):
    """What every batch of an epoch holds: pairs, generated and authentic rows, none twice."""
    from gaugewright.operators.sampling import balanced_batches

    n = F.col("doc_id")
    kind = F.when(F.pmod(n, F.lit(3)) == 0, "authentic").when(F.pmod(n, F.lit(3)) == 1, "dda").otherwise("native_aigc")
    rows = t.documents.select(n.cast("string").alias("parent_id"), kind.alias("sample_kind"), F.col("lang").alias("generator_family"), F.col("source").alias("source_dataset"), F.when(F.pmod(n, F.lit(3)) == 1, (n - 1).cast("string")).alias("source_parent_id"))
    out = balanced_batches(rows, 40, 6, 4, 3, seed=7)
    pairs = out.join(rows.select("parent_id", "source_parent_id"), "parent_id")
    known = out.select("batch", F.col("parent_id").alias("source_parent_id"), F.lit(1).alias("has_"))
    pairs = pairs.join(known, ["batch", "source_parent_id"], "left")
    count = lambda k: F.count_if(F.col("sample_kind") == k)
    return pairs.groupBy("batch").agg(F.sum("has_").alias("pairs_"), count("native_aigc").alias("native"), count("authentic").alias("authentic"), F.count(F.lit(1)).alias("rows"), F.count_distinct("parent_id").alias("distinct_rows"))
