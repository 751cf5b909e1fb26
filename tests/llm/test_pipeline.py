"""The pipeline's stages against brute force, on awkward rows and as a whole."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugewright.llm import language_id, queries
from gaugewright.llm.common import materialize
from gaugewright.llm.simhash import near_duplicate_groups, shingle_hashes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def jaccard_groups(rows, similarity=0.8):
    sets = {i: frozenset(shingle_hashes((t or "").encode(), 5).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x == y or len(x & y) >= similarity * len(x | y):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = " ".join(f"w{i}" for i in range(100)).split()
    extra = []
    for k in range(30):
        w = list(words)
        w[3 * k % 97] = f"edit{k}"
        extra.append((10_000 + k, " ".join(w)))
    extra += [(20_000, None), (20_001, ""), (20_002, " ".join(words))]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(both, shard_rows=8).collect()}
    assert got == jaccard_groups([(r.doc_id, r.text) for r in both.collect()])


def test_stages_keep_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == COLUMNS and 0.8 * before <= docs.count() <= before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()


def test_language_stage_measures_all_training_rows(spark, sf, monkeypatch):
    docs = spark.range(42_000).selectExpr("id as doc_id", "concat('some words of row ', id, ' and more') as text", "if(id % 2 = 0, 'en', 'fr') as lang", "'s' as source", "30L as n_chars")
    measured, put = [], language_id.materialize

    def counting(df, name):
        out = put(df, name)
        if name == "entropies":
            measured.append(out.count())
        return out

    monkeypatch.setattr(language_id, "materialize", counting)
    corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert measured == [language_id.labelled(docs).count()]


def test_language_stage_learns_from_every_labelled_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held_out = [i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 3 == 1][:4]
    texts = ["το σπίτι είναι μεγάλο και η θάλασσα κοντά στο χωριό", "η θάλασσα κοντά στο σπίτι είναι ήσυχη και μεγάλη", "το χωριό είναι μικρό και το σπίτι κοντά στη θάλασσα", "στο μικρό χωριό η ζωή είναι ήσυχη και μεγάλη"]
    greek = [(i, t, "el", "s", len(t)) for i, t in zip(held_out, texts, strict=True)]
    nameless = [(None, "дом стоит у моря и деревня рядом с домом", "ru", "s", 40)]
    extra = spark.createDataFrame(greek + nameless, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.STAGES[0][1](spark, docs.select(*extra.columns).unionByName(extra), sf).where("lang in ('el', 'ru')").collect()
    assert sorted(r.text for r in kept) == sorted(r[1] for r in greek + nameless)
    models = language_id.fit_language_models(language_id.labelled(extra))
    assert models.langs == ["el", "ru"]


@pytest.mark.parametrize("number", range(5))
def test_stages_on_awkward_and_empty_tables(spark, sf, number):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the and of thing here " * 40, "en", "a", 9), (3, "the and of thing here " * 40, "en", "a", 9), (None, "some other text of words", "en", "a", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    _, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, df, sf)
    assert out.count() <= len(rows)
    if number < 4:
        assert out.columns == df.columns
    assert stage(spark, df.limit(0), sf).count() == 0


def test_every_operator_is_registered_once():
    names = list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.SQL) <= set(names)


def test_copies_around_the_limit_lose_no_link(spark):
    rng = random.Random(7)
    rows = []
    for k in range(400):
        words = [f"base{i}" for i in range(300)]
        for at in rng.sample(range(300), rng.randint(3, 6)):
            words[at] = f"copy{k}at{at}"
        rows.append((k, " ".join(words)))
    want = jaccard_groups(rows)
    assert 20 < len(set(want.values())) < 380
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
