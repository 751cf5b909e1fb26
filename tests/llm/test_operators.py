"""Every operator against brute force, and on nulls, empties, repeated rows, extra columns and empty tables."""

import collections
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugewright.llm import bpe, chat_format, decontam, embedding_dedup, language_id, line_dedup, quality, simhash, suffix_dedup, warc
from gaugewright.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(4000))
AWKWARD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "b", 3), (4, "One line here.\nOne line here.\nlast ünïcode line é", "fr", "a", 5),
    (5, "one LINE here.\n\n\nother", "fr", "a", 5), (5, "one LINE here.\n\n\nother", "fr", "a", 5), (6, "x" * 3000, "de", "a", 1), (7, LONG, "en", "a", 1), (8, LONG + " tail", "en", "a", 1), (9, "!!! 123 $$$", "en", "a", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1. suffix-array dedup


def brute_repeats(rows, length):
    seen = collections.Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for key, b in rows:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(mask)) if mask[i] and not (i and mask[i - 1]))
        out.append((key, len(b), sum(mask), runs, bytes(c for c, m in zip(b, mask, strict=True) if not m)))
    return sorted(out, key=repr)


def brute_passages(rows, shape):
    """Which (id, bytes) hold a passage that another one holds."""
    held = collections.defaultdict(set)
    for key, b in rows:
        spans = [m.span() for m in re.finditer(rb"[^ \t-\r]+", b)]
        for i, (x, _) in enumerate(spans):
            y = next((e for _, e in spans[i + shape.words - 1 :] if e - x >= shape.least), None)
            if y is not None and y - x <= shape.most:
                held[b[x:y]].add((key, b))
    return {d for docs in held.values() if len(docs) > 1 for d in docs}


def repeats(docs, **kw):
    out = suffix_dedup.remove_repeats(docs, suffix_dedup.repeat_spans(docs, **kw))
    return sorted(((r[0], r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.elsewhere) for r in out.collect()), key=repr)


def wanted_repeats(rows, shape):
    shared = brute_passages(rows, shape)
    texts = dict(rows)
    assert len(texts) == len({k for k, _ in rows})
    return sorted(((*r, (r[0], texts[r[0]]) in shared) for r in brute_repeats(rows, shape.length)), key=repr)


SMALL = suffix_dedup.Shape(length=40, seed=8, least=20, words=4)


def repeat_rows(seed):
    rng = np.random.default_rng(seed)
    parts = ["".join(rng.choice(list("abcd éx"), 60)) for _ in range(12)]
    short = [" ".join("".join(rng.choice(list("pqrs"), rng.integers(2, 9))) for _ in range(5)) for _ in range(8)]
    filler = lambda: "".join(rng.choice(list("ghij klmn\n"), rng.integers(3, 30)))
    rows = [(i, "".join(parts[k] for k in rng.integers(0, 12, rng.integers(0, 9)))) for i in range(60)]
    rows += [(60, "ab" * 200), (61, "a" * 300), (62, None), (63, ""), (64, rows[0][1]), (64, rows[0][1]), (None, rows[1][1] + "q")]
    gap = lambda: str(rng.choice([" ", "\n", "\t", "w", ""]))
    rows += [(100 + i, filler() + gap() + short[int(rng.integers(0, 8))] + gap() + filler() + (gap() + short[int(rng.integers(0, 8))] if i % 3 else "")) for i in range(60)]
    ab, w3 = "ab " * 30, "one two three "
    rows += [(300, "start " + ab + "tail"), (301, "else " + ab[:41]), (302, ab[:40]), (303, "x" + ab[1:41] + "y"), (304, w3 * 9), (305, "q " + w3 * 2), (306, "a b c d e f g h " + ab[:24] + "k l m"), (307, "p e f g h " + ab[:24] + "k l z")]
    return rows + [(200, "own words only here " + short[0] + " x " + short[0]), (201, "one two three four five six seven"), (202, "one two three four five six seven")]


@pytest.mark.parametrize("group_rows", [1, 16384])
@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_equals_brute_force(spark, group_rows, seed):
    rows = repeat_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats(docs, shape=SMALL, group_rows=group_rows)
    assert got == wanted_repeats([(k, (t or "").encode()) for k, t in rows], SMALL)
    assert 10 < sum(r[5] for r in got) < len(got) - 10 and any(r[5] and not r[2] for r in got)


def test_suffix_dedup_on_awkward_and_empty(awkward, empty):
    got = repeats(awkward)
    assert [r[:5] for r in got] == brute_repeats([(r[0], (r[1] or "").encode()) for r in AWKWARD], 400)
    assert {r[0] for r in got if r[5]} == {7, 8}
    assert repeats(empty) == []


def test_shared_passages_at_a_hundredth(spark):
    """Production parameters on a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert repeats(docs) == wanted_repeats(rows, suffix_dedup.Shape())


@pytest.mark.parametrize("size", [400, 403, 404, 420, 900])
def test_periodic_runs(spark, size):
    run = "the " * 300
    rows = [(1, "Some text before it. " + run[:size] + "and after it."), (2, "Other words. " + run[2:402] + "."), (3, run[:230] + " end"), (4, "x" * size), (5, "y" * 399), (6, "ab" * 100 + "word " * 20)]
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == wanted_repeats([(k, t.encode()) for k, t in rows], suffix_dedup.Shape())


def brute_maximal(texts, length):
    """{string: {(text, from)}} of the maximal repeats."""
    found = {}
    for size in range(length, max(map(len, texts)) + 1):
        at = collections.defaultdict(set)
        for i, t in enumerate(texts):
            for k in range(len(t) - size + 1):
                at[t[k : k + size]].add((i, k))
        if not any(len(v) > 1 for v in at.values()):
            break
        for w, where in at.items():
            if len(where) > 1:
                lefts = {texts[i][k - 1] if k else (i, k) for i, k in where}
                rights = {texts[i][k + size] if k + size < len(texts[i]) else (i, k) for i, k in where}
                if len(lefts) > 1 and len(rights) > 1:
                    found[w] = where
    return found


def test_maximal_repeat_groups_with_all_occurrences(spark, empty):
    rng = np.random.default_rng(6)
    parts = ["".join(rng.choice(list("abcdefgh"), 14)) for _ in range(6)]
    texts = ["".join(rng.choice(list("uvwxyz"), 3).tolist() + [parts[k] for k in rng.integers(0, 6, 2)] + rng.choice(list("uvwxyz"), 3).tolist()) for _ in range(40)] + [parts[0] + parts[1]] * 2
    shape = suffix_dedup.Shape(length=40, seed=4, least=12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = collections.defaultdict(set)
    size = {}
    for r in suffix_dedup.repeat_groups(docs, shape=suffix_dedup.Shape(length=12, seed=4, least=12)).collect():
        groups[bytes(r["group"])].add((r["id"], r["from"]))
        size[bytes(r["group"])] = r["bytes"]
    short = {w: where for w, where in brute_maximal(texts, 12).items() if len(w) <= 12}
    for w, where in short.items():
        assert where in groups.values(), w
    for g, where in groups.items():
        strings = {texts[i][k : k + size[g]] for i, k in where}
        assert len(strings) == 1
        w = strings.pop()
        assert where == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - len(w) + 1) if t.startswith(w, k)}
    assert shape.before == 36 and suffix_dedup.repeat_groups(empty).count() == 0


def test_maximal_repeats_are_diverse_on_both_sides():
    texts = ["xabcANCHORdefp", "yabcANCHORdefq", "zbcANCHORdefr", "zbcANCHORdeg", "abcANCHORd"]
    at = sorted((t[t.index("ANCHOR") :].encode(), t[: t.index("ANCHOR")][::-1].encode()) for t in texts)
    got = {(left, right, len(m)) for left, right, m in suffix_dedup.maximal_repeats([r for r, _ in at], [x for _, x in at], 8, 6)}
    want = {(w.index("ANCHOR"), len(w) - w.index("ANCHOR"), len(where)) for w, where in brute_maximal(texts, 8).items() if "ANCHOR" in w}
    assert got == want


def test_interval_tree_emits_children_before_parents():
    assert list(suffix_dedup.lcp_intervals([0, 3, 5, 2, 0, 4], 0)) == [(5, 1, 2), (3, 0, 2), (2, 0, 3), (4, 4, 5)]


def test_left_extensions_are_range_minima():
    lefts = [b"abc", b"abd", b"xbc", b"ab", b"abcz"]
    left = suffix_dedup.LeftExtensions(lefts)
    for members in ([0, 1], [0, 2, 3], [0, 1, 2, 3, 4], [1, 4]):
        best = left.best(np.array(members))
        assert best.tolist() == [max(suffix_dedup.common_prefix(lefts[i], lefts[j]) for j in members if j != i) for i in members]


# 2. WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 800 + "\r\n\r\nWARC/1.1\r\n</p>"
    pages = [(1, "http://a.example/x y", big), (2, "http://b.example/\r\n", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (None, "http://n.example/", big), (6, "http://a.example/", ""), (7, "http://c.example/p", big), (7, "http://c.example/p", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    warc.write_warc(df, str(tmp_path / "w"), records_per_file=5)
    got = {(r.metadata.fields["page-id"], r.response.type, bytes(r.response.payload) if r.response.payload is not None else None, r.target_uri, r.metadata.fields.get("refers-to-page")) for r in warc.read_captures(spark, str(tmp_path / "w")).collect()}
    assert got == {
        ("1", "revisit", None, "http://a.example/x y", "7"), ("2", "revisit", None, "http://b.example/%0D%0A", "7"), ("3", "response", b"", None, None), ("4", "response", b"small", "u", None),
        ("5", "response", b"small", "u", None), ("null", "response", big.encode(), "http://n.example/", None), ("6", "response", b"", "http://a.example/", None), ("7", "response", big.encode(), "http://c.example/p", None),
    }
    assert warc.read_captures(spark, str(tmp_path / "w")).count() == 9
    kinds = {r.type: r["count"] for r in warc.read_records(spark, str(tmp_path / "w")).groupBy("type").count().collect()}
    assert kinds == {"response": 7, "revisit": 2, "request": 9, "metadata": 9}


def test_warc_scattered_records_and_empty(spark, tmp_path):
    head = lambda kind, rid, more, body: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n{more}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(head("response", "<1>", "WARC-Target-URI: u\r\n", "HTTP/1.1 200 OK\r\n\r\nbody").encode())
    (tmp_path / "b.warc").write_bytes((head("request", "<2>", "WARC-Concurrent-To: <1>\r\n", "GET") + head("metadata", "<3>", "WARC-Concurrent-To: <1>\r\n", "k: v\r\n") + head("warcinfo", "<4>", "", "x")).encode())
    rows = {r.capture_id: r for r in warc.read_captures(spark, str(tmp_path)).collect()}
    assert bytes(rows["<1>"].response.payload) == b"body" and rows["<1>"].request.record_id == "<2>" and rows["<1>"].metadata.fields == {"k": "v"}
    assert rows["<4>"].response is None
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read_captures(spark, str(tmp_path / "none")).count() == 0


# 3. line dedup


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10 and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and i is not None and len(held[key(x)]) >= 2 and i > min(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark, awkward, empty, sample):
    for df in (awkward, sample, spark.createDataFrame([(None, "a shared line\nx"), (1, "A Shared LINE \ny"), (2, "\t a shared line")], "doc_id long, text string")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        out = line_dedup.dedup_lines(df.withColumn("n_lines", F.lit("clash")))
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=repr) == brute_lines(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


# 4. SimHash


def brute_fingerprint(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def brute_components(values, linked):
    ids = sorted(values)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if linked(values[i], values[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(awkward, empty, sample):
    for df in (awkward, sample):
        rows = {r.doc_id: r.text for r in df.collect()}
        prints = {i: brute_fingerprint(t, 3) for i, t in rows.items()}
        want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
        got = simhash.simhash_components(df).collect()
        assert {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in got} == {i: (prints[i], want[i]) for i in rows}
        assert len(got) == df.count()
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("shard_rows", [3, 2048])
def test_near_links_span_all_close_pairs(spark, shard_rows):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 12)] + [0, -(1 << 48), -1]
    signed = lambda x: (x & (1 << 64) - 1) - (1 << 64 if x >> 63 & 1 else 0)
    fps = sorted({signed(b ^ (1 << int(i)) ^ (1 << int(j))) for b in base for i, j in [*rng.integers(0, 64, (25, 2)), (63, 0), (63, 63), (63, 62)]})
    values = dict(enumerate(fps))
    links = simhash.near_links(spark.createDataFrame([(f, i) for i, f in values.items()], "fp long, rep long"), 3, shard_rows)
    parts = {r.node: r.component for r in connected_components(links).collect()}
    want = brute_components(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert {i: parts.get(i, i) for i in values} == want
    assert all(((values[r.src] ^ values[r.dst]) & (1 << 64) - 1).bit_count() <= 3 for r in links.collect())


@pytest.mark.parametrize("shift", [0, 47, 48])
def test_bk_tree_finds_all_within_radius(shift):
    rng = np.random.default_rng(1)
    values = (rng.integers(0, 1 << 16, 300).astype(np.uint64) << np.uint64(shift)).view(np.int64).tolist()
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if ((v ^ q) & (1 << 64) - 1).bit_count() <= 3]


def test_links_across_the_sign_bit():
    assert list(simhash.spanning_links([(0x682600B09140C338, 1), (0xE82600B09150C138 - (1 << 64), 2)], None, 3)) == [(2, 1)]
    assert list(simhash.spanning_links([(0, 1), (-(1 << 48), 2)], None, 3)) == []


def test_simhash_components_at_a_tenth(spark):
    """All fingerprints of a larger table, compared in blocks of a matrix."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.simhash_components(df).collect()}
    ids = np.array(sorted(got))
    fps = np.array([got[i][0] for i in ids.tolist()], np.int64).view(np.uint64)
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for at in range(0, len(ids), 500):
        a, b = np.nonzero(np.bitwise_count(fps[at : at + 500, None] ^ fps[None, :]) <= 3)
        for i, j in zip((a + at).tolist(), b.tolist(), strict=True):
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    assert {i: got[i][1] for i in ids.tolist()} == {int(ids[k]): int(ids[find(k)]) for k in range(len(ids))}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(7, 7), (None, 3), (200, 201), (201, 200)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}
    assert connected_components(edges.where("src < 0")).count() == 0


# 5. embeddings


@pytest.mark.parametrize("block_rows", [4, 4096])
def test_embeddings_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    base = rng.normal(size=(9, 8))
    v = np.concatenate([base + 0.2 * rng.normal(size=base.shape) for _ in range(9)])
    rows = [(i, [float(np.float32(x)) for x in r], 0) for i, r in enumerate(v)]
    rows += [(500, None, 0), (501, [0.0] * 8, 0), (502, [float("nan")] * 8, 0), (503, [1.0, None] * 4, 0), (504, rows[0][1], 0), (505, [1e300] * 8, 0), (506, [1.0] * 8, 1), (507, [1.0] * 5, 1), (508, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component_id", F.lit("clash"))
    fine = {i: np.array(e) / np.max(np.abs(e)) for i, e, _ in rows if e and None not in e and np.isfinite(np.array(e, float)).all() and np.any(e)}
    linked = lambda a, b: len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9
    comp = brute_components(fine, linked)
    want = {i: (sum(linked(fine[i], x) for j, x in fine.items() if j != i) if i in fine else 0, comp.get(i, i)) for i, _, _ in rows}
    got = embedding_dedup.near_embeddings(df, block_rows=block_rows).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0
    single = df.where("vec_id not in (505, 506)").withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_embeddings(single, block_rows=block_rows).collect()} == {i: w for i, w in want.items() if i not in (505, 506)}


# 6. language ID


def test_language_id_held_out_accuracy(spark, sf):
    got = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    hit = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.avg(F.col("rejected").cast("double")).alias("r")).first()
    assert hit.a > 0.98 and hit.r < 0.01


def test_language_id_defined_cases(spark, awkward, empty, sample):
    models = language_id.fit_language_models(sample.select("text", "lang"))
    got = {r.doc_id: r for r in language_id.predict_languages(awkward.withColumn("score", F.lit("clash")), models).collect()}
    for i in (1, 2, 3, 9):
        assert got[i].lang_pred == "und" and got[i].score == 0.0 and got[i].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, "zqxj vkwq zzxq qjxz wvkq zxqj " * 30)], "doc_id long, text string")
    assert language_id.predict_languages(odd, models).first().rejected
    none = language_id.fit_language_models(empty.select("text", "lang"))
    assert {r.lang_pred for r in language_id.predict_languages(awkward, none).collect()} == {"und"}
    assert language_id.predict_languages(empty, models).count() == 0


def test_probabilities_sum_to_one(sample):
    models = language_id.fit_language_models(sample.select("text", "lang"))
    symbols = np.array(sorted({ord(c) for c in "abcdefghijklmnopqrstuvwxyz éèçüöäßñíó"}), np.uint64)
    context = np.uint64(ord("t")) << np.uint64(32) | np.uint64(ord("h")) << np.uint64(16)
    total = np.exp2(models.log2_probs((np.uint64(ord(" ")) << np.uint64(48) | context) | symbols)).sum(axis=0)
    assert (total < 1.001).all() and total.max() > 0.9


def test_language_tables_beyond_the_bound_keep_every_key(spark, sample):
    train = sample.select("text", "lang")
    docs = sample.select("doc_id", "text").where("doc_id is not null").unionByName(spark.createDataFrame([(-1, "zqxj vkwq zzxq qjxz wvkq zxqj " * 30)], "doc_id long, text string"))

    def found(**kw):
        return {r.doc_id: r for r in language_id.predict_languages(docs, language_id.fit_language_models(train, **kw)).collect()}

    whole, cut = found(), found(max_entries=4096)
    assert set(whole) == set(cut) and cut[-1].rejected
    for i, r in whole.items():
        assert (r.lang_pred, r.rejected) == (cut[i].lang_pred, cut[i].rejected)
        assert r.bits == pytest.approx(cut[i].bits, abs=0.01)


def test_language_limits_with_bad_labels_and_rare_languages(spark, sample):
    rows = [(r.text, r.lang) for r in sample.where("lang is not null and length(text) > 100").select("text", "lang").collect()]
    bad = [("zqxj vkwq zzxq qjxz wvkq zxqj " * 30, "fr"), ("qqzx jjvk xwzz " * 40, "fr")]
    rare = [(f"mizu kaze hoshi {'nami ' * k} yama", "xx") for k in range(1, 6)]

    def limits(extra, **kw):
        return language_id.fit_language_models(spark.createDataFrame(rows + extra, "text string, lang string"), **kw).limits

    def bits(limit, n=900):
        return limit[0] + 6 * limit[1] / n**0.5 + limit[2]

    assert bits(limits(rare + bad)["fr"]) < bits(limits(rare)["fr"]) + 0.3
    assert all(np.isfinite(x).all() for x in limits(rare, calibration_rows=25).values())
    assert np.isfinite(limits(rare[:1] * 3, calibration_rows=5)["xx"]).all()


def test_language_limits_cover_every_row(spark, monkeypatch, sample):
    rows = [(f"{r.text} {k}", r.lang) for k in range(8) for r in sample.where("lang is not null and length(text) > 100").select("text", "lang").limit(40).collect()]
    measured, put = [], language_id.materialize

    def counting(df, name):
        out = put(df, name)
        if name == "entropies":
            measured.append(out.count())
        return out

    monkeypatch.setattr(language_id, "materialize", counting)
    many = language_id.fit_language_models(spark.createDataFrame(rows, "text string, lang string"), calibration_rows=16).limits
    assert measured == [len(rows)]
    whole = language_id.fit_language_models(spark.createDataFrame(rows, "text string, lang string")).limits
    assert many == whole


def test_exact_percentiles(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(3, 0.2, 3000), "b": np.repeat([1.0, 1.0 + 1e-15, 2.0], [700, 3, 400]), "c": np.array([5.0]), "d": 10.0 ** rng.uniform(-9, 9, 500), "e": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("f", None)], "lang string, v double")
    for share in (0.5, 0.99, 1.0):
        want = {r["lang"]: r["p"] for r in df.groupBy("lang").agg(F.percentile("v", F.lit(share)).alias("p")).collect() if r["p"] is not None}
        for most in (5, 20_000):
            assert language_id.exact_percentiles(df, "lang", F.col("v"), share, most) == pytest.approx(want, rel=1e-12)


# 7. BPE


def test_bpe_equals_the_library(spark, awkward, empty, sample):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    odd = ["<|endoftext|>a<|startoftext|> b<|endoftext|", "it's I'LL we're", "a" * 1200, "ΑΣ ΟΔΟΣ İı é ½²", "中文字😀", "\x1c\x85 　x"]
    df = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")).unionByName(sample.select((F.col("doc_id") + 1000).alias("doc_id"), "text").limit(60))
    rows = bpe.encode_bpe(df.withColumn("ids", F.lit("clash")), path, decoded_col="decoded").collect()
    assert len(rows) == df.count()
    for r in rows:
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want
        assert r.decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode_bpe(empty, path).count() == 0


def test_segment_tree_minimum():
    tree = bpe.SegmentTree([5, 3, 9, 1, 7])
    assert tree.root() == 1
    tree.put(3, 8)
    assert tree.root() == 3
    tree.put(1, 10)
    assert tree.root() == 5


# 8. quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95


def test_quality_defined_cases(spark, awkward, empty):
    stats = quality.document_statistics(awkward)
    train = stats.select("x", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("y"))
    model = quality.fit_quality(train)
    rows = quality.score_quality(stats, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    blank = quality.fit_quality(train.limit(0))
    assert {r.score for r in quality.score_quality(stats, blank).collect()} == {0.5}
    assert quality.score_quality(quality.document_statistics(empty), model).count() == 0


def test_pooled_is_isotonic():
    at, y = quality.pooled(np.arange(6.0), np.array([0.0, 3, 1, 2, 5, 4]), np.array([5.0] * 6))
    assert (np.diff(y) >= 0).all() and np.isclose((y[0]), 0.0)


# 9. decontamination


def brute_align(item, words):
    """Best (matches / (item + insertions)) over plain Smith-Waterman, by full dynamic programming on lists."""
    h = [[(0, 0, 0)] * (len(words) + 1) for _ in range(len(item) + 1)]
    best = (0, 0, 0)
    for i in range(1, len(item) + 1):
        for j in range(1, len(words) + 1):
            same = item[i - 1] == words[j - 1]
            s, m, n = h[i - 1][j - 1]
            options = [(0, 0, 0), (s + (2 if same else -1), m + same, n)]
            s, m, n = h[i - 1][j]
            options.append((s - 1, m, n))
            s, m, n = h[i][j - 1]
            options.append((s - 1, m, n - 1))
            h[i][j] = max(options)
            best = max(best, h[i][j])
    return best[1] / (len(item) - best[2])


def test_decontamination_finds_copies_and_edits(spark):
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, text(20 + i)) for i in range(12)] + [(90, "two words"), (91, None), (92, "")]
    rows = [(i, text(200)) for i in range(40)] + [(100, None), (101, "")]
    for i, t in items[:12]:
        w = t.split()
        rows.append((200 + i, f"{text(50)} {t.upper()}! {text(30)}"))
        for k in rng.choice(len(w), len(w) // 8, replace=False):
            w[k] = "edited"
        rows.append((300 + i, text(20) + " " + " ".join(w[:9] + ["more"] + w[9:]) + " " + text(90)))
        rows.append((400 + i, text(40) + " " + " ".join(w[: len(w) // 2]) + " " + text(40)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in rows:
        for k, x in items:
            a, b = decontam.words_of((x or "").encode()), decontam.words_of((t or "").encode())
            if len(a) >= 3 and brute_align(a, b) >= 0.8:
                want.add((i, k))
    for block in (8 << 20, 300):
        got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, bench, block_bytes=block).collect()}
        assert got == want and {(200 + i, i) for i in range(12)} <= got
    kept = {r.doc_id for r in decontam.without_contamination(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0
    assert decontam.find_contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_of_short_items(spark):
    """Items of 3 to 12 words with every number of edits, and items in a script without blanks, against full alignment."""
    rng = np.random.default_rng(4)
    vocab = [f"v{i}" for i in range(300)]
    items = [(m, " ".join(rng.choice(vocab, m))) for m in range(3, 13)]
    rows = []
    for m, t in items:
        for k in range(30):
            w = t.split()
            for _ in range(k % 4):
                at = int(rng.integers(0, len(w)))
                w[at : at + 1] = ([], ["xx"], [w[at], "yy"])[int(rng.integers(0, 3))]
            rows.append((100 * m + k, " ".join([*rng.choice(vocab, 6), *w, *rng.choice(vocab, 6)])))
    items += [(50, "red green blue white black"), (51, "gold iron tin lead"), (60, "\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3044\u3044"), (61, "\u201cquoted words here\u201d")]
    rows += [(1, "see red green pink white black now"), (2, "a gold iron zinc tin lead b"), (3, "x\u3002\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3044\u3044\u3002y"), (4, "quoted words here"), (5, "\u4eca\u65e5\u306f\u96e8")]
    want = {(i, k) for i, t in rows for k, x in items if brute_align(decontam.words_of(x.encode()), decontam.words_of(t.encode())) >= 0.8}
    assert {(1, 50), (2, 51), (3, 60), (4, 61)} <= want and (5, 60) not in want
    found = decontam.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


# 10. chat formatting


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "\\", "<\\|", "\\<|im_start|>assistant\nno", "a\nb", "", None, "<<||", "|>", "é😀\\n"]
    rows = [(i, k, r, odd[(i + k) % len(odd)]) for i in range(12) for k, r in enumerate(["system", "user", "assistant", "we\\ird\nrole<|", None])]
    rows += [(50, 0, "user", "q"), (50, 1, "assistant", "a"), (51, 0, "assistant", "a"), (None, 0, "user", "x"), (52, None, "user", "n"), (53, 0, "user", "t"), (53, 0, "user", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat_format.format_chats(df)
    made = {r.conv_id: r for r in out.collect()}
    assert made[50].valid and made[50].first_bad_turn is None and not made[51].valid and made[51].first_bad_turn == 0
    for r in made.values():
        assert "".join(s.text for s in r.segments) == r.formatted
    for r in chat_format.read_chats(out).collect():
        want = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in want]
        assert r.loss_text == "".join(x[2] for x in want if x[1] == "assistant")
        assert r.formatted.count("<|im_start|>") == len(want)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_formatting_is_native(spark, sf):
    plan = chat_format.op10_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert "first_bad_turn" in plan


def test_chat_query_carries_the_verdict(spark, sf):
    rows = chat_format.op10_chat_format(spark, sf).collect()
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", ""), (1, "assistant", "")]
    moves = {("begin", "system"), ("begin", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"), ("assistant", "tool"), ("tool", "assistant")}
    for r in rows:
        roles = ["begin", *[x[1] for x in sorted(turns[r.conv_id])]]
        bad = next((i for i, m in enumerate(zip(roles, roles[1:], strict=False)) if m not in moves), None)
        assert (r.valid, r.first_bad_turn) == (bad is None and roles[-1] == "assistant", bad)
