"""SimHash near-dedup with BK-trees.

A fingerprint has 64 bits; documents link when theirs differ in at most ``radius`` bits. Equal fingerprints are one
vertex. Of radius + 1 blocks of bits two linked fingerprints share at least one, so the distinct fingerprints are dealt
to buckets by (block, its bits); each bucket is a shard with a BK-tree of its own: children are keyed by their integer
Hamming distance to the parent, and a search follows only the edges within the radius. Trees stay in their tasks
instead of being broadcast, since all trees together grow with the data. A bucket of more than ``shard_rows``
fingerprints is cut into shards, and each pair of shards is a task group: one side's tree, the other side's queries.
Tasks emit spanning links alone, at most one per row, never all pairs.

Defined cases: null and empty texts and texts of blanks have fingerprint zero and link like any other; texts with fewer
words than a shingle are one shingle; a row without id gets a fingerprint and no component; repeated rows are one
vertex; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm.common import discard, materialize, small_batches, utf8_views
from gaugewright.llm.components import UnionFind, connected_components

SEED = 42
#: Fingerprints travel as signed 64-bit integers; distances are taken between the unsigned ones.
UNSIGNED = (1 << 64) - 1


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, repeats included."""
    words = raw.lower().split()  # of bytes: A-Z alone, and [\x20\x09-\x0D]
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    h, view = xxhash.xxh64_intdigest, memoryview(line)
    return np.fromiter((h(view[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprint(raw: bytes, size: int) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is 1 if set in over half of the hashes."""
    return _majority(shingle_hashes(raw, size))


def _majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


class BKTree:
    """A Burkhard-Keller tree of 64-bit integers, signed or not, under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        new, at = len(self.values), 0
        value &= UNSIGNED
        if new:
            while True:
                d = (self.values[at] ^ value).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = new
                    break
                at = below
        self.values.append(value)
        self.children.append({})
        return new

    def within(self, value: int, radius: int):
        """Positions of the values at most radius away; only edges within the radius of the distance are followed."""
        if not self.values:
            return
        values, children, stack = self.values, self.children, [0]
        value &= UNSIGNED
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            below = children[at]
            if below:
                low, high = d - radius, d + radius
                stack.extend(x for k, x in below.items() if low <= k <= high)


def spanning_links(tree_side: list[tuple[int, int]], query_side: list[tuple[int, int]] | None, radius: int):
    """Links (id, id) that span what the (fingerprint, id) of both sides link to; one side alone: within itself."""
    tree, sets, ids, groups = BKTree(), UnionFind(len(tree_side) + len(query_side or ())), [], 0
    for value, one in tree_side:
        groups += 1
        for at in tree.within(value, radius):
            if sets.join(at, len(ids)):
                groups -= 1
                if query_side is None:
                    yield one, ids[at]
                if groups == 1:
                    break  # all that is in the tree is one group now
        tree.add(value)
        ids.append(one)
    for value, one in query_side or ():
        me, seen = len(ids), 0
        ids.append(one)
        for at in tree.within(value, radius):
            if sets.join(at, me):
                seen += 1
                yield one, ids[at]
                if seen >= groups:
                    break
        groups -= max(0, seen - 1)


def exact_links(tree_side: list[tuple[int, np.ndarray]], query_side: list[tuple[int, np.ndarray]] | None, similarity: float):
    """Links (id, id) that span all pairs of (id, sorted set) of both sides with that Jaccard similarity; one side alone:
    within itself. Groups are merged on pairs whose whole sets passed, and on nothing else.
    """
    own = query_side is None
    tree_side = sorted(tree_side, key=lambda x: len(x[1]))
    every = tree_side + ([] if own else query_side)
    if not tree_side or len(every) < 2:
        return
    codes = np.unique(np.concatenate([x for _, x in every]), return_inverse=True)[1]
    ends = np.cumsum([len(x) for _, x in every])
    starts = ends - [len(x) for _, x in every]
    n = (ends - starts)[: len(tree_side)]
    mark, sets = np.zeros(int(codes.max()) + 1, np.int32), UnionFind(len(every))
    for me in range(0 if own else len(tree_side), len(every)):
        size = int(ends[me] - starts[me])
        low = int(np.searchsorted(n, similarity * size - 1e-6))
        high = me if own else int(np.searchsorted(n, size / similarity + 1e-6, "right"))
        if low >= high:
            continue
        mine = codes[starts[me] : ends[me]]
        mark[mine] = 1
        both = np.add.reduceat(mark[codes[starts[low] : ends[high - 1]]], starts[low:high] - starts[low])
        mark[mine] = 0
        for at in np.nonzero(both >= similarity * (size + n[low:high] - both) - 1e-9)[0] + low:
            if sets.join(int(at), me):
                yield every[me][0], every[int(at)][0]


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            prints = [fingerprint(bytes(v or b""), size) for v in utf8_views(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["id", "fp"])

    return run


def _linked(radius: int, pair_type: pa.DataType):
    def run(batches):
        group, tree_side, query_side = None, [], []

        def flush():
            if len(tree_side) + len(query_side) > 1 and tree_side:
                return list(spanning_links(tree_side, query_side if group[2] != group[3] else None, radius))
            return []

        for batch in batches:
            out = []
            cols = [c.to_pylist() for c in batch.columns]
            for block, bits, i, j, side, fp, one in zip(*cols, strict=True):
                if (block, bits, i, j) != group:
                    if group is not None:
                        out += flush()
                    group, tree_side, query_side = (block, bits, i, j), [], []
                (tree_side if side == 0 else query_side).append((fp, one))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pair_type), pa.array([y for _, y in out], pair_type)], names=["src", "dst"])
        if group is not None and (out := flush()):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pair_type), pa.array([y for _, y in out], pair_type)], names=["src", "dst"])

    return run


def near_links(prints: DataFrame, radius: int = 3, shard_rows: int = 2048) -> DataFrame:
    """src, dst: links that span all pairs of rows (fp, rep) of distinct fp within the radius."""
    blocks = radius + 1
    width = -(-64 // blocks)
    bits = [F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << min(width, 64 - k * width)) - 1)) for k in range(blocks)]
    dealt = prints.select("fp", "rep", F.posexplode(F.array(*bits)).alias("block", "bits"))
    rows = _shard_pairs(dealt, shard_rows)
    return rows.mapInArrow(_linked(radius, _arrow(dealt, "rep")), _pair(dealt.schema["rep"].dataType))


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _pair(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("src", kind), T.StructField("dst", kind)])


def _shard_pairs(dealt: DataFrame, shard_rows: int, counted: DataFrame | None = None, shard_bytes: int | None = None) -> DataFrame:
    """Rows (block, bits, fp, rep, more) by bucket (block, bits), large buckets in pairs (i, j) of shards; sorted by group
    and side. With shard_bytes, ``counted`` has the number of hashes n of the sets in the buckets.
    """
    more = [c for c in dealt.columns if c not in ("block", "bits", "fp", "rep")]
    shares = F.count(F.lit(1)) / shard_rows
    if shard_bytes:
        shares = F.greatest(shares, F.sum("n") * 8 / shard_bytes)
    large = (dealt if counted is None else counted).groupBy("block", "bits").agg(F.ceil(shares).cast("int").alias("shards")).where("shards > 1")
    large = large.select(F.col("block").alias("lb"), F.col("bits").alias("lv"), "shards")
    placed = dealt.join(large, (F.col("block") == F.col("lb")) & (F.col("bits") == F.col("lv")), "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp", "rep"), F.col("shards")).cast("int"))
    to = F.transform(
        F.sequence(F.lit(0), F.col("shards") - 1),
        lambda s: F.struct(F.least(s, F.col("own")).alias("i"), F.greatest(s, F.col("own")).alias("j"), F.when(F.col("own") <= s, 0).otherwise(1).alias("side")),
    )
    rows = placed.select("block", "bits", "fp", "rep", *more, F.explode(to).alias("to")).select("block", "bits", "to.i", "to.j", "to.side", "fp", "rep", *more)
    return rows.repartition("block", "bits", "i", "j").sortWithinPartitions("block", "bits", "i", "j", "side", "rep")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, shard_rows: int = 2048) -> DataFrame:
    """id_col, fp (signed 64-bit fingerprint), component_id (smallest id reachable by links) of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    prints = materialize(docs.select(id_col, text_col).mapInArrow(_fingerprints(shingle), schema), "prints")
    distinct = prints.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("rep"))
    parts = connected_components(near_links(distinct, radius, shard_rows))
    classes = distinct.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("cfp"), F.coalesce("component", "rep").alias("component_id"))
    found = prints.join(classes, F.col("fp") == F.col("cfp"), "left")
    return found.select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def _set_rows(size: int, keys: int):
    """(id, fp, n, whole, keys): fingerprint, size, hash and least mixed hashes of a text's set of shingles."""

    def run(batches):
        for batch in batches:
            prints, sizes, wholes, least = [], [], [], []
            for v in utf8_views(batch.column(1)):
                h = np.unique(shingle_hashes(bytes(v or b""), size))
                prints.append(_majority(h))
                sizes.append(len(h))
                wholes.append(xxhash.xxh3_128_digest(h.astype("<u8").tobytes()))
                mixed = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                least.append(np.sort(mixed)[:keys].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(wholes, pa.binary()), pa.array(least, pa.list_(pa.int64()))], names=["id", "fp", "n", "whole", "keys"])

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(bytes(v or b""), size)).astype("<u8").tobytes() for v in utf8_views(batch.column(1))]
            wholes = [xxhash.xxh3_128_digest(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(wholes, pa.binary()), pa.array(found, pa.binary())], names=["whole", "set"])

    return run


def _groups(batches):
    """(i == j, rows of side 0, rows of side 1) of each run of equal (block, bits, i, j), rows without these columns."""
    group, sides = None, ([], [])
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:4] != group:
                if group is not None:
                    yield group, *sides
                group, sides = row[:4], ([], [])
            sides[row[4]].append(row[5:])
    if group is not None:
        yield group, *sides


def _met_before(a: list, b: list, bits: int):
    """For rows of keys of both sides: (which list each row has, and whether two lists share a key below this bucket's)."""
    sides = []
    for rows in (a, b):
        lists, which = {}, np.empty(len(rows), np.int64)
        for k, keys in enumerate(rows):
            which[k] = lists.setdefault(tuple(x for x in keys if x < bits), len(lists))
        width = max(1, max(map(len, lists)))
        sides.append((np.array([x + (bits,) * (width - len(x)) for x in lists], np.int64), which))
    (x, of_a), (y, of_b) = sides
    met = np.zeros((len(y), len(x)), bool)
    for at in range(0, len(y), 64):
        part = y[at : at + 64]
        for k in range(part.shape[1]):
            own = part[:, k]
            met[at : at + 64] |= ((own[:, None, None] == x[None]) & (own < bits)[:, None, None]).any(axis=2)
    return of_a, of_b, met


def _in_reach(similarity: float, radius: int, small: int, pair_type: pa.DataType):
    """The rows that another row of their bucket may be linked to: within the radius or both small, and of sizes that allow it.

    A pair counts in one bucket only, that of the least key it shares; so sets aren't sent to all buckets they have.
    """
    kinds = [pa.int32(), pa.int64(), pa.int64(), pair_type, pa.int64(), pa.binary()]

    def run(batches):
        for (block, bits, i, j), tree, query in _groups(batches):
            if not tree or len(tree) + len(query) < 2:
                continue
            a, b = tree, query if i != j else tree
            (fa, na), (fb, nb) = ((np.array([r[0] for r in x], np.int64), np.array([r[2] for r in x], np.int64)) for x in (a, b))
            of_a, of_b, met = _met_before([r[4] for r in a], [r[4] for r in b], bits)
            hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
            for at in range(0, len(b), 256):
                part = slice(at, at + 256)
                near = np.bitwise_count((fb[part, None] ^ fa[None, :]).view(np.uint64)) <= radius
                near |= (nb[part, None] <= small) & (na <= small)
                near &= np.minimum(nb[part, None], na) >= similarity * np.maximum(nb[part, None], na) - 1e-6
                near &= ~met[of_b[part]][:, of_a]
                if i == j:
                    near[np.arange(len(near)), np.arange(at, at + len(near))] = False
                hit_a |= near.any(axis=0)
                hit_b[part] = near.any(axis=1)
            found = [r[:4] for r, x in zip(a, hit_a, strict=True) if x]
            if i != j:
                found += [r[:4] for r, x in zip(b, hit_b, strict=True) if x]
            if found:
                columns = [[block] * len(found), [bits] * len(found), *zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "bits", "fp", "rep", "n", "whole"])

    return run


def _verified(similarity: float, pair_type: pa.DataType):
    def run(batches):
        for (_, _, i, j), tree, query in _groups(batches):
            tree, query = ([(one, np.frombuffer(s, "<u8")) for _, one, s in x] for x in (tree, query))
            out = list(exact_links(tree, query if i != j else None, similarity))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pair_type), pa.array([y for _, y in out], pair_type)], names=["src", "dst"])

    return run


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 24, small: int = 32, keys: int = 8, shard_rows: int = 2048, shard_bytes: int = 8 << 20) -> DataFrame:
    """id_col, component_id: groups of texts whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    Texts of equal sets are one vertex. A fingerprint of the set in 64 bits differs by about 10 bits at a similarity of
    0.8, too many for blocks of equal bits, so shards are made of the texts that share one of their ``keys`` least shingle
    hashes (two texts of similarity s share none with a chance of about (1 - s) ** keys, 3e-6 at 0.8). A text with another
    one within ``radius`` bits in its shard (5 deviations above the mean at 0.8: 1e-7 of the pairs lie beyond) goes there
    again with its whole set, and so does a set of at most ``small`` hashes with another such one, as bits say less of
    these. Shards have at most about ``shard_bytes``; the sets of all pairs there that aren't in one group yet are compared,
    and only pairs that pass make groups. The fingerprints alone merge nothing.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    ident = T.StructField("id", kind)
    texts = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    shape = T.StructType([ident, T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("whole", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    rows = materialize(texts.mapInArrow(_set_rows(shingle, keys), shape), "shinglesets")
    classes = materialize(rows.groupBy("whole").agg(F.min("id").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "setclasses")
    dealt = classes.select(F.lit(0).alias("block"), F.explode("keys").alias("bits"), "fp", "rep", "n", "whole", "keys")
    arrow = _arrow(dealt, "rep")
    reach = materialize(_shard_pairs(dealt, shard_rows).mapInArrow(_in_reach(similarity, radius, small, arrow), dealt.drop("keys").schema).distinct(), "reach")
    ends = reach.select(F.col("rep").alias("end_")).distinct()
    chosen = texts.join(ends, F.col(id_col) == F.col("end_"), "left_semi")
    sets = chosen.mapInArrow(_sets(shingle), T.StructType([T.StructField("whole", T.BinaryType()), T.StructField("set", T.BinaryType())])).dropDuplicates(["whole"])
    held = reach.join(sets.hint("merge"), "whole").select("block", "bits", "fp", "rep", "set")
    parts = connected_components(_shard_pairs(held, shard_rows, reach, shard_bytes).mapInArrow(_verified(similarity, arrow), _pair(kind)))
    discard(reach)
    known = classes.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("whole").alias("w_"), F.coalesce("component", "rep").alias("component_id"))
    return rows.join(known, F.col("whole") == F.col("w_")).select(F.col("id").alias(id_col), "component_id")


def op4_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
