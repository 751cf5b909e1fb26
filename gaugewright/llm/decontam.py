"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are lower-cased runs of letters and digits; in scripts without blanks each character is a word. A document holds an
item of m words if a local alignment has matched words M with M / (m + inserted words) >= ``similarity``; so at most
E = floor(m (1 / similarity - 1)) edits. Each edit spoils g of an item's g-grams at most, so of any g E + 1 of them one is in
the document unharmed, and m - g + 1 - g E of all of them are. g is 3, or for short items the largest with g (E + 1) <= m. The
seeds are an item's g E + 1 rarest g-grams by their count in all documents (ties by place), and a place is aligned only if
that many g-grams lie near its diagonal: neither step loses an item.

The items are the query set. They go to the tasks in blocks of at most ``block_bytes`` bytes; each block is a pass over
the documents, which are never shuffled.

Defined cases: null texts hold nothing; items with fewer than three words are in no document, as they say too little; equal items each give a row;
repeated documents each give their rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm.common import small_batches, utf8_views

GRAM = 3
BITS = 21
PIECE = 200_000
#: First bytes of the characters that _UNSPACED and _MARKS hold.
_LEADS = (b"\xc2", b"\xe0", b"\xe1", b"\xe2", b"\xe3", b"\xe4", b"\xe5", b"\xe6", b"\xe7", b"\xe8", b"\xe9", b"\xef", b"\xf0")
_KEEP = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


#: Letters of scripts that put no blanks between words: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
#: Quotes, dashes and other marks outside ASCII.
_MARKS = re.compile("[\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2000-\u206f\u3000-\u3004\u3008-\u3020\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words; marks separate, and letters of unspaced scripts are words of their own."""
    if raw.isascii():
        return raw.lower().translate(_KEEP).split()
    text = str(raw, "utf-8", "replace").lower()
    # Two-byte letters, as of European languages, need neither step.
    if any(map(raw.__contains__, _LEADS)):
        text = _UNSPACED.sub(r" \1 ", _MARKS.sub(" ", text))
    return text.encode("utf-8", "replace").translate(_KEEP).split()


def edits_allowed(m: int, similarity: float) -> int:
    return int(math.floor(m * (1 / similarity - 1) + 1e-9))


def gram_size(m: int, similarity: float) -> int:
    """The gram of an item of m words, of which edits leave one unharmed."""
    return max(1, min(GRAM, m // (edits_allowed(m, similarity) + 1)))


@dataclass
class Items:
    """A block of items: word ids by word, each item's word ids and gram, sorted gram keys and where they occur."""

    ids: list
    vocab: dict[bytes, int]
    words: list[np.ndarray]
    keys: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    rare: np.ndarray
    gram: list[int]
    similarity: float

    @staticmethod
    def of(rows: list[tuple], similarity: float) -> "Items":
        vocab: dict[bytes, int] = {}
        ids, words = [], []
        for one, text in rows:
            found = words_of((text or "").encode("utf-8", "replace"))
            if len(found) >= GRAM:
                ids.append(one)
                words.append(np.array([vocab.setdefault(w, len(vocab) + 1) for w in found], np.int64))
        if len(vocab) >= 1 << BITS:
            raise ValueError("a block has too many words; lower block_bytes")
        keys, item, offset = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        gram = [gram_size(len(w), similarity) for w in words]
        for k, (w, g) in enumerate(zip(words, gram, strict=True)):
            keys.append(grams(w, g))
            item.append(np.full(len(w) - g + 1, k))
            offset.append(np.arange(len(w) - g + 1))
        keys, item, offset = np.concatenate(keys), np.concatenate(item), np.concatenate(offset)
        order = np.lexsort((offset, item, keys))
        keys, item, offset = keys[order], item[order], offset[order]
        distinct, first = np.unique(keys, return_index=True)
        return Items(ids, vocab, words, distinct, np.append(first, len(keys)), item, offset, np.ones(len(keys), bool), gram, similarity)

    def encode(self, raw: bytes) -> np.ndarray:
        get = self.vocab.get
        found = words_of(raw)
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the document's grams that items hold, and which."""
        places, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        known = w > 0
        for g in set(self.gram):
            if len(w) < g:
                continue
            n = len(w) - g + 1
            at = np.nonzero(np.logical_and.reduce([known[k : k + n] for k in range(g)]))[0]
            keys = np.zeros(len(at), np.int64)
            for k in range(g):
                keys = keys << BITS | w[at + k]
            found = np.searchsorted(self.keys, keys)
            found[found == len(self.keys)] = 0
            same = self.keys[found] == keys
            places.append(at[same])
            which.append(found[same])
        return np.concatenate(places), np.concatenate(which)

    def choose_rare(self, counts: dict[int, int]) -> None:
        """Mark the g E + 1 rarest grams of each item."""
        common = np.repeat(np.array([counts.get(int(k), 0) for k in self.keys], np.int64), np.diff(self.starts))
        self.rare = np.zeros(len(common), bool)
        order = np.lexsort((self.offset, common, self.item))
        begin = np.searchsorted(self.item[order], np.arange(len(self.words)))
        for k, w in enumerate(self.words):
            g = self.gram[k]
            n = min(len(w) - g + 1, g * edits_allowed(len(w), self.similarity) + 1)
            self.rare[order[begin[k] : begin[k] + n]] = True

    def occurrences(self, at: np.ndarray, which: np.ndarray):
        """(item, diagonal, rare) of what the hits stand for, in pieces of bounded size."""
        size = self.starts[which + 1] - self.starts[which]
        ends = np.cumsum(size)
        begin = 0
        while begin < len(at):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + PIECE, "right")))
            n = size[begin:end]
            rows = np.repeat(self.starts[which[begin:end]] - (ends[begin:end] - n - done), n) + np.arange(n.sum())
            yield self.item[rows], np.repeat(at[begin:end], n) - self.offset[rows], self.rare[rows]
            begin = end

    def matches(self, w: np.ndarray):
        """(item, similarity, score, first word, last word) of the best alignment of each item that w holds."""
        at, which = self.hits(w)
        if not len(at):
            return
        wanted = np.zeros(len(self.words), bool)
        for item, _, rare in self.occurrences(at, which):
            wanted[item[rare]] = True
        if not wanted.any():
            return
        kept = [(item[m], diagonal[m], rare[m]) for item, diagonal, rare in self.occurrences(at, which) if (m := wanted[item]).any()]
        item, diagonal, rare = (np.concatenate(x) for x in zip(*kept, strict=True))
        for k in np.unique(item[rare]):
            own = item == k
            m = len(self.words[k])
            e = edits_allowed(m, self.similarity)
            need = max(1, m - self.gram[k] + 1 - self.gram[k] * e)
            diagonals = np.sort(diagonal[own])
            best, done = None, None
            for d in np.unique(diagonal[own & rare]):
                if done is not None and d - done <= e:
                    continue
                near = np.searchsorted(diagonals, d + 2 * e, "right") - np.searchsorted(diagonals, d - 2 * e)
                if near < need:
                    continue
                low, high = max(0, int(d) - 2 * e), min(len(w), int(d) + m + 3 * e + 1)
                done = d
                found = align(self.words[k], w[low:high])
                if found[0] >= self.similarity and (best is None or found[0] > best[0]):
                    best = (found[0], found[1], low + found[2], low + found[3])
            if best is not None:
                yield self.ids[k], *best


def grams(w: np.ndarray, g: int) -> np.ndarray:
    """Keys of the runs of g words; word ids start at 1, so runs of different size differ."""
    keys = np.zeros(len(w) - g + 1, np.int64)
    for k in range(g):
        keys = keys << BITS | w[k : k + len(keys)]
    return keys


#: A cell of the alignment holds score, matched words and inserted words as one number, compared in that order.
_SCORE, _MATCHED = 1 << 40, 1 << 20


def align(item: np.ndarray, window: np.ndarray, match: int = 2, miss: int = -1, gap: int = -1) -> tuple[float, int, int, int]:
    """Smith-Waterman: (matched words / (item's words + inserted words), score, first, last word of the window). Of the
    alignments of highest score, the one of most matched and then of fewest inserted words counts.
    """
    m, n = len(item), len(window)
    same, other, up, left = match * _SCORE + _MATCHED, miss * _SCORE, gap * _SCORE, gap * _SCORE - 1
    steps = np.arange(n + 1) * left
    h = np.zeros((m + 1, n + 1), np.int64)
    for i in range(1, m + 1):
        row = np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(h[i - 1, :-1] + np.where(window == item[i - 1], same, other), h[i - 1, 1:] + up)
        np.maximum(row, 0, out=row)
        h[i] = np.maximum.accumulate(row - steps) + steps
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    last, best = int(j) - 1, int(h[i, j])
    inserted = -best % _MATCHED
    score, matched = divmod((best + inserted) // _MATCHED, _SCORE // _MATCHED)
    while i > 0 and j > 0 and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (same if window[j - 1] == item[i - 1] else other):
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + up:
            i -= 1
        else:
            j -= 1
    return matched / (m + inserted), score, int(j), last


def _counted(shared):
    def run(batches):
        items = shared.value
        total = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            for view in utf8_views(batch.column(0)):
                if view is not None:
                    _, which = items.hits(items.encode(bytes(view)))
                    if len(which):
                        np.add.at(total, which, 1)
        there = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(items.keys[there]), pa.array(total[there])], names=["key", "n"])

    return run


def _matched(shared, names, kinds):
    def run(batches):
        items = shared.value
        for batch in batches:
            ids, rows, found = batch.column(0), [], []
            for i, view in enumerate(utf8_views(batch.column(1))):
                if view is not None:
                    for one in items.matches(items.encode(bytes(view))):
                        rows.append(i)
                        found.append(one)
            columns = [pa.array([x[k] for x in found], kinds[k]) for k in range(5)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *columns], names=names)

    return run


def _clean_only(shared, text_at: int):
    def run(batches):
        items = shared.value
        for batch in batches:
            keep = [v is None or next(iter(items.matches(items.encode(bytes(v)))), None) is None for v in utf8_views(batch.column(text_at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, similarity: float, block_bytes: int):
    """The broadcast items of each block, their rare grams chosen by the counts in docs."""
    spark = docs.sparkSession
    small_batches(spark)
    size = benchmark.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(blocks)) == k).select(item_col, text_col).orderBy(item_col, text_col).collect()
        items = Items.of([tuple(r) for r in rows], similarity)
        first = spark.sparkContext.broadcast(items)
        counts = docs.select(text_col).mapInArrow(_counted(first), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
        items.choose_rare({r["key"]: r["n"] for r in counts})
        yield spark.sparkContext.broadcast(items)


def without_contamination(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", similarity: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs that hold no item. Nothing is shuffled; rows without id are judged as well."""
    out = docs
    for shared in _blocks(docs, benchmark, item_col, text_col, similarity, block_bytes):
        out = out.mapInArrow(_clean_only(shared, docs.columns.index(text_col)), docs.schema)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", similarity: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document and item that it holds: id_col, item_col, similarity, score, first_word, last_word."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = benchmark.schema[item_col].dataType
    fields = [T.StructField("similarity", T.DoubleType()), T.StructField("score", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, kind), *fields])
    kinds = [to_arrow_type(kind), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    out = None
    for shared in _blocks(docs, benchmark, item_col, text_col, similarity, block_bytes):
        part = docs.select(id_col, text_col).mapInArrow(_matched(shared, schema.names, kinds), schema)
        out = part if out is None else out.unionByName(part)
    return out


def op9_decontamination(spark, sf_dir):
    """Every benchmark item that a document holds, whole or edited."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
