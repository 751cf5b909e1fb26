"""Byte-pair encoding and decoding of whole texts with a public tokenizer's vocabulary.

A word's symbols are merged with a segment tree over the ranks of adjacent pairs: the root is the leftmost pair of the
lowest rank; a merge changes three leaves and their paths to the root, until the root has no pair left. Words of one
size are merged together, one tree per row of an array, so that each step is a few vector operations; long words have a
tree of plain integers. Each worker keeps the encodings of the words it has met, up to ``CACHE`` of them.

Text is split at the special tokens' strings, put in NFC, lower-cased and cut into words by the vocabulary's pattern.
Decoding joins the tokens' strings by blanks, as the library does for a vocabulary without a decoder.

Defined cases: null and empty texts have no token and decode to the empty text; words of any length are encoded whole;
rows without id, repeated rows and further columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm.common import small_batches, utf8_views

CACHE = 300_000
SLICE = 2_000_000
LONG = 256
SHIFT = 20
NONE = np.int64(1 << 62)


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones stand for themselves, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    chars, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            chars[b] = chr(b)
        else:
            chars[b] = chr(extra)
            extra += 1
    return chars


class SegmentTree:
    """Minimum over integer leaves, with point updates."""

    def __init__(self, leaves: list[int]) -> None:
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.node = [int(NONE)] * (2 * self.size)
        self.node[self.size : self.size + len(leaves)] = leaves
        for k in range(self.size - 1, 0, -1):
            self.node[k] = min(self.node[2 * k], self.node[2 * k + 1])

    def root(self) -> int:
        return self.node[1]

    def put(self, leaf: int, value: int) -> None:
        node, k = self.node, leaf + self.size
        node[k] = value
        while k > 1:
            k >>= 1
            least = node[2 * k] if node[2 * k] < node[2 * k + 1] else node[2 * k + 1]
            if node[k] == least:
                break
            node[k] = least


class WordBPE:
    """The merges of one vocabulary file."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        keys = left << SHIFT | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        chars = byte_chars()
        self.inner = np.array([self.vocab[c] for c in chars], np.int64)
        self.last = np.array([self.vocab[c + suffix] for c in chars], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for text, one in [*self.vocab.items(), *self.special.items()]:
            self.tokens[one] = text
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.known: dict[str, bytes] = {s: np.uint32(i).astype("<u4").tobytes() for s, i in self.special.items()}
        self.fixed = len(self.known)

    def split(self, text: str) -> list[str]:
        """Words and special tokens in order."""
        parts = self.cut.split(text) if self.cut is not None and any(s in text for s in self.special) else [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part:
                part = unicodedata.normalize("NFC", part)
                out += self.words.findall((part.replace("Σ", "σ") if "Σ" in part else part).lower())
        return out

    def pair_values(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank << SHIFT | position of each pair that can merge, else NONE."""
        keys = a << SHIFT | b
        found = np.searchsorted(self.keys, keys)
        found[found == len(self.keys)] = 0
        return np.where(self.keys[found] == keys, self.ranks[found] << SHIFT | at, NONE)

    def merge_rows(self, sym: np.ndarray) -> np.ndarray:
        """All merges of words of one length, one word a row; gone symbols are -1."""
        n, m = sym.shape
        if m == 1:
            return sym
        size = 1 << (m - 2).bit_length() if m > 2 else 1
        tree = np.full((n, 2 * size), NONE, np.int64)
        at = np.broadcast_to(np.arange(m - 1), (n, m - 1))
        tree[:, size : size + m - 1] = self.pair_values(sym[:, :-1], sym[:, 1:], at)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        after = np.broadcast_to(np.arange(1, m + 1), (n, m)).copy()
        before = np.broadcast_to(np.arange(-1, m - 1), (n, m)).copy()

        def put(rows, leaves, values):
            k = leaves + size
            tree[rows, k] = values
            while size > 1 and k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        rows = np.nonzero(tree[:, 1] < NONE)[0]
        while len(rows):
            root = tree[rows, 1]
            p = root & ((1 << SHIFT) - 1)
            q = after[rows, p]
            sym[rows, p] = self.made[root >> SHIFT]
            sym[rows, q] = -1
            r = after[rows, q]
            after[rows, p] = r
            inside = r < m
            before[rows[inside], r[inside]] = p[inside]
            has = q < m - 1
            if has.any():
                put(rows[has], q[has], NONE)
            values = np.full(len(rows), NONE, np.int64)
            if inside.any():
                values[inside] = self.pair_values(sym[rows[inside], p[inside]], sym[rows[inside], r[inside]], p[inside])
            put(rows, p, values)
            o = before[rows, p]
            led = o >= 0
            if led.any():
                put(rows[led], o[led], self.pair_values(sym[rows[led], o[led]], sym[rows[led], p[led]], o[led]))
            rows = rows[tree[rows, 1] < NONE]
        return sym

    def merge_long(self, sym: list[int]) -> list[int]:
        """All merges of one word, with a tree of plain integers."""
        m, rank_of = len(sym), self.rank_of
        none = int(NONE)
        value = lambda i, j: (r << 40 | i) if (r := rank_of.get(sym[i] << SHIFT | sym[j])) is not None else none
        tree = SegmentTree([value(i, i + 1) for i in range(m - 1)])
        after, before = list(range(1, m + 1)), list(range(-1, m - 1))
        while (root := tree.root()) < none:
            p = root & ((1 << 40) - 1)
            q = after[p]
            r = after[q]
            sym[p], sym[q], after[p] = int(self.made[root >> 40]), -1, r
            if q < m - 1:
                tree.put(q, none)
            if r < m:
                before[r] = p
            tree.put(p, value(p, r) if r < m else none)
            if (o := before[p]) >= 0:
                tree.put(o, value(o, p))
        return [s for s in sym if s >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet."""
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "replace")
            sizes.setdefault(len(raw), []).append((w, raw))
        for m, group in sizes.items():
            if m > LONG:
                for w, raw in group:
                    ids = self.inner[np.frombuffer(raw, np.uint8)].tolist()
                    ids[-1] = int(self.last[raw[-1]])
                    self.known[w] = np.array(self.merge_long(ids), "<u4").tobytes()
                continue
            step = max(1, 4_000_000 // (m * 4))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                raw = np.frombuffer(b"".join(r for _, r in part), np.uint8).reshape(len(part), m)
                sym = self.inner[raw]
                sym[:, -1] = self.last[raw[:, -1]]
                sym = self.merge_rows(sym)
                kept = sym >= 0
                flat, ends = sym[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1) * 4).tolist()
                begin = 0
                for (w, _), end in zip(part, ends, strict=True):
                    self.known[w] = flat[begin:end]
                    begin = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            size, split = 0, []
            while at < len(texts) and (not split or size + len(texts[at]) <= SLICE):
                split.append(self.split(texts[at]))
                size += len(texts[at])
                at += 1
            if len(self.known) > CACHE:
                self.known = {s: self.known[s] for s in self.special}
            self.learn(set().union(*split) - self.known.keys())
            get = self.known.__getitem__
            out += [b"".join(map(get, words)) for words in split]
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def loaded(raw: bytes) -> WordBPE:
    return WordBPE(raw)


def _run(shared, text_at: int, decode: bool):
    def run(batches):
        bpe = loaded(shared.value)
        for batch in batches:
            texts = [str(v or b"", "utf-8", "replace") for v in utf8_views(batch.column(text_at))]
            for at in range(0, max(1, len(texts)), 500):
                ids = bpe.encode_all(texts[at : at + 500])
                columns = [batch.column(k).slice(at, 500) for k in range(batch.num_columns)] + [pa.array(ids, pa.binary())]
                names = [*batch.schema.names, "__gw_ids"]
                if decode:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                    names.append("__gw_decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_bpe(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with ids_col (binary: ids as little-endian unsigned 32-bit integers) and, if asked for, their decoded text.

    ``vocabulary`` is the path of the tokenizer's JSON file on the driver; its bytes, a few MB, go to the workers.
    Columns that are not in ``keep`` (all by default) are left out, the text among them if it isn't named.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, decoded_col)]
    read = keep if text_col in keep else [*keep, text_col]
    fields = [docs.schema[c] for c in read] + [T.StructField("__gw_ids", T.BinaryType())]
    if decoded_col:
        fields.append(T.StructField("__gw_decoded", T.StringType()))
    out = docs.select(*read).mapInArrow(_run(shared, read.index(text_col), bool(decoded_col)), T.StructType(fields))
    new = [F.col("__gw_ids").alias(ids_col)] + ([F.col("__gw_decoded").alias(decoded_col)] if decoded_col else [])
    return out.select(*keep, *new)


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns from doc_id, ids and decoded."""
    return encoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark, sf_dir):
    """Token count and digests of every document's ids and decoded text."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode_bpe(docs, public_tokenizers.path("word_bpe_49k.json"), decoded_col="decoded", keep=["doc_id"]))
