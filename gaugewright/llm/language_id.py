"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Texts become sequences of lower-case letters and marks with one blank between words. Every 4-gram of every labelled
training text is counted; the lower orders are continuation counts, taken from the distinct 4-grams. Each order has
absolute discounting with D = n1 / (n1 + 2 n2). Counting is a partial sum per task and a shuffle of distinct 4-grams.

The tables are sorted arrays of 32-bit key hashes with a value each, for each language, order and kind (probabilities,
back-off weights). At most about ``max_entries`` entries are on the driver or in a broadcast at once. If there are more,
the keys are mixed to 64 bits, one to one, and the tables go out in pieces by range of key; each worker lays the pieces
side by side in an unlinked file of its own and looks keys up in the mapped pages. No key is left out or folded.

The language with the lowest cross-entropy per symbol wins, ties by name. It is rejected if that cross-entropy exceeds
what the language's own texts show: mean + 6 s / sqrt(n) + margin. These are exact quantiles over all training rows of the
language, found by counting rows in ever narrower intervals, so that a few bad labels don't move the limit. At most about
``calibration_rows`` distinct values are then on the driver.

Defined cases: texts that are null or without any letter are ``und`` with score 0 and rejected; texts of any length are
scored whole; training rows with null text or null language are skipped; without any training row everything is
``und``; repeated rows count as often as they occur; further columns pass through.
"""

from __future__ import annotations

import functools
import math
import tempfile
import unicodedata
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm.common import crc32_mod3, discard, materialize, small_batches, utf8_views

ORDER = 4
BEGIN = 1
BLANK = 32
SLICE = 300_000
#: Size of the uniform distribution below the unigrams.
SYMBOLS = 4096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def symbol_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its 16-bit symbol (BLANK if neither letter nor mark), and whether it is a letter."""
    symbols = np.full(0x110000, BLANK, np.uint16)
    letters = np.zeros(0x110000, bool)
    for cp in range(0x110000):
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            low = c.lower()
            code = ord(low) if len(low) == 1 else cp
            symbols[cp] = (code ^ code >> 16 << 3) & 0xFFFF
            letters[cp] = kind == "L"
    symbols[0] = BEGIN
    return symbols, letters


def packed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of all texts packed in 64 bits, how many each text has, and how many letters."""
    symbols, letters = symbol_tables()
    pad = "\0" * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(t.replace("\0", " ") for t in texts)).encode("utf-32-le", "replace"), "<u4")
    sym = symbols[codes]
    owner = np.repeat(np.arange(len(texts)), [len(t) + ORDER - 1 for t in texts])
    n_letters = np.bincount(owner, weights=letters[codes], minlength=len(texts)).astype(np.int64)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != BLANK) | (sym[:-1] != BLANK) & (sym[:-1] != BEGIN)
    sym, owner = sym[keep].astype(np.uint64), owner[keep]
    grams = sym.copy()
    for k in range(1, ORDER):
        grams[k:] |= sym[:-k] << np.uint64(16 * k)
    real = sym != BEGIN
    return grams[real], np.bincount(owner[real], minlength=len(texts)), n_letters


def _slices(sizes: list[int]):
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= SLICE):
            total += sizes[end]
            end += 1
        yield at, end
        at = end


def _text(view) -> str:
    return str(view, "utf-8", "replace") if view is not None else ""


class _Counts:
    """Counts of 4-grams by language, kept as sorted arrays and merged when there are many."""

    def __init__(self, limit: int = 400_000) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.rows, self.limit = 0, limit

    def add(self, lang: str, grams: np.ndarray) -> None:
        found, n = np.unique(grams, return_counts=True)
        self.parts.setdefault(lang, []).append((found, n))
        self.rows += len(found)
        if self.rows > 2 * self.limit:
            self.merge()

    def merge(self) -> None:
        for lang, parts in self.parts.items():
            if len(parts) > 1:
                keys, first = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                self.parts[lang] = [(keys, np.bincount(first, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64))]
        self.rows = sum(len(k) for parts in self.parts.values() for k, _ in parts)

    def taken(self):
        self.merge()
        for lang, parts in self.parts.items():
            for keys, n in parts:
                yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int8)), pa.array([lang])).dictionary_decode(), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
        self.parts, self.rows = {}, 0


def _count(batches):
    """(lang, gram, n) partial counts."""
    counts = _Counts()
    for batch in batches:
        langs = batch.column(1).to_pylist()
        texts = utf8_views(batch.column(0))
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for lang, view in zip(langs, texts, strict=True):
            held.setdefault(lang, []).append(_text(view))
            size[lang] = size.get(lang, 0) + len(held[lang][-1])
            if size[lang] > SLICE:
                counts.add(lang, packed_grams(held.pop(lang))[0])
                size[lang] = 0
        for lang, rest in held.items():
            counts.add(lang, packed_grams(rest)[0])
        if counts.rows > counts.limit:
            counts.merge()
            if counts.rows > counts.limit:
                yield from counts.taken()
    yield from counts.taken()


def slots(keys: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Key hashes of ``bits`` bits; of 64 (signed, as Spark sorts them) each key has its own."""
    k = keys.astype(np.uint64)
    k = (k ^ (k >> np.uint64(31)) ^ np.uint64(order)) * MULTIPLIER
    k = (k ^ (k >> np.uint64(29))) * MULTIPLIER
    return k.view(np.int64) if bits == 64 else (k >> np.uint64(64 - bits)).astype(np.uint32)


def _folded(bits: int):
    def run(batches):
        for batch in batches:
            key, order = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 1))
            slot = np.zeros(len(key), np.int64)
            for o in np.unique(order):
                at = order == o
                slot[at] = slots(key[at].view(np.uint64), int(o), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(slot), batch.column(4)], names=["lang", "ord", "kind", "slot", "value"])

    return run


@dataclass
class LanguageModels:
    """tables[lang][order] = (slots, probabilities, context slots, back-off weights); limits[lang] = (mean, s, margin).

    Large tables are in ``pieces`` instead: broadcasts of [((lang, order, kind), slots, values)], ranges of slots in order,
    with the rows of each table in ``sizes``.
    """

    langs: list[str]
    bits: int
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    limits: dict[str, tuple[float, float, float]]
    pieces: list = field(default_factory=list)
    sizes: dict[tuple[int, int, int], int] = field(default_factory=dict)

    def assembled(self, pieces: list) -> LanguageModels:
        """These models with the tables of all pieces in one mapped file, which holds no name and ends with its process."""
        total = max(1, sum(self.sizes.values()))
        keys, values = (np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=total) for kind in (np.int64, np.float64))
        starts = dict(zip(self.sizes, np.cumsum([0, *self.sizes.values()])[:-1].tolist(), strict=True))
        ends = dict(starts)
        for piece in pieces:
            for table, slot, value in piece.value:
                at = ends[table]
                keys[at : at + len(slot)], values[at : at + len(slot)] = slot, value
                ends[table] = at + len(slot)
            piece.__dict__.pop("_value", None)  # a broadcast keeps what it has read
        tables = []
        for k in range(len(self.langs)):
            per = []
            for o in range(1, ORDER + 1):
                cut = [slice(starts.get((k, o, kind), 0), ends.get((k, o, kind), 0)) for kind in (0, 1)]
                per.append((keys[cut[0]], values[cut[0]], keys[cut[1]], values[cut[1]]))
            tables.append(per)
        return replace(self, tables=tables)

    def log2_probs(self, grams: np.ndarray) -> np.ndarray:
        """[grams, langs] log2 of the interpolated probability of each 4-gram's last symbol."""
        out = np.empty((len(grams), len(self.langs)))
        cut = [grams & np.uint64((1 << 16 * o) - 1) if o < 4 else grams for o in range(1, ORDER + 1)]
        at = [(slots(g, o, self.bits), slots(g >> np.uint64(16), o + 8, self.bits)) for o, g in enumerate(cut, 1)]
        for k, orders in enumerate(self.tables):
            p = np.full(len(grams), 1.0 / SYMBOLS)
            for (gram, context), (keys, probs, contexts, weights) in zip(at, orders, strict=True):
                p = _looked_up(keys, probs, gram, 0.0) + _looked_up(contexts, weights, context, 1.0) * p
            out[:, k] = np.log2(p)
        return out


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), absent)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], absent)


class Scorer:
    """Cross-entropies with a memo of the 4-grams met so far."""

    def __init__(self, models: LanguageModels) -> None:
        self.models = models
        self.keys, self.rows = np.empty(0, np.uint64), np.empty((0, len(models.langs)))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[texts, langs] bits per symbol, symbols and letters of each text."""
        grams, lengths, letters = packed_grams(texts)
        which, distinct = pd.factorize(grams)
        distinct = np.asarray(distinct)
        at = np.searchsorted(self.keys, distinct)
        new = distinct[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != distinct)] if len(self.keys) else distinct
        if len(new):
            if len(self.keys) + len(new) > 300_000:
                self.keys, self.rows, new = np.empty(0, np.uint64), np.empty((0, len(self.models.langs))), distinct
            keys = np.concatenate((self.keys, new))
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], np.concatenate((self.rows, self.models.log2_probs(new)))[order]
            at = np.searchsorted(self.keys, distinct)
        rows = self.rows[at]
        owner = np.repeat(np.arange(len(texts)), lengths)
        bits = np.stack([-np.bincount(owner, weights=rows[which, k], minlength=len(texts)) for k in range(rows.shape[1])], axis=1)
        return bits / np.maximum(lengths, 1)[:, None], lengths, letters


_SCORERS: list[tuple[LanguageModels, Scorer]] = []


def _scorer_of(shared, pieces: list) -> Scorer:
    """This worker's scorer of the broadcast models; its memo outlives a task."""
    models = shared.value
    if not _SCORERS or _SCORERS[0][0] is not models:
        _SCORERS.clear()
        _SCORERS.append((models, Scorer(models.assembled(pieces) if pieces else models)))
    return _SCORERS[0][1]


def _entropy_rows(shared, pieces: list):
    """(lang, n, bits) of texts under their own language."""

    def run(batches):
        for batch in batches:
            scorer = _scorer_of(shared, pieces)
            at = {x: k for k, x in enumerate(scorer.models.langs)}
            texts, langs = [_text(v) for v in utf8_views(batch.column(0))], batch.column(1).to_pylist()
            for a, b in _slices([len(t) for t in texts]):
                bits, lengths, _ = scorer.entropies(texts[a:b])
                own = [(x, int(n), float(h[at[x]])) for x, n, h in zip(langs[a:b], lengths, bits, strict=True) if n]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64()))], names=["lang", "n", "bits"])

    return run


def _predict(shared, pieces: list, text_at: int):
    def run(batches):
        for batch in batches:
            scorer = _scorer_of(shared, pieces)
            m = scorer.models
            sizes = [len(v) if v is not None else 0 for v in utf8_views(batch.column(text_at))]
            views = utf8_views(batch.column(text_at))
            found: list[tuple[str, float, float | None, bool]] = []
            for a, b in _slices(sizes):
                texts = [_text(next(views)) for _ in range(b - a)]
                if not m.langs:
                    found += [("und", 0.0, None, True)] * (b - a)
                    continue
                bits, lengths, letters = scorer.entropies(texts)
                best = bits.argmin(axis=1)
                low = bits[np.arange(b - a), best]
                share = 1.0 / np.exp2((low[:, None] - bits) * np.sqrt(lengths)[:, None]).sum(axis=1)
                for k, lang in enumerate(best):
                    if not letters[k]:
                        found.append(("und", 0.0, None, True))
                        continue
                    mean, s, margin = m.limits[m.langs[lang]]
                    limit = mean + 6 * s / math.sqrt(lengths[k]) + margin
                    found.append((m.langs[lang], float(share[k]), float(low[k]), bool(low[k] > limit)))
            new = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "__gw_lang", "__gw_score", "__gw_bits", "__gw_rejected"])

    return run


def _tables(counts: DataFrame) -> DataFrame:
    """(lang, ord, kind, key, value): discounted probabilities (kind 0) and back-off weights by context (kind 1)."""
    levels, now = {}, counts.select("lang", F.col("gram").alias("key"), F.col("n").alias("c"))
    levels[ORDER] = now
    for o in range(ORDER - 1, 0, -1):
        now = now.select("lang", F.col("key").bitwiseAND(F.lit((1 << 16 * o) - 1)).alias("key")).groupBy("lang", "key").agg(F.count(F.lit(1)).alias("c"))
        levels[o] = now
    out = None
    for o, level in levels.items():
        once = level.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
        d = once.select("lang", F.coalesce(F.try_divide(F.col("n1").cast("double"), F.col("n1") + 2.0 * F.col("n2")), F.lit(0.5)).alias("d")).withColumn("d", F.greatest(F.least("d", F.lit(0.95)), F.lit(0.05)))
        context = level.withColumn("ctx", F.shiftrightunsigned("key", 16))
        totals = context.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types")).join(d, "lang")
        probs = context.join(totals, ["lang", "ctx"]).select("lang", F.lit(o).alias("ord"), F.lit(0).alias("kind"), "key", ((F.greatest(F.col("c") - F.col("d"), F.lit(0.0))) / F.col("total")).alias("value"))
        weights = totals.select("lang", F.lit(o + 8).alias("ord"), F.lit(1).alias("kind"), F.col("ctx").alias("key"), (F.col("d") * F.col("types") / F.col("total")).alias("value"))
        both = probs.unionByName(weights)
        out = both if out is None else out.unionByName(both)
    return out


FOLDED = "lang string, ord int, kind int, slot long, value double"


def _whole_tables(entries: DataFrame, langs: list[str]) -> list:
    """The tables as arrays, of 32-bit slots."""
    folded = entries.mapInArrow(_folded(32), FOLDED).groupBy("lang", "ord", "slot").agg(F.max("value").alias("value"))
    got = folded.toArrow()
    lang, order = np.array(got["lang"].to_pylist(), object), got["ord"].to_numpy()
    slot, value = got["slot"].to_numpy().astype(np.uint32), got["value"].to_numpy()
    tables = []
    for one in langs:
        per = []
        for o in range(1, ORDER + 1):
            pair = []
            for code in (o, o + 8):
                at = np.nonzero((lang == one) & (order == code))[0]
                at = at[np.argsort(slot[at])]
                pair += [slot[at], value[at]]
            per.append(tuple(pair))
        tables.append(per)
    return tables


def _table_pieces(entries: DataFrame, langs: list[str], n: int) -> tuple[list, dict[tuple[int, int, int], int]]:
    """Broadcasts of n ranges of 64-bit slots, one after the other on the driver, and the rows of each table."""
    context = entries.sparkSession.sparkContext
    names = F.array(*[F.lit(x) for x in langs])
    hashed = entries.mapInArrow(_folded(64), FOLDED).select((F.array_position(names, F.col("lang")) - 1).cast("byte").alias("lang"), F.col("ord").cast("byte").alias("ord"), "slot", "value")
    hashed = materialize(hashed.repartitionByRange(n, "slot").sortWithinPartitions("slot"), "tablepieces")
    cuts = [-(1 << 63) + (k << 64) // n for k in range(n)] + [(1 << 63) - 1]
    pieces, sizes = [], {}
    for k in range(n):
        last = F.col("slot") <= cuts[k + 1] if k == n - 1 else F.col("slot") < cuts[k + 1]
        got = hashed.where((F.col("slot") >= cuts[k]) & last).toArrow()
        lang, order, slot, value = (got[c].to_numpy() for c in ("lang", "ord", "slot", "value"))
        del got
        table = lang.astype(np.int16) * 16 + order
        by = np.lexsort((slot, table))
        table, slot, value = table[by], slot[by], value[by]
        found, first = np.unique(table, return_index=True)
        piece = []
        for one, a, b in zip(found.tolist(), first, [*first[1:], len(table)], strict=True):
            name = (one // 16, (one % 16 - 1) % 8 + 1, one % 16 // 9)
            piece.append((name, slot[a:b], value[a:b]))
            sizes[name] = sizes.get(name, 0) + int(b - a)
        pieces.append(context.broadcast(piece))
    discard(hashed)
    return pieces, sizes


def exact_percentiles(df: DataFrame, key: str, value, share: float, most: int = 20_000, bins: int = 256) -> dict[str, float]:
    """The percentile of ``value`` (a column; nulls are left out) for each of the few keys, interpolated as F.percentile does.

    Each pass counts the rows of a key's interval by bin, as partial sums, and goes on with the bin that holds the rank. Intervals
    of few rows are then counted by value. All rows count; no task and no driver holds a key's rows.
    """
    rows = df.select(F.col(key).alias("key"), value.cast("double").alias("v")).where("v is not null")
    found, open_ = {}, {}

    def settle(x: str, rank: float, parts: list[tuple[int, float, float]], below: int) -> None:
        """parts: (rows, least, greatest) in order, ``below`` rows before them."""
        low, high = math.floor(rank), math.ceil(rank)
        ends = []
        for n, least, greatest in parts:
            if below <= low < below + n and high < below + n and least < greatest:
                open_[x] = (rank, below, n, least, greatest)
                return
            ends += [(least if r == below else greatest) for r in (low, high) if below <= r < below + n]
            below += n
        found[x] = ends[0] + (ends[-1] - ends[0]) * (rank - low)

    for r in rows.groupBy("key").agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect():
        settle(r["key"], share * (r["n"] - 1), [(r["n"], r["a"], r["b"])], 0)
    while open_:
        now, open_ = open_, {}
        each = max(1, most // len(now))
        inside = F.coalesce(*[F.when((F.col("key") == x) & F.col("v").between(a, b), F.lit(k)) for k, (x, (_, _, _, a, b)) in enumerate(now.items())])
        place = F.coalesce(*[F.when(F.col("k") == k, F.col("v") if n <= each else F.floor((F.col("v") - a) / F.lit(b - a) * bins).cast("double")) for k, (_, _, n, a, b) in enumerate(now.values())])
        counts = rows.select(inside.alias("k"), "v").where("k is not null").groupBy("k", place.alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        for k, (x, (rank, below, *_)) in enumerate(now.items()):
            settle(x, rank, [(r["n"], r["a"], r["b"]) for r in sorted((r for r in counts if r["k"] == k), key=lambda r: r["a"])], below)
    return found


def _limits(known: DataFrame, shared, pieces: list, most: int) -> dict[str, tuple[float, float, float]]:
    """mean, s and margin of each language from all of its labelled texts.

    All three are quantiles: mean the median, s of the lower three quarters of the deviations, and the margin of the excesses
    of rows not far beyond, so that rows of another language or of garbage move them little while they are few.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n", T.LongType()), T.StructField("bits", T.DoubleType())])
    measured = materialize(known.mapInArrow(_entropy_rows(shared, pieces), schema), "entropies")

    def looked_up(values: dict[str, float]):
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("lang"))

    means = exact_percentiles(measured, "lang", F.col("bits"), 0.5, most)
    if means:
        root = F.sqrt("n")
        off = F.col("bits") - looked_up(means)
        spans = {x: v / 1.15 for x, v in exact_percentiles(measured, "lang", F.abs(off) * root, 0.75, most).items()}
        over = F.greatest(F.lit(0.0), off - 6 * looked_up(spans) / root)
        margins = exact_percentiles(measured, "lang", F.when(over <= 0.75, over), 0.99, most)
        means = {x: (m, spans[x], margins.get(x, 0.0) + 0.75) for x, m in means.items()}
    discard(measured)
    return means


def fit_language_models(train: DataFrame, text_col: str = "text", lang_col: str = "lang", max_entries: int = 1 << 23, max_languages: int = 64, calibration_rows: int = 20_000) -> LanguageModels:
    """Models of every language in train; counts and limits cover all of it."""
    spark = train.sparkSession
    small_batches(spark)
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    counts = materialize(rows.mapInArrow(_count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    if len(rows.select("lang").distinct().take(max_languages + 1)) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        discard(counts)
        return LanguageModels([], 1, [], {})
    entries = materialize(_tables(counts), "tables")
    discard(counts)
    limits = {x: (0.0, 0.0, math.inf) for x in langs}
    n_entries = entries.count()
    if n_entries <= max_entries:
        models = LanguageModels(langs, 32, _whole_tables(entries, langs), limits)
    else:
        pieces, sizes = _table_pieces(entries, langs, math.ceil(n_entries / max_entries))
        models = LanguageModels(langs, 64, [], limits, pieces, sizes)
    discard(entries)
    shared = spark.sparkContext.broadcast(replace(models, pieces=[]))
    models.limits.update(_limits(rows.where(F.col("lang").isin(langs)), shared, models.pieces, calibration_rows))
    shared.unpersist()
    return models


def predict_languages(docs: DataFrame, models: LanguageModels, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, bits (per symbol; null for und) and rejected; columns of these names are replaced."""
    new = ["lang_pred", "score", "bits", "rejected"]
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(replace(models, pieces=[]))
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"__gw_{n}", k) for n, k in zip(("lang", "score", "bits", "rejected"), kinds, strict=True)])
    out = docs.select(*keep).mapInArrow(_predict(shared, models.pieces, keep.index(text_col)), schema)
    return out.withColumnsRenamed(dict(zip(("__gw_lang", "__gw_score", "__gw_bits", "__gw_rejected"), new, strict=True)))


def labelled(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from, whatever their doc_id; a fold that is held out is taken off before."""
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")


def op6_language_id(spark, sf_dir):
    """Language of every document, from models of the documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = fit_language_models(labelled(docs.where(F.col("doc_id").isNotNull() & (crc32_mod3() != 1))))
    out = predict_languages(docs.select("doc_id", "text"), models)
    return out.select("doc_id", (crc32_mod3() == 1).alias("held_out"), "lang_pred", "score", "bits", "rejected")
