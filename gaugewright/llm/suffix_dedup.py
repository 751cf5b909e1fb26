r"""Exact substring dedup over an enhanced suffix array that is sampled, split by content and scanned in parts.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else goes. Besides, documents that hold a
passage of over 50 words which another document holds too are marked, as such a passage may be shorter than ``length``. One
suffix array of all positions would be hundreds of times the corpus, so it is sampled: winnowing picks positions (anchors)
such that every string of ``least`` bytes holds one, and equal strings hold equal ones at equal offsets. Suffixes that start
at anchors are grouped by the anchor's first ``seed`` bytes: the corpus' suffix array, cut at common prefixes of that length.

1. Anchors (16 bytes of hashes and a position each) are counted by prefix; prefixes that occur once are left behind.
2. Anchors whose whole surroundings (all strings of ``length`` that hold the anchor) are equal form a class: two members
   prove each other, without any text. A class goes on as one representative.
3. A prefix with several classes is an interval of the suffix array. Its representatives arrive sorted by what follows
   (the suffix array), the longest common prefixes of neighbours are taken, and a stack scan yields the interval tree.
   In every interval the left extensions are compared in sorted order, and each member learns how far it agrees to the
   left with the best of all others. A member is covered from its longest left to its longest right agreement among those
   of ``length`` bytes together. ``maximal_repeats`` gives the groups themselves: runs of the sorted left extensions whose
   members' extensions are diverse on both sides, with all occurrences.
4. Anchors are never taken inside runs of a period of at most ``PERIOD`` bytes, where all of them would be alike: a string
   that isn't all run holds another anchor. What lies in runs is counted by hash as in 5.
5. Prefixes with more than ``group_rows`` classes are scanned at full depth instead: their strings of ``length`` bytes and
   their passages are counted by 128-bit hash, so that no task holds such a group. The result is the same.

A passage is the shortest run of whole words, from a word on, that has at least ``words`` words and ``least`` bytes, if it
has at most 2 ``length`` - ``least`` - 2 bytes (598); words are runs of bytes but [\x20\x09-\x0D]. A longer run of 51 words
holds a string of ``length`` bytes anyway.

Defined cases: texts are UTF-8 bytes, null is the empty text; texts shorter than ``length`` lose nothing; each row is a
document, so repeated rows of at least ``length`` bytes lose everything, but rows of equal id and text are one document
where passages are concerned; ids may be null; matches never cross documents; texts of any length are read whole, in
overlapping parts; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.llm.common import discard, materialize, small_batches, utf8_views

PART = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)
PERIOD = 16
WORD = re.compile(rb"[^ \t-\r]+")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Shape:
    """Bytes of a repeat, of an anchor and of the shortest passage; words of a passage."""

    length: int = 400
    seed: int = 64
    least: int = 200
    words: int = 51

    @property
    def before(self) -> int:
        """How far the surroundings of an anchor reach to the left; to the right they reach ``length`` bytes."""
        return self.length - self.seed

    @property
    def most(self) -> int:
        return 2 * self.length - self.least - 2


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64, and a random number for each byte."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed rolling hash of every run of ``size`` bytes."""
    n = len(data)
    up, down, table = _powers(1 << max(12, int(n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * down[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * up[: n - size + 1]
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values."""
    f, fill = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    n = len(values)
    rows = np.full(-(-n // width) * width, fill, np.uint64)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    ahead = f.accumulate(rows, axis=1).ravel()
    back = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, least: int, seed: int, periodic: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the sampled runs of ``seed`` bytes: the least of each ``least - seed + 1`` in a row, but for
    those that are ``periodic``.
    """
    width, last = least - seed + 1, np.iinfo(np.uint64).max
    data, at, got = np.frombuffer(raw, np.uint8), 0, []
    while at + least <= len(data):
        part = data[at : at + PART + least - 1]
        h = gram_hashes(part, seed)
        if periodic is not None:
            h[periodic[at : at + len(h)]] = last
        low = _sliding(h, width, True)
        edge = np.zeros(width - 1, np.uint64)
        chosen = np.nonzero((_sliding(np.concatenate((edge, low, edge)), width, False) == h) & (h != last))[0]
        got.append((chosen + at, h[chosen]))
        at += PART
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    where, h = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
    where, first = np.unique(where, return_index=True)
    return where, h[first]


def longest_period(seed: int) -> int:
    """A quarter of a seed at most, so that seeds which overlap in all but one byte have one period."""
    return max(1, min(PERIOD, seed // 4))


def periodic_seeds(data: np.ndarray, seed: int) -> np.ndarray:
    """Which runs of ``seed`` bytes have a short period."""
    out = np.zeros(max(0, len(data) - seed + 1), bool)
    for q in range(1, longest_period(seed) + 1):
        differs = np.concatenate(([0], np.cumsum(data[:-q] != data[q:])))
        n = len(out)
        out |= differs[seed - q : seed - q + n] == differs[:n]
    return out


def any_periodic(data: np.ndarray, where: np.ndarray, seed: int) -> np.ndarray:
    """Which of the runs of ``seed`` bytes at ``where`` are periodic."""
    longest = longest_period(seed)
    head = min(8, seed - longest)
    near = data[where[:, None] + np.arange(head + longest)]
    maybe = np.zeros(len(where), bool)
    for q in range(1, longest + 1):
        maybe |= (near[:, q] == near[:, 0]) & (near[:, q + head - 1] == near[:, head - 1]) & (near[:, q : q + head] == near[:, :head]).all(axis=1)
    out, rows = np.zeros(len(where), bool), data[where[maybe][:, None] + np.arange(seed)]
    for q in range(1, longest + 1):
        out[maybe] |= (rows[:, :-q] == rows[:, q:]).all(axis=1)
    return out


def runs_of(periodic: np.ndarray, seed: int, least: int) -> list[tuple[int, int]]:
    """[from, to) of the maximal runs of at least ``least`` bytes whose seeds are all periodic."""
    edge = np.diff(np.concatenate(([False], periodic, [False])).astype(np.int8))
    pairs = zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True)
    return [(a, b + seed - 1) for a, b in pairs if b + seed - 1 - a >= least]


def period_of(run: bytes) -> int:
    return next(q for q in range(1, PERIOD + 1) if run[q:] == run[:-q])


class Passages:
    """The passages of texts that lie one after the other in ``data``, cut at ``ends``."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, shape: Shape) -> None:
        blank = _BLANK[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:] = False
        cut[ends[ends <= len(data)]] = True
        before, after = np.append(True, blank) | cut, np.append(blank, True) | cut
        self.starts = np.nonzero(~blank & before[:-1])[0]
        stops = np.nonzero(~blank & after[1:])[0] + 1
        owner = np.searchsorted(ends, self.starts, "right")
        last = np.maximum(np.arange(len(stops)) + shape.words - 1, np.searchsorted(stops, self.starts + shape.least))
        fine = last < len(stops)
        last[~fine] = 0
        fine &= owner[last] == owner if len(owner) else fine
        end = np.where(fine, stops[last] if len(stops) else 0, len(data) + 2)
        end[end - self.starts > shape.most] = len(data) + 2
        self.least_end = np.append(np.minimum.accumulate(end[::-1])[::-1], len(data) + 2)

    def within(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether [a, b) holds a passage."""
        return self.least_end[np.searchsorted(self.starts, a)] <= b


def _parts(batch: pa.RecordBatch):
    """(first row, texts) of a batch in parts of at most 8 MB, or of one text."""
    views, at = [v or b"" for v in utf8_views(batch.column(2))], 0
    while at < len(views):
        end, size = at, 0
        while end < len(views) and (end == at or size + len(views[end]) <= 8 << 20):
            size += len(views[end])
            end += 1
        yield at, views[at:end]
        at = end


def _anchor_rows(shape: Shape, names: list[str]):
    """(id, mark, at, head, whole, fits, passage, key) of the anchors; texts with long periodic runs add rows with a key."""

    def run(batches):
        for batch in batches:
            for at, views in _parts(batch):
                yield from part(batch, at, views)

    def part(batch, base, views):
        found = [(i, *anchors(v, shape.least, shape.seed)) for i, v in enumerate(views) if len(v) >= shape.least]
        if not found:
            return
        data = np.frombuffer(b"".join(views), np.uint8)
        ends = np.cumsum([len(v) for v in views])
        begins = ends - [len(v) for v in views]
        flat = np.concatenate([w + begins[i] for i, w, _ in found])
        owner = np.repeat([i for i, _, _ in found], [len(w) for _, w, _ in found])
        odd = set(owner[any_periodic(data, flat, shape.seed)].tolist())
        told = []
        for k, (i, _, _) in enumerate(found):
            if i in odd:
                text = data[begins[i] : ends[i]]
                periodic = periodic_seeds(text, shape.seed)
                found[k] = (i, *anchors(views[i], shape.least, shape.seed, periodic))
                told += [(i + base, *x) for x in _run_rows(bytes(views[i]), runs_of(periodic, shape.seed, shape.least), shape)]
        rows = np.concatenate([np.full(len(w), i + base, np.int64) for i, w, _ in found])
        where, heads = np.concatenate([w for _, w, _ in found]), np.concatenate([h for _, _, h in found])
        digest, wholes, spans = xxhash.xxh3_64_intdigest, [], []
        for i, w, _ in found:
            view, n = views[i], len(views[i])
            a, b = np.maximum(0, w - shape.before), np.minimum(n, w + shape.length)
            wholes.append(np.fromiter((digest(view[x:y], p - x) for x, y, p in zip(a.tolist(), b.tolist(), w.tolist(), strict=True)), np.uint64, len(w)))
            # Words at an end of the surroundings are whole in all members only if the text ends there in all of them.
            spans.append((a + begins[i] + (w - a == shape.before), b + begins[i] - (b - w == shape.length), b - a >= shape.length))
        a, b, fits = (np.concatenate(x) for x in zip(*spans, strict=True))
        held = Passages(data, ends, shape).within(a, b)
        take = pa.array(rows)
        columns = [where.astype(np.int32), heads.view(np.int64), np.concatenate(wholes).view(np.int64), fits, held]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, columns), pa.nulls(len(rows), pa.binary())], names=names)
        if told:
            take = pa.array([x[0] for x in told])
            columns = [pa.array([x[1] for x in told], pa.int32()), pa.nulls(len(told), pa.int64()), pa.nulls(len(told), pa.int64()), pa.array([x[2] for x in told], pa.bool_()), pa.array([x[3] for x in told], pa.bool_()), pa.array([x[4] for x in told], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns], names=names)

    return run


def _run_rows(text: bytes, runs: list[tuple[int, int]], shape: Shape):
    """(at, alone, passage, key) of the strings of ``length`` bytes in periodic runs, one of each, and of the passages of which
    at least ``least`` bytes are run. A string is not alone if the run holds it twice; then all of the run is covered.
    """
    for a, b in runs:
        spare = b - a - shape.length
        if spare >= 0:
            q = period_of(text[a:b])
            for k in range(min(spare, q - 1) + 1):
                yield a + k, spare < q, False, xxhash.xxh3_128_digest(text[a + k : a + k + shape.length])
            if spare >= q:
                for k in range(a, b - shape.length, shape.length):
                    yield k, True, False, None
                yield b - shape.length, True, False, None
    if runs:
        seen = set()
        for a, b in runs:
            low, high = max(0, a - shape.most), min(len(text), b + shape.most)
            open_left, open_right = low == 0 or bool(_BLANK[text[low - 1]]), high == len(text) or bool(_BLANK[text[high]])
            for x, y in passage_spans(text[low:high], shape, open_left, open_right):
                if min(y + low, b) - max(x + low, a) >= shape.least:
                    key = xxhash.xxh3_128_digest(text[x + low : y + low])
                    if key not in seen:
                        seen.add(key)
                        yield x + low, True, True, key


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    if a[known:] == b[known:]:
        return len(a)
    return len(os.path.commonprefix((a[known:], b[known:]))) + known


def lcp_intervals(lcp: list[int], floor: int):
    """(depth, first, last) of the intervals deeper than floor, children first; lcp[i] is between suffixes i - 1 and i."""
    stack = [(floor, 0)]
    for i in range(1, len(lcp) + 1):
        now, left = (lcp[i] if i < len(lcp) else floor), i - 1
        while now < stack[-1][0]:
            depth, left = stack.pop()
            yield depth, left, i - 1
        if now > stack[-1][0]:
            stack.append((now, left))


class LeftExtensions:
    """Left agreement of any members: positions in the sorted reversed left contexts, and range minima of neighbours."""

    def __init__(self, lefts: list[bytes]) -> None:
        order = sorted(range(len(lefts)), key=lefts.__getitem__)
        self.rank = np.empty(len(lefts), np.int64)
        self.rank[order] = np.arange(len(lefts))
        near = [common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)]
        self.levels = [np.array(near, np.int64)]
        step = 1
        while 2 * step <= len(near):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The agreement of the left contexts of ranks a < b."""
        level = np.log2(b - a).astype(np.int64)
        level -= (1 << level) > b - a
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            table = self.levels[k]
            out[at] = np.minimum(table[a[at]], table[b[at] - (1 << k)])
        return out

    def best(self, members: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        """The longest left agreement of each member with any other of them, or of another owner (-1 if there is none)."""
        rank = self.rank[members]
        order = np.argsort(rank)
        ranks = rank[order]
        out = np.full(len(members), -1, np.int64)
        if owner is None:
            pairs = self._between(ranks[:-1], ranks[1:])
            out[order[:-1]] = pairs
            out[order[1:]] = np.maximum(out[order[1:]], pairs)
            return out
        run = np.concatenate(([0], np.cumsum(np.diff(owner[members][order]) != 0)))
        first = np.searchsorted(run, run)
        after = np.searchsorted(run, run, "right")
        for at, a, b in ((first > 0, first - 1, None), (after < len(run), None, after)):
            i = np.nonzero(at)[0]
            if len(i):
                pairs = self._between(ranks[a[i]], ranks[i]) if b is None else self._between(ranks[i], ranks[b[i]])
                out[order[i]] = np.maximum(out[order[i]], pairs)
        return out


def maximal_repeats(rights: list[bytes], lefts: list[bytes], length: int, floor: int):
    """(left, right, members) of every maximal repeat of at least ``length`` bytes around the anchor, all occurrences.

    ``rights`` are sorted, ``lefts`` are reversed. In each interval of the right contexts the left contexts are sorted in
    their turn: an interval of these is a repeat whose left extensions are diverse. It is a maximal one if its right
    extensions are diverse too, that is, unless all of its members lie in one child of the right interval.
    """
    lcp = [0] + [common_prefix(a, b, floor) for a, b in zip(rights, rights[1:], strict=False)]
    for depth, first, last in lcp_intervals(lcp, floor - 1):
        child = np.cumsum([0, *[lcp[i] <= depth for i in range(first + 1, last + 1)]])
        order = sorted(range(first, last + 1), key=lefts.__getitem__)
        agree = [0] + [common_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)]
        for left, a, b in lcp_intervals(agree, -1):
            members = order[a : b + 1]
            if left + depth >= length and len({int(child[m - first]) for m in members}) > 1:
                yield left, depth, sorted(members)


def covered(rights: list[bytes], lefts: list[bytes], length: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes to the left and right of each anchor are in repeats of ``length`` bytes; zeros if none."""
    to_left, to_right = np.zeros(len(rights), np.int64), np.zeros(len(rights), np.int64)
    for depth, members, left in _intervals(rights, lefts, floor):
        agree = left.best(members)
        hit = agree + depth >= length
        at = members[hit]
        to_left[at] = np.maximum(to_left[at], agree[hit])
        to_right[at] = np.maximum(to_right[at], depth)
    return to_left, to_right


def _intervals(rights: list[bytes], lefts: list[bytes], floor: int):
    lcp = [0] + [common_prefix(a, b, floor) for a, b in zip(rights, rights[1:], strict=False)]
    left = LeftExtensions(lefts)
    for depth, first, last in lcp_intervals(lcp, floor - 1):
        yield depth, np.arange(first, last + 1), left


def passage_spans(text: bytes, shape: Shape, open_left: bool, open_right: bool):
    """(from, to) of the passages of a stretch of text; its first and last word are whole if open."""
    spans = [m.span() for m in WORD.finditer(text)]
    if spans and not open_left and spans[0][0] == 0:
        del spans[0]
    if spans and not open_right and spans[-1][1] == len(text):
        del spans[-1]
    j = 0
    for i in range(len(spans) - shape.words + 1):
        a = spans[i][0]
        j = max(j, i + shape.words - 1)
        while j < len(spans) and spans[j][1] < a + shape.least:
            j += 1
        if j == len(spans):
            return
        if spans[j][1] - a <= shape.most:
            yield a, spans[j][1]


def _bounded(context: bytes, at: int, full: int) -> bool:
    """Whether a word may begin or end after ``at`` bytes of a context."""
    return bool(_BLANK[context[at]]) if at < len(context) else len(context) < full


def _common_passage(one: tuple, other: tuple, left: int, right: int, shape: Shape) -> bool:
    """Whether two members that agree for left and right bytes hold a passage there."""
    text = one[0][:left][::-1] + one[1][:right]
    if len(text) < shape.least or len(text.split()) < shape.words:
        return False
    open_left = _bounded(one[0], left, shape.before) and _bounded(other[0], left, shape.before)
    open_right = _bounded(one[1], right, shape.length) and _bounded(other[1], right, shape.length)
    return next(passage_spans(text, shape, open_left, open_right), None) is not None


def shared_passages(members: list[tuple[bytes, bytes]], owner: list[int], shape: Shape) -> np.ndarray:
    """Which of the (left reversed, right), sorted by right, hold a passage that a member of another owner holds as well."""
    found = np.zeros(len(members), bool)
    owners = np.array(owner)
    for depth, every, left in _intervals([m[1] for m in members], [m[0] for m in members], shape.seed):
        agree = left.best(every, owners)
        for k in every[(agree >= 0) & (agree + depth >= shape.least) & ~found[every]].tolist():
            own, l = members[k], int(agree[k - every[0]])
            text = own[0][:l][::-1] + own[1][:depth]
            if len(text.split()) < shape.words:
                continue
            if next(passage_spans(text, shape, False, False), None):
                found[k] = True
            elif next(passage_spans(text, shape, True, True), None):
                for q in every.tolist():
                    if owner[q] != owner[k]:
                        other = members[q]
                        if _common_passage(own, other, common_prefix(own[0], other[0]), common_prefix(own[1], other[1]), shape):
                            found[k] = True
                            break
    return found


def _contexts(shape: Shape, names: list[str]):
    """(id, mark, at, head, alone, multi, hot, left reversed, right) of the representatives a document holds."""

    def run(batches):
        for batch in batches:
            ids, marks, lists = batch.column(0), batch.column(1), batch.column(3)
            rows, out = [], []
            for i, view in enumerate(_unpacked(batch.column(2))):
                for r in lists[i].as_py() or ():
                    p = r["at"]
                    rows.append(i)
                    out.append((p, r["head"], r["alone"], r["multi"], r["hot"], bytes(view[max(0, p - shape.before) : p])[::-1], bytes(view[p : p + shape.length])))
                if len(out) > 20_000:
                    yield flushed(ids, marks, rows, out)
                    rows, out = [], []
            if rows:
                yield flushed(ids, marks, rows, out)

    def flushed(ids, marks, rows, out):
        take = pa.array(rows, pa.int64())
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([ids.take(take), marks.take(take), *[pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]], names=names)

    return run


def _scan(shape: Shape, names: list[str]):
    """Group by group of sorted rows: spans of the members that stand alone in their class, and who holds shared passages."""
    length, seed = shape.length, shape.seed

    def spans(group):
        """(id, mark, from, to, elsewhere)."""
        if len(group) == 2:
            a, b = group
            left, right = common_prefix(a[5], b[5]), common_prefix(a[6], b[6], seed)
            out = [(g[0], g[1], g[2] - left, g[2] + right, False) for g in group if g[3]] if left + right >= length else []
            if left + right >= shape.least and (a[:2] != b[:2] or a[4] or b[4]) and _common_passage(a[5:7], b[5:7], left, right, shape):
                out += [(g[0], g[1], None, None, True) for g in group]
            return out
        lefts, rights = [g[5] for g in group], [g[6] for g in group]
        left, right = covered(rights, lefts, length, seed)
        out = [(g[0], g[1], g[2] - int(a), g[2] + int(b), False) for g, a, b in zip(group, left, right, strict=True) if b and g[3]]
        docs: dict = {}
        owner = [len(group) + k if g[4] else docs.setdefault(g[:2], len(docs)) for k, g in enumerate(group)]
        if len(set(owner)) > 1:
            held = shared_passages(list(zip(lefts, rights, strict=True)), owner, shape)
            out += [(g[0], g[1], None, None, True) for g, h in zip(group, held, strict=True) if h]
        return out

    def run(batches):
        head, group, kinds = None, [], None

        def flushed(out):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            kinds = (batch.column(0).type, batch.column(1).type, pa.int32(), pa.int32(), pa.bool_())
            out = []
            for one, mark, at, h, alone, multi, left, right in zip(*[batch.column(k).to_pylist() for k in range(8)], strict=True):
                if h != head:
                    if len(group) > 1:
                        out += spans(group)
                    head, group = h, []
                group.append((one, mark, at, alone, multi, left, right))
            if out:
                yield flushed(out)
        if len(group) > 1 and (out := spans(group)):
            yield flushed(out)

    return run


def _full_depth(shape: Shape, names: list[str]):
    """(id, mark, start, alone, key) of every string of ``length`` bytes that holds the anchor."""
    length = shape.length

    def run(batches):
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (2, 3, 4, 6, 7)]
            for i, (at, head, alone, left, right) in enumerate(zip(*cols, strict=True)):
                text = left[::-1] + right
                n = len(text) - length + 1
                if n > 0:
                    starts = np.arange(n) + (at - len(left))
                    keys = [xxhash.xxh3_128_digest(text[k : k + length], (head ^ (len(left) - k)) & (1 << 64) - 1) for k in range(n)]
                    take = pa.array(np.full(n, i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(starts.astype(np.int32)), pa.array([alone] * n), pa.array(keys, pa.binary())], names=names)

    return run


def _hot_passages(shape: Shape, names: list[str]):
    """(id, mark, multi, key) of every passage that holds the anchor."""

    def run(batches):
        for batch in batches:
            rows, keys = [], []
            for i, (left, right) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)):
                text, p = left[::-1] + right, len(left)
                for a, b in passage_spans(text, shape, p < shape.before, len(right) < shape.length):
                    if a <= p and b >= p + shape.seed:
                        rows.append(i)
                        keys.append(xxhash.xxh3_128_digest(text[a:b]))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(5).take(take), pa.array(keys, pa.binary())], names=names)

    return run


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans within [0, n)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        a, b = max(0, a), min(n, b)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _packed(batches):
    """Texts compressed one by one, for the shuffles that only carry them."""
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [z.compress(v) for v in utf8_views(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "mark", "packed"])


def _carried(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_packed, T.StructType([texts.schema["id"], texts.schema["mark"], T.StructField("packed", T.BinaryType())]))


def _unpacked(column: pa.Array):
    z = zstandard.ZstdDecompressor()
    return (z.decompress(v) for v in utf8_views(column))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mark (tells texts of one id apart), text."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("mark"), text.alias("text"))


def _anchors_and_classes(docs: DataFrame, id_col: str, text_col: str, shape: Shape) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """texts; the anchors whose prefix occurs twice; their classes: head, whole, n, rep, multi (of several documents), fits,
    passage; what texts hold in periodic runs: at, fits (alone), passage, key. All but the texts are written.
    """
    small_batches(docs.sparkSession)
    texts = _marked(docs, id_col, text_col)
    rows = T.StructType([*_key(docs, id_col), _field("at", T.IntegerType()), _field("head", T.LongType()), _field("whole", T.LongType()), _field("fits", T.BooleanType()), _field("passage", T.BooleanType()), _field("key", T.BinaryType())])
    found = materialize(texts.mapInArrow(_anchor_rows(shape, rows.names), rows), "anchors")
    twice = materialize(found.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head"), "heads")
    kept = materialize(found.drop("key").join(twice, "head", "left_semi"), "repeated")
    runs = materialize(found.where("head is null").select("id", "mark", "at", "fits", "passage", "key"), "runs")
    discard(found, twice)
    grouped = kept.groupBy("head", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "mark", "at")).alias("rep"), F.max(F.struct("id", "mark")).alias("last_"), F.max("fits").alias("fits"), F.max("passage").alias("passage")
    )
    same_doc = F.col("rep.id").eqNullSafe(F.col("last_.id")) & (F.col("rep.mark") == F.col("last_.mark"))
    return texts, kept, materialize(grouped.withColumn("multi", ~same_doc).drop("last_"), "classes"), runs


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def _key(docs: DataFrame, id_col: str) -> list[T.StructField]:
    return [_field("id", docs.schema[id_col].dataType), _field("mark", T.IntegerType())]


def _representatives(texts: DataFrame, classes: DataFrame, shape: Shape, group_rows: int) -> DataFrame:
    """One representative with its contexts of each class of a prefix with several, written."""
    many = classes.groupBy("head").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    reps = classes.join(many, "head").select("rep.id", "rep.mark", F.struct("rep.at", "head", (F.col("n") == 1).alias("alone"), "multi", (F.col("classes") > group_rows).alias("hot")).alias("r"))
    lists = reps.groupBy("id", "mark").agg(F.collect_list("r").alias("reps")).select(F.col("id").alias("rid"), F.col("mark").alias("rmark"), "reps")
    joined = _carried(texts).join(lists, F.col("id").eqNullSafe(F.col("rid")) & (F.col("mark") == F.col("rmark"))).select("id", "mark", "packed", "reps")
    flags = [_field(c, T.BooleanType()) for c in ("alone", "multi", "hot")]
    out = T.StructType([texts.schema["id"], texts.schema["mark"], _field("at", T.IntegerType()), _field("head", T.LongType()), *flags, _field("left", T.BinaryType()), _field("right", T.BinaryType())])
    return materialize(joined.mapInArrow(_contexts(shape, out.names), out), "contexts")


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None, group_rows: int = 16384) -> DataFrame:
    """id, mark, spans (array<struct<from:int,to:int>>, overlapping: the repeated stretches), elsewhere (holds a passage that
    another document holds too) of each text that has some.
    """
    shape = shape or Shape()
    texts, kept, classes, runs = _anchors_and_classes(docs, id_col, text_col, shape)
    # Two members of a class prove each other.
    pairs = classes.where("n > 1 and (fits or multi and passage)").select("head", "whole", "fits", (F.col("multi") & F.col("passage")).alias("elsewhere"))
    fits = lambda c: F.when(F.col("fits"), c)
    span = T.StructType([*_key(docs, id_col), _field("from", T.IntegerType()), _field("to", T.IntegerType()), _field("elsewhere", T.BooleanType())])
    proven = kept.drop("fits").join(pairs, ["head", "whole"]).select("id", "mark", fits(F.col("at") - shape.before).alias("from"), fits(F.col("at") + shape.length).alias("to"), "elsewhere")
    contexts = _representatives(texts, classes, shape, group_rows)
    parts = contexts.where("not hot").select("id", "mark", "at", "head", "alone", "multi", "left", "right")
    scanned = parts.repartition("head").sortWithinPartitions("head", "right").mapInArrow(_scan(shape, span.names), span)
    hot = contexts.where("hot").select("id", "mark", "at", "head", "alone", "multi", "left", "right")
    deep = T.StructType([*_key(docs, id_col), _field("start", T.IntegerType()), _field("alone", T.BooleanType()), _field("key", T.BinaryType())])
    strings = hot.mapInArrow(_full_depth(shape, deep.names), deep).unionByName(runs.where("not passage and key is not null").select("id", "mark", F.col("at").alias("start"), F.col("fits").alias("alone"), "key"))
    within = runs.where("key is null").select("id", "mark", F.col("at").alias("from"), (F.col("at") + shape.length).alias("to"), F.lit(False).alias("elsewhere"))
    shared = materialize(strings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "strings")
    deeper = strings.where("alone").join(shared, "key", "left_semi").select("id", "mark", F.col("start").alias("from"), (F.col("start") + shape.length).alias("to"), F.lit(False).alias("elsewhere"))
    told = T.StructType([*_key(docs, id_col), _field("multi", T.BooleanType()), _field("key", T.BinaryType())])
    passages = hot.mapInArrow(_hot_passages(shape, told.names), told).unionByName(runs.where("passage").select("id", "mark", F.lit(False).alias("multi"), "key"))
    two = F.max(F.struct("id", "mark")) != F.min(F.struct("id", "mark"))
    common = materialize(passages.groupBy("key").agg((F.max("multi") | two).alias("x_")).where("x_").select("key"), "passages")
    none = F.lit(None).cast("int")
    holders = passages.join(common, "key", "left_semi").select("id", "mark", none.alias("from"), none.alias("to"), F.lit(True).alias("elsewhere"))
    spans = proven.unionByName(scanned).unionByName(deeper).unionByName(within).unionByName(holders)
    listed = F.collect_list(F.when(F.col("from").isNotNull(), F.struct("from", "to"))).alias("spans")
    out = materialize(spans.groupBy("id", "mark").agg(listed, F.max("elsewhere").alias("elsewhere")), "spans")
    discard(kept, classes, runs, contexts, shared, common)
    return out


def _groups_of(shape: Shape, names: list[str]):
    """(group, left, right, head, class) of the maximal repeats of each prefix of sorted rows (head, whole, left, right).

    A repeat counts at the anchor of least hash in it: that one is an anchor wherever the repeat occurs.
    """

    def run(batches):
        head, group = None, []

        def found():
            out = []
            for left, right, members in maximal_repeats([g[2] for g in group], [g[1] for g in group], shape.length, shape.seed):
                text = group[members[0]][1][:left][::-1] + group[members[0]][2][:right]
                if int(gram_hashes(np.frombuffer(text, np.uint8), shape.seed).argmin()) == left:
                    out += [(xxhash.xxh3_128_digest(text), left, right, head, group[m][0]) for m in members]
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for h, whole, left, right in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if h != head:
                    if group:
                        yield found()
                    head, group = h, []
                group.append((whole, left, right))
        if group:
            yield found()

    return run


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None) -> DataFrame:
    """group (128-bit hash of the string), bytes, id, from: every occurrence of every maximal repeat of at least ``length``
    bytes that reaches at most ``before`` bytes before and ``length`` bytes after one of its anchors; longer repeats appear
    as the pieces around their anchors, and what is all periodic run is left out. A class' members are occurrences of what its representative holds.
    """
    shape = shape or Shape()
    texts, kept, classes, _ = _anchors_and_classes(docs, id_col, text_col, shape)
    # A class of several members repeats as a whole; so it is listed twice where the tree is built.
    contexts = _representatives(texts, classes.withColumn("copy_", F.explode(F.when(F.col("n") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))), shape, 1 << 60)
    at = contexts.join(classes.select(F.col("head").alias("chead"), "whole", "rep"), (F.col("head") == F.col("chead")) & F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("mark") == F.col("rep.mark")) & (F.col("at") == F.col("rep.at")))
    out = T.StructType([_field("group", T.BinaryType()), _field("left", T.IntegerType()), _field("right", T.IntegerType()), _field("head", T.LongType()), _field("whole", T.LongType())])
    sorted_ = at.select("head", "whole", "left", "right").repartition("head").sortWithinPartitions("head", "right")
    found = sorted_.mapInArrow(_groups_of(shape, out.names), out).distinct()
    rows = found.join(kept.select("head", "whole", "id", "at"), ["head", "whole"])
    return rows.select("group", (F.col("left") + F.col("right")).alias("bytes"), "id", (F.col("at") - F.col("left")).alias("from")).distinct()


def _removed(batches):
    for batch in batches:
        spans = batch.column(2)
        out = []
        for i, view in enumerate(_unpacked(batch.column(1))):
            n = len(view)
            runs = merged([(s["from"], s["to"]) for s in spans[i].as_py()], n) if spans[i].is_valid else []
            if not runs:
                out.append((n, 0, 0, view))
                continue
            ends = [0, *[b for _, b in runs]]
            starts = [*[a for a, _ in runs], n]
            out.append((n, sum(b - a for a, b in runs), len(runs), b"".join(view[a:b] for a, b in zip(ends, starts, strict=True))))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], batch.column(3)], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "elsewhere"])


def remove_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay), elsewhere of every document."""
    small_batches(docs.sparkSession)
    texts = _marked(docs, id_col, text_col)
    joined = _carried(texts).join(spans.withColumnsRenamed({"id": "sid", "mark": "smark"}), F.col("id").eqNullSafe(F.col("sid")) & (F.col("mark") == F.col("smark")), "left").select("id", "packed", "spans", F.coalesce("elsewhere", F.lit(False)).alias("elsewhere"))
    long = T.LongType()
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", long), T.StructField("n_removed", long), T.StructField("n_spans", long), T.StructField("kept", T.BinaryType()), T.StructField("elsewhere", T.BooleanType())])
    return joined.mapInArrow(_removed, out).withColumnRenamed("id", id_col)


def op1_suffix_dedup(spark, sf_dir):
    """Every document after removal of what repeats for 400 bytes, as digests; shared_passage is 1 where it holds a passage of
    over 50 words that another document holds too.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, repeat_spans(docs))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("elsewhere").cast("int").alias("shared_passage"))
