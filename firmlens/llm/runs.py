"""Runs of repeated words, by a run-length grammar that is built by recompression.

Words of many texts become one row of symbols, each text ended by a symbol of its own.
Two steps alternate until texts are short: blocks of one symbol become (symbol, count),
and pairs of a left and a right symbol, as a hash of the symbol says, become one. Equal
stretches are compressed alike but for their ends, so how far two places agree, to the
right or to the left, is read off the levels of the grammar: a few symbols are compared on
each level on the way up, until they differ, and on each on the way down.

Candidates: a run of period q and at least four periods holds three places i, i + q and
i + 2q of the grid of multiples of 2q. Grids of all q are harmonic, n ln n places in all.
Three equal words make a candidate; the grammar extends it both ways to the whole run.
Texts go through Arrow batches in parts of a bounded number of words; each is read once and
nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words and this many periods.
MIN_LENGTH, MIN_PERIODS = 6, 4
#: Texts of about this many words share a grammar.
WORDS_AT_ONCE = 400_000
#: The grammar ends where no text has more symbols.
TOP = 8
#: Which hash sides are tried on each level; the one with most pairs is taken.
_TRIES = 2
_ODD = [int(x) | 1 for x in np.random.default_rng(20_240_611).integers(1 << 62, 1 << 63, 400, dtype=np.uint64)]

#: Says which original word stands at each place of a text of n words, by its id; None: the words as they are.
Order = Callable[[object, int], "np.ndarray | None"]


def _right(symbols: np.ndarray, seed: int) -> np.ndarray:
    return (symbols.astype(np.uint64) * np.uint64(_ODD[seed % len(_ODD)]) >> np.uint64(61) & np.uint64(1)).astype(bool)


class Grammar:
    """Levels of recompression of rows of symbols (>= 0), each ended by a negative symbol of its own; one more stands first.

    levels[k]: its symbols; up[k]: of each symbol, its place on level k + 1; down[k]: of each on level k + 1, where it begins on level k,
    and the end; blocks[k]: whether k + 1 came of blocks; right[k]: which symbols are right ones.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels, self.up, self.down, self.blocks, self.right = [symbols], [], [], [], []
        new = int(symbols.max(initial=0)) + 1
        while len(self.blocks) < len(_ODD) and np.diff(np.flatnonzero(self.levels[-1] < 0)).max(initial=0) > TOP + 1:
            new = self._pairs(new) if len(self.blocks) % 2 else self._blocks(new)

    def _next(self, starts: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        first = np.zeros(len(self.levels[-1]), np.int64)
        first[starts] = 1
        self.up.append(np.cumsum(first) - 1)
        self.down.append(np.append(starts, len(self.levels[-1])))
        self.blocks.append(blocks)
        self.levels.append(symbols)

    def _blocks(self, new: int) -> int:
        s = self.levels[-1]
        starts = np.flatnonzero(np.diff(s, prepend=s[0] - 1))
        size, out = np.diff(np.append(starts, len(s))), s[starts]
        long = np.flatnonzero(size > 1)
        names, of = np.unique(out[long] * (int(size.max()) + 1) + size[long], return_inverse=True)
        out[long] = new + of
        self.right.append(None)
        self._next(starts, out, True)
        return new + len(names)

    def _pairs(self, new: int) -> int:
        s, level = self.levels[-1], len(self.blocks)
        best = None
        for t in range(_TRIES):
            for flip in (False, True):
                right = _right(s, _TRIES * level + t) ^ flip
                left = ~right & (s >= 0)
                right &= s >= 0
                firsts = np.flatnonzero(left[:-1] & right[1:])
                if best is None or len(firsts) > len(best[0]):
                    best = firsts, right
        firsts, right = best
        keep = np.ones(len(s), bool)
        keep[firsts + 1] = False
        starts, out = np.flatnonzero(keep), s.copy()
        names, of = np.unique(s[firsts] * new + s[firsts + 1], return_inverse=True)
        out[firsts] = new + of
        self.right.append(right)
        self._next(starts, out[starts], False)
        return new + len(names)

    def extend(self, a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
        """How many symbols from places a and b on (a < b, of one text; both included) are equal, to the right (by = 1) or left (-1)."""
        x, y = a.copy(), b.copy()
        fell = np.full(len(a), -1)
        rising, top = np.arange(len(a)), len(self.up)
        for k in range(top):
            s, up, down = self.levels[k], self.up[k], self.down[k]
            same = s[x[rising]] == s[y[rising]]
            fell[rising[~same]] = k
            rising = rising[same]
            i, j = x[rising], y[rising]
            if self.blocks[k]:
                rest = [down[up[z] + 1] - z if by > 0 else z - down[up[z]] + 1 for z in (i, j)]
                step = by * np.minimum(*rest)
                ends = rest[0] != rest[1]
                x[rising], y[rising] = i + step, j + step
                fell[rising[ends]] = k
                rising = rising[~ends]
            else:
                step = by * (self.right[k][i] == (by > 0))  # a symbol that may be the inner one of a pair goes first
                x[rising], y[rising] = i + step, j + step
            x[rising], y[rising] = up[x[rising]], up[y[rising]]
        s = self.levels[top]
        fell[rising] = top
        while len(rising := rising[s[x[rising]] == s[y[rising]]]):
            x[rising] += by
            y[rising] += by
        for k in range(top - 1, -1, -1):
            some = np.flatnonzero(fell > k)
            s, down, side = self.levels[k], self.down[k], by < 0
            p, q = x[some], y[some]
            i, j = (down[z + side] - side for z in (p, q))
            same = s[i] == s[j]
            most = np.minimum(down[p + 1] - down[p], down[q + 1] - down[q]) if self.blocks[k] else 1
            step = by * most * same
            x[some], y[some] = i + step, j + step
        return (x - a) * by


def _ragged(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def runs_of(texts: list[np.ndarray], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[np.ndarray]:
    """Of each text of word numbers: rows (start, length, period) of its runs, by start, then period."""
    n = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(n + 1) - n
    row = np.full(int(n.sum()) + len(n) + 1, -1, np.int64)
    row[0] = -len(n) - 1
    for d, t in enumerate(texts):
        row[start[d] : start[d] + len(t)] = t
        row[start[d] + len(t)] = -d - 1
    grammar = None
    covered, until = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    found = [np.zeros((0, 4), np.int64)]
    low = 1
    while len(docs := np.flatnonzero((n >= min_length) & (n >= min_periods * low))):
        high = np.minimum(2 * low, n[docs] // min_periods + 1)
        doc = np.repeat(docs, high - low)
        q = low + _ragged(high - low)
        places = (n[doc] - 1) // (2 * q)
        i = np.repeat(start[doc], places) + _ragged(places) * np.repeat(2 * q, places)
        doc, q = np.repeat(doc, places), np.repeat(q, places)
        hit = row[i] == row[i + q]
        i, q, doc = i[hit], q[hit], doc[hit]
        hit = row[i] == row[i + 2 * q]
        i, q, doc = i[hit], q[hit], doc[hit]
        # Within a run of a period that divides q, there is no other run of q.
        hit = (covered[i] == 0) | (until[i] <= i + 2 * q) | (q % np.maximum(covered[i], 1) > 0)
        i, q, doc = i[hit], q[hit], doc[hit]
        if len(i):
            grammar = grammar or Grammar(row)
            first = i - grammar.extend(i - 1, i + q - 1, -1)
            end = i + q + grammar.extend(i, i + q, 1)
            long = end - first >= np.maximum(min_length, min_periods * q)
            new = np.unique(np.column_stack([doc, first, end, q])[long], axis=0)
            found.append(new)
            for _, a, b, p in new.tolist():
                if not covered[a] or until[a] < b:
                    covered[a:b], until[a:b] = p, b
        low *= 2
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
    smallest = np.ones(len(every), bool)
    smallest[1:] = (np.diff(every[:, :3], axis=0) != 0).any(axis=1)
    every = every[smallest]  # of one stretch, the smallest period
    every = every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]
    cuts = np.searchsorted(every[:, 0], np.arange(len(n) + 1))
    return [np.column_stack([r[:, 1] - s, r[:, 2] - r[:, 1], r[:, 3]]) for s, r in ((start[d], every[cuts[d] : cuts[d + 1]]) for d in range(len(n)))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", order: Order | None = None) -> DataFrame:
    """(key, n_words, runs array<struct<start, length, period>>, collapsed): one row per row of `docs`.

    Words are cut at space and U+0009..U+000D. A run is a stretch of words with smallest
    period q, of at least MIN_LENGTH words and MIN_PERIODS periods, that neither
    neighbouring word extends; numbers count words from 0, runs are sorted by start, then
    period. `collapsed` holds the words that no run holds after its first period, joined by
    one space. Null and empty texts have no words, no runs and an empty `collapsed`.
    Repeated and null keys are rows of their own; other columns are not read. `order` may put other words of
    a text in the places of its words first.
    """

    def part(keys: list, texts: list[bytes]) -> pa.RecordBatch:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        words = [t.split() for t in texts]
        ids = []
        for d, w in enumerate(words):
            of = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
            at = order(keys[d], len(w)) if order else None
            if at is not None:
                words[d], of = [w[k] for k in at.tolist()], of[at]
            ids.append(of)
        runs = runs_of(ids)
        collapsed = [b" ".join(compress(w, kept_words(len(w), r).tolist()) if len(r) else w).decode() for w, r in zip(words, runs, strict=True)]
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        columns = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in columns.T], ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int64()), listed, pa.array(collapsed, pa.string())], names=["n_words", "runs", "collapsed"])

    def batches(of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of:
            keys, texts = batch.column("key"), batch.column("text").cast(pa.binary()).to_pylist()
            at = size = 0
            for k, t in enumerate(chain(texts, [None])):
                if k == len(texts) or (k > at and size + len(t) > 6 * WORDS_AT_ONCE):
                    if k > at:
                        some = part(keys.slice(at, k - at).to_pylist(), texts[at:k])
                        yield pa.RecordBatch.from_arrays([keys.slice(at, k - at), *some.columns], names=["key", *some.schema.names])
                    at, size = k, 0
                size += len(t or b"")

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    out = rows.mapInArrow(batches, f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("key", key)
