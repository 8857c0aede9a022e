"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token pieces of at most `size` ids; only longer documents are cut, with
the short piece first. Only the histogram of piece lengths, at most `size` numbers, comes
to the driver. There the program "few sequences, every length covered" is solved by
multiplicative weights: each round prices a best configuration by a knapsack dynamic
program and lowers the weights of the lengths it covers. Its configurations around long pieces
are kept as whole sequences, and best fit, longest first, places the rest.
Plan and work on the driver don't grow with the number of documents.

Pieces then find their place by their rank among pieces of equal length. Ranks come from
groups of (length, salt), with more salts the more pieces the commonest length has.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.bpe import PATTERN, codec
from firmlens.llm.common import stored

SIZE = 1_024
END_ID = 2
#: Rounds that mix; after them each round ends a length.
MIXING = 200
RATE = 0.3
#: Pieces that one group of (length, salt) is to hold, and the groups a length has at most.
PER_GROUP, SALTS = 5_000, 1_024
#: Places and bases are broadcast up to so many rows.
BROADCAST_ROWS = 200_000

Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def price(weights: np.ndarray, lengths: np.ndarray, size: int) -> dict[int, int]:
    """A configuration of the largest weight: unbounded knapsack by dynamic programming over fills."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    for w in range(1, size + 1):
        n = int(np.searchsorted(lengths, w, side="right"))
        best[w], last[w] = best[w - 1], -1
        if n:
            v = best[w - lengths[:n]] + weights[:n]
            i = int(v.argmax())
            if v[i] > best[w]:
                best[w], last[w] = v[i], i
    out, w = {}, size
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            out[int(last[w])] = out.get(int(last[w]), 0) + 1
            w -= int(lengths[last[w]])
    return out


def solve(histogram: dict[int, int], size: int = SIZE, mixing: int = MIXING) -> list[tuple[Pattern, int]]:
    """Configurations and how often each is used, so that all pieces are covered: a covering program by multiplicative weights.

    A round's best configuration is used in whole steps and the lengths in it lose weight by
    the share of their need that it covers. The first `mixing` rounds go half the way to the
    end of the scarcest length, so that others can mix it otherwise; later ones go all the
    way, which ends a length each time, so the rounds are bounded by the lengths.
    """
    lengths = np.array(sorted(x for x in histogram if x < size), np.int64)
    if not len(lengths):
        return []
    left = np.array([histogram[int(x)] for x in lengths], np.int64)
    need, weights, use = left.astype(float), lengths / size, {}
    done = 0
    while len(open_ := np.flatnonzero(left)):
        found = price(weights[open_], lengths[open_], size)
        at = open_[np.array(list(found))]
        times = np.minimum(np.array(list(found.values()), np.int64), left[at])
        step = int((left[at] // times).min())
        if done < mixing:
            step = max(1, step // 2)
        pattern = tuple(sorted(((int(lengths[i]), int(t)) for i, t in zip(at, times, strict=True)), reverse=True))
        use[pattern] = use.get(pattern, 0) + step
        left[at] -= step * times
        weights[at] *= np.exp(-RATE * step * times / need[at])
        done += 1
    return list(use.items())


def best_fit(histogram: dict[int, int], size: int = SIZE) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, of whole groups of equal pieces into groups of equal sequences."""
    groups: dict[int, dict[Pattern, int]] = {}  # free room -> pattern -> sequences
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                per = size // length
                for times, count in ((per, n // per), (n % per, 1)):
                    if times and count:
                        g = groups.setdefault(size - times * length, {})
                        g[(length, times),] = g.get(((length, times),), 0) + count
                break
            pattern, have = next(iter(groups[room].items()))
            times = min(room // length, max(1, n // have))
            count = min(have, n // times)
            if count == have:
                del groups[room][pattern]
                if not groups[room]:
                    del groups[room]
            else:
                groups[room][pattern] = have - count
            now = tuple(sorted((dict(pattern) | {length: dict(pattern).get(length, 0) + times}).items(), reverse=True))
            g = groups.setdefault(room - times * length, {})
            g[now] = g.get(now, 0) + count
            n -= times * count
    return [(p, c) for g in groups.values() for p, c in g.items()]


def rounded(solution: list[tuple[Pattern, int]], histogram: dict[int, int], size: int, waste: int, longest: int) -> tuple[list, list]:
    """Whole sequences from configurations that waste at most `waste` and hold a piece of `longest` or more; and the rest by best fit.

    Long pieces are what needs the program; short ones that best fit has left fill its gaps.
    """
    left, out = dict(histogram), []
    for pattern, times in solution:
        if pattern[0][0] >= longest and size - sum(a * b for a, b in pattern) <= waste:
            out.append((pattern, times))
            for x, t in pattern:
                left[x] -= times * t
    return out, best_fit({k: v for k, v in left.items() if v}, size)


def plan(histogram: dict[int, int], size: int = SIZE, mixing: int = MIXING) -> tuple[list[tuple[Pattern, int]], list[tuple[Pattern, int]]]:
    """Patterns of whole sequences that hold every piece of the histogram exactly once: from configurations, and by best fit.

    The program's solution is rounded in several ways, of which one takes nothing from it.
    The fewest sequences win, and of ways that need as many, that with the most from configurations.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    full = [(((size, 1),), left.pop(size))] if left.get(size) else []
    solution = solve(left, size, mixing)
    count = lambda way: sum(n for _, n in way)
    ways = [rounded(solution, left, size, waste, longest) for waste in (size, 2, 1, 0) for longest in (0, size // 4, size // 2, 3 * size // 4)] + [([], best_fit(left, size))]
    chosen, rest = min(ways, key=lambda way: (count(way[0]) + count(way[1]), -count(way[0])))
    return full + chosen, rest


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The same vocabulary in the library whose encoder is compiled; special strings become their ids."""
    bpe = codec(path)
    ranks = {s: i for i, s in bpe.strings.items() if i not in bpe.special.values()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=bpe.special)


def pieces(docs: DataFrame, vocab: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a row per piece; a null or empty text is one piece of `end_id`."""
    names = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    shape = pa.schema([*names, *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = []
                for i, t in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns), strict=True):
                    ids = np.array([*enc.encode(t or "", allowed_special="all"), end_id], "<u4")
                    start, piece = 0, 0
                    while start < len(ids):
                        end = start + ((len(ids) - start - 1) % size + 1 if not piece else size)
                        part = ids[start:end]
                        rows.append((i, piece, start, len(part), zlib.crc32(part.tobytes()), *([part.astype("i4")] if keep_ids else [])))
                        start, piece = end, piece + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocab: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset: every id of every document once, sequences without gaps from 0.

    One row per piece; repeated documents are packed each. An empty table gives none.
    `keep_ids` adds the piece's ids.
    """
    cut = stored(pieces(docs, vocab, doc_id, text, size, end_id, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    # A length has as many groups as its pieces need, so no rank is counted over too many rows in one task.
    salts = min(SALTS, max([1, *(n // PER_GROUP + 1 for n in histogram.values())]))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = stored(cut.groupBy("length", "salt").agg(F.count("*").alias("n")), "histogram")
    slots, sequence, used = [], 0, {}
    for pattern, n in itertools.chain(*plan(histogram, size)):
        offset = 0
        for length, times in pattern:
            first = used.get(length, 0)
            slots.append((length, first, first + n * times, times, sequence, offset))
            used[length] = first + n * times
            offset += length * times
        sequence += n
    spark = docs.sparkSession
    slot = spark.createDataFrame(slots, "length long, lo long, hi long, times long, sequence long, at long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = stored(base, "base")
    side = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("shuffle_merge")
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(side(base, base.count()), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(side(slot, len(slots)), "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []),
        (F.col("sequence") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )
