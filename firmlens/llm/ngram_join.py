"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the distinct word shingles of its whole text. Sets of similar size
share a size band, and two sets that link are in the same band or in neighbouring ones, so
each set signs for its own band and for the next. In a band, a Jaccard bound is a bound k
on how many elements two sets may differ in. The shingle domain is cut into first-level
partitions, so that in one of them at most `spare` elements differ, and each of these into
second-level parts; every subset of parts that leaves `spare` of them out is hashed to a
signature. Two sets that link then share a signature; no link is lost.

1. Signatures are made in Arrow batches, streamed bucket by bucket in sorted order, and
   buckets of two sets or more come out as lists of at most BLOCK members. Equal lists
   of different signatures are merged.
2. Each set has a parity sketch, whose bits bound the number of differing elements from
   below: pairs that it rules out are never shipped. What remains is checked exactly on
   the texts.
3. First, members are checked against their list's first member. Distributed union-find
   joins what links. A second round checks, list by list, a forest of the closest pairs
   between its components. In the last round every pair of a list that is still in two
   components goes through the sketch, and what remains through the exact check. So all
   components are complete, and pairs inside a component are never made.

Equal sets have one id, so copies meet once per batch and never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import connected_components, extended, stored

WORDS = 4
#: The similarity bound as a fraction.
BOUND = (85, 100)
#: Second-level parts of a partition, and how many of them a subset leaves out.
PARTS, SPARE = 2, 1
BLOCK = 1_024
SKETCH_BYTES = 1 << 13
#: Characters of texts that are hashed at a time.
_CHARS = 1 << 17
#: Elements of sets that are signed at a time, but for larger sets.
_ELEMENTS = 1 << 16
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _U(32))) * _ODD[0]
    x = (x ^ (x >> _U(29))) * _ODD[1]
    return x ^ (x >> _U(32))


def _powers(base: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(_SLICE + _SHORT, base, _U)) * _U(pow(base, -1, 1 << 64))


#: Bytes that are hashed at a time, and bytes of the longest word that they may end in.
_SLICE, _SHORT = 1 << 16, 64
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTES = mix(np.arange(1, 257, dtype=_U) * _ODD[1])
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C13
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words, in order; A-Z count as a-z, words are cut at space and U+0009..U+000D.

    A word's bytes are the digits of a number, modulo 2**64; words over _SHORT bytes are hashed one by one.
    """
    x = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[x], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), _U)
    cuts = np.searchsorted(starts, np.arange(0, len(x) + _SLICE, _SLICE))
    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if i < j:
            at = k * _SLICE
            part = x[at : at + _SLICE + _SHORT]
            digits = np.zeros(len(part) + 1, _U)
            np.multiply(_BYTES[part], _UP[: len(part)], out=digits[:-1])
            first = starts[i:j] - at
            ranges = np.column_stack([first, np.minimum(ends[i:j] - at, len(part))]).ravel()
            out[i:j] = np.add.reduceat(digits, ranges)[::2] * _DOWN[first]
    for i in np.flatnonzero(ends - starts > _SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]].lower())
    return mix(out), starts


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of word shingles; fewer words make one, none none."""
    data = [(t or "").encode() for t in texts]
    h, starts = word_hashes(b"\n".join(data))
    ends = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in data])).tolist()
    factors = [_U(pow(_BASE, i + 1, 1 << 64)) for i in range(words)]
    n = max(0, len(h) - words + 1)
    windows = np.full(n, words, _U)
    for i, f in enumerate(factors):
        windows += h[i : i + n] * f
    windows = mix(windows)
    for start, end in zip([0, *ends], ends, strict=False):
        if end - start >= words:
            out = np.sort(windows[start : end - words + 1])
            new = np.ones(len(out), bool)
            np.not_equal(out[1:], out[:-1], out=new[1:])
            yield out[new]
        else:
            short = h[start:end]
            yield mix((short * np.array(factors[: len(short)], _U)).sum(keepdims=True) + _U(len(short))) if len(short) else short


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return next(shingle_sets([text], words))


def shingled(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sets of a column's texts, about _CHARS characters hashed at a time, but for longer texts."""
    texts, size = [], 0
    for i, t in enumerate(column):
        texts.append(t.as_py())
        size += len(texts[-1] or "")
        if size >= _CHARS or i == len(column) - 1:
            yield from shingle_sets(texts, words)
            texts, size = [], 0


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


@lru_cache(maxsize=8)
def bands(num: int, den: int) -> np.ndarray:
    """The largest size of each band; sizes of one band are all similar enough to link."""
    tops, top = [], 0
    while top < 1 << 40:
        top = (top + 1) * den // num
        tops.append(top)
    return np.array(tops)


def differ(total: np.ndarray | int, num: int, den: int):
    """How many elements two sets of `total` elements together may differ in and still link."""
    return total * (den - num) // (den + num)


def layout(band: int, num: int, den: int, parts: int, spare: int) -> tuple[int, int]:
    """(first-level partitions, how many of their signatures may be empty) of a band."""
    tops = bands(num, den)
    k = int(differ(2 * int(tops[band]), num, den))
    first = k // (spare + 1) + 1
    if k == 0:
        return 1, 0
    least = int(tops[band - 2]) + 1 if band > 1 else 1
    for margin in range(4 * first + 64):
        n = first + margin
        empty = n * np.exp(-least * (parts - spare) / (n * parts))
        if empty + 3 * np.sqrt(empty) <= margin:
            return n, margin
    return first, 0


layout = lru_cache(maxsize=4096)(layout)


def signed(sets: list[np.ndarray], bound: tuple[int, int], parts: int = PARTS, spare: int = SPARE) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, places of their sets) of non-empty sets, each for its own band and the next.

    With `margin` partitions more than needed, two sets that link agree in more than
    `margin` signatures of partitions; so empty ones are left out, unless a set has more
    than `margin` of them.
    """
    out, owners = [], []
    sizes = np.array(list(map(len, sets)))
    elements = np.concatenate(sets)
    own = np.searchsorted(bands(*bound), sizes)
    for band in (own, own + 1):
        n, margin = np.array([layout(b, *bound, parts, spare) for b in band.tolist()]).T
        first = np.cumsum(n) - n
        h = mix(elements ^ np.repeat(band.astype(_U) * _U(2654435761) + _U(97), sizes))
        cell = ((h >> _U(32)) * np.repeat((n * parts).astype(_U), sizes) >> _U(32)).astype(np.int64) + np.repeat(first * parts, sizes)
        total = np.zeros(n.sum() * parts, _U)
        np.add.at(total, cell, mix(h + _ODD[3]))
        total = total.reshape(-1, parts)
        owner = np.repeat(np.arange(len(sets)), n)
        place = mix((np.arange(len(owner)) - first[owner]).astype(_U) * _ODD[1] + band[owner].astype(_U))
        for i, subset in enumerate(combinations(range(parts), parts - spare)):
            v, full = np.full(len(owner), i + 1, _U), np.zeros(len(owner), bool)
            for p in subset:
                v, full = mix(v * _ODD[2] + total[:, p]), full | (total[:, p] != 0)
            many = n - np.add.reduceat(full, first, dtype=np.int64) > margin
            keep = full | many[owner]
            out.append(mix(v + place)[keep])
            owners.append(owner[keep])
    return np.concatenate(out), np.concatenate(owners)


def signatures(s: np.ndarray, bound: tuple[int, int], parts: int = PARTS, spare: int = SPARE) -> np.ndarray:
    """The distinct signatures of one non-empty set."""
    return np.unique(signed([s], bound, parts, spare)[0])


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's counts per cell of the domain; about four cells an element, a power of two."""
    bits = 256
    while bits < 4 * len(s) and bits < 8 * SKETCH_BYTES:
        bits *= 2
    odd = np.bincount((mix(s + _ODD[4]) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch_: bytes, size: int) -> np.ndarray:
    """A sketch brought down to `size` bytes: halves that fall together add up."""
    x = np.frombuffer(sketch_, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(n: np.ndarray, sketches: list[bytes], component: np.ndarray, bound: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of different components that sizes and sketches don't rule out, and how far apart they seem."""
    size = min(map(len, sketches))
    x = np.stack([folded(s, size) for s in sketches]).view(np.uint64)
    out, order = [], np.arange(len(n))
    for i in range(len(n) - 1):
        j = order[i + 1 :][component[i + 1 :] != component[i]]
        a, b = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        j = j[a * bound[1] >= b * bound[0]]
        if len(j):
            apart = np.bitwise_count(x[j] ^ x[i]).sum(axis=1, dtype=np.int64)
            good = apart <= differ(n[j] + n[i], *bound)
            out.append((np.full(good.sum(), i), j[good], apart[good]))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (empty, empty, empty)


def closest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, component: np.ndarray) -> list[int]:
    """Positions of a spanning forest of components over the pairs, the closest pairs first."""
    root: dict[int, int] = {}

    def find(z: int) -> int:
        while root.setdefault(z, z) != z:
            root[z] = z = root[root[z]]
        return z

    out = []
    for k in np.argsort(apart, kind="stable").tolist():
        a, b = find(int(component[i[k]])), find(int(component[j[k]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(k)
    return out


def _pass(docs: DataFrame, fn, schema: str) -> DataFrame:
    return docs.select("_id", "_text", "_hash").mapInArrow(fn, schema)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = list(shingled(part.column(1), words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(list(map(len, sets)), pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                    names=["_id", "_hash", "n", "set", "sketch"],
                )

    return run


def _signed(words: int, bound: tuple[int, int], parts: int, spare: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = set()  # equal sets of a batch sign once
            sets, ids, size = [], [], 0
            for row, s in enumerate(shingled(batch.column(1), words)):
                if len(s) and (i := set_id(s)) not in done:
                    done.add(i)
                    sets.append(s)
                    ids.append(i)
                    size += len(s)
                if sets and (row == batch.num_rows - 1 or size >= _ELEMENTS):
                    sigs, at = signed(sets, bound, parts, spare)
                    yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(np.array(ids)[at])], names=["sig", "set"])
                    sets, ids, size = [], [], 0

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sig, set) rows to lists of different sets of one signature, in chunks of at most BLOCK."""
    sig, members, chunk = None, [], 0
    out: list[tuple] = []

    def flush(end: bool) -> None:
        nonlocal members, chunk
        if len(members) > 1 or chunk:
            out.append((sig, chunk, members))
        members, chunk = [], 0 if end else chunk + 1

    def made() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.list_(pa.int64()))], names=["sig", "chunk", "members"])

    for batch in batches:
        sigs, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(sigs)) + 1).tolist(), len(sigs)]
        alone = np.diff(cuts) == 1
        for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if s == e:
                continue
            now = int(sigs[s])
            if now != sig:
                if members or chunk:
                    flush(True)
                sig = now
                if alone[i] and e < len(sigs):
                    continue  # nobody else has it
            for x in np.unique(sets[s:e]).tolist():
                if members and members[-1] == x:
                    continue
                members.append(x)
                if len(members) == BLOCK:
                    flush(False)
        if len(out) >= 1_000:
            yield made()
    if members or chunk:
        flush(True)
    if out:
        yield made()


def _candidates(bound: tuple[int, int], forest: bool):
    """Rows (cell, set, n, sketch, component), cells together, to pairs that may link; or to a forest of the closest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for df in _with_end(batches):
            now = df if rest is None else rest if df is None else pd.concat([rest, df], ignore_index=True)
            if now is None or not len(now):
                continue
            ends = (np.flatnonzero(np.diff(now["cell"].to_numpy())) + 1).tolist()
            cuts = [0, *ends, *([len(now)] if df is None else [])]
            sets, n, component, sketches = now["set"].to_numpy(), now["n"].to_numpy(), now["component"].to_numpy(), now["sketch"].tolist()
            out = set()
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e - s > 1 and (component[s:e] != component[s]).any():
                    i, j, apart = may_link(n[s:e], sketches[s:e], component[s:e], bound)
                    if forest and len(i):
                        keep = closest(i, j, apart, component[s:e])
                        i, j = i[keep], j[keep]
                    out.update(zip(np.minimum(sets[s + i], sets[s + j]).tolist(), np.maximum(sets[s + i], sets[s + j]).tolist(), strict=True))
            rest = now.iloc[cuts[-1] :] if df is not None else None
            if out:
                yield pd.DataFrame(sorted(out), columns=["a", "b"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def _stars(bound: tuple[int, int]):
    """Pairs with sizes and sketches to those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
            close = np.minimum(na, nb) * bound[1] >= np.maximum(na, nb) * bound[0]
            most = differ(na + nb, *bound)
            keep = []
            for i in np.flatnonzero(close).tolist():
                x, y = batch.column("sa")[i].as_py(), batch.column("sb")[i].as_py()
                size = min(len(x), len(y))
                if int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= most[i]:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _exact(words: int, bound: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part, keep, memo = batch.slice(start, 64), [], {}
                for i, r in enumerate(part.to_pylist()):
                    for k, t in ((r["a"], r["ta"]), (r["b"], r["tb"])):
                        if k not in memo:
                            memo[k] = shingles(t, words)
                    x, y = memo[r["a"]], memo[r["b"]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bound[1] * both >= bound[0] * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bound: tuple[int, int] = BOUND, parts: int = PARTS, spare: int = SPARE) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document.

    Documents link when den * |intersection| >= num * |union| of their sets, `bound` being
    (num, den); component_id is the smallest doc_id that links reach. Null, empty and
    word-free texts have no set and are their own component; equal sets link. Sets are told
    apart by a 64-bit hash and shingles by another. Every row is a document, also where
    ids repeat or are null: rows of one id join nothing for that, and a component without
    an id has a null component_id. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    # A row's number is fixed by writing it; a set's first row is that of its smallest id.
    sets = stored(_pass(docs, _sets(words), "_id long, _hash long, n long, `set` long, sketch binary").withColumn("_row", F.monotonically_increasing_id()), "sets")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("rep"), "_row", "_hash")).alias("x")
    firsts = stored(sets.where("`set` is not null").groupBy("set").agg(first).select("set", "x.rep", "x._row", "x._hash"), "firsts")
    own = stored(firsts.hint("shuffle_merge").join(sets.select("_row", "n", "sketch").hint("shuffle_merge"), "_row").select("set", "rep", "_hash", "n", "sketch"), "own")

    rows = _pass(docs, _signed(words, bound, parts, spare), "sig long, `set` long")
    lists = stored(rows.repartition("sig").sortWithinPartitions("sig", "set").mapInArrow(_buckets, "sig long, chunk int, members array<long>"), "lists")
    merged = lists.groupBy(F.xxhash64("members").alias("cell")).agg(F.first("members").alias("members"))
    long = lists.where("chunk > 0").select("sig").distinct()
    if not long.isEmpty():
        x = lists.join(long.hint("shuffle_merge"), "sig", "left_semi")
        y = x.select("sig", F.col("chunk").alias("c"), F.col("members").alias("m"))
        crossed = x.join(y.hint("shuffle_merge"), "sig").where("chunk < c").select(F.array_distinct(F.concat("members", "m")).alias("members"))
        merged = merged.unionByName(crossed.select(F.xxhash64("members").alias("cell"), "members")).dropDuplicates(["cell"])
    cells = stored(merged.where(F.size("members") > 1), "cells")

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their texts; only texts of pairs move."""
        need = stored(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(own.select("set", "rep", "_hash").hint("shuffle_merge"), "set"), "need")
        same = docs["_id"].eqNullSafe(need["rep"]) & (docs["_hash"] == need["_hash"])
        have = stored(docs.join(need.hint("shuffle_hash"), same).select("set", "_text").dropDuplicates(["set"]), "texts")  # equal rows repeat
        x, y = have.select(F.col("set").alias("a"), F.col("_text").alias("ta")), have.select(F.col("set").alias("b"), F.col("_text").alias("tb"))
        both = pairs.join(x.hint("shuffle_merge"), "a").join(y.hint("shuffle_merge"), "b").select("a", "b", "ta", "tb")
        return stored(both.mapInArrow(_exact(words, bound), "a long, b long"), "linked")

    star = cells.select(F.explode("members").alias("b"), F.col("members")[0].alias("a")).where("a != b").distinct()
    mine = own.select("set", "n", "sketch")
    star = star.join(mine.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")).hint("shuffle_merge"), "a")
    star = star.join(mine.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")).hint("shuffle_merge"), "b")
    near = checked(stored(star.mapInArrow(_stars(bound), "a long, b long"), "stars"))
    final = stored(connected_components(near), "components")
    for forest in (True, False):
        at = mine.join(final.withColumnRenamed("node", "set").hint("shuffle_merge"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        spread = cells.select("cell", F.explode("members").alias("set")).join(stored(at, "at").hint("shuffle_merge"), "set").select("cell", "set", "n", "sketch", "component")
        rest = spread.repartition("cell").sortWithinPartitions("cell").mapInPandas(_candidates(bound, forest), "a long, b long")
        final = extended(final, checked(stored(rest.distinct(), "rest")))

    named = stored(own.select("set", "rep").join(final.withColumnRenamed("node", "set").hint("shuffle_merge"), "set", "left").withColumn("component", F.coalesce("component", "set")), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = stored(named.join(least.hint("shuffle_merge"), "component").select("set", "component_id"), "components")
    return sets.join(named.hint("shuffle_merge"), "set", "left").select(
        F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id")
    )
