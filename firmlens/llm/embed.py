"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is rotated at random. Stored of it are the signs of its coordinates, packed
into bits, one factor that corrects what the signs lose, and the coordinates in LEVELS
steps as bit planes. From one vector's signs and another's planes, bit counts give an
unbiased estimate of their inner product, with a confidence bound. Candidates meet in
buckets of sign bits, in several tables, so no two vectors without shared bits are ever
compared.

1. Codes alone move to the buckets. A pair that shares several buckets is judged in the
   first of them; members of pairs whose upper bound reaches the threshold stay.
2. Full vectors move for these members only, and what their pairs' bounds leave open is
   computed in double precision. Links are counted where they are found, and only a
   spanning forest of them goes on to the union-find.

Equal vectors collapse first and count with their number. A bucket too large for one
task is cut into blocks, and block pairs are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import connected_components, stored

THRESHOLD = 0.98
#: A pair at the threshold is missed by all tables with at most this probability.
MISS = 1e-3
#: Standard deviations of the estimate's confidence bound.
SIGMAS = 4.0
BLOCK = 1_024
SEED = 20_240_101
#: Steps of a coordinate in a code.
PLANES = 4
LEVELS = 1 << PLANES
#: Pairs that are judged at once.
_PAIRS = 100_000


@lru_cache(maxsize=8)
def rotations(dim: int, n: int) -> np.ndarray:
    """n random orthogonal matrices of `dim` rows, the same in every process."""
    rng = np.random.default_rng([SEED, dim])
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)])


def plan(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): buckets of about one row, and as many tables as `miss` needs."""
    bits = max(8, min(30, math.ceil(math.log2(max(rows, 2)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codes(v: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) bucket keys from the sign bits of rotated unit vectors."""
    dim = v.shape[1]
    n = -(-bits * tables // dim)
    signs = np.concatenate([v @ r.T >= 0 for r in rotations(dim, n)], axis=1)[:, : bits * tables]
    return signs.reshape(len(v), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def sketches(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits, factor, low, step) of unit vectors: words of signs, then of each bit plane of the coordinates in steps from `low`."""
    dim = v.shape[1]
    q = v @ rotations(dim, 1)[0].T
    low = q.min(axis=1)
    step = np.maximum(q.max(axis=1) - low, 1e-12) / (LEVELS - 1)
    dither = np.random.default_rng([SEED, dim, 1]).random(dim)  # rounding at random has no bias
    level = np.clip(np.floor((q - low[:, None]) / step[:, None] + dither), 0, LEVELS - 1).astype(np.uint8)
    planes = np.stack([q >= 0, *((level >> b & 1).astype(bool) for b in range(PLANES))], axis=1)
    words = np.packbits(np.pad(planes, ((0, 0), (0, 0), (0, -dim % 64))), axis=2, bitorder="little")
    return words.reshape(len(v), -1), np.maximum(np.abs(q).sum(axis=1) / math.sqrt(dim), 1e-9), low, step


def estimates(bits: np.ndarray, factor: np.ndarray, low: np.ndarray, step: np.ndarray, dim: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of vectors i (by planes) and j (by signs), and how far off they may be."""
    words = bits.view(np.uint64).reshape(len(bits), 1 + PLANES, -1)
    weights, root = 1 << np.arange(PLANES), math.sqrt(dim)
    level = np.bitwise_count(words[:, 1:]).sum(axis=2, dtype=np.int64) @ weights
    ones = np.bitwise_count(words[:, 0]).sum(axis=1, dtype=np.int64)
    both = np.bitwise_count(words[i, 1:] & words[j, :1]).sum(axis=2, dtype=np.int64) @ weights
    inner = step[i] * (2 * both - level[i]) / root + low[i] * (2 * ones[j] - dim) / root
    spread = np.sqrt(np.maximum(1 - factor[j] ** 2, 0) / max(dim - 1, 1)) + step[i] / 2
    return inner / factor[j], SIGMAS * spread / factor[j]


def near(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(vec_id, label, n_links, component_id, kept): one row per vector.

    Links join vectors of equal, non-null label and equal dimension whose cosine is at
    least `threshold`. Null, empty and zero vectors and those with null or non-finite
    components have no links and are their own component. Equal vectors link with each
    other. Every row is a vector, also where ids repeat or are null; a component
    without an id has a null component_id, and a row without one is not kept.
    """
    e, x = F.col(embedding), F.col(label)
    good = x.isNotNull() & e.isNotNull() & (F.size(e) > 0)
    good &= F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    good &= F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False))
    base = vectors.select(F.col(vec_id).alias("id"), x.alias("label"), F.when(good, e).alias("v"))
    # A different vector's number is fixed by writing it.
    reps = stored(base.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    rows = reps.count()
    bits, tables = plan(rows, threshold, miss)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column("v")).to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                v = unit(some.column("v").flatten().to_numpy().reshape(-1, dim))
                words, *rest = sketches(v)
                keys = codes(v, bits, tables).astype("<i4")
                packed = [pa.array([x.tobytes() for x in k], pa.binary()) for k in (keys, words)]
                yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("n"), pa.array(np.full(len(v), dim, "i4")), *packed, *map(pa.array, rest)], schema=CODES)

    coded = stored(reps.select("rep", "n", "v").mapInArrow(encode, "rep long, n long, dim int, keys binary, words binary, factor double, low double, step double"), "codes")
    kinds = reps.select("rep", F.xxhash64("label", F.size("v")).alias("kind"))
    keyed = stored(coded.join(kinds.hint("shuffle_merge"), "rep"), "kinds")
    key = lambda t: F.expr(f"substring(keys, 4 * {t} + 1, 4)")
    narrow = stored(keyed.select("rep", F.posexplode(F.array(*(F.xxhash64("kind", F.lit(t), key(t)) for t in range(tables)))).alias("t", "bucket")), "buckets")
    full = narrow.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    members = narrow.join(full.hint("shuffle_merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = members.select("rep", "t", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "rep", "t", "block", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    )

    def judged(df: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of whole cells of one dimension that are first met here and that the bounds leave open."""
        dim = int(df["dim"].iloc[0])
        keys = np.frombuffer(b"".join(df["keys"]), "<i4").reshape(len(df), -1)
        words = np.frombuffer(b"".join(df["words"]), np.uint8).reshape(len(df), -1)
        rep, kind, t, block = (df[c].to_numpy() for c in ("rep", "kind", "t", "block"))
        code = [df[c].to_numpy() for c in ("factor", "low", "step")]
        for i, j in _cell_pairs(df["cell"].to_numpy(), block):
            same = keys[i] == keys[j]
            first = same.any(axis=1) & (same.argmax(axis=1) == t[i]) & (kind[i] == kind[j]) & (rep[i] != rep[j])
            i, j = i[first], j[first]
            estimate, off = estimates(words, *code, dim, i, j)
            open_ = estimate + off >= threshold
            yield i[open_], j[open_]

    def screen(df: pd.DataFrame) -> pd.DataFrame:
        at = [np.concatenate(p) for p in judged(df)]
        at = np.unique(np.concatenate(at)) if at else np.zeros(0, int)
        return df.iloc[at][["rep", "t", "block", "cell"]]

    def exact(df: pd.DataFrame) -> pd.DataFrame:
        """Counts, and a spanning forest of the links of the cells."""
        v, rep, n = unit(np.array(df["v"].tolist())), df["rep"].to_numpy(), df["n"].to_numpy()
        counts, root, forest = np.zeros(len(df), np.int64), {}, []

        def find(z):
            while root.setdefault(z, z) != z:
                root[z] = z = root[root[z]]
            return z

        for i, j in judged(df):
            hit = (v[i] * v[j]).sum(axis=1) >= threshold
            i, j = i[hit], j[hit]
            np.add.at(counts, i, n[j])
            np.add.at(counts, j, n[i])
            for a, b in zip(rep[i].tolist(), rep[j].tolist(), strict=True):
                p, q = find(a), find(b)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    forest.append((a, b))
        some = counts > 0
        links = pd.DataFrame({"rep": rep[some], "links": counts[some], "other": None})
        edges = pd.DataFrame(forest, columns=["rep", "other"]).assign(links=None)
        return pd.concat([x for x in (links, edges) if len(x)] or [links])[["rep", "links", "other"]].astype({"rep": "int64", "links": "Int64", "other": "Int64"})

    def cells(of: DataFrame, fn, schema: str, columns: list[str]) -> DataFrame:
        rows = of.select("cell", "t", "block", "rep", "n", "dim", "kind", "keys", "words", "factor", "low", "step", *columns)
        return rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(_whole_cells(fn), schema)

    stay = stored(cells(dealt.join(keyed.hint("shuffle_merge"), "rep"), screen, "rep long, t int, block int, cell long", []), "open")
    vectors_of = keyed.join(reps.select("rep", "v").hint("shuffle_merge"), "rep")
    found = stored(cells(stay.join(vectors_of.hint("shuffle_merge"), "rep"), exact, "rep long, links long, other long", ["v"]), "links")
    links = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    placed = stored(reps.select("rep", "least").join(parts.withColumnRenamed("node", "rep").hint("shuffle_merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = stored(placed.join(ids.hint("shuffle_merge"), "component").select("rep", "component_id"), "components")
    classes = reps.join(links.hint("shuffle_merge"), "rep", "left").join(placed.hint("shuffle_merge"), "rep")
    classes = stored(classes.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "classes")
    return (
        base.join(classes.hint("shuffle_merge"), ["label", "v"], "left")
        .select(F.col("id").alias(vec_id), F.col("label").alias(label), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(False)))
    )


CODES = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("keys", pa.binary()), ("words", pa.binary()), ("factor", pa.float64()), ("low", pa.float64()), ("step", pa.float64())])


def _cell_pairs(cell: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of each cell: between its two blocks, or of its one block; many cells at once, large ones in parts."""
    cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
    left, right, size = [], [], 0
    for s, e in zip(cuts, cuts[1:], strict=False):
        if e - s == 2:
            parts = [(np.array([s]), np.array([s + 1]))]
        elif e - s > 2:
            one = block[s:e] == block[s]
            a, b = s + np.flatnonzero(one), s + np.flatnonzero(~one)
            if len(b):
                parts = ((np.full(len(b), x), b) for x in a.tolist())
            else:
                parts = ((np.full(e - x - 1, x), np.arange(x + 1, e)) for x in range(s, e - 1))
        else:
            continue
        for i, j in parts:
            left.append(i)
            right.append(j)
            size += len(i)
            if size >= _PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def _whole_cells(fn):
    """Batches of rows sorted by cell to `fn` of rows of whole cells of one dimension; a cell runs on from batch to batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for df in _with_end(batches):
            now = df if rest is None else rest if df is None else pd.concat([rest, df], ignore_index=True)
            if now is None or not len(now):
                continue
            ends = np.flatnonzero(np.diff(now["cell"].to_numpy())) + 1
            cut = len(now) if df is None else int(ends[-1]) if len(ends) else 0
            rest = now.iloc[cut:] if df is not None else None
            for _, part in now.iloc[:cut].groupby("dim"):
                out = fn(part)
                if len(out):
                    yield out

    return run


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None
