"""Product codes of vectors, trained by rounds of assignment, each assignment found by Orchard's search.

Vectors become integers and are cut into equal parts; each part position has a codebook.
An assignment keeps, for every entry, all entries sorted by distance from it. A search
walks the list of its current entry, marks what it has visited, jumps to the list of any
entry that is nearer, and stops where the list goes beyond twice the current distance:
by the triangle inequality nothing nearer, or as near with a lower index, can follow.

A round is one pass over the written vectors. Tasks hand on sums of their parts, at most
parts x entries rows each, which combine map-side; only codebooks (entries x dimension
integers) reach the driver and go out with the next pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers are held within plus and minus this, so that distances stay exact in 64 bits up to 16,000 dimensions.
LIMIT = 1 << 24
#: Components that are searched at a time.
_AT_ONCE = 1 << 21
#: Label sums are broadcast up to this many.
BROADCAST_LABELS = 50_000

#: Codebooks by dimension: arrays of (parts, entries, components of a part).
Books = dict[int, np.ndarray]


def whole(vectors: np.ndarray, scale: int = SCALE, parts: int = PARTS) -> np.ndarray:
    """(rows, parts, components) floor(scale * x); zeros fill up a last part."""
    v = np.clip(np.floor(vectors.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)
    return np.pad(v, ((0, 0), (0, -v.shape[1] % parts))).reshape(len(v), parts, -1)


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry: all entries by squared distance from it, then index; and these distances."""
    apart = ((book[:, None] - book[None]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, axis=1)


def search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each row of x, ties to the lower index, by Orchard's search."""
    order, apart = neighbours(book)
    n, entries = len(x), len(book)
    now, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    best = ((x - book[0]) ** 2).sum(axis=1)
    visited = np.zeros((n, entries), bool)
    visited[:, 0] = True
    going = np.arange(n)
    while len(going):
        going = going[place[going] < entries]
        going = going[apart[now[going], place[going]] <= 4 * best[going]]
        y = order[now[going], place[going]]
        place[going] += 1
        new = ~visited[going, y]
        at, y = going[new], y[new]
        visited[at, y] = True
        d = ((x[at] - book[y]) ** 2).sum(axis=1)
        nearer = (d < best[at]) | ((d == best[at]) & (y < now[at]))
        at, y = at[nearer], y[nearer]
        now[at], best[at], place[at] = y, d[nearer], 0
    return now, best


def _assigned(batch: pa.RecordBatch, books: Books, scale: int, parts: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, rows, integers, entries, distances), rows of one dimension and bounded size at a time."""
    dims = pc.list_value_length(batch.column("v")).to_numpy()
    for dim in np.unique(dims).tolist():
        some = batch.filter(pa.array(dims == dim))
        size = max(1, _AT_ONCE // max(dim, 1))
        for k in range(0, len(some), size):
            rows = some.slice(k, size)
            x = whole(rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim), scale, parts)
            found = [search(x[:, p], books[dim][p]) for p in range(parts)]
            yield dim, rows, x, np.column_stack([i for i, _ in found]), np.column_stack([d for _, d in found])


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, v): the vectors without null, NaN or infinite components, written to the shared folder."""
    e = F.col(embedding).cast("array<double>")
    good = F.col(embedding).isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return stored(vectors.where(good).select(F.col(vec_id).alias("id"), F.col(label).alias("label"), e.alias("v")), "vectors")


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Books:
    """Codebooks of `prepared` rows.

    They begin as the vectors with the smallest ids (ties by the vector, null ids last).
    Each round replaces an entry by the floor of the mean of the parts nearest to it; an
    entry without parts stays. Fewer vectors than entries give fewer entries. Vectors of
    different length have codebooks of their own, and tables hold few lengths.
    """
    books: Books = {}
    for (dim,) in rows.select(F.size("v")).distinct().collect():
        first = rows.where(F.size("v") == dim).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        books[dim] = whole(np.array([r.v for r in first]).reshape(len(first), dim), scale, parts).transpose(1, 0, 2)
    for _ in range(rounds if books else 0):
        books = _moved(rows, books, parts, scale)
    return books


def _moved(rows: DataFrame, books: Books, parts: int, scale: int) -> Books:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {dim: (np.zeros(b.shape, np.int64), np.zeros(b.shape[:2], np.int64)) for dim, b in books.items()}
        for batch in batches:
            for dim, _, x, found, _ in _assigned(batch, books, scale, parts):
                for p in range(parts):
                    np.add.at(total[dim][0][p], found[:, p], x[:, p])
                    np.add.at(total[dim][1][p], found[:, p], 1)
        for dim, (s, n) in total.items():
            for p, e in np.argwhere(n).tolist():
                yield pa.RecordBatch.from_pydict({"dim": [dim], "part": [p], "entry": [e], "n": [int(n[p, e])], "s": [s[p, e].tolist()]}, schema=SUMS)

    partial = rows.select("v").mapInArrow(sums, "dim int, part int, entry int, n long, s array<long>")
    spread = partial.select("dim", "part", "entry", "n", F.posexplode_outer("s").alias("at", "x"))
    grouped = spread.groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(28,0)")).alias("x"))
    after = {dim: b.copy() for dim, b in books.items()}
    for r in grouped.where("at is not null").collect():  # the components of the codebooks
        after[r.dim][r.part, r.entry, r.at] = int(r.x) // r.n
    return after


def encode(rows: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """(id, label, dim, code, error) of `prepared` rows: the nearest entries, two hex digits a part, and the sum of squared distances."""
    parts = len(next(iter(books.values()), ()))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some, _, found, d in _assigned(batch, books, scale, parts):
                text = [bytes(r).hex() for r in found.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), pa.array(np.full(len(some), dim, "i4")), pa.array(text, pa.string()), pa.array(d.sum(axis=1))], names=["id", "label", "dim", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, dim int, code string, error long")


def decode(codes: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """`codes` (dim, code) with `approx`: the vector that a code stands for."""

    def vectors(dims, texts):
        for dim, t in zip(dims.tolist(), texts, strict=True):
            b = books[dim]
            yield (b[np.arange(len(b)), np.frombuffer(bytes.fromhex(t), np.uint8)].reshape(-1)[:dim] / scale).tolist()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            approx = pa.array(list(vectors(batch.column("dim").to_numpy(), batch.column("code").to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, approx], names=[*batch.schema.names, "approx"])

    inner = ", ".join(f"`{c}` {t}" for c, t in codes.dtypes)
    return codes.mapInArrow(decoded, f"{inner}, approx array<double>")


def digest(book: np.ndarray) -> str:
    """SHA-256 of a codebook's decimal integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """(vec_id, label, dim, code, error, label_error) of each vector that takes part, and the codebooks.

    Null vectors and those with null, NaN or infinite components are left out; empty ones
    have an empty part at each position and the error 0. Repeated ids are rows of their
    own. Components beyond 4096 are held there (at the default scale). `label_error` sums the errors of all rows of a
    label; null labels are one. An empty table gives no row and no codebook.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold up to 256 entries")
    rows = prepared(vectors, vec_id, embedding, label)
    books = train(rows, parts, entries, rounds, scale)
    coded = stored(encode(rows, books, scale), "codes")
    sums = stored(coded.groupBy(F.col("label").alias("_fl_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    side = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums.hint("shuffle_merge")
    out = coded.join(side, F.col("label").eqNullSafe(F.col("_fl_label")), "left")
    return out.select(F.col("id").alias(vec_id), F.col("label").alias(label), "dim", "code", "error", "label_error"), books


SUMS = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])
