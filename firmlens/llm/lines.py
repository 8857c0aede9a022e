"""Fuzzy line dedup by MinHash.

1. Equal lines collapse by an aggregation of their keys (96 bits) with map-side combining;
   a line's id is its first occurrence, document and place in one long. Texts are neither
   shuffled nor kept; those of lines that meet others are read from the documents again.
2. In the same aggregation each line's character shingles are hashed; the hash space has BINS bins,
   and each keeps its smallest hash (one-permutation MinHash). Hashes too large to be a
   bin's smallest are passed over before the minima. Lines with a bin that this may have
   emptied, which are those that repeat themselves and BINS * exp(-PER_BIN) of the others,
   are hashed again without passing over any, so every bin holds its true minimum.
3. Banding: the bins are the edges of a cube, and the three at each corner are a band. Two
   lines of similarity 0.8 share a band and AGREE bins with a probability of 0.98, nearer
   ones with more.
4. In a bucket each line is paired with the first line and with the one before it, if
   AGREE bins agree. Bitmaps of all shingles, made once a line, rule out pairs that are
   surely below the threshold; the others count after an exact Jaccard check of the full sets.
   Distributed union-find joins the pairs.
5. Where a bucket of three or more still holds several components, no pair with AGREE
   bins is left unchecked: up to SMALL_BUCKET lines meet each other; the lines of larger
   buckets, which one template's lines fill, go through an exact join by their rarest
   shingles (prefix filter). What links is added to the components.
6. One line per component stays, the first.

Only DataFrame functions; the hot loops (hashing, minima, buckets) run in generated code.
A bucket is streamed by a window, never collected. Shingles are runs of SHINGLE UTF-16
units, whose fixed width makes each a slice of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import connected_components, extended, stored

#: Characters of a shingle.
SHINGLE = 8
#: Lines that share this part of their shingles are the same.
THRESHOLD = 0.8
#: Lines of fewer UTF-8 bytes (headings, marks) are no passages and always stay.
MIN_BYTES = 20
BINS = 12
#: Hashes a bin that are looked at, on average.
PER_BIN = 6
#: The edges at each corner of a cube.
BANDS = [(0, 1, 2), (0, 3, 4), (1, 5, 6), (3, 5, 7), (2, 8, 9), (4, 8, 10), (6, 9, 11), (7, 10, 11)]
#: Bins that a pair must agree in before it is checked.
AGREE = 6
#: Bits a bin in a sketch.
_BITS = 5
#: Words of 64 bits in a line's bitmap (a power of two).
WORDS = 16
#: In buckets up to this many lines all pairs are compared.
SMALL_BUCKET = 256
#: Keys are broadcast up to this many.
BROADCAST_KEYS = 1_000_000
#: The lines that documents lose are broadcast up to so many places.
BROADCAST_PLACES = 4_000_000
_PLACE_BITS = 24


def occurrences(docs: DataFrame, doc_id: str, text: str, min_bytes: int) -> DataFrame:
    """(at, line): the lines of all documents that take part; `at` holds document and place."""
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("p", "line"))
    return rows.where(F.octet_length("line") >= min_bytes).select((F.col("d") * (1 << _PLACE_BITS) + F.col("p")).alias("at"), "line")


def key(line: Column) -> list[Column]:
    """96 bits that stand for a line where its text is not needed."""
    return [F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")]


def signatures(docs: DataFrame, doc_id: str, text: str, min_bytes: int) -> DataFrame:
    """(id, n, h1, h2, v0, v1 ...): each distinct line's first occurrence, occurrences, key, and the smallest shingle hash of each bin, by 31 bits and 1; 0 for a bin without a shingle.

    Lines are told apart by their keys, so that no text is shuffled or kept.
    """
    found = occurrences(docs, doc_id, text, min_bytes)
    hashed = _hashed(found.select("at", *key(F.col("line")), F.lit(1).alias("n"), "line"), "at", "n", "h1", "h2")
    first = stored(_minima(hashed, True), "minima")
    # A line of no document has no place to read it from, and meets no other.
    again = stored(first.where("open and id is not null").select("id", "n", "h1", "h2"), "open_lines")
    whole = stored(_minima(_hashed(read_lines(docs, doc_id, text, again).where(of_key()).withColumnRenamed("id", "at"), "at", "n", "h1", "h2"), False), "whole")
    signed = first.where("not open or id is null").unionByName(whole)
    halves = (F.expr(f"shiftrightunsigned(p{i // 2}, 32)" if i % 2 == 0 else f"p{i // 2} & 4294967295L").alias(f"v{i}") for i in range(BINS))
    return signed.select("id", "n", "h1", "h2", *halves)


def read_lines(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """`wanted` (stored: id and more) with `line`, read from the documents; no others are split. Where a doc_id repeats, a place may have several lines."""
    place = F.struct(F.col("id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int").alias("p"), *wanted.columns)
    places = wanted.groupBy(F.shiftright("id", _PLACE_BITS).alias("d")).agg(F.collect_list(place).alias("places"))
    side = F.broadcast(places) if wanted.count() <= BROADCAST_KEYS else places.hint("shuffle_merge")
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).join(side, "d").select("places", F.split("t", "\n").alias("all"))
    return rows.select("all", F.inline("places")).select(*wanted.columns, F.get("all", F.col("p")).alias("line")).where("line is not null")


def of_key() -> Column:
    """Whether `line` is that of the key beside it."""
    return F.expr("h1 = xxhash64(line) and h2 = hash(line)")


def texts_of(docs: DataFrame, doc_id: str, text: str, signed: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line): the lines of `ids` (stored)."""
    lines = stored(read_lines(docs, doc_id, text, ids), "texts")
    if lines.count() == ids.count():
        return lines
    # A doc_id repeats: the key tells which lines are meant.
    keys = some_of(signed.select("id", "h1", "h2"), ids, "id")
    named = lines.select("id", *key(F.col("line")), "line").join(keys.hint("shuffle_merge"), ["id", "h1", "h2"], "left_semi")
    return stored(named.dropDuplicates(["id", "h1", "h2"]).select("id", "line"), "texts")


def _minima(hashed: DataFrame, pass_over: bool) -> DataFrame:
    """(id, n, h1, h2, p0, p1 ..., open) of `hashed` (at, n, h1, h2, last, i, h), by key: the minima of each line's bins and 1, two in a long, 0 for empty ones; and whether passing over may have emptied one.

    Without passing over, `hashed` are distinct lines with their `n` (repeated rows add nothing).
    """
    v = hashed.withColumn("v", F.shiftrightunsigned("h", 33))
    low = F.expr(f"v * (last + 1) < {BINS * PER_BIN << 31}L" if pass_over else "true")
    # The first shingle's row stays, so that each line has one.
    some = v.where(low | (F.col("i") == 0)).select("at", "n", "h1", "h2", "last", "i", F.expr(f"(h & 65535) % {BINS}").alias("b"), F.when(low, F.col("v") + 1).alias("v"))
    n = F.sum(F.when(F.col("i") == 0, F.col("n")).otherwise(0)) if pass_over else F.max("n")
    least = some.groupBy("h1", "h2", "last").agg(
        F.min("at").alias("id"), n.cast("long").alias("n"), *(F.min(F.when(F.col("b") == i, F.col("v"))).alias(f"v{i}") for i in range(BINS))
    )
    # Six columns are written in half the time of twelve.
    pairs = (F.expr(f"shiftleft(coalesce(v{i}, 0L), 32) | coalesce(v{i + 1}, 0L)").alias(f"p{i // 2}") for i in range(0, BINS, 2))
    open_ = F.expr(f"last >= {BINS * PER_BIN} and ({' or '.join(f'v{i} is null' for i in range(BINS))})" if pass_over else "false")
    return least.select("id", "n", "h1", "h2", *pairs, open_.alias("open"))


def _hashed(lines: DataFrame, *names: str) -> DataFrame:
    """(names, last, i, h): a row for each shingle of each line; its place and hash, and the last one's place."""
    units = lines.select(*names, F.encode("line", "UTF-16BE").alias("u")).select(*names, "u", F.expr(f"greatest(0, cast(octet_length(u) / 2 as int) - {SHINGLE})").alias("last"))
    runs = units.select(*names, "u", "last", F.explode(F.expr("sequence(0, last)")).alias("i"))
    return runs.select(*names, "last", "i", F.expr(f"xxhash64(substring(u, 2 * i + 1, {2 * SHINGLE}))").alias("h"))


def bitmaps(texts: DataFrame) -> DataFrame:
    """(id, size, w0, w1 ...) of `texts` (id, line): the bits that a line's shingles set among 64 * WORDS, and no fewer than its shingles."""
    hashed = _hashed(texts.select("id", key(F.col("line"))[0], "line"), "id", "h1")
    bits = hashed.select("id", "h1", "last", F.expr(f"shiftrightunsigned(h, 6) & {WORDS - 1}").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    words = [F.expr(f"bit_or(if(w = {i}, bit, 0L))").alias(f"w{i}") for i in range(WORDS)]
    return bits.groupBy("id", "h1", "last").agg(*words).select("id", (F.col("last") + 1).alias("size"), *(f"w{i}" for i in range(WORDS)))


def may_reach(x: str, y: str, threshold: float) -> Column:
    """Whether two lines' bitmaps leave it open that they are similar; columns end in x and y. No similar pair fails.

    Each bit that one line alone sets is a shingle that it alone has, and sets of n and m
    shingles reach t only with at most (n + m)(1 - t) / (1 + t) such shingles.
    """
    alone = " + ".join(f"bit_count(w{i}{x} ^ w{i}{y})" for i in range(WORDS))
    return F.expr(f"{alone} <= (size{x} + size{y}) * {(1 - threshold) / (1 + threshold)!r}D + 1e-6D")


def sieved(pairs: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that may be similar by their bitmaps."""
    a, b = (maps.select(*(F.col(c).alias(c + v) for c in maps.columns)) for v in "xy")
    both = pairs.join(b.hint("shuffle_merge"), F.col("b") == F.col("idy")).join(a.hint("shuffle_merge"), F.col("a") == F.col("idx"))
    return both.where(may_reach("x", "y", threshold)).select("a", "b").distinct()


def agree(s: str, t: str) -> str:
    """Whether two sketches may agree in AGREE bins, as SQL."""
    ones = sum(1 << _BITS * i for i in range(BINS))
    differ = " | ".join(f"shiftrightunsigned({s} ^ {t}, {i})" for i in range(_BITS))
    return f"bit_count(({differ}) & {ones}L) <= {BINS - AGREE}"


def met(signed: DataFrame) -> DataFrame:
    """(id, others, bucket, s, first): each line of a bucket but the first, by bucket.

    `others` are the bucket's first line and the line before where AGREE bins agree. Only
    buckets of three lines and more carry bucket, sketch and first line (else null). A
    bucket is a band's bins; bands that are empty or could meet no other count for nothing. Sketches
    keep a few bits a bin, so no pair is missed and no second look at the signatures is due.
    """
    keys = [F.when(F.expr("least({0}) >= 0 and greatest({0}) > 0".format(", ".join(f"v{i}" for i in band))), F.xxhash64(F.lit(n), *(F.col(f"v{i}") for i in band))) for n, band in enumerate(BANDS)]
    sketch = F.expr(" | ".join(f"shiftleft(v{i} & {(1 << _BITS) - 1}, {_BITS * i})" for i in range(BINS)))
    rows = signed.where("id is not null").select("id", sketch.alias("s"), F.explode(F.array(*keys)).alias("bucket")).where("bucket is not null").repartition("bucket")
    # Most buckets hold one line: they go before the sort. One exchange serves both sides: both use all columns, and no semi join replaces it.
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.expr("bit_xor(id)").alias("x"), F.expr("bit_xor(s)").alias("s"))
    meet = sizes.where(F.expr(f"n > 2 or n = 2 and x != 0 and {agree('s', '0L')}")).select("bucket")
    w = Window.partitionBy("bucket").orderBy("id")
    each = rows.join(meet.hint("shuffle_hash"), "bucket").select(
        "bucket", "id", "s", F.first(F.struct("id", "s")).over(w).alias("first"), F.lag(F.struct("id", "s")).over(w).alias("before"), F.lead("id").over(w).alias("next")
    ).where("before is not null")
    near = [F.when(F.expr(agree("s", f"{o}.s")), F.col(f"{o}.id")) for o in ("first", "before")]
    crowded = F.expr("first.id != before.id or next is not null")
    kept = [F.when(crowded, F.col(c)).alias(c) for c in ("bucket", "s", "first")]
    return each.select("id", F.array_compact(F.array_distinct(F.array(*near))).alias("others"), *kept).where("bucket is not null or size(others) > 0")


def crowds(met_: DataFrame, same: DataFrame) -> DataFrame:
    """(bucket, id, s, c, n): the lines of buckets of three and more that hold several components; c the line's, n the bucket's lines."""
    lines = met_.where("bucket is not null").select("bucket", F.explode(F.array(F.struct("id", "s"), "first")).alias("o")).select("bucket", "o.*").distinct()
    of = stored(lines.join(same.hint("shuffle_merge"), "id", "left").select("bucket", "id", "s", F.coalesce("component", "id").alias("c")), "crowds")
    mixed = of.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("n")).where("x != y").select("bucket", "n")
    return of.join(mixed.hint("shuffle_merge"), "bucket")


def all_pairs(crowd: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of different components in a bucket that agree in AGREE bins and may be similar by their bitmaps."""
    mapped = crowd.join(maps.hint("shuffle_merge"), "id")
    x, y = (mapped.select("bucket", *(F.col(k).alias(k + v) for k in ("id", "s", "c", *maps.columns[1:]))) for v in "xy")
    fits = (x["bucket"] == y["bucket"]) & F.expr("idx > idy and cx != cy") & F.expr(agree("sx", "sy")) & may_reach("x", "y", threshold)
    return x.hint("shuffle_merge").join(y, fits).select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct()


def rare_pairs(open_: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of `open_` lines (id, c) of different components, all that can have this similarity.

    Shingles are ordered from rare to common. The first common one of two similar sets is
    among the first n - t n + 1 of the larger, and among the first n - 2t / (1 + t) n + 1 of
    the smaller: what all lines of a template share comes later, unless it is nearly all of
    them. Only shingles of several components are joined.
    """
    texts = stored(lines.select("id", "line").join(open_.hint("shuffle_merge"), "id"), "texts")
    sets = texts.select("id", "c", F.array_distinct(_hashes("line")).alias("hs"))
    # explode_outer, since Spark would make each set anew to test that it is not empty.
    rows = stored(sets.select("id", "c", F.size("hs").alias("n"), F.explode_outer("hs").alias("h")), "shingles")
    often = rows.groupBy("h").agg(F.count("*").alias("often"), F.min("c").alias("x"), F.max("c").alias("y"))
    ranked = rows.join(often.hint("shuffle_merge"), "h").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("often", "h")))
    first = lambda t: F.col("at") <= F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1
    front = stored(ranked.where(first(threshold)).where("x != y").select("h", "id", "c", "n", "at"), "front")
    x, y = (df.select("h", *(F.col(k).alias(k + v) for k in ("id", "c", "n", "at"))) for v, df in (("x", front.where(first(2 * threshold / (1 + threshold)))), ("y", front)))
    fits = (
        (x["h"] == y["h"]) & (F.col("cx") != F.col("cy")) & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("idx") < F.col("idy"))))
        & (F.col("nx") >= threshold * F.col("ny") - 1e-9)
        & ((1 + F.least(F.expr("nx - atx"), F.expr("ny - aty"))) * (1 + threshold) >= threshold * (F.col("nx") + F.col("ny")) - 1e-9)
    )
    return x.hint("shuffle_merge").join(y, fits).select(F.greatest("idx", "idy").alias("a"), F.least("idx", "idy").alias("b")).distinct()


def _hashes(line: str) -> Column:
    """The hashes of all shingles of a line; a shorter line is its own.

    The bytes are bound by an outer lambda once, so that the inner one does not copy them for each shingle.
    """
    return F.expr(
        f"transform(array(encode({line}, 'UTF-16BE')), u -> transform(sequence(1, greatest(1, octet_length(u) - {2 * SHINGLE - 1}), 2), "
        f"i -> xxhash64(substring(u, i, {2 * SHINGLE}))))[0]"
    )


def beside(side: DataFrame) -> DataFrame:
    """`side` (stored) with its join's strategy: broadcast up to a checked count, else by shuffle."""
    return F.broadcast(side) if side.count() <= BROADCAST_KEYS else side.hint("shuffle_merge")


def some_of(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`rows` whose key is in `keys` (stored, one column): by broadcast up to a checked count, else by shuffle."""
    return rows.join(beside(keys), key, "left_semi")


def similar(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """The pairs (stored) whose shingle sets have at least this Jaccard similarity."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = stored(some_of(lines.select("id", "line"), ids, "id"), "texts")
    # Dealt out before they are made, the sets of `a` are made once a line and not shuffled.
    x = texts.repartition("id").select(F.col("id").alias("a"), F.array_distinct(_hashes("line")).alias("ha"))
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("line").alias("tb")).hint("shuffle_merge"), "b").join(x.hint("shuffle_merge"), "a")
    sets = both.select("a", "b", "ha", F.array_distinct(_hashes("tb")).alias("hb"))
    # |A and B| >= t |A or B| if and only if |A| + |B| >= (1 + t) |A or B|: one union a pair.
    # A generator's rows, since Spark would else move the condition below and make each set anew for each mention.
    sizes = sets.select("a", "b", F.inline(F.array(F.struct((F.size("ha") + F.size("hb")).alias("n"), F.size(F.array_union("ha", "hb")).alias("union")))))
    return sizes.where(F.col("n") >= (1 + threshold) * F.col("union") - 1e-9).select("a", "b")


def dropped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, places): for each document that loses lines, their places from 0."""
    signed = signatures(docs, doc_id, text, min_bytes)
    met_ = stored(met(signed), "met")
    ids = stored(met_.select(F.explode(F.expr("array_compact(concat(array(id, first.id), others))")).alias("id")).distinct(), "ids")
    lines = texts_of(docs, doc_id, text, signed, ids)
    maps = stored(bitmaps(lines), "bitmaps")
    pairs = stored(sieved(met_.select(F.col("id").alias("a"), F.explode("others").alias("b")).distinct(), maps, threshold), "pairs")
    links = stored(similar(pairs, lines, threshold), "same")
    same = stored(connected_components(links), "components").withColumnRenamed("node", "id")
    crowd = stored(crowds(met_, same), "crowd")
    if not crowd.isEmpty():
        large = stored(crowd.where(F.col("n") > SMALL_BUCKET).select("id", "c").distinct(), "open")
        more = all_pairs(crowd.where(F.col("n") <= SMALL_BUCKET), maps, threshold)
        more = more if large.isEmpty() else more.unionByName(sieved(rare_pairs(large, lines, threshold), maps, threshold)).distinct()
        more = stored(similar(stored(more, "pairs"), lines, threshold), "same")
        same = extended(same.withColumnRenamed("id", "node"), more).withColumnRenamed("node", "id")
    # Lines that occur once and resemble none lose nothing; the others, by key.
    named = signed.select("id", "n", "h1", "h2").join(beside(same), "id", "left")
    repeated = stored(named.where("n > 1 or component is not null").select("h1", "h2", F.coalesce("component", "id").alias("keep")), "repeated")
    gone = occurrences(docs, doc_id, text, min_bytes).select("at", *key(F.col("line"))).join(beside(repeated), ["h1", "h2"]).where("at != keep")
    return gone.select(F.shiftright("at", _PLACE_BITS).alias("_fl_doc"), F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int").alias("p")).groupBy("_fl_doc").agg(
        F.collect_set("p").alias("_fl_places")
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """`docs` with `text` less the lines that stay elsewhere, and n_lines and n_removed (long).

    Of each component of similar lines the occurrence with the smallest doc_id, then
    place, stays. Lines of fewer than `min_bytes` bytes of UTF-8 always stay; null texts stay
    null, empty ones empty, and a text may become empty. Repeated rows with one doc_id
    count as one document; a null id is a document that keeps its lines. Columns with the
    new names are replaced. Ids must be in +-2**38, and a text may have 2**24 lines.
    """
    gone = stored(dropped(docs, doc_id, text, threshold, min_bytes), "gone")
    all_ = F.split(F.col(text), "\n")
    kept = F.when(F.col("_fl_places").isNull(), F.col(text)).otherwise(
        F.array_join(F.filter(all_, lambda line, i: ~F.array_contains("_fl_places", i)), "\n")
    )
    size = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_fl_places")), F.lit(0)).alias("p")).first()
    side = F.broadcast(gone) if size["n"] <= BROADCAST_KEYS and size["p"] <= BROADCAST_PLACES else gone.hint("shuffle_merge")
    joined = docs.join(side, F.col(doc_id).cast("long") == F.col("_fl_doc"), "left")
    return (
        joined.withColumn("n_lines", F.coalesce(F.size(all_), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("_fl_places"), F.lit(0)).cast("long"))
        .withColumn(text, kept).select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
    )
