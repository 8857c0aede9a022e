"""Entity resolution: listings to companies by domain, exact name and fuzzy name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import text as T
from firmlens.operators.components import connected_components
from firmlens.sources.shared import stored

MIN_NAME_LENGTH = 4
NAME_SCORE = 93
#: Bits of a word of `lcs_length`; a sum of two words and a carry stays a positive long.
WORD = 62
#: Rows of a batch (names, domains, trigrams) are broadcast to the known companies up to so many.
BROADCAST_ROWS = 200_000


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(name), r"\s+")), " ")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def lcs_length(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence, bit by bit in parallel: a set bit is a place of x that does not lengthen it.

    For each character of y, the places of x with that character move the lowest set bits of
    their stretch by one addition; words of WORD bits hand a carry on. Work grows with
    length(y) * length(x) / WORD.
    """
    zero = F.lit(0).cast("long")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)

    def of_chars(chars: Column) -> Column:
        n = F.size(chars)
        words = F.sequence(F.lit(0), F.floor((n - 1) / WORD).cast("int"))
        size = lambda w: F.least(n - w * WORD, F.lit(WORD))

        def mask(c: Column, w: Column) -> Column:
            """The places of c in word w."""
            return F.aggregate(F.sequence(F.lit(0), size(w) - 1), zero, lambda m, i: F.when(F.get(chars, w * WORD + i) == c, m.bitwiseOR(bit(i))).otherwise(m))

        places = F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("c"), F.transform(words, lambda w: mask(c, w)).alias("m"))))
        return _let(F.struct(places.alias("places"), words.alias("words"), F.transform(words, lambda w: bit(size(w)) - 1).alias("ones")), lambda k: n - matched(k))

    def matched(k: Column) -> Column:
        def step(v: Column, c: Column) -> Column:
            def word(s: Column, at: Column) -> Column:
                old, m = at["0"], at["1"]
                hit = old.bitwiseAND(m)
                total = old + hit + s["carry"]
                now = total.bitwiseAND((1 << WORD) - 1).bitwiseOR(old - hit)
                return F.struct(F.concat(s["v"], F.array(now)).alias("v"), F.shiftright(total, WORD).alias("carry"))

            start = F.struct(F.array().cast("array<long>").alias("v"), zero.alias("carry"))
            moved = lambda m: F.aggregate(F.arrays_zip(v.alias("0"), m.alias("1")), start, word, lambda s: s["v"])
            return _let(F.try_element_at(k["places"], c), lambda m: F.when(m.isNull(), v).otherwise(moved(m)))

        def left(v: Column) -> Column:
            return F.aggregate(F.zip_with(v, k["ones"], lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda a, b: a + b)

        return F.aggregate(F.split(y, ""), k["ones"], step, left)

    return F.when((F.length(x) == 0) | (F.length(y) == 0), 0).otherwise(_let(F.split(x, ""), of_chars))


def token_sort_score(x: Column, y: Column) -> Column:
    """0..100: twice the common subsequence over both lengths, of names with sorted words."""
    a, b = sorted_tokens(x), sorted_tokens(y)
    return 200.0 * lcs_length(a, b) / F.greatest(F.length(a) + F.length(b), F.lit(1))


def trigrams(name: Column) -> Column:
    t = sorted_tokens(name)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substr(t, i, F.lit(3))))


def _budget(n: Column, threshold: int) -> Column:
    """Trigrams that a name of n characters signs with: as many as differing characters could hide, and one more.

    The insertions and deletions between two names are at most (1 - s) * (|a| + |b|), and
    |b| <= |a| * (2 - s) / s; each touches three trigrams.
    """
    s = threshold / 100
    return 3 * F.floor((1 - s) * 2 / s * n) + 1


def _scored(pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (t1, n1, t2, n2) with `score`, those that reach the threshold. The edit distance, which is never more, goes before the exact one."""
    most = F.floor((1 - threshold / 100) * (F.col("n1") + F.col("n2")) + 1e-9)
    near = pairs.where((F.abs(F.col("n1") - F.col("n2")) <= most) & (F.levenshtein("t1", "t2") <= most))
    return near.withColumn("score", token_sort_score(F.col("t1"), F.col("t2"))).where(F.col("score") >= threshold)


def fuzzy_name_edges(names: DataFrame, threshold: int = NAME_SCORE, min_length: int = MIN_NAME_LENGTH) -> DataFrame:
    """(a, b, score): pairs of (key, name_norm) whose score reaches the threshold, a < b.

    Pairs share a trigram and a length band. Each name signs only with its rarest trigrams,
    so a trigram that very many names have is not a block.
    """
    base = stored(names.where(F.length("name_norm") >= min_length).select("key", sorted_tokens(F.col("name_norm")).alias("t")), "names")
    signed = _ranked(base, _gram_counts(base)).where(F.col("rank") <= _budget(F.col("n"), threshold)).select("key", "t", "n", "g")
    signed = stored(signed, "signed")
    x, y = (signed.select(*(F.col(c).alias(c + k) if c != "g" else F.col("g") for c in signed.columns)) for k in ("1", "2"))
    pairs = x.join(y.hint("shuffle_merge"), "g").where("key1 < key2").drop("g").distinct()
    return _scored(pairs, threshold).select(F.col("key1").alias("a"), F.col("key2").alias("b"), "score")


def _gram_counts(base: DataFrame) -> DataFrame:
    return stored(base.select(F.explode(trigrams(F.col("t"))).alias("g")).groupBy("g").agg(F.count("*").alias("c")), "trigrams")


def _ranked(base: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, t, n, g, c, rank): the trigrams of names (key, t), the rarest by `counts` (g, c) first; what has no count is the rarest."""
    grams = base.select("key", "t", F.length("t").alias("n"), F.explode(trigrams(F.col("t"))).alias("g")).join(counts.hint("shuffle_merge"), "g", "left")
    grams = grams.withColumn("c", F.coalesce("c", F.lit(0)))
    return grams.withColumn("rank", F.row_number().over(Window.partitionBy("key", "t").orderBy("c", "g")))


def name_index(names: DataFrame, index: DataFrame | None = None, min_length: int = MIN_NAME_LENGTH) -> DataFrame:
    """(key, t, n, g, c, rank): a trigram index of known names (key, name_norm), to be kept as a table.

    Equal names (with sorted words) are one entry, that of the smallest key. The order of
    trigrams, by their count `c`, is that of the first build: with `index`, the rows to add
    to it for more names are returned, ranked in its order, so that what is stored stays valid.
    """
    base = names.where(F.length("name_norm") >= min_length).groupBy(sorted_tokens(F.col("name_norm")).alias("t")).agg(F.min("key").alias("key"))
    base = stored(base, "names")
    counts = _gram_counts(base) if index is None else _known_counts(index, base)
    return _ranked(base, counts).select("key", "t", "n", "g", "c", "rank")


def _small(df: DataFrame) -> DataFrame:
    """A written table of a batch, to be met by all known companies: broadcast where it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_merge")


def _known_counts(index: DataFrame, base: DataFrame) -> DataFrame:
    """(g, c) of the index for the trigrams of `base`."""
    asked = stored(base.select(F.explode(trigrams(F.col("t"))).alias("g")).distinct(), "asked_trigrams")
    return stored(index.join(_small(asked), "g", "left_semi").groupBy("g").agg(F.max("c").alias("c")), "trigrams")


def probe_names(names: DataFrame, index: DataFrame, threshold: int = NAME_SCORE, min_length: int = MIN_NAME_LENGTH) -> DataFrame:
    """(name_norm, known, score): the index's best entry for each name that has one, by score, then the smallest key.

    A one-sided join: the batch's rarest trigrams meet the stored index, of which each entry
    counts only with its own rarest ones; the index is read, but neither built nor shuffled where the batch is small.
    """
    base = stored(names.where(F.length("name_norm") >= min_length).select(F.col("name_norm").alias("key"), sorted_tokens(F.col("name_norm")).alias("t")).distinct(), "names")
    mine = _ranked(base, _known_counts(index, base)).where(F.col("rank") <= _budget(F.col("n"), threshold))
    mine = stored(mine.select(F.col("key").alias("name_norm"), F.col("t").alias("t1"), F.col("n").alias("n1"), "g"), "probes")
    theirs = index.where(F.col("rank") <= _budget(F.col("n"), threshold)).select("g", F.col("key").alias("known"), F.col("t").alias("t2"), F.col("n").alias("n2"))
    pairs = theirs.join(_small(mine), "g").drop("g").distinct()
    best = _scored(pairs, threshold).groupBy("name_norm").agg(F.min(F.struct((-F.col("score")).alias("s"), "known")).alias("b"))
    return best.select("name_norm", "b.known", (-F.col("b.s")).alias("score"))


def match_existing(rows: DataFrame, state: DataFrame, index: DataFrame | None = None, threshold: int = NAME_SCORE) -> DataFrame:
    """(seq, known, how): the company of `state` (id, name_norm, domain) that each of `rows` (seq, name_norm, domain) belongs to.

    By domain first; else by equal name, the smallest id; else by the best similar name among
    companies without a domain. Names under MIN_NAME_LENGTH match nothing. `index` is the
    stored `name_index` of companies without a domain, by their ids; entries whose company
    has got a domain since don't count, and without it one is built for this call. Rows
    without a match are left out.
    """
    rows = stored(rows.select("seq", "name_norm", "domain"), "new_rows")
    domains = stored(rows.where("domain is not null").select("domain").distinct(), "new_domains")
    by_domain = stored(state.select("domain", "id").join(_small(domains), "domain", "left_semi").groupBy("domain").agg(F.min("id").alias("_by_domain")), "by_domain")
    names = stored(rows.where(F.length("name_norm") >= MIN_NAME_LENGTH).select("name_norm").distinct(), "new_names")
    by_name = stored(state.select("name_norm", "id").join(_small(names), "name_norm", "left_semi").groupBy("name_norm").agg(F.min("id").alias("_by_name")), "by_name")
    found = stored(rows.join(by_domain.hint("shuffle_merge"), "domain", "left").join(by_name.hint("shuffle_merge"), "name_norm", "left"), "matched")
    open_ = found.where("_by_domain is null and _by_name is null").select("name_norm")
    without = state.where("domain is null")
    if index is None:
        index = stored(name_index(without.select(F.col("id").alias("key"), "name_norm")), "name_index")
    else:
        index = index.join(without.select(F.col("id").alias("key")), "key", "left_semi")
    similar = stored(probe_names(open_, index, threshold), "similar")
    out = found.join(similar.hint("shuffle_merge"), "name_norm", "left").withColumn("_known", F.coalesce("_by_domain", "_by_name", "known"))
    how = F.when(F.col("_by_domain").isNotNull(), "domain").when(F.col("_by_name").isNotNull(), "name").otherwise("similar")
    return out.where("_known is not null").select("seq", F.col("_known").alias("known"), how.alias("how"))


def keyed(listings: DataFrame, suffixes=T.TWO_LEVEL_SUFFIXES) -> DataFrame:
    """Listings (seq, name, website, ...) with name_norm and domain."""
    return listings.withColumns({"name": F.trim("name"), "name_norm": T.normalize_name(F.col("name")), "domain": T.registrable_domain(T.url_host(F.col("website")), suffixes)})


def resolve_entities(
    listings: DataFrame, threshold: int = NAME_SCORE, name_merge_across_domains: bool = True, suffixes=T.TWO_LEVEL_SUFFIXES, state: DataFrame | None = None, index: DataFrame | None = None
) -> DataFrame:
    """`listings` (seq, name, website, city, source_key, listed_url) with entity: the smallest seq of its component.

    With `state`, the companies known before, also `known`: the id of the company that the
    entity is, which is that of its rows' matches (`match_existing`) by domain, then equal
    name, then similar name, then the smallest id; null for a new one.

    Equal domains join; equal names of at least MIN_NAME_LENGTH join; a name group without
    a domain joins its best fuzzy partner. The result does not depend on arrival order.
    Edges run from each row to the first of its group, so a large group is a star.
    """
    rows = stored(keyed(listings, suffixes), "keyed")
    by_domain = rows.where("domain is not null").groupBy("domain").agg(F.min("seq").alias("b"))
    edges = rows.join(by_domain.hint("shuffle_merge"), "domain").select(F.col("seq").alias("a"), "b")
    long = rows.where(F.length("name_norm") >= MIN_NAME_LENGTH)
    group = ["name_norm"] if name_merge_across_domains else ["name_norm", "_d"]
    long = long.withColumn("_d", F.coalesce("domain", F.lit("")))
    by_name = stored(long.groupBy(*group).agg(F.min("seq").alias("b"), F.max(F.col("domain").isNotNull()).alias("has_domain")), "names")
    edges = edges.unionByName(long.join(by_name.hint("shuffle_merge"), group).select(F.col("seq").alias("a"), "b"))
    fuzzy = fuzzy_name_edges(by_name.select(F.col("b").alias("key"), "name_norm"), threshold)
    fuzzy = stored(fuzzy, "similar_names")
    both = fuzzy.select("a", "b", "score").unionByName(fuzzy.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    best = both.join(by_name.where("not has_domain").select(F.col("b").alias("a")).hint("shuffle_merge"), "a", "left_semi").groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b"))
    parts = connected_components(edges.unionByName(best))
    out = rows.join(parts.withColumnRenamed("node", "seq").hint("shuffle_merge"), "seq", "left").withColumn("entity", F.coalesce("component", "seq")).drop("component")
    if state is None:
        return out
    out = stored(out, "entities")
    matches = match_existing(out, state, index, threshold).join(out.select("seq", "entity").hint("shuffle_merge"), "seq")
    order = F.element_at(F.create_map(*map(F.lit, ("domain", 0, "name", 1, "similar", 2))), F.col("how"))
    known = stored(matches.groupBy("entity").agg(F.min(F.struct(order.alias("o"), "known")).alias("k")).select("entity", "k.known"), "known_entities")
    return out.join(known.hint("shuffle_merge"), "entity", "left")


def entity_key(first_name: Column, first_domain: Column) -> Column:
    """A stable long key of an entity's earliest member."""
    return F.xxhash64(F.coalesce(first_domain, F.lit("")), first_name)


def companies_of(resolved: DataFrame, run_ts: Column) -> DataFrame:
    """One row per entity: the first non-null of each attribute by seq; other domains go to aliases. The id is that of the known company, if it is one."""
    o = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    known = F.min("known" if "known" in resolved.columns else F.lit(None).cast("long")).alias("known")
    df = resolved.groupBy("entity").agg(o("name"), o("name_norm"), o("domain"), o("city"), o("website"), F.array_sort(F.collect_set("domain")).alias("domains"), known)
    return df.withColumns({"id": F.coalesce("known", entity_key(F.col("name"), F.col("domain"))), "aliases": F.array_except("domains", F.array("domain")), "first_seen": run_ts, "last_seen": run_ts}).drop("domains", "known")


def company_links(resolved: DataFrame) -> DataFrame:
    """(entity, source_key, listed_url): the earliest listing of each entity and source."""
    return resolved.where("source_key is not null").groupBy("entity", "source_key").agg(F.min_by("listed_url", "seq").alias("listed_url"))


def upsert_companies(state: DataFrame, new: DataFrame, run_ts: Column, index: DataFrame | None = None, threshold: int = NAME_SCORE) -> DataFrame:
    """State and new rows (one per company, with an id of its own): only empty fields fill, first_seen stays, last_seen moves.

    A new row belongs to the company with its id, else to that which `match_existing` finds
    by domain, equal name or similar name, else it is inserted. Of several new rows of one
    company the smallest id's fields count first.
    """
    columns = ("name", "name_norm", "domain", "city", "website")
    n = stored(new.select(F.col("id").alias("_new"), *(F.col(c).alias(f"_{c}") for c in columns)), "new_companies")
    found = stored(match_existing(n.select(F.col("_new").alias("seq"), F.col("_name_norm").alias("name_norm"), F.col("_domain").alias("domain")), state, index, threshold), "known_companies")
    same = stored(state.select("id").join(_small(stored(n.select(F.col("_new").alias("id")).distinct(), "new_ids")), "id", "left_semi"), "same_ids")
    n = n.join(found.select(F.col("seq").alias("_new"), "known").hint("shuffle_merge"), "_new", "left").join(same.select(F.col("id").alias("_new"), F.lit(True).alias("_same")).hint("shuffle_merge"), "_new", "left")
    n = n.withColumn("_id", F.when(F.col("_same"), F.col("_new")).otherwise(F.coalesce("known", "_new")))
    first = lambda c: F.min_by(f"_{c}", F.when(F.col(f"_{c}").isNotNull(), F.col("_new"))).alias(f"_{c}")
    n = n.groupBy("_id").agg(*map(first, columns))
    joined = state.join(n.hint("shuffle_merge"), F.col("id") == F.col("_id"), "full")
    return joined.select(
        F.coalesce("id", "_id").alias("id"),
        *(F.coalesce(c, f"_{c}").alias(c) for c in columns),
        F.coalesce("first_seen", run_ts).alias("first_seen"), F.when(F.col("_id").isNotNull(), run_ts).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def upsert_sources(state: DataFrame, new: DataFrame) -> DataFrame:
    """Sources by key: kind, name, url and parser are replaced; enabled only on insert."""
    n = new.select("key", *(F.col(c).alias(f"_{c}") for c in ("kind", "name", "url", "parser", "enabled")), F.lit(True).alias("_new"))
    j = state.join(n, "key", "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return j.select("key", *(pick(c) for c in ("kind", "name", "url", "parser")), F.coalesce("enabled", "_enabled").alias("enabled"))


def link_sources(state: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-ignore of (company_id, source_key, listed_url, first_seen)."""
    fresh = new.dropDuplicates(["company_id", "source_key"]).join(state.select("company_id", "source_key"), ["company_id", "source_key"], "left_anti")
    return state.unionByName(fresh)
