"""Named people: evidence checks against page texts, and the second-tier rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions.text import fold
from firmlens.operators.contacts import save_contacts
from firmlens.operators.labels import last_wins
from firmlens.sources.shared import stored

MIN_QUOTE = 8
#: Words, or else UTF-16 units, of a passage's key.
KEY_WORDS = 5
SHORT_KEYS = (1, 2, 3, 4, 6, 8, 12, 16)
#: Passages are broadcast up to so many.
BROADCAST_KEYS = 200_000
#: Bits of the bitmap of keys, at most; beyond half of it, more windows that are no key become rows.
MAX_BITS = 1 << 23
SECOND_TIER_BELOW = 0.7


def passages_held(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id): which documents (doc_id, text) hold which passages (item_id, q) verbatim, each pair once.

    A passage's key is the hash of the run of up to KEY_WORDS words that follows its first
    word, which is cut by nothing; one of one or two words has as key its first characters,
    as many of SHORT_KEYS as it has. A bitmap of all keys is tested inside the row, so
    windows that are no key never become rows, and texts of documents without a key go no
    further. Then the passage is looked for in the whole text. Null and empty passages are
    held by none.
    """
    words = lambda c: F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    known = passages.where("q != ''").select("item_id", "q", words(F.col("q")).alias("w"), F.encode("q", "UTF-16BE").alias("u"))
    fits = [F.when(F.length("u") >= 2 * n, -n) for n in reversed(SHORT_KEYS)]
    known = known.withColumn("k", F.when(F.size("w") > 2, F.least(F.size("w") - 2, F.lit(KEY_WORDS))).otherwise(F.coalesce(*fits)))
    known = known.withColumn("h", hashes(F.expr("if(k > 0, slice(w, 2, k), array())")))
    key = F.coalesce(F.when(F.col("k") > 0, F.expr(_word_runs(KEY_WORDS))[0]), *(F.when(F.col("k") == -n, F.expr(_unit_key(n, "0"))) for n in SHORT_KEYS))
    keys = stored(known.select("item_id", "q", "k", key.alias("g")), "passages")
    n = keys.count()
    bits = min(max(1 << (16 * n).bit_length(), 1 << 10), MAX_BITS)
    filled = keys.select((F.col("g").bitwiseAND(bits - 1)).alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x"))
    bitmap = dict(map(tuple, filled.collect()))  # MAX_BITS / 64 rows at most
    listed = ",".join(str(bitmap.get(i, 0)) for i in range(bits // 64))
    hit = f"x -> getbit(get(bitmap, cast(shiftright(x & {bits - 1}, 6) as int)), cast(x & 63 as int)) = 1"
    sizes = sorted(r["k"] for r in keys.select("k").distinct().collect())
    found = ", ".join(f"filter({_word_runs(k) if k > 0 else _units(-k)}, {hit})" for k in sizes) or "cast(array() as array<long>)"
    text = docs.select("doc_id", "text", hashes(words(F.col("text"))).alias("h"), F.encode("text", "UTF-16BE").alias("u") if sizes and sizes[0] < 0 else F.lit(None).alias("u"))
    rows = text.withColumn("bitmap", F.split(F.lit(listed), ",").cast("array<long>")).select("doc_id", "text", F.expr(f"array_distinct(concat({found}))").alias("hits"))
    # No filter before the write: it would be pushed below the split and split the text anew for every window.
    # Written with row numbers, which a lost executor can then not change.
    rows = rows.select("doc_id", F.when(F.size("hits") > 0, F.col("text")).alias("text"), "hits", F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "holders").where("text is not null")
    few = n <= BROADCAST_KEYS
    side = lambda df: F.broadcast(df) if few else df.hint("shuffle_merge")
    pairs = rows.select("row", F.explode("hits").alias("g")).join(side(keys.select("item_id", "g")), "g").select("row", "item_id").distinct()
    held = pairs.join(side(keys.select("item_id", "q")), "item_id").join(rows.select("row", "doc_id", "text").hint("shuffle_merge"), "row")
    return held.where(F.col("text").contains(F.col("q"))).select("item_id", "doc_id").distinct()


def _word_runs(k: int) -> str:
    """SQL of the keys of runs of k words from each word hash of h on; a row's last ones are of fewer words."""
    return f"transform(h, (x, i) -> xxhash64({', '.join(['x', *(f'get(h, i + {j})' for j in range(1, k))])}))"


def _unit_key(n: int, at: str) -> str:
    """SQL of the key of n UTF-16 units of u; their fixed width makes each run a slice of bytes."""
    return f"xxhash64({-n}, substring(u, 2 * {at} + 1, {2 * n}))"


def _units(n: int) -> str:
    return f"if(coalesce(length(u), 0) < {2 * n}, array(), transform(sequence(0, cast(length(u) div 2 - {n} as int)), i -> {_unit_key(n, 'i')}))"


def verify_evidence(people: DataFrame, pages: DataFrame, min_quote: int = MIN_QUOTE) -> DataFrame:
    """`people` (company_id, person_no, evidence_quote, ...) with source_url and reason.

    pages: (company_id, pos, url, text). The folded, trimmed quote must have at least
    `min_quote` characters and be in a folded page of the same company; the earliest wins.
    source_url is null and reason set where it fails.
    """
    p = people.withColumn("_q", fold(F.trim("evidence_quote")))
    texts = pages.select("company_id", "pos", "url", fold(F.col("text")).alias("_t"))
    hits = p.where(F.length("_q") >= min_quote).join(texts, "company_id").where(F.col("_t").contains(F.col("_q")))
    first = hits.groupBy("company_id", "person_no").agg(F.min_by("url", "pos").alias("source_url"))
    out = p.join(first, ["company_id", "person_no"], "left")
    reason = F.when(F.coalesce(F.length("_q"), F.lit(0)) < min_quote, "quote too short").when(F.col("source_url").isNull(), "quote not found")
    return out.withColumn("reason", reason).drop("_q")


def explode_people(results: DataFrame) -> DataFrame:
    """Results (company_id, people array<struct>) to a row per person with person_no."""
    return results.select("company_id", F.posexplode("people").alias("person_no", "p")).select("company_id", "person_no", "p.*")


def needs_second_tier(checked: DataFrame, below: float = SECOND_TIER_BELOW) -> DataFrame:
    """(company_id): a verified record is below the confidence, or any record failed its evidence."""
    weak = F.col("reason").isNotNull() | (F.col("confidence") < below)
    return checked.groupBy("company_id").agg(F.max(weak).alias("_w")).where("_w").select("company_id")


def contact_records(checked: DataFrame) -> DataFrame:
    """Verified people as contact records; those without evidence never become one."""
    return checked.where("reason is null").select("company_id", "name", "role", "email", "contact_type", "source_url", F.lit("llm").alias("extraction_method"), "confidence")


def verify_people(results: DataFrame, pages: DataFrame, contacts: DataFrame, second: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(contacts, rejected): people of result lines (company_id, seq, people) whose evidence holds, saved as contacts.

    Companies with a weak or failed record take the second tier's people where it has a line for them.
    """
    checked = verify_evidence(explode_people(last_wins(results)), pages)
    if second is not None:
        asked = needs_second_tier(checked).join(second.select("company_id").distinct(), "company_id", "left_semi")
        again = verify_evidence(explode_people(last_wins(second.join(asked, "company_id", "left_semi"))), pages)
        checked = checked.join(asked, "company_id", "left_anti").unionByName(again)
    rejected = checked.where("reason is not null").select("company_id", "person_no", "name", "reason")
    return save_contacts(contacts, contact_records(checked).withColumn("phone", F.lit(None).cast("string"))), rejected
