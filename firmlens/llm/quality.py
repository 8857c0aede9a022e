"""Quality rules judged per document and per host.

1. Each document gets counts over its whole text and fails or passes the base rules.
2. Failures are summed per host; a beta prior fitted to the hosts' own rates (method of
   moments) shrinks the rates of hosts with few documents towards the common one.
3. Hosts whose shrunken rate is above the limit are joined back; their documents go.

Only DataFrame functions. Documents themselves are never shuffled: hosts meet them by a
broadcast whose size is checked, or else by a join that AQE splits where a host is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import WORD_PATTERN, stored

#: What counts as a symbol.
SYMBOLS = r"[^#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host whose shrunken failure rate is above this loses all its documents.
MAX_HOST_RATE = 0.9
#: Rejected hosts are broadcast up to this many.
BROADCAST_HOSTS = 50_000


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    Null and empty texts count as no words. New names that exist already are replaced;
    names that begin with `_fl_` are this library's own.
    Repeats: 3-word windows are compared by a 64-bit hash; sorted by hash and place, equal
    ones are neighbours, and each place covers at most three words that the one before
    it did not.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_fl_words", F.regexp_extract_all(t, F.lit(f"({WORD_PATTERN})"), 1))
    df = df.withColumn("n_words", F.size("_fl_words").cast("long"))
    df = df.withColumn(
        "_fl_windows",
        F.expr(
            "if(n_words < 4, array(), sort_array(transform(sequence(0, cast(n_words as int) - 3), "
            "i -> struct(xxhash64(_fl_words[i], _fl_words[i + 1], _fl_words[i + 2]) as h, i as p))))"
        ),
    )
    df = df.withColumn(
        "_fl_places",
        F.expr(
            "sort_array(transform(filter(_fl_windows, (x, k) -> (k > 0 and _fl_windows[k - 1].h = x.h) or "
            "(k < size(_fl_windows) - 1 and _fl_windows[k + 1].h = x.h)), x -> x.p))"
        ),
    )
    kept_lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_PATTERN))
    return (
        df.withColumn("n_repeat_words", F.expr("aggregate(transform(_fl_places, (p, k) -> if(k = 0, 3, least(3, p - _fl_places[k - 1]))), 0, (s, x) -> s + x)").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long"))
        .withColumn("_fl_lines", kept_lines)
        .withColumn("n_dup_lines", (F.size("_fl_lines") - F.size(F.array_distinct("_fl_lines"))).cast("long"))
        .drop("_fl_words", "_fl_windows", "_fl_places", "_fl_lines")
    )


def base_failed(min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """(host, n, failed, rate): the failure rate shrunken by a beta prior.

    The prior's mean is that of all documents and its strength is by the method of
    moments over hosts, at least 1 and at most 1000 documents' worth. A null host is a
    host of its own. One row per host; an empty table gives an empty one.
    """
    per = judged.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.count_if("base_failed").alias("failed")
    )
    r = F.col("failed") / F.col("n")
    prior = per.agg(
        (F.sum("failed") / F.sum("n")).alias("m"),
        (F.sum(F.col("n") * r * r) / F.sum("n")).alias("m2"),
        (F.count("*") / F.sum(1.0 / F.col("n"))).alias("size"),
    )
    # Between hosts: the variance of rates less what chance alone makes of it.
    m, between = F.col("m"), F.col("m2") - F.col("m") ** 2 - F.col("m") * (1 - F.col("m")) / F.col("size")
    strength = F.when(between > 0, m * (1 - m) / between - 1).otherwise(F.lit(1000.0))
    prior = prior.select("m", F.greatest(F.lit(1.0), F.least(F.lit(1000.0), strength)).alias("k"))
    return per.join(F.broadcast(prior)).select(  # one row
        "host", "n", "failed", ((F.col("failed") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k"))).alias("rate")
    )


def judge_counts(counted: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rows of `with_counts` with base_failed, and kept: passed the base rules, and its host is not rejected.

    One row per row, repeated ones too. Documents of a null host are judged as one host.
    The rows are written once to the shared folder and read twice from there.
    """
    judged = stored(counted.withColumn("base_failed", base_failed()), "quality")
    bad = stored(host_rates(judged, host).where(F.col("rate") > max_host_rate).select(F.col("host").alias("_fl_host"), F.lit(True).alias("_fl_bad")), "hosts")
    n = bad.count()
    if not n:
        return judged.withColumn("kept", ~F.col("base_failed"))
    side = F.broadcast(bad) if n <= BROADCAST_HOSTS else bad.hint("shuffle_merge")
    return (
        judged.join(side, F.col(host).eqNullSafe(F.col("_fl_host")), "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("_fl_bad").isNull())
        .drop("_fl_host", "_fl_bad")
    )


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """`docs` with the counts and verdicts; see `with_counts` and `judge_counts`."""
    return judge_counts(with_counts(docs, text), host, max_host_rate)
