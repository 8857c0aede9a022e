"""Crawl planning over tables: fresh copies, robots rules, politeness slots, outcome counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.operators.links import fetch_outcome
from firmlens.sources.shared import stored

TTL_DAYS = 30
MIN_INTERVAL = 1.0
#: Origins with rules are broadcast up to so many.
BROADCAST_ORIGINS = 100_000


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def latest_copies(log: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """The newest copy of each url; with a positive TTL only if it is not older."""
    fresh = log if ttl_days <= 0 else log.where(F.col("fetched_at") >= now - F.make_interval(days=F.lit(ttl_days)))
    return fresh.withColumn("_rn", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("fetched_at")))).where("_rn = 1").drop("_rn")


def robots_gate(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Urls that no disallow rule (origin, path) of their origin begins; origins without rules are open.

    A prefix trie as rows: a url asks for its path cut at each length that a rule of its
    origin has, by hash, so rules are met by equality alone, however many an origin has.
    """
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    r = rules.where("path != ''").select(F.col("origin").alias("_ro"), F.col("path").alias("_rp"), F.length("path").alias("_l"))
    r = stored(r.withColumn("_h", F.xxhash64("_ro", "_rp")).distinct(), "rules")
    lengths = stored(r.groupBy(F.col("_ro").alias("_o")).agg(F.array_sort(F.collect_set("_l")).alias("_ls")), "rule_lengths")
    u = stored(urls.select("url").distinct().select("url", origin(F.col("url")).alias("_o"), F.when(path == "", "/").otherwise(path).alias("_p")), "urls")
    side = F.broadcast(lengths) if lengths.count() <= BROADCAST_ORIGINS else lengths.hint("shuffle_merge")
    cut = F.transform(F.filter("_ls", lambda n: n <= F.length("_p")), lambda n: F.xxhash64("_o", F.substr("_p", F.lit(1), n)))
    asked = u.join(side, "_o").select("url", "_o", "_p", F.explode(cut).alias("_h"))
    hit = stored(asked.join(r.hint("shuffle_merge"), "_h").where((F.col("_o") == F.col("_ro")) & F.col("_p").startswith(F.col("_rp"))).select("url").distinct(), "disallowed")
    return urls.join(hit.hint("shuffle_merge"), "url", "left_anti").select(*urls.columns)


def ranked_within(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """`rows` with `name`: their number from 1 within the group, by order (unique within it).

    In two phases, so that no group is in one task: rows are dealt by ranges of (group,
    order) and written with their range; a range's first number is the count of the
    group's rows in the ranges before it, and rows are numbered within their range.
    """
    dealt = stored(rows.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    base = stored(counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "range_bases")
    local = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order))
    return dealt.withColumn("_local", local).join(base.hint("shuffle_merge"), [group, "_range"]).withColumn(name, F.col("_base") + F.col("_local")).drop("_range", "_base", "_local")


def plan_frontier(candidates: DataFrame, log: DataFrame, rules: DataFrame, now: Column, ttl_days: int = TTL_DAYS, interval: float = MIN_INTERVAL) -> DataFrame:
    """(url, origin, decision, slot_no, offset_s): fetch, fresh or disallowed, and when within its origin."""
    once = stored(candidates.select("url").distinct().withColumn("origin", origin(F.col("url"))), "candidates")
    slim = log.select("url", "fetched_at", fetch_outcome(F.col("blocked_by_robots"), F.col("status"), F.col("body")).alias("outcome"))  # no body moves
    fresh = latest_copies(slim, now, ttl_days).where("outcome = 'ok'").select("url", F.lit(True).alias("_fresh"))
    open_ = robots_gate(once.select("url"), rules).select("url", F.lit(True).alias("_open"))
    d = once.join(fresh.hint("shuffle_merge"), "url", "left").join(open_.hint("shuffle_merge"), "url", "left")
    d = stored(d.select("url", "origin", F.when(F.col("_fresh"), "fresh").when(F.col("_open").isNull(), "disallowed").otherwise("fetch").alias("decision")), "decisions")
    slots = ranked_within(d.where("decision = 'fetch'"), "origin", "url", "slot_no")
    rest = d.where("decision != 'fetch'").withColumn("slot_no", F.lit(None).cast("long"))
    return slots.unionByName(rest).select("url", "origin", "decision", "slot_no", ((F.col("slot_no") - 1) * interval).alias("offset_s"))


def fetch_counters(log: DataFrame) -> DataFrame:
    """One row: network, cache, blocked, errors, insecure_tls."""
    o = fetch_outcome(F.col("blocked_by_robots"), F.col("status"), F.col("body"))
    return log.agg(
        F.count_if(~F.col("from_cache") & (o != "blocked")).alias("network"), F.count_if("from_cache").alias("cache"), F.count_if(o == "blocked").alias("blocked"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("insecure_tls").alias("insecure_tls"),
    )


def stage_outcomes(df: DataFrame, status: str, wide: bool = False) -> DataFrame:
    """Counts per status value, or one row with a column each."""
    return df.groupBy().pivot(status).count() if wide else df.groupBy(status).agg(F.count("*").alias("n"))
