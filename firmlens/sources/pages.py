"""The page store: fetched pages kept by url, and their bodies fetched late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.text import url_bucket
from firmlens.sources.shared import stored

#: Urls are broadcast to the pages up to so many, so that no body is shuffled.
BROADCAST_URLS = 200_000
INDEX = "url string, outcome string"


def write_page_store(pages: DataFrame, path: str) -> None:
    """Pages (url, status, body, blocked_by_robots[, fetched_at]) as a store: a folder per bucket of url keys, sorted by url.

    A url keeps its newest copy (without times, one of the largest status), found before
    any body moves. `outcome` is computed once, so choosing among pages reads no body; bodies
    of pages that cannot be read are not kept.
    """
    from firmlens.operators.links import fetch_outcome

    at = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    named = pages.select("url", "status", "blocked_by_robots", "body", at.alias("fetched_at"), F.xxhash64("body").alias("_h"))
    newest = named.groupBy("url").agg(F.max(F.struct(F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0))).alias("t"), F.coalesce("status", F.lit(0)).alias("s"), F.col("_h"))).alias("k"))
    newest = stored(newest.select("url", "k.t", "k.s", F.col("k._h").alias("h")), "newest")
    keyed = named.withColumns({"_t": F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0))), "_s": F.coalesce("status", F.lit(0))})
    outcome = fetch_outcome(F.col("blocked_by_robots"), F.col("status"), F.col("body"))
    same = F.expr("_t = t and _s = s and _h = h")
    # The join deals bodies by url, so that equal copies are in one task already.
    kept = keyed.join(newest.hint("shuffle_merge"), "url").where(same).dropDuplicates(["url"])
    rows = kept.select("url", outcome.alias("outcome"), "fetched_at", F.when(outcome == "ok", F.col("body")).alias("body"), url_bucket(F.col("url")).alias("bucket"))
    rows.repartition("bucket", F.pmod(F.xxhash64("url"), F.lit(8))).sortWithinPartitions("bucket", "url").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_page_store(spark: SparkSession, path: str) -> DataFrame:
    """(url, outcome, fetched_at, body, bucket); a query that names no body reads none."""
    return spark.read.schema(f"{INDEX}, fetched_at timestamp, body string, bucket string").parquet(path)


def outcomes(pages: DataFrame) -> DataFrame:
    """(url, outcome) of a store, or of pages (url, status, body, blocked_by_robots)."""
    from firmlens.operators.links import fetch_outcome

    if "outcome" in pages.columns:
        return pages.select("url", "outcome")
    return pages.select("url", fetch_outcome(F.col("blocked_by_robots"), F.col("status"), F.col("body")).alias("outcome"))


def with_bodies(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """`rows` (stored, with url) and the body of each url that can be read; rows of other urls go.

    The urls go to the pages, not the pages to the urls: by broadcast where they are counted
    to be few, so only bodies that are asked for move, and of a store only their buckets are read.
    """
    asked = stored(rows.select("url", url_bucket(F.col("url")).alias("_b")).distinct(), "urls")
    from_ = pages.where("outcome = 'ok'") if "outcome" in pages.columns else _readable(pages)
    if "bucket" in pages.columns:
        from_ = from_.where(F.col("bucket").isin([r["_b"] for r in asked.select("_b").distinct().collect()]))  # 256 at most
    urls = asked.select("url")
    side = F.broadcast(urls) if urls.count() <= BROADCAST_URLS else urls.hint("shuffle_merge")
    bodies = stored(from_.select("url", "body").join(side, "url", "left_semi").dropDuplicates(["url"]), "bodies")
    return bodies.join(rows.hint("shuffle_merge"), "url")


def _readable(pages: DataFrame) -> DataFrame:
    from firmlens.operators.links import fetched

    return pages.where(fetched(F.col("status"), F.col("body")) & ~F.coalesce("blocked_by_robots", F.lit(False)))
