"""URL filters: host and path rules, and for the rest trust carried along links.

Trust is a personalised PageRank from hosts that allow rules fit, over host edges;
distrust runs over the reversed edges from hosts that block rules fit. There each link
counts by its share of the linking host's own links, so that others who link to the same
host change nothing. Both are judged as a share of the PageRank that links bring the host
from anywhere, so both are from 0 to 1, and a host is blocked where its distrust outweighs
its trust by the threshold. A block rule is about paths: a host that one fits is a seed,
but its other pages are blocked only if its own links condemn it. Only DataFrame functions; one
row per host and per host edge after pre-aggregation, so a page's many links and a host's
many pages never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import stored

#: A rule: verdict, host, path.
Rule = tuple[str, str, str]
DAMPING = 0.85
ROUNDS = 10
#: A PageRank is done when no host's score grows by more than this part of it in a round.
TOLERANCE = 1e-3
#: A host is blocked when distrust - trust, each a share of what links bring it, is above this.
MAX_DISTRUST = 0.1
BROADCAST_HOSTS = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; null or no `://`: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, w): absolute links between different hosts, w pages' links each."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), 1)
    return (
        pages.where(F.col("host") != "")
        .select(F.col("host").alias("src"), F.explode(hrefs).alias("href"))
        .select("src", host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))).alias("dst"))
        .where("dst != '' and dst != src").groupBy("src", "dst").agg(F.count("*").alias("w"))
    )


def spread(
    edges: DataFrame, seeds: DataFrame, rounds: int | None = ROUNDS, damping: float = DAMPING, by: str = "src", tolerance: float = TOLERANCE
) -> DataFrame:
    """(host, score): personalised PageRank from `seeds` (host, seed); more columns of seeds are spread likewise.

    After `rounds` rounds from the seeds; or, with None, from what they keep until the last
    column of no host grows by more than `tolerance` of itself. A link's share is of all
    links of its `by` host.
    """
    name = {c: "score" if c == "seed" else c for c in seeds.columns if c != "host"}
    last = list(name.values())[-1]
    out = edges.groupBy(by).agg(F.sum("w").alias("total"))
    step = stored(edges.join(out.hint("shuffle_merge"), by).select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "steps")
    base = seeds.select("host", *(((1 - damping) * F.col(c)).alias(n) for c, n in name.items()), F.lit(0.0).alias("_fl_was"))
    now = base if rounds is None else seeds.select("host", *(F.col(c).alias(n) for c, n in name.items()))
    done = 0
    while done != rounds:
        moved = step.join(now.hint("shuffle_merge"), step["src"] == now["host"]).select(
            F.col("dst").alias("host"), *((damping * F.col("share") * F.col(n)).alias(n) for n in name.values()), F.lit(0.0).alias("_fl_was")
        )
        before = now.select("host", *(F.lit(0.0).alias(n) for n in name.values()), F.col(last).alias("_fl_was"))
        parts = base.unionByName(moved).unionByName(before)
        now = stored(parts.groupBy("host").agg(*(F.sum(c).alias(c) for c in (*name.values(), "_fl_was"))), "rank")
        done += 1
        if rounds is None and (now.agg(F.max((F.col(last) - F.col("_fl_was")) / F.col(last))).first()[0] or 0.0) <= tolerance:
            break
    return now.select("host", *name.values())


def linked_share(edges: DataFrame, hosts: DataFrame, seed: str, by: str) -> DataFrame:
    """(host, share): of the PageRank that links bring each of `hosts` from anywhere, the part that comes from `seed` hosts; 0 without links."""
    seeds = hosts.select("host", F.col(seed).cast("double").alias("seed"), F.lit(1.0).alias("whole"))
    got = spread(edges, seeds, None, by=by).join(hosts.select("host", seed).hint("shuffle_merge"), "host")
    part, whole = F.col("score") - (1 - DAMPING) * F.col(seed).cast("double"), F.col("whole") - (1 - DAMPING)
    return got.select("host", F.when(whole > 1e-9, part / whole).otherwise(0.0).alias("share"))


def blocked_hosts(pages: DataFrame, rules: list[Rule], max_distrust: float = MAX_DISTRUST, html: str = "html") -> DataFrame:
    """(host, trust, distrust) of the hosts that links condemn; `pages` has host, rule verdict and html."""
    edges = stored(host_edges(pages, html), "links")
    per = pages.where("host != ''").groupBy("host").agg(
        F.count_if(F.col("_fl_rule_verdict") == "allow").alias("good"), F.count_if(F.col("_fl_rule_verdict") == "block").alias("bad")
    )
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0).alias("good"), F.lit(0).alias("bad"))
    seeds = per.unionByName(linked).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    hosts = stored(seeds.select("host", F.expr("good > 0 and bad = 0").alias("good"), F.expr("bad > 0 and good = 0").alias("bad")), "hosts")
    trust = linked_share(edges, hosts, "good", "src").select("host", F.col("share").alias("_fl_trust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = linked_share(back, hosts, "bad", "dst").select("host", F.col("share").alias("distrust"))
    return (
        hosts.join(trust.hint("shuffle_merge"), "host").join(distrust.hint("shuffle_merge"), "host")
        .select("host", F.when(F.col("good"), 1.0).otherwise(F.col("_fl_trust")).alias("trust"), "distrust")
        .where(F.col("distrust") - F.col("trust") > max_distrust)
    )


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", max_distrust: float = MAX_DISTRUST) -> DataFrame:
    """`pages` with host, path, rule (text, or null) and verdict (allow or block).

    A url that a rule fits has the rule's verdict. The others are blocked where links
    condemn their host, else allowed; so are null urls, whose host and path are empty.
    One row per row, and columns with the new names are replaced. Condemned hosts are broadcast up to a checked count, beyond it
    they are joined by a shuffle that AQE splits.
    """
    df = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    df = df.withColumn("rule", rule).withColumn("_fl_rule_verdict", verdict)
    bad = stored(blocked_hosts(df, rules, max_distrust, html).select(F.col("host").alias("_fl_host"), F.lit("block").alias("_fl_by_links")), "condemned")
    n = bad.count()
    side = F.broadcast(bad) if n <= BROADCAST_HOSTS else bad.hint("shuffle_merge")
    return (
        df.join(side, F.col("host") == F.col("_fl_host"), "left")
        .withColumn("verdict", F.coalesce("_fl_rule_verdict", "_fl_by_links", F.lit("allow")))
        .drop("_fl_host", "_fl_by_links", "_fl_rule_verdict")
    )
