"""Links of pages: anchors, keyword links, sitemaps, two-hop expansion and ranked candidate pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import text as T
from firmlens.sources.pages import BROADCAST_URLS, outcomes, with_bodies
from firmlens.sources.shared import stored

#: Keywords, folded.
CAREER_KEYWORDS = ("kariyer", "career", "jobs", "job", "is ilan", "acik pozisyon", "insan kaynak", "join us", "work with us", "bize katil", "aramiza katil", "staj", "we are hiring", "is basvuru")
CONTACT_KEYWORDS = ("iletisim", "contact", "hakkimizda", "about", "ekip", "team", "yonetim", "kurumsal", "insan kaynak", "kariyer", "career", "bize ulasin", "get in touch")
HUB_KEYWORDS = ("kurumsal", "hakkimizda", "about", "corporate", "yonetim")
#: Paths that are tried on every site.
CAREER_PATHS = ("/kariyer", "/careers", "/career", "/jobs", "/tr/kariyer", "/en/careers", "/insan-kaynaklari", "/tr/insan-kaynaklari", "/acik-pozisyonlar", "/join-us")
CONTACT_PATHS = ("/iletisim", "/contact", "/hakkimizda", "/about", "/about-us", "/ekibimiz", "/team", "/kurumsal", "/tr/iletisim")
#: Hosts that carry careers pages for others.
CAREER_HOSTS = (
    "careers-page.com", "kariyer.net", "youthall.com", "toptalent.co", "successfactors.com", "successfactors.eu",
    "sapsf.com", "sapsf.eu", "myworkdayjobs.com", "taleo.net", "icims.com", "isbasi.com",
)
CONTACT_PAGES, CAREER_PAGES, HUBS, SITEMAP_HITS = 8, 6, 2, 3


def fetched(status: Column, body: Column) -> Column:
    """A page that can be read: 2xx and not empty."""
    return status.between(200, 299) & (F.coalesce(F.length(body), F.lit(0)) > 0)


def fetch_outcome(blocked: Column, status: Column, body: Column) -> Column:
    return (
        F.when(F.coalesce(blocked, F.lit(False)), "blocked").when(status.isin(403, 429), "protected").when(status.isin(500, 502, 503, 504), "retryable")
        .when(fetched(status, body), "ok").otherwise("error")
    )


def anchors(pages: DataFrame, html: str = "body") -> DataFrame:
    """`pages` without the html, a row per anchor: pos from 0, href, title and text, in page order."""
    tag = r"(?is)<a\b([^>]*)>(.*?)(?:</a>|(?=<a\b)|$)"
    hits = F.transform(
        F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(tag), 0),
        lambda a: F.struct(F.regexp_extract(a, tag, 1).alias("attrs"), F.regexp_extract(a, tag, 2).alias("inner")),
    )
    attr = lambda n: F.trim(F.regexp_replace(F.regexp_extract(F.col("a.attrs"), rf"""(?is)\b{n}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), "^[\"']|[\"']$", ""))
    return pages.select("*", F.posexplode(hits).alias("pos", "a")).select(
        *[c for c in pages.columns if c != html], "pos", attr("href").alias("href"), attr("title").alias("title"), F.regexp_replace("a.inner", r"<[^>]*>", "").alias("text")
    )


def any_of(haystack: Column, words: Sequence[str]) -> Column:
    return haystack.rlike("|".join(words))


def keyword_links(pages: DataFrame, keywords: Sequence[str], external: Column | None = None, html: str = "body") -> DataFrame:
    """(company_id, from_url, pos, url): links of a page (company_id, domain, url, body) that a keyword fits.

    Links to other sites count only where `external` (over column link) says so. Each
    url of a page counts once, at its first place.
    """
    a = anchors(pages.select("company_id", "domain", F.col("url").alias("from_url"), html), html)
    a = a.where((F.col("href") != "") & ~F.col("href").startswith("#") & ~T.skip_link(F.col("href")))
    a = a.where(any_of(T.match_haystack(F.col("href"), F.col("text")), keywords))
    a = a.withColumn("link", T.resolve_url(F.col("from_url"), F.col("href"))).where(F.col("link").rlike("^https?://"))
    own = T.same_site(F.col("link"), F.col("domain"))
    a = a.where(own if external is None else own | external)
    return a.groupBy("company_id", "from_url", F.col("link").alias("url")).agg(F.min("pos").alias("pos"))


def known_career_host(link: Column, signature: Column) -> Column:
    host = T.host_of(link)
    return host.rlike("|".join(h.replace(".", r"\.") for h in CAREER_HOSTS)) | signature


def sitemap_urls(pages: DataFrame, keywords: Sequence[str], limit: int = SITEMAP_HITS, body: str = "body") -> DataFrame:
    """(company_id, url, pos): the first `limit` `<loc>` values of each sitemap that a keyword fits, in order."""
    locs = pages.select("company_id", F.posexplode(F.regexp_extract_all(F.col(body), F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("pos", "url"))
    hits = locs.where(any_of(T.match_haystack(F.col("url")), keywords))
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy("pos"))).where(F.col("rn") <= limit).drop("rn")


def with_fallback(hits: DataFrame, fallback: DataFrame) -> DataFrame:
    """`hits`, and for companies without any the rows of `fallback`."""
    return hits.select("company_id", "url", "pos").unionByName(fallback.join(hits.select("company_id").distinct().hint("shuffle_merge"), "company_id", "left_anti").select("company_id", "url", "pos"))


def ranked_hubs(links: DataFrame, hubs: int = HUBS) -> DataFrame:
    """The links of each company that are expanded: hub keywords first, then page order."""
    hub = any_of(T.match_haystack(F.col("url")), HUB_KEYWORDS)
    rn = F.row_number().over(Window.partitionBy("company_id").orderBy(F.when(hub, 0).otherwise(1), "pos", "url"))
    return links.withColumn("hub", rn).where(F.col("hub") <= hubs)


def two_hop_links(links: DataFrame, pages: DataFrame, keywords: Sequence[str], hubs: int = HUBS) -> DataFrame:
    """(company_id, url, pos): links found on the hub pages, after hub rank and place.

    `pages` is as for `home_pages`; `links` is (company_id, domain, url, pos).
    """
    top = stored(ranked_hubs(links, hubs).select("company_id", "domain", "url", "hub"), "hubs")
    opened = with_bodies(top, pages)
    deeper = keyword_links(opened.drop("hub"), keywords).join(top.select("company_id", F.col("url").alias("from_url"), "hub").hint("shuffle_merge"), ["company_id", "from_url"])
    return deeper.groupBy("company_id", "url").agg(F.min(F.col("hub") * 1_000_000 + F.col("pos")).alias("pos"))


def probe_paths(companies: DataFrame, paths: Sequence[str]) -> DataFrame:
    """(company_id, url, pos): fixed paths on each company's site."""
    rows = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(p).alias("path")) for i, p in enumerate(paths)))
    return companies.select("company_id", "domain", F.explode(rows).alias("p")).select("company_id", F.concat(F.lit("https://"), "domain", "p.path").alias("url"), "p.pos")


def ranked_candidates(parts: Sequence[DataFrame], limit: int) -> DataFrame:
    """(company_id, url, rn): the union of `parts` in that order without repeats, cut to the page budget."""
    all_ = None
    for rank, part in enumerate(parts):
        rows = part.select("company_id", "url", F.struct(F.lit(rank).alias("rank"), F.col("pos").cast("long").alias("pos")).alias("o"))
        all_ = rows if all_ is None else all_.unionByName(rows)
    once = all_.groupBy("company_id", "url").agg(F.min("o").alias("o"))
    return once.withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy("o", "url"))).where(F.col("rn") <= limit).drop("o")


def home_pages(companies: DataFrame, pages: DataFrame, careers: bool = False) -> DataFrame:
    """(company_id, domain, url, body, outcome): the first readable of website, or https://domain/, and https://www.domain/.

    `pages` is (url, status, body, blocked_by_robots), a row per url, or a page store. A
    robots block ends the search; for careers so does 403 or 429. The choice is made by
    outcomes alone; then the chosen bodies are fetched. `body` is null where the outcome is not ok.
    """
    c = companies.select("company_id", "domain", F.coalesce("website", F.concat(F.lit("https://"), "domain", F.lit("/"))).alias("u1"), F.concat(F.lit("https://www."), "domain", F.lit("/")).alias("u2"))
    asked = stored(c.select(F.explode(F.array("u1", "u2")).alias("url")).where("url is not null").distinct(), "home_urls")
    side = F.broadcast(asked) if asked.count() <= BROADCAST_URLS else asked.hint("shuffle_merge")
    known = stored(outcomes(pages).join(side, "url", "left_semi").groupBy("url").agg(F.min("outcome").alias("outcome")), "home_outcomes")
    for i in ("1", "2"):
        c = c.join(known.select(F.col("url").alias(f"u{i}"), F.col("outcome").alias(f"o{i}")).hint("shuffle_merge"), f"u{i}", "left")
    ends = F.col("o1").isin("ok", "blocked", *(["protected"] if careers else []))
    first = F.coalesce(ends, F.lit(False))
    pick = lambda n: F.when(first, F.col(f"{n}1")).otherwise(F.col(f"{n}2"))
    chosen = stored(c.select("company_id", "domain", pick("u").alias("url"), F.coalesce(pick("o"), F.lit("error")).alias("outcome")), "homes")
    bodies = with_bodies(chosen.where("outcome = 'ok'").select("url").distinct(), pages)
    return chosen.join(bodies.hint("shuffle_merge"), "url", "left").select("company_id", "domain", "url", "body", "outcome")
