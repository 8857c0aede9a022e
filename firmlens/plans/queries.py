"""Registered queries over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlens.functions import text as T
from firmlens.operators import catalog as C
from firmlens.operators import contacts as K
from firmlens.operators import discovery as D
from firmlens.operators import distinct as N
from firmlens.operators import frontier as R
from firmlens.operators import labels as B
from firmlens.operators import links as L
from firmlens.operators import paging as G
from firmlens.operators import people as P
from firmlens.operators import postings as J
from firmlens.operators import resolve as E
from firmlens.plans import standin as S
from firmlens.plans.standin import WITH, table
from firmlens.sources import bucketed
from firmlens.sources.pages import read_page_store, write_page_store
from firmlens.sources.shared import shared_dir, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The pages' hosts are under example.com, .net and .org; these count as suffixes here.
SUFFIXES = (*T.TWO_LEVEL_SUFFIXES, "example.com", "example.net", "example.org")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
BARE = f"regexp_replace(lower({HOST}), '^www\\.', '')"
#: Parts of the SQL for the registrable domain of column h.
DOMAIN = "CASE WHEN len(string_split(h, '.')) <= 2 THEN h ELSE array_to_string(string_split(h, '.')[-3:], '.') END"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/firmlens/{name}-{uuid.uuid4().hex}"


# --- pages: hosts, keys, text, links ------------------------------------------------------------


@query(f"""WITH p AS (SELECT page_id, url, {BARE} AS h FROM pages), q AS (SELECT *, {DOMAIN} AS domain FROM p)
SELECT domain, count(*) AS n_pages, arg_min(url, page_id) AS first_url, string_agg(DISTINCT regexp_extract(url, '://[^/]*/([a-z]+)/', 1), ',' ORDER BY regexp_extract(url, '://[^/]*/([a-z]+)/', 1)) AS langs
FROM q WHERE domain IS NOT NULL GROUP BY domain""")
def site_entities(spark: SparkSession, d: str) -> DataFrame:
    """One entity per registrable domain of the pages."""
    p = table(spark, d, "pages").withColumns({"domain": T.registrable_domain(T.url_host(F.col("url")), SUFFIXES), "lang": F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1)})
    return p.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n_pages"), F.min_by("url", "page_id").alias("first_url"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query(f"""SELECT page_id, {BARE} AS host, {BARE} AS site_host, sha256(url) AS url_key, substr(sha256(url), 1, 2) AS bucket, ({BARE} = 'example.com' OR {BARE} LIKE '%.example.com') AS same_site FROM pages""")
def url_columns(spark: SparkSession, d: str) -> DataFrame:
    """B4, B6, B7, B19."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.url_host(u).alias("host"), T.host_of(u).alias("site_host"), T.url_key(u).alias("url_key"), T.url_bucket(u).alias("bucket"), T.same_site(u, F.lit("example.com")).alias("same_site"))


@query(r"""SELECT doc_id, translate(lower(translate(text, 'IİŞĞÜÖÇ', 'ıişğüöç')), 'ışğüöçâîû', 'isguocaiu') AS folded,
  lower(translate(text, 'IİŞĞÜÖÇ', 'ıişğüöç')) AS lowered, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS squashed FROM documents""")
def folded_texts(spark: SparkSession, d: str) -> DataFrame:
    """B1, B2, B16."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.fold(t).alias("folded"), T.tr_lower(t).alias("lowered"), T.squash_ws(t).alias("squashed"))


LEGAL = "(" + ", ".join(f"'{w}'" for w in T.LEGAL_WORDS) + ")"
NORM = rf"""WITH w AS (SELECT k, list_filter(list_transform(string_split_regex(regexp_replace(translate(lower(translate(n, 'IİŞĞÜÖÇ', 'ıişğüöç')), 'ışğüöçâîû', 'isguocaiu'), '[^\p{{L}}\p{{N}}_\s.]', ' ', 'g'), '\s+'), lambda x: replace(x, '.', '')), lambda x: x <> '') AS ws FROM names)
SELECT k, array_to_string(CASE WHEN len(list_filter(ws, lambda x: x NOT IN {LEGAL})) > 0 THEN list_filter(ws, lambda x: x NOT IN {LEGAL}) ELSE ws END, ' ') AS name_norm FROM w"""


@query("WITH names AS (SELECT p_partkey AS k, p_name || ' A.Ş. ' || p_brand || ' Ltd. Şti.' AS n FROM part UNION ALL SELECT -1 - s_suppkey, s_name || ' Holding' FROM supplier), " + NORM.removeprefix("WITH "))
def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    """B3."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" A.Ş. "), "p_brand", F.lit(" Ltd. Şti.")).alias("n"))
    s = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("k"), F.concat("s_name", F.lit(" Holding")).alias("n"))
    return p.unionByName(s).select("k", T.normalize_name(F.col("n")).alias("name_norm"))


EMAILS = r"""list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda e: trim(lower(e), '.')), lambda e: NOT regexp_matches(e, '\.(png|jpg|jpeg|gif|webp|svg)$'))"""
EMAIL_CLASS = (
    "CASE WHEN split_part(email, '@', 1) IN (" + ", ".join(f"'{x}'" for x in T.HR_MAILBOXES) + ") OR regexp_matches(split_part(email, '@', 1), 'kariyer|insankaynak|staj|recruit') THEN 'hr' "
    "WHEN split_part(email, '@', 1) IN (" + ", ".join(f"'{x}'" for x in T.GENERIC_MAILBOXES) + ") THEN 'generic' ELSE 'personal' END"
)
PHONE = r"nullif(trim(regexp_extract(text, '(?:\+90|0)?\s?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}\b')), '')"


@query(f"""WITH e AS (SELECT doc_id, {PHONE} AS phone, unnest({EMAILS}) AS email, generate_subscripts({EMAILS}, 1) AS pos FROM documents),
  f AS (SELECT doc_id, phone, email, min(pos) AS pos FROM e GROUP BY ALL)
SELECT doc_id, email, {EMAIL_CLASS} AS contact_type, CASE WHEN pos = 1 THEN phone END AS phone FROM f""")
def document_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of documents with the phone on the first."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("company_id"), F.lit(None).cast("string").alias("domain"), F.col("doc_id").cast("string").alias("url"), F.col("text").alias("body"))
    found = K.page_contacts(docs)
    return found.select(F.col("company_id").alias("doc_id"), "email", T.email_class(F.col("email")).alias("contact_type"), "phone")


@query(f"""WITH e AS (SELECT doc_id, source, unnest({EMAILS}) AS email FROM documents),
  o AS (SELECT *, split_part(email, '@', -1) AS dom FROM e)
SELECT source, count(*) AS n, count(*) FILTER (WHERE dom = 'example.com' OR dom LIKE '%.example.com') AS own, count(DISTINCT email) AS n_distinct,
  count(DISTINCT CASE WHEN {EMAIL_CLASS} = 'hr' THEN email END) AS n_hr FROM o GROUP BY source""")
def source_emails(spark: SparkSession, d: str) -> DataFrame:
    """Addresses per source, own-domain and hr ones."""
    e = table(spark, d, "documents").select("source", F.explode(F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({T.EMAIL})"), 1), lambda x: F.lit(True))).alias("raw"))
    e = e.select("source", F.explode(T.emails(F.col("raw"))).alias("email"))
    own = T.own_domain_email(F.col("email"), F.lit("example.com"))
    return e.groupBy("source").agg(F.count("*").alias("n"), F.count_if(own).alias("own"), F.count_distinct("email").alias("n_distinct"), F.count_distinct(F.when(T.email_class(F.col("email")) == "hr", F.col("email"))).alias("n_hr"))


TEXT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<noscript\b.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"""
TEXT = f"substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace({TEXT}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')), 1, 12000)"


@query(f"SELECT page_id, {TEXT} AS text FROM pages")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """B27."""
    return table(spark, d, "pages").select("page_id", T.page_text(F.col("html")).alias("text"))


ANCHORS = r"""anchors AS (SELECT page_id, url, generate_subscripts(m, 1) - 1 AS pos, regexp_extract(unnest(m), '(?is)<a\b[^>]*\bhref="([^"]*)"', 1) AS href, regexp_replace(regexp_replace(unnest(m), '(?is)^<a\b[^>]*>', ''), '<[^>]*>', '', 'g') AS text
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS m FROM pages))"""


@query(f"WITH {ANCHORS} SELECT page_id, pos, href, text, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link FROM anchors")
def page_anchors(spark: SparkSession, d: str) -> DataFrame:
    """D8's edge table, B21: anchors with position and absolute address."""
    a = L.anchors(table(spark, d, "pages"), "html")
    return a.select("page_id", "pos", "href", "text", T.resolve_url(F.col("url"), F.col("href")).alias("link"))


@query(f"""WITH {ANCHORS}, k AS (SELECT page_id, url, href, pos, CASE WHEN regexp_matches(lower(href || ' ' || text), 'the|and|que') THEN 1 END AS hit FROM anchors),
  l AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link, min(pos) AS pos FROM k WHERE hit = 1 GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, link) AS rn FROM l)
SELECT page_id, link, rn FROM r WHERE rn <= 8""")
def keyword_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Ranked keyword links of each page."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("company_id"), T.url_host(F.col("url")).alias("domain"), "url", F.col("html").alias("body"))
    hits = L.keyword_links(p, ("the", "and", "que"))
    return L.ranked_candidates([hits.select("company_id", "url", "pos")], L.CONTACT_PAGES).select(F.col("company_id").alias("page_id"), F.col("url").alias("link"), F.col("rn"))


@query(f"""WITH {ANCHORS}, s AS (SELECT page_id, {BARE} AS domain, url FROM pages),
  l AS (SELECT a.page_id, regexp_extract(a.url, '^([a-z]+://[^/?#]*)', 1) || href AS url, min(pos) AS pos FROM anchors a GROUP BY ALL),
  h AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN regexp_matches(regexp_replace(lower(url), '[-_/.]+', ' ', 'g'), 'kurumsal|hakkimizda|about|corporate|yonetim') THEN 0 ELSE 1 END, pos, url) AS hub FROM l)
SELECT page_id, url, hub FROM h WHERE hub <= 2""")
def hub_links(spark: SparkSession, d: str) -> DataFrame:
    """F3."""
    a = L.anchors(table(spark, d, "pages"), "html").withColumn("link", T.resolve_url(F.col("url"), F.col("href")))
    links = a.groupBy(F.col("page_id").alias("company_id"), F.col("link").alias("url")).agg(F.min("pos").alias("pos"))
    return L.ranked_hubs(links).select(F.col("company_id").alias("page_id"), "url", "hub")


CUTS = "CASE WHEN page_id % 10 = 0 THEN 404 WHEN page_id % 10 = 1 THEN 403 WHEN page_id % 10 = 2 THEN 503 ELSE 200 END"


def _log(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    status = F.when(F.col("page_id") % 10 == 0, 404).when(F.col("page_id") % 10 == 1, 403).when(F.col("page_id") % 10 == 2, 503).otherwise(200)
    return p.select("page_id", "url", status.alias("status"), F.col("html").alias("body"), (F.col("page_id") % 7 == 0).alias("blocked_by_robots"), (F.col("page_id") % 2 == 0).alias("from_cache"),
                    F.when(F.col("page_id") % 10 == 0, "HTTP 404").alias("error"), (F.col("page_id") % 11 == 0).alias("insecure_tls"), F.timestamp_seconds(1700000000 + F.col("page_id") * 40000).alias("fetched_at"))


OUTCOME = f"CASE WHEN page_id % 7 = 0 THEN 'blocked' WHEN {CUTS} IN (403, 429) THEN 'protected' WHEN {CUTS} IN (500, 502, 503, 504) THEN 'retryable' WHEN {CUTS} BETWEEN 200 AND 299 AND length(html) > 0 THEN 'ok' ELSE 'error' END"


@query(f"SELECT {OUTCOME} AS outcome, count(*) AS n FROM pages GROUP BY 1")
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """C12, C13, E16."""
    log = _log(spark, d)
    return R.stage_outcomes(log.withColumn("outcome", L.fetch_outcome(F.col("blocked_by_robots"), F.col("status"), F.col("body"))), "outcome")


@query(f"""SELECT count(*) FILTER (WHERE page_id % 2 <> 0 AND page_id % 7 <> 0) AS network, count(*) FILTER (WHERE page_id % 2 = 0) AS cache, count(*) FILTER (WHERE page_id % 7 = 0) AS blocked,
  count(*) FILTER (WHERE page_id % 10 = 0) AS errors, count(*) FILTER (WHERE page_id % 11 = 0) AS insecure_tls FROM pages""")
def fetch_counters(spark: SparkSession, d: str) -> DataFrame:
    """E17."""
    return R.fetch_counters(_log(spark, d))


@query(f"""WITH c AS (SELECT DISTINCT url FROM pages), l AS (SELECT url, max(page_id) AS page_id FROM pages WHERE page_id * 40000 + 1700000000 >= 1707408000 GROUP BY url),
  f AS (SELECT p.url FROM l JOIN pages p USING (page_id) WHERE {OUTCOME.replace('page_id', 'p.page_id').replace('html', 'p.html')} = 'ok'),
  d AS (SELECT c.url, lower(regexp_extract(c.url, '^([a-z]+://[^/?#]*)', 1)) AS origin, CASE WHEN f.url IS NOT NULL THEN 'fresh' WHEN regexp_matches(c.url, '^[a-z]+://[^/?#]*/es/') THEN 'disallowed' ELSE 'fetch' END AS decision FROM c LEFT JOIN f ON c.url = f.url),
  s AS (SELECT *, CASE WHEN decision = 'fetch' THEN row_number() OVER (PARTITION BY origin, decision = 'fetch' ORDER BY url) END AS slot_no FROM d)
SELECT url, origin, decision, slot_no, (slot_no - 1) * 1.0::DOUBLE AS offset_s FROM s""")
def crawl_plan(spark: SparkSession, d: str) -> DataFrame:
    """F8, D19, F10, E18."""
    log = _log(spark, d)
    rules = log.select(R.origin(F.col("url")).alias("origin")).distinct().withColumn("path", F.lit("/es/"))
    return R.plan_frontier(log, log, rules, F.timestamp_seconds(F.lit(1710000000)))


@query(f"""WITH h AS (SELECT {BARE} AS domain, page_id, url, {OUTCOME} AS outcome, row_number() OVER (PARTITION BY {BARE} ORDER BY page_id) AS rn FROM pages),
  a AS (SELECT * FROM h WHERE rn = 1), b AS (SELECT * FROM h WHERE rn = 2)
SELECT a.domain, CASE WHEN a.outcome IN ('ok', 'blocked', 'protected') THEN a.url ELSE 'https://www.' || a.domain || '/' END AS url,
  CASE WHEN a.outcome IN ('ok', 'blocked', 'protected') THEN a.outcome ELSE COALESCE(b.outcome, 'error') END AS outcome FROM a LEFT JOIN b USING (domain)""")
def home_page_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a host stands for its home, the second for its www home."""
    log = _log(spark, d).withColumn("domain", T.url_host(F.col("url")))
    w = Window.partitionBy("domain").orderBy("page_id")
    r = log.withColumn("rn", F.row_number().over(w))
    firms = r.where("rn = 1").select(F.xxhash64("domain").alias("company_id"), "domain", F.col("url").alias("website"))
    second = r.where("rn = 2").withColumn("url", F.concat(F.lit("https://www."), "domain", F.lit("/")))
    return L.home_pages(firms, r.where("rn = 1").unionByName(second), careers=True).select("domain", "url", "outcome")


@query(r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url WHEN url LIKE '%?%' THEN regexp_replace(regexp_extract(url, '^([^#]*)', 1), '\?', '?') || '&p=' || (page_id % 5 + 1) || regexp_extract(url, '(#.*)$', 1)
  ELSE regexp_extract(url, '^([^#]*)', 1) || '?p=' || (page_id % 5 + 1) || regexp_extract(url, '(#.*)$', 1) END AS page_url FROM pages""")
def page_urls(spark: SparkSession, d: str) -> DataFrame:
    """B20."""
    return table(spark, d, "pages").select("page_id", T.page_url(F.col("url"), F.lit("p"), F.col("page_id") % 5 + 1).alias("page_url"))


@query(f"""WITH e AS (SELECT {BARE} AS source_key, page_id % 5 + 1 AS page_no, page_id AS pos, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name, CASE WHEN page_id % 4 = 0 THEN 404 ELSE 200 END AS status FROM pages),
  g AS (SELECT source_key, page_no, min(status) AS status, string_agg(name, '|' ORDER BY pos) AS sig FROM e GROUP BY ALL),
  s AS (SELECT *, CASE WHEN status <> 200 OR sig = lag(sig) OVER (PARTITION BY source_key ORDER BY page_no) THEN 1 ELSE 0 END AS stop FROM g),
  t AS (SELECT *, max(stop) OVER (PARTITION BY source_key ORDER BY page_no) AS stopped FROM s)
SELECT e.source_key, e.page_no, e.pos, e.name FROM e JOIN t USING (source_key, page_no) WHERE stopped = 0""")
def listing_stop(spark: SparkSession, d: str) -> DataFrame:
    """a source's entries up to its first missing, empty or repeated page."""
    e = table(spark, d, "pages").select(T.url_host(F.col("url")).alias("source_key"), (F.col("page_id") % 5 + 1).alias("page_no"), F.col("page_id").alias("pos"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"), F.when(F.col("page_id") % 4 == 0, 404).otherwise(200).alias("status"))
    pages = e.groupBy("source_key", "page_no").agg(F.min("status").alias("status"))
    return D.before_stop(pages, e.drop("status")).select("source_key", "page_no", "pos", "name")


@query()
def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    """2.12: elements per page and tag, from the node table of J1."""
    return D.html_nodes(table(spark, d, "pages"), html="html").groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("last").alias("last"))


@query()
def discovered_listings(spark: SparkSession, d: str) -> DataFrame:
    """J1, detail mode: menu entries of each page as listing entries, with stop and first-wins."""
    pages = table(spark, d, "pages").select("page_id", T.url_host(F.col("url")).alias("source_key"), (F.col("page_id") % 5 + 1).cast("int").alias("page_no"), "url", F.lit(200).alias("status"), F.col("html").alias("body"))
    null = F.lit(None).cast("string")
    sources = pages.select(F.col("source_key").alias("key")).distinct().select("key", F.lit("detail").alias("mode"), F.lit("li").alias("item_selector"), null.alias("name_selector"), null.alias("name_attr"), F.lit("a").alias("website_selector"), null.alias("sector_selector"), null.alias("sector_attr"), F.lit("a").alias("detail_selector"), F.lit(True).alias("enabled"), F.lit("Ankara").alias("city"))
    return D.discover_listings(pages, sources)


#: Menus as listings: links that begin with an ASCII letter lead to a firm's site. Hosts are sources, by the length of their name in one of three modes; the pages of a host are numbered.
LISTED = r"""m AS (SELECT page_id, url, regexp_replace(html, 'href="/([A-Za-z])[^"]*"', 'href="https://\1.firm' || (page_id % 50) || '.com/"', 'g') AS html FROM pages),
  anchors AS (SELECT page_id, url, generate_subscripts(a, 1) - 1 AS k, regexp_extract(unnest(a), 'href="([^"]*)"', 1) AS href, replace(regexp_replace(unnest(a), '<[^>]*>', '', 'g'), '&amp;', '&') AS text FROM (SELECT page_id, url, regexp_extract_all(html, '<a href[^>]*>.*?</a>') AS a FROM m))"""


@query(rf"""WITH {LISTED}, p AS (SELECT page_id, url, {BARE} AS source_key, row_number() OVER (PARTITION BY {BARE} ORDER BY page_id) AS page_no FROM pages),
  e AS (SELECT p.*, len(source_key) % 3 AS mode, k, trim(regexp_replace(text, '\s+', ' ', 'g')) AS said, CASE WHEN href LIKE 'https://_.firm%' THEN href END AS site,
    CASE WHEN href LIKE 'https://_.firm%' THEN href ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href END AS link FROM anchors JOIN p USING (page_id, url)),
  f AS (SELECT page_id, source_key, page_no, url AS listed_url, CASE WHEN mode = 2 THEN 10 + 2 * k ELSE 9 + 2 * k END AS pos, mode, said AS name, CASE WHEN mode <> 1 THEN site END AS website, CASE WHEN mode = 1 THEN link END AS detail_url,
    lower(regexp_extract(site, '://([^/]*)', 1)) AS host FROM e WHERE mode <> 2 OR (site IS NOT NULL AND length(said) BETWEEN 2 AND 120)),
  d AS (SELECT * FROM f WHERE mode <> 2 UNION ALL SELECT * FROM f WHERE mode = 2 QUALIFY row_number() OVER (PARTITION BY page_id, host ORDER BY pos) = 1),
  g AS (SELECT source_key, page_no, list_slice(list(name ORDER BY pos, name), 1, 10) AS sig FROM d WHERE name <> '' GROUP BY ALL),
  s AS (SELECT p.source_key, p.page_no, CASE WHEN sig IS NULL OR sig = lag(sig) OVER (PARTITION BY p.source_key ORDER BY p.page_no) THEN 1 ELSE 0 END AS stop FROM p LEFT JOIN g USING (source_key, page_no)),
  t AS (SELECT *, max(stop) OVER (PARTITION BY source_key ORDER BY page_no) AS stopped FROM s),
  u AS (SELECT d.* FROM d JOIN t USING (source_key, page_no) WHERE stopped = 0 AND name <> '' QUALIFY row_number() OVER (PARTITION BY source_key, CASE WHEN website IS NULL THEN lower(name) ELSE host END ORDER BY page_no, pos) = 1)
SELECT source_key, page_no, pos, name, website, detail_url, listed_url, 'Ankara' AS city FROM u""")
def discovered_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Listings of all three modes, each page parsed once; page stop, first of each site, city."""
    site = F.expr("regexp_replace(html, 'href=\"/([A-Za-z])[^\"]*\"', concat('href=\"https://$1.firm', page_id % 50, '.com/\"'))")
    no = F.row_number().over(Window.partitionBy("source_key").orderBy("page_id"))
    pages = table(spark, d, "pages").withColumn("source_key", T.url_host(F.col("url"))).select("page_id", "source_key", no.alias("page_no"), "url", F.lit(200).alias("status"), site.alias("body"))
    null, mode = F.lit(None).cast("string"), F.length("key") % 3
    keys = pages.select(F.col("source_key").alias("key")).distinct()
    sources = keys.select(
        "key", F.when(mode == 0, "structured").when(mode == 1, "detail").otherwise("outbound").alias("mode"), F.when(mode == 2, "ul").otherwise("li").alias("item_selector"), null.alias("name_selector"), null.alias("name_attr"),
        F.lit("a").alias("website_selector"), null.alias("sector_selector"), null.alias("sector_attr"), F.lit("a").alias("detail_selector"), F.lit(True).alias("enabled"), F.lit("Ankara").alias("city"),
    )
    return D.discover_listings(pages, sources).drop("sector")


@query(f"""WITH p AS (SELECT page_id, replace(regexp_replace({BARE}, '\\.example\\.[a-z]+$', ''), '.', '-') AS slug,
    (['greenhouse', 'lever', 'ashby', 'workable', 'recruitee', 'smartrecruiters', 'breezy', 'personio'])[page_id % 8 + 1] AS provider FROM pages)
SELECT page_id, provider, slug, provider AS found_provider, CASE provider WHEN 'workable' THEN 'apply' ELSE slug END AS found_slug FROM p""")
def ats_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Hosts as board slugs behind each provider's address, found again by signature."""
    names = list(J.PROVIDERS)
    p = table(spark, d, "pages").withColumn("slug", F.regexp_replace(F.regexp_replace(T.url_host(F.col("url")), r"\.example\.[a-z]+$", ""), r"\.", "-"))
    p = p.withColumn("provider", F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int")))
    s = J.signatures(F.concat(F.lit("<a href='"), J.ats_job_url(F.col("provider"), F.col("slug")), F.lit("'>"), "html"))
    return p.select("page_id", "provider", "slug", s["provider"].alias("found_provider"), s["slug"].alias("found_slug"))


#: Sites of hosts: the first five pages of a host stand at fixed paths, with links, addresses and boards of their own.
SITES_SQL = f"""site AS (SELECT page_id, {BARE} AS domain, {OUTCOME} AS outcome, row_number() OVER (PARTITION BY {BARE} ORDER BY page_id) AS rn FROM pages),
  home AS (SELECT * FROM site WHERE rn = 1)"""


def _sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Companies, and a page store of their sites: home, contact, hub, a page behind the hub, and one at a probed path."""
    log = _log(spark, d).withColumn("domain", T.url_host(F.col("url")))
    log = log.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy("page_id")))
    id_ = F.col("page_id").cast("string")
    at = lambda path: F.concat(F.lit("https://"), "domain", F.lit(path))
    board = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<a href='https://boards.greenhouse.io/firm"), id_, F.lit("'>b</a>"))).otherwise("")
    lever = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<a href='https://jobs.lever.co/firm"), id_, F.lit("'>b</a>"))).otherwise("")
    mail = lambda *parts: F.concat(*(F.lit(x) if x not in ("page_id", "domain") else id_ if x == "page_id" else F.col(x) for x in parts))
    extra = (
        F.when(F.col("rn") == 1, F.concat(F.lit("<a href='/kurumsal'>Biz</a> <a href='/iletisim'>Bize yazın</a> <a href='/kariyer'>x</a>"), board))
        .when(F.col("rn") == 2, F.concat(mail("<p>Tel: 0212 555 44 33 info", "page_id", "@", "domain", " x@other.de</p>"), lever))
        .when(F.col("rn") == 3, mail("<a href='/kurumsal/ekip'>e</a> <a href='mailto:ik@", "domain", "'>y</a> yaz@", "domain"))
        .when(F.col("rn") == 4, mail("<p>ad.soyad", "page_id", "@mail.", "domain", " ik@", "domain", "</p>")).when(F.col("rn") == 5, mail("info", "page_id", "@", "domain")).otherwise("")
    )
    path = F.when(F.col("rn") == 1, at("/")).when(F.col("rn") == 2, at("/iletisim")).when(F.col("rn") == 3, at("/kurumsal")).when(F.col("rn") == 4, at("/kurumsal/ekip")).when(F.col("rn") == 5, at("/about"))
    own = F.translate("body", "@0123456789", "")  # the pages' own addresses and numbers are no case of this
    pages = log.select(F.coalesce(path, "url").alias("url"), "status", F.concat(own, extra).alias("body"), "blocked_by_robots", "fetched_at")
    folder = f"{shared_dir(spark)}/firmlens/page-store-{uuid.uuid4().hex}"
    write_page_store(pages, folder)
    first = log.where("rn = 1")
    null = F.lit(None).cast("string")
    return first.select(F.col("page_id").alias("company_id"), "domain", null.alias("website"), null.alias("careers_url")), read_page_store(spark, folder)


@query(f"""WITH {SITES_SQL}, up AS (SELECT * FROM home WHERE outcome = 'ok'),
  p AS (SELECT u.page_id AS company_id, u.domain, s.page_id, s.rn, CASE s.rn WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 5 ELSE 6 END AS place FROM up u JOIN site s ON s.domain = u.domain AND s.rn <= 5 AND s.outcome = 'ok'),
  q AS (SELECT * FROM p WHERE rn <> 4 OR EXISTS (SELECT 1 FROM p h WHERE h.company_id = p.company_id AND h.rn = 3)),
  m AS (SELECT *, 'info' || page_id || '@' || domain AS email, 0 AS pos FROM q WHERE rn IN (2, 5) UNION ALL SELECT *, 'ik@' || domain, 0 FROM q WHERE rn = 3 UNION ALL SELECT *, 'yaz@' || domain, 1 FROM q WHERE rn = 3
    UNION ALL SELECT *, 'ad.soyad' || page_id || '@mail.' || domain, 0 FROM q WHERE rn = 4 UNION ALL SELECT *, 'ik@' || domain, 1 FROM q WHERE rn = 4),
  f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY company_id, email ORDER BY place, pos) = 1)
SELECT company_id, email, CASE WHEN rn = 2 THEN '0212 555 44 33' END AS phone, {EMAIL_CLASS} AS contact_type, 'https://' || domain || CASE rn WHEN 2 THEN '/iletisim' WHEN 3 THEN '/kurumsal' WHEN 4 THEN '/kurumsal/ekip' ELSE '/about' END AS source_url FROM f""")
def harvested_contacts(spark: SparkSession, d: str) -> DataFrame:
    """D17, D8, F3, D10, C17, F1, D9, E18 over a page store."""
    companies, store = _sites(spark, d)
    return K.harvest_contacts(companies, store).select("company_id", "email", "phone", "contact_type", "source_url")


@query(f"""WITH {SITES_SQL}, w AS (SELECT h.page_id AS company_id, h.domain, h.outcome, h.outcome = 'ok' AND h.page_id % 3 = 0 AS board FROM home h),
  k AS (SELECT w.*, CASE WHEN board AND company_id % 4 <> 1 THEN 'greenhouse' END AS ats_provider FROM w)
SELECT company_id, CASE WHEN ats_provider IS NOT NULL THEN 'firm' || company_id END AS ats_slug, ats_provider,
  CASE WHEN ats_provider IS NOT NULL THEN 'ats' WHEN outcome = 'blocked' THEN 'blocked' WHEN outcome = 'protected' THEN 'protected' WHEN outcome <> 'ok' THEN 'error' ELSE 'none' END AS detect_status,
  CASE WHEN board AND ats_provider IS NULL THEN 'greenhouse:firm' || company_id || ' doğrulanamadı' WHEN outcome <> 'ok' AND outcome <> 'retryable' AND outcome <> 'error' THEN outcome WHEN outcome <> 'ok' THEN 'error' END AS detect_note,
  CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END AS pages_ok FROM k""")
def detected_careers(spark: SparkSession, d: str) -> DataFrame:
    """Home pages' boards against payloads of which some are wrong, and the status of each company."""
    companies, store = _sites(spark, d)
    slug = F.concat(F.lit("firm"), F.col("company_id").cast("string"))
    body = F.when(F.col("company_id") % 4 == 1, "<html>").when(F.col("company_id") % 4 == 2, '{"jobs": []}').otherwise('{"jobs":[{"id":1,"title":"T"}]}')
    payloads = companies.select("company_id", F.lit("greenhouse").alias("provider"), slug.alias("slug"), body.alias("body"))
    return J.detect_careers(companies, store, payloads).drop("careers_url")


# --- documents, labels, conversations ------------------------------------------------------------


@query("""SELECT b.item_id, arg_min(d.doc_id, d.doc_id) AS source_doc, count(*) AS n_docs FROM benchmark b JOIN documents d
  ON contains(d.text, trim(b.text)) WHERE length(trim(b.text)) >= 8 GROUP BY b.item_id""")
def benchmark_evidence(spark: SparkSession, d: str) -> DataFrame:
    """D11's test across tables: which documents hold a passage verbatim."""
    b = table(spark, d, "benchmark").select("item_id", F.trim("text").alias("q")).where(F.length("q") >= 8)
    return P.passages_held(b, table(spark, d, "documents").select("doc_id", "text")).groupBy("item_id").agg(F.min("doc_id").alias("source_doc"), F.count("*").alias("n_docs"))


@query("""WITH q AS (SELECT doc_id, substr(coalesce(text, ''), 5, CASE WHEN doc_id % 10 = 0 THEN 6 ELSE 40 END) || CASE WHEN doc_id % 7 = 0 THEN 'zzqq' ELSE '' END AS quote, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CASE WHEN length(trim(quote)) < 8 THEN 'quote too short' WHEN NOT contains(text, trim(quote)) THEN 'quote not found' END AS reason FROM q""")
def evidence_check(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of documents checked against their own text."""
    docs = table(spark, d, "documents").withColumn("company_id", F.col("doc_id"))
    quote = F.concat(F.substr("text", F.lit(5), F.when(F.col("doc_id") % 10 == 0, 6).otherwise(40)), F.when(F.col("doc_id") % 7 == 0, "zzqq").otherwise(""))
    people = docs.select("company_id", F.lit(0).alias("person_no"), quote.alias("evidence_quote"))
    pages = docs.select("company_id", F.lit(0).alias("pos"), F.lit("u").alias("url"), "text")
    return P.verify_evidence(people, pages).select(F.col("company_id").alias("doc_id"), "reason")


@query("""SELECT conv_id, string_agg('=== ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def assembled_turns(spark: SparkSession, d: str) -> DataFrame:
    """Ordered texts of a key joined under their headings."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("company_id"), F.col("turn").alias("pos"), F.col("role").alias("url"), "text")
    return B.assemble_pages(c).withColumnRenamed("company_id", "conv_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source IS NOT NULL")
def documents_needing_labels(spark: SparkSession, d: str) -> DataFrame:
    """C4 as a checkpoint table: an anti join."""
    return table(spark, d, "documents").where("source is not null").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("""WITH r AS (SELECT doc_id, CASE quality WHEN 1 THEN 'ai_ml' ELSE 'invented' END AS a, CASE toxic WHEN 1 THEN 'oyun' ELSE 'fintech' END AS b, CASE WHEN doc_id % 3 = 0 THEN 'orta' ELSE 'dev' END AS s FROM labels)
SELECT doc_id, CASE WHEN a = 'invented' THEN b ELSE a || ',' || b END AS domain, CASE WHEN s = 'orta' THEN s END AS size_bucket,
  array_to_string(list_filter([CASE WHEN a = 'invented' THEN a END, CASE WHEN s <> 'orta' THEN s END], lambda x: x IS NOT NULL), ',') AS rejected FROM r""")
def validated_labels(spark: SparkSession, d: str) -> DataFrame:
    """C8."""
    r = table(spark, d, "labels").select(
        "doc_id", F.array(F.when(F.col("quality") == 1, "ai_ml").otherwise("invented"), F.when(F.col("toxic") == 1, "oyun").otherwise("fintech")).alias("domain"),
        F.when(F.col("doc_id") % 3 == 0, "orta").otherwise("dev").alias("size_bucket"), F.lit(None).cast("string").alias("sector"),
    )
    return B.validate_labels(r).select("doc_id", F.array_join("domain", ",").alias("domain"), "size_bucket", F.array_join("rejected", ",").alias("rejected"))


@query("""WITH first AS (SELECT doc_id, 0.5 + quality * 0.3 AS confidence, 'small' AS model FROM labels), second AS (SELECT doc_id, 0.9 AS confidence, 'large' AS model FROM labels WHERE doc_id % 2 = 0),
  asked AS (SELECT * FROM second WHERE doc_id IN (SELECT doc_id FROM first WHERE confidence < 0.6))
SELECT doc_id, confidence::DOUBLE AS confidence, model FROM asked UNION ALL SELECT doc_id, confidence::DOUBLE, model FROM first WHERE doc_id NOT IN (SELECT doc_id FROM asked)""")
def second_tier_labels(spark: SparkSession, d: str) -> DataFrame:
    """J6's tier rule."""
    t = table(spark, d, "labels").withColumnRenamed("doc_id", "company_id")
    first = t.select("company_id", F.when(F.col("quality") == 1, 0.8).otherwise(0.5).alias("confidence"), F.lit("small").alias("model"))
    second = t.where("company_id % 2 = 0").select("company_id", F.lit(0.9).alias("confidence"), F.lit("large").alias("model"))
    return B.merge_tiers(first, second, B.needs_second_tier(first)).withColumnRenamed("company_id", "doc_id")


@query("""WITH r AS (SELECT doc_id, quality, toxic, CASE quality WHEN 1 THEN 0.8 ELSE 0.5 END AS confidence FROM labels),
  x AS (SELECT *, confidence < 0.6 AND doc_id % 2 = 0 AS second FROM r)
SELECT doc_id, 'domain' AS dimension, 'ai_ml' AS label, 0.8::DOUBLE AS confidence, 'small' AS model FROM x WHERE NOT second AND quality = 1
UNION ALL SELECT doc_id, 'domain', CASE toxic WHEN 1 THEN 'oyun' ELSE 'fintech' END, confidence::DOUBLE, 'small' FROM x WHERE NOT second
UNION ALL SELECT doc_id, 'domain', 'quantum_derin_tek', 0.9::DOUBLE, 'large' FROM x WHERE second UNION ALL SELECT doc_id, 'stack', 'go', 0.9::DOUBLE, 'large' FROM x WHERE second""")
def labelled_companies(spark: SparkSession, d: str) -> DataFrame:
    """Result lines of two tiers, earlier lines of which are replaced; validated, merged, and saved as labels."""
    t = table(spark, d, "labels")
    null = F.lit(None).cast("string")
    first = t.select(
        F.col("doc_id").alias("company_id"), F.lit(2).alias("seq"), F.array(F.when(F.col("quality") == 1, "ai_ml").otherwise("invented"), F.when(F.col("toxic") == 1, "oyun").otherwise("fintech")).alias("domain"), null.alias("size_bucket"),
        null.alias("sector"), F.array().cast("array<string>").alias("stack"), F.when(F.col("quality") == 1, 0.8).otherwise(0.5).alias("confidence"), F.lit("u").alias("page_url"), F.lit("small").alias("model"),
    )
    earlier = first.withColumns({"seq": F.lit(1), "domain": F.array(F.lit("robotik_otonom")), "confidence": F.lit(0.99)})
    second = first.where("company_id % 2 = 0").withColumns({"domain": F.array(F.lit("quantum_derin_tek"), F.lit("none of these")), "stack": F.array(F.lit(" go"), F.lit(" ")), "confidence": F.lit(0.9), "model": F.lit("large")})
    state = spark.createDataFrame([], "company_id long, dimension string, label string, confidence double, evidence_url string, model string, as_of timestamp")
    companies = t.select(F.col("doc_id").alias("id"), null.alias("size_bucket"), null.alias("sector"), F.lit(None).cast("timestamp").alias("classify_checked_at"))
    labels, _, _ = B.label_companies(first.unionByName(earlier), state, companies, _at(), second)
    return labels.select(F.col("company_id").alias("doc_id"), "dimension", "label", "confidence", "model")


@query("""WITH q AS (SELECT doc_id, coalesce(text, '') AS t, trim(substr(coalesce(text, ''), 5, 40) || CASE WHEN doc_id % 7 = 0 THEN 'zzqq' ELSE '' END) AS a, trim(substr(coalesce(text, ''), 1, 20)) AS b FROM documents),
  r AS (SELECT *, length(a) >= 8 AND contains(t, a) AS first, length(b) >= 8 AND contains(t, b) AS second FROM q)
SELECT doc_id, 'P' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'ik@x' || doc_id || '.com' END AS email, 'executive' AS contact_type, 'https://d/' || doc_id AS source_url FROM r WHERE first
UNION ALL SELECT doc_id, 'Q' || doc_id, NULL, 'hr', 'https://d/' || doc_id FROM r WHERE NOT first AND doc_id % 2 = 0 AND second""")
def verified_people(spark: SparkSession, d: str) -> DataFrame:
    """People of every document with a quote as evidence; failed ones take the second tier's; what holds is saved."""
    docs = table(spark, d, "documents").withColumn("company_id", F.col("doc_id"))
    id_ = F.col("doc_id").cast("string")
    person = lambda name, email, kind, quote: F.array(F.struct(F.concat(F.lit(name), id_).alias("name"), F.lit("r").alias("role"), email.alias("email"), F.lit(kind).alias("contact_type"), quote.alias("evidence_quote"), F.lit(0.8).alias("confidence")))
    quote = F.concat(F.substr("text", F.lit(5), F.lit(40)), F.when(F.col("doc_id") % 7 == 0, "zzqq").otherwise(""))
    mail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" IK@x"), id_, F.lit(".com ")))
    one = docs.select("company_id", F.lit(1).alias("seq"), person("P", mail, "executive", quote).alias("people"))
    two = docs.where("doc_id % 2 = 0").select("company_id", F.lit(1).alias("seq"), person("Q", F.lit(None).cast("string"), "hr", F.substr("text", F.lit(1), F.lit(20))).alias("people"))
    pages = docs.select("company_id", F.lit(0).alias("pos"), F.concat(F.lit("https://d/"), id_).alias("url"), "text")
    saved, _ = P.verify_people(one, pages, spark.createDataFrame([], K.CONTACT_COLUMNS), two)
    return saved.select(F.col("company_id").alias("doc_id"), "name", "email", "contact_type", "source_url")


# --- catalogue -------------------------------------------------------------------------------------


def _all(spark: SparkSession, d: str):
    return S.companies(spark, d), S.labels(spark, d), S.links(spark, d), S.sources(spark, d)


@query(WITH + """SELECT id, name_norm, city, open_jobs_count FROM companies c WHERE contains(name_norm, 'customer 00') AND city = 'NATION_3'
  AND EXISTS (SELECT 1 FROM links l WHERE l.company_id = c.id AND source_key = 's1') AND EXISTS (SELECT 1 FROM company_labels x WHERE x.company_id = c.id AND dimension = 'domain' AND label IN ('1-URGENT', '5-LOW'))
  AND domain IS NOT NULL AND NOT (careers_url IS NOT NULL) AND open_jobs_count > 0""")
def filtered_companies(spark: SparkSession, d: str) -> DataFrame:
    """C1, C2, D2."""
    c, labels, links, _ = _all(spark, d)
    out = C.filter_companies(c, labels, links, q="CUSTOMER 00", city="NATION_3", source="s1", category=["1-URGENT", "5-LOW"], has_domain=True, has_careers=False, has_jobs=True)
    return out.select("id", "name_norm", "city", "open_jobs_count")


PAGE_SQL = """, page AS (SELECT * FROM companies WHERE has_internship ORDER BY {order} LIMIT 25 OFFSET 25),
  cats AS (SELECT company_id, string_agg(label, ', ' ORDER BY label) FILTER (WHERE dimension = 'domain') AS categories, string_agg(label, ', ' ORDER BY label) FILTER (WHERE dimension = 'directory_sector') AS sectors FROM company_labels GROUP BY company_id),
  srcs AS (SELECT company_id, string_agg(COALESCE(s.name, l.source_key), ', ' ORDER BY COALESCE(s.name, l.source_key)) AS sources FROM links l LEFT JOIN sources s ON s.key = l.source_key GROUP BY company_id)
SELECT id, name, domain, city, website, careers_url, COALESCE(categories, '') AS categories, COALESCE(sectors, '') AS sectors, COALESCE(sources, '') AS sources, open_jobs_count, has_internship, email_count, hr_email_count, user_status, first_seen
FROM page LEFT JOIN cats ON cats.company_id = id LEFT JOIN srcs ON srcs.company_id = id"""


def _list(order: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c, labels, links, sources = _all(spark, d)
        items = C.catalog_list(c, labels, links, sources, order, 2, 25, has_internship=True)
        joined = {n: F.array_join(n, ", ") for n in ("categories", "sectors", "sources")}
        return items.withColumns(joined).drop("summary", "size_bucket", "sector", "detect_status")

    run.__name__ = f"catalog_by_{order}"
    run.__doc__ = "J8: C1, D1, E11, G1, G2."
    return run


for _order, _by in {"name": "name_norm, id", "jobs": "open_jobs_count DESC, name_norm, id", "newest": "first_seen DESC, id DESC", "contacts": "hr_email_count DESC, email_count DESC, name_norm, id"}.items():
    query(WITH + PAGE_SQL.replace("{order}", _by))(_list(_order))


ORDERS_SQL = {"name": "name_norm, id", "jobs": "open_jobs_count DESC, name_norm, id", "newest": "first_seen DESC NULLS LAST, id DESC", "contacts": "hr_email_count DESC, email_count DESC, name_norm, id"}


@query(WITH + " UNION ALL ".join(f"SELECT '{k}' AS sort, n // 50 + 1 AS page, n % 50 AS place, id FROM (SELECT id, row_number() OVER (ORDER BY {by}) - 1 AS n FROM companies)" for k, by in ORDERS_SQL.items()))
def catalog_deep_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page of each sort, from stored orders in which a page's place is known without the rows before it."""
    companies, root = S.companies(spark, d).select("id", "name_norm", "open_jobs_count", "first_seen", "hr_email_count", "email_count"), _folder(spark, "orders")
    companies = stored(companies, "companies")
    at, parts = F.col(G.POSITION), []
    for sort, keys in C.SORTS.items():
        G.write_order(companies.select(*(c for c, _ in keys)), keys, f"{root}/{sort}")
        ordered = G.read_order(spark, f"{root}/{sort}")
        parts.append(ordered.select(F.lit(sort).alias("sort"), (F.floor(at / C.PAGE_SIZE) + 1).alias("page"), (at % C.PAGE_SIZE).alias("place"), "id"))
    return reduce(DataFrame.unionByName, parts)


@query(WITH + " UNION ALL ".join(f"SELECT '{k}' AS sort, * FROM (SELECT id, name FROM companies WHERE has_internship ORDER BY {by} LIMIT 20 OFFSET 20)" for k, by in ORDERS_SQL.items()))
def catalog_after_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The page behind the last row of the first page, for each sort; its number of rows is the feature."""
    companies, labels, links, sources = _all(spark, d)
    companies, parts = stored(companies, "companies"), []
    for sort, keys in C.SORTS.items():
        first = G.page_after(C.filter_companies(companies, has_internship=True), keys, None, 20)
        found = C.catalog_list(companies, labels, links, sources, sort, size=20, cursor=G.cursor_of(first, keys), has_internship=True)
        parts.append(found.select(F.lit(sort).alias("sort"), "id", "name"))
    return reduce(DataFrame.unionByName, parts)


@query(WITH + """SELECT 'company' AS kind, CAST(company_id AS VARCHAR) AS key, count(DISTINCT email) AS n, count(DISTINCT CASE WHEN contact_type = 'hr' THEN email END) AS n_hr FROM contacts GROUP BY company_id
  UNION ALL SELECT 'source', source_key, count(DISTINCT company_id), NULL FROM links GROUP BY source_key""")
def kept_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct addresses of companies and companies of sources, kept up over three batches that overlap."""
    root = _folder(spark, "distinct")
    contacts = S.contacts(spark, d).select("company_id", "email", (F.col("contact_type") == "hr").alias("hr"))
    links = S.links(spark, d).select("source_key", "company_id")
    for version, part in enumerate(("company_id % 2 = 0", "company_id % 3 = 0", "company_id % 2 != 0"), 1):
        N.add_values(contacts.where(part), root, "emails", version, "company_id", "email", ("hr",), buckets=16)
        N.add_values(links.where(part), root, "listed", version, "source_key", "company_id", buckets=16)
    mails, listed = N.value_counts(spark, root, "emails", "company_id"), N.value_counts(spark, root, "listed", "source_key")
    a = mails.select(F.lit("company").alias("kind"), F.col("company_id").cast("string").alias("key"), "n", F.col("n_hr"))
    return a.unionByName(listed.select(F.lit("source").alias("kind"), F.col("source_key").alias("key"), "n", F.lit(None).cast("long").alias("n_hr")))


@query(WITH + "SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM companies WHERE domain IS NOT NULL")
def catalog_pages(spark: SparkSession, d: str) -> DataFrame:
    """E8."""
    return C.page_count(C.filter_companies(S.companies(spark, d), has_domain=True))


@query(WITH + """,
 con AS (SELECT company_id, string_agg(email, ',' ORDER BY CASE contact_type WHEN 'hr' THEN 0 WHEN 'executive' THEN 1 ELSE 2 END, email) AS contacts FROM contacts GROUP BY company_id),
 job AS (SELECT company_id, string_agg(title || '/' || location, ',' ORDER BY CASE WHEN is_internship THEN 0 ELSE 1 END, title, location) AS jobs FROM jobs WHERE is_active GROUP BY company_id),
 ref AS (SELECT company_id, string_agg(COALESCE(s.name, l.source_key) || ' ' || listed_url, ',' ORDER BY COALESCE(s.name, l.source_key), listed_url) AS refs FROM links l LEFT JOIN sources s ON s.key = l.source_key GROUP BY company_id)
SELECT id, name, refs, contacts, jobs FROM companies LEFT JOIN con ON con.company_id = id LEFT JOIN job ON job.company_id = id LEFT JOIN ref ON ref.company_id = id""")
def catalog_details(spark: SparkSession, d: str) -> DataFrame:
    """E12, G3, G4. All companies are asked for, and as many unknown ids, which give no row."""
    c, labels, links, sources = _all(spark, d)
    out = C.catalog_detail(c.select(F.explode(F.array("id", -1 - F.col("id"))).alias("id")), c, labels, links, sources, S.contacts(spark, d), S.jobs(spark, d))
    flat = lambda col, f: F.array_join(F.transform(col, f), ",")
    return out.select(
        "id", "name", flat("source_refs", lambda x: F.concat(x["source_name"], F.lit(" "), x["listed_url"])).alias("refs"),
        flat("contacts", lambda x: x["email"]).alias("contacts"), flat("jobs", lambda x: F.concat(x["title"], F.lit("/"), x["location"])).alias("jobs"),
    )


@query(WITH + """, f AS (SELECT 'city' AS facet, city AS value, city AS label, count(*) AS count FROM companies GROUP BY city
  UNION ALL SELECT 'status', user_status, user_status, count(*) FROM companies GROUP BY user_status
  UNION ALL SELECT 'source', source_key, COALESCE(s.name, source_key), count(DISTINCT company_id) FROM links LEFT JOIN sources s ON s.key = source_key GROUP BY ALL
  UNION ALL SELECT 'category', label, label, count(*) FROM company_labels WHERE dimension = 'domain' GROUP BY label
  UNION ALL SELECT * FROM (SELECT 'sector', label, label, count(*) AS n FROM company_labels WHERE dimension = 'directory_sector' GROUP BY label ORDER BY n DESC, label LIMIT 60))
SELECT * FROM f WHERE value IS NOT NULL AND value <> ''""")
def catalog_facets(spark: SparkSession, d: str) -> DataFrame:
    """E3-E7, G6."""
    return C.facets(*_all(spark, d))


@query(WITH + """SELECT count(*) AS companies, count(domain) AS with_domain, count(careers_url) AS with_careers, count(ats_provider) AS with_ats, count(*) FILTER (WHERE open_jobs_count > 0) AS with_jobs,
  count(*) FILTER (WHERE has_internship) AS with_internship, count(*) FILTER (WHERE email_count > 0) AS with_email, count(*) FILTER (WHERE hr_email_count > 0) AS with_hr_email,
  (SELECT count(*) FROM contacts) AS contacts, (SELECT count(*) FILTER (WHERE is_active) FROM jobs) AS active_jobs, (SELECT count(*) FILTER (WHERE is_active AND is_internship) FROM jobs) AS internships,
  (SELECT count(DISTINCT company_id) FROM company_labels WHERE dimension = 'domain') AS labelled, count(domain) * 100 // greatest(count(*), 1) AS domain_percent FROM companies""")
def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    """E1, E2."""
    s = C.catalog_stats(S.companies(spark, d), S.contacts(spark, d), S.jobs(spark, d), S.labels(spark, d))
    return s.withColumn("domain_percent", C.share(F.col("with_domain"), F.col("companies")))


@query(WITH + "SELECT key, name, kind, CASE WHEN NOT enabled THEN 'kapalı' ELSE COALESCE(health, '-') END AS status FROM sources")
def source_report(spark: SparkSession, d: str) -> DataFrame:
    """C6, G5, J11."""
    return C.source_report(S.sources(spark, d)).select("key", "name", "kind", "status")


@query(WITH + "SELECT id, name FROM companies c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.company_id = c.id AND source_key NOT IN ('s0', 's1', 's2', 's3', 's4', 's5')) AND city = 'NATION_3'")
def exclusive_companies(spark: SparkSession, d: str) -> DataFrame:
    """D3, I11."""
    return C.exclusive_to_sources(S.companies(spark, d), S.links(spark, d), ["s0", "s1", "s2", "s3", "s4", "s5"], "NATION_3").select("id", "name")


@query(WITH + """, gone AS (SELECT id FROM companies c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.company_id = c.id AND source_key NOT IN ('s0', 's1', 's2', 's3', 's4', 's5')))
SELECT 'companies' AS t, count(*) AS n FROM companies WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'labels', count(*) FROM company_labels WHERE company_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'contacts', count(*) FROM contacts WHERE company_id NOT IN (SELECT id FROM gone)""")
def pruned_tables(spark: SparkSession, d: str) -> DataFrame:
    """I11."""
    c = S.companies(spark, d)
    gone = C.exclusive_to_sources(c, S.links(spark, d), ["s0", "s1", "s2", "s3", "s4", "s5"])
    kept = C.prune(gone, {"companies": c, "labels": S.labels(spark, d), "contacts": S.contacts(spark, d)})
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n") for n, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(WITH + "SELECT company_id, count(*) FILTER (WHERE is_active) AS open_jobs_count, COALESCE(bool_or(is_active AND is_internship), false) AS has_internship FROM jobs GROUP BY company_id")
def job_counters(spark: SparkSession, d: str) -> DataFrame:
    """E9, B12."""
    return C.job_counters(S.jobs(spark, d))


@query(WITH + "SELECT company_id, count(DISTINCT email) AS email_count, count(DISTINCT CASE WHEN contact_type = 'hr' THEN email END) AS hr_email_count FROM contacts GROUP BY company_id")
def email_counters(spark: SparkSession, d: str) -> DataFrame:
    """E10, B11."""
    return C.email_counters(S.contacts(spark, d))


@query(WITH + """, x AS (SELECT company_id, list_sort(list(label) FILTER (WHERE dimension = 'domain')) AS c, list_sort(list(label) FILTER (WHERE dimension = 'directory_sector')) AS s FROM company_labels GROUP BY company_id)
SELECT id, array_to_string(CASE WHEN len(COALESCE(c, [])) > 0 THEN c[1:3] ELSE s[1:2] END, ', ') AS shown,
  array_to_string(list_filter([CASE WHEN hr_email_count > 0 THEN 'hr-mail' WHEN email_count > 0 THEN 'mail' END, CASE WHEN has_internship THEN 'internship' END, CASE WHEN domain IS NULL THEN 'no-domain' END], lambda v: v IS NOT NULL), ',') AS badges
FROM companies JOIN x ON company_id = id""")
def display_rows(spark: SparkSession, d: str) -> DataFrame:
    """C19."""
    items = C.list_items(*_all(spark, d))
    return items.select("id", F.array_join(C.display_labels(F.col("categories"), F.col("sectors")), ", ").alias("shown"), F.array_join(C.badges(), ",").alias("badges"))


@query(WITH + """, cats AS (SELECT company_id, string_agg(label, ', ' ORDER BY label) FILTER (WHERE dimension = 'domain') AS categories, string_agg(label, ', ' ORDER BY label) FILTER (WHERE dimension = 'directory_sector') AS sectors FROM company_labels GROUP BY company_id),
  srcs AS (SELECT company_id, string_agg(COALESCE(s.name, l.source_key), ', ' ORDER BY COALESCE(s.name, l.source_key)) AS sources FROM links l LEFT JOIN sources s ON s.key = l.source_key GROUP BY company_id)
SELECT name, domain, city, website, careers_url, COALESCE(categories, '') AS categories, COALESCE(sectors, '') AS sectors, COALESCE(sources, '') AS sources, open_jobs_count, CASE WHEN has_internship THEN 'evet' ELSE '' END AS internship, email_count, hr_email_count
FROM companies LEFT JOIN cats ON cats.company_id = id LEFT JOIN srcs ON srcs.company_id = id WHERE open_jobs_count > 0""")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """J10, A9 as a table."""
    c, labels, links, sources = _all(spark, d)
    return C.export_rows(C.list_items(C.filter_companies(c, has_jobs=True), labels, links, sources))


@query(WITH + "SELECT id, domain FROM companies WHERE careers_url IS NULL AND domain IS NOT NULL AND ats_provider IS NOT NULL")
def companies_needing_jobs(spark: SparkSession, d: str) -> DataFrame:
    """careers_url stands for the jobs checkpoint."""
    return C.companies_needing(S.companies(spark, d).withColumn("jobs_checked_at", F.col("careers_url")), "jobs").select("id", "domain")


@query(WITH + """SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'cevap_geldi' ELSE user_status END AS user_status, CASE WHEN id % 4 = 1 THEN 'note' END AS user_note, CASE WHEN id % 4 < 2 THEN '2024-05-01' END AS updated FROM companies""")
def annotated_companies(spark: SparkSession, d: str) -> DataFrame:
    """I10, C18."""
    c = S.companies(spark, d).withColumns({"user_note": F.lit(None).cast("string"), "user_updated_at": F.lit(None).cast("timestamp")})
    p = c.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, "").otherwise("cevap_geldi").alias("user_status"), F.when(F.col("id") % 4 == 1, "note").alias("user_note"))
    return C.annotate(c, p, F.to_timestamp(F.lit("2024-05-01"))).select("id", "user_status", "user_note", F.date_format("user_updated_at", "yyyy-MM-dd").alias("updated"))


@query(WITH + "SELECT company_id, arg_min(label, label) AS hint FROM company_labels WHERE dimension = 'directory_sector' AND length(label) BETWEEN 1 AND 80 GROUP BY company_id")
def directory_hints(spark: SparkSession, d: str) -> DataFrame:
    """D18, C7."""
    return B.directory_hint(S.labels(spark, d)).withColumn("hint", B.clean_hint(F.col("hint"))).where("hint is not null")


@query(WITH + """, v AS (SELECT company_id, lower(trim(email)) AS email, CASE contact_type WHEN 'personal' THEN 'generic' ELSE contact_type END AS contact_type, source_url FROM contacts),
 u AS (SELECT * FROM v WHERE company_id % 2 = 0 UNION ALL SELECT * FROM v) SELECT company_id, email, min(contact_type) AS contact_type, min(source_url) AS source_url, count(DISTINCT email) AS n FROM u GROUP BY company_id, email""")
def saved_contacts(spark: SparkSession, d: str) -> DataFrame:
    """A second run inserts nothing again."""
    new = S.contacts(spark, d)
    state = K.valid_contacts(new.where("company_id % 2 = 0"))
    return K.save_contacts(state, new).select("company_id", "email", "contact_type", "source_url", F.lit(1).cast("long").alias("n"))


# --- entity resolution ---------------------------------------------------------------------------


@query(f"""WITH RECURSIVE p AS (SELECT page_id AS seq, {BARE} AS h FROM pages), k AS (SELECT seq, {DOMAIN} AS domain, {DOMAIN} AS name_norm FROM p) SELECT seq, min(seq) OVER (PARTITION BY domain) AS entity FROM k""")
def resolved_pages(spark: SparkSession, d: str) -> DataFrame:
    """D4-D6 and components over page hosts, named by their domain."""
    site = T.registrable_domain(T.url_host(F.col("url")), SUFFIXES)
    p = table(spark, d, "pages").select(F.col("page_id").alias("seq"), site.alias("name"), F.col("url").alias("website"), F.lit(None).cast("string").alias("city"), F.lit("pages").alias("source_key"), F.col("url").alias("listed_url"))
    return E.resolve_entities(p, threshold=100, suffixes=SUFFIXES).select("seq", "entity")


def _lcs(x: str, y: str) -> str:
    """SQL of the length of the longest common subsequence: one row of the table at a time."""
    cell = f"list_append(cells, CASE WHEN list_extract({y}, j[1] + 1) = c[1] THEN above[j[1] + 1] + 1 ELSE greatest(above[j[1] + 2], cells[-1]) END)"
    row = f"list_reduce(list_prepend([0::BIGINT], list_transform(range(len({y})), lambda j: [j])), lambda cells, j: {cell})"
    return f"list_reduce(list_prepend(list_transform(range(len({y}) + 1), lambda i: 0::BIGINT), list_transform({x}, lambda c: [c])), lambda above, c: {row})[-1]"


CODES = "list_transform(string_split(t{0}, ''), lambda z: unicode(z)::BIGINT)"
SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"


@query(f"""WITH n AS (SELECT p_name, min(p_partkey) AS key, {SORTED.format('p_name')} AS t FROM part GROUP BY p_name HAVING length(p_name) >= 4),
  p AS (SELECT a.key AS a, b.key AS b, a.t AS t1, b.t AS t2 FROM n a JOIN n b ON a.key < b.key), c AS (SELECT a, b, {CODES.format(1)} AS x, {CODES.format(2)} AS y FROM p)
SELECT * FROM (SELECT a, b, round(200.0::DOUBLE * {_lcs('x', 'y')} / (len(x) + len(y)), 6) AS score FROM c) WHERE score >= 75""")
def fuzzy_part_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names whose sorted-word score reaches 75."""
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("name_norm")).agg(F.min("p_partkey").alias("key"))
    return E.fuzzy_name_edges(names.select("key", "name_norm"), threshold=75).withColumn("score", F.round("score", 6))


#: Known firms: part names with brand, every third with a site. Listed ones: of each part, its firm by site, by equal name with a legal form, by a name with a slip, by a name too short to match, or a new one.
FIRMS_SQL = f"""known AS (SELECT min(p_partkey) AS id, p_name || ' ' || lower(replace(p_brand, '#', ' ')) AS name_norm FROM part GROUP BY 2),
  state AS (SELECT id, name_norm, CASE WHEN id % 3 = 0 THEN 'p' || id || '.com' END AS domain FROM known),
  listed AS (SELECT p_partkey AS seq, k.id, p_partkey % 6 AS kind, CASE p_partkey % 6 WHEN 2 THEN substr(k.name_norm, 2) WHEN 3 THEN 'abc' WHEN 4 THEN reverse(k.name_norm) WHEN 5 THEN 'a' || k.name_norm ELSE k.name_norm END AS name_norm,
    CASE WHEN p_partkey % 6 = 0 THEN 'p' || k.id || '.com' WHEN p_partkey % 6 = 4 THEN 'new' || p_partkey || '.com' END AS domain FROM part JOIN known k ON k.name_norm = p_name || ' ' || lower(replace(p_brand, '#', ' '))),
  by_name AS (SELECT name_norm, min(id) AS id FROM state WHERE length(name_norm) >= 4 GROUP BY name_norm),
  first AS (SELECT l.*, s.id AS by_domain, b.id AS by_name FROM listed l LEFT JOIN state s USING (domain) LEFT JOIN by_name b ON b.name_norm = l.name_norm),
  open AS (SELECT DISTINCT name_norm, {SORTED.format('name_norm')} AS t1 FROM first WHERE by_domain IS NULL AND by_name IS NULL AND length(name_norm) >= 4),
  near AS (SELECT o.name_norm, id, t1, t2 FROM open o JOIN (SELECT min(id) AS id, {SORTED.format('name_norm')} AS t2 FROM state WHERE domain IS NULL AND length(name_norm) >= 4 GROUP BY 2) k
    ON abs(length(t1) - length(t2)) <= 0.07 * (length(t1) + length(t2)) AND levenshtein(t1, t2) <= 0.07 * (length(t1) + length(t2))),
  codes AS (SELECT name_norm, id, {CODES.format(1)} AS x, {CODES.format(2)} AS y FROM near),
  scored AS (SELECT name_norm, id, 200.0::DOUBLE * {_lcs('x', 'y')} / (len(x) + len(y)) AS score FROM codes),
  best AS (SELECT name_norm, arg_min(id, (-score, id)) AS id FROM scored WHERE score >= 93 GROUP BY name_norm),
  matched AS (SELECT f.seq, f.name_norm, f.domain, COALESCE(f.by_domain, f.by_name, b.id) AS known, CASE WHEN f.by_domain IS NOT NULL THEN 'domain' WHEN f.by_name IS NOT NULL THEN 'name' WHEN b.id IS NOT NULL THEN 'similar' END AS how
    FROM first f LEFT JOIN best b ON b.name_norm = f.name_norm AND f.by_domain IS NULL AND f.by_name IS NULL)"""


def _firms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    known = p.groupBy("name").agg(F.min("p_partkey").alias("id"))
    state = known.select("id", "name", T.normalize_name(F.col("name")).alias("name_norm"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), "id", F.lit(".com"))).alias("domain"))
    k, n = F.col("p_partkey") % 6, F.col("name")
    norm = T.normalize_name(n)
    name = F.when(k == 1, F.concat(n, F.lit(" A.Ş."))).when(k == 2, F.substr(norm, F.lit(2))).when(k == 3, "abc").when(k == 4, F.reverse(norm)).when(k == 5, F.concat(F.lit("a"), norm)).otherwise(n)
    site = F.when(k == 0, F.concat(F.lit("https://www.p"), "id", F.lit(".com/tr"))).when(k == 4, F.concat(F.lit("https://new"), "p_partkey", F.lit(".com")))
    rows = p.join(known.hint("shuffle_merge"), "name").select(F.col("p_partkey").alias("seq"), name.alias("name"), site.alias("website"), F.lit("Ankara").alias("city"), F.lit("s").alias("source_key"), F.lit("u").alias("listed_url"))
    return state, rows


@query(f"WITH {FIRMS_SQL} SELECT seq, known, how FROM matched WHERE known IS NOT NULL")
def matched_companies(spark: SparkSession, d: str) -> DataFrame:
    """Listed rows and the known company of each, by domain, equal name or similar name, from a trigram index of names."""
    state, rows = _firms(spark, d)
    index = E.name_index(state.where("domain is null").select(F.col("id").alias("key"), "name_norm"))
    return E.match_existing(E.keyed(rows), state, stored(index, "name_index"))


@query(f"""WITH {FIRMS_SQL}
SELECT s.id, s.domain, CASE WHEN m.id IS NOT NULL THEN 'Ankara' END AS city, CASE WHEN m.id IS NULL THEN '2024-01-01' ELSE '2024-05-01' END AS last_seen
FROM state s LEFT JOIN (SELECT DISTINCT known AS id FROM matched WHERE known IS NOT NULL) m ON m.id = s.id""")
def companies_after_batch(spark: SparkSession, d: str) -> DataFrame:
    """J2 and I2 on known companies: a batch is matched to them and fills their empty fields."""
    state, rows = _firms(spark, d)
    old, null = F.to_timestamp(F.lit("2024-01-01")), F.lit(None).cast("string")
    state = stored(state.withColumns({"city": null, "website": null, "first_seen": old, "last_seen": old}), "state")
    matched = E.match_existing(E.keyed(rows), state)
    new = E.keyed(rows).join(matched.hint("shuffle_merge"), "seq").select(F.col("known").alias("id"), "name", "name_norm", F.lit(None).cast("string").alias("domain"), "city", "website").dropDuplicates(["id"])
    return E.upsert_companies(state, new, _at()).select("id", "domain", "city", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


# --- postings --------------------------------------------------------------------------------------

SNAPSHOT_SQL = """WITH s AS (SELECT user_id AS company_id, event_type AS title, ts < TIMESTAMP '2024-01-16' AS old FROM events),
  f AS (SELECT company_id, sha256(company_id || '|' || title || '|') AS fingerprint, bool_or(old) AS o, bool_or(NOT old) AS n FROM s GROUP BY company_id, title)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("user_id").alias("company_id"), F.col("event_id").cast("string").alias("external_id"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("location"),
                                          F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("posted_at"), F.lit(None).cast("boolean").alias("remote"), F.lit(True).alias("valid"), F.lit("p").alias("provider"), F.lit("s").alias("slug"), "ts")
    old, new = e.where("ts < timestamp'2024-01-16'").drop("ts"), e.where("ts >= timestamp'2024-01-16'").drop("ts")
    return J.snapshot(old), J.snapshot(new)


@query(SNAPSHOT_SQL + " SELECT fingerprint, company_id, CASE WHEN NOT o THEN 'added' WHEN NOT n THEN 'closed' ELSE 'kept' END AS change FROM f")
def posting_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of postings compared."""
    old, new = _snapshots(spark, d)
    return J.job_diff(old.withColumn("is_active", F.lit(True)), new)


@query(SNAPSHOT_SQL + """ SELECT fingerprint, company_id, n OR company_id % 3 = 0 AS is_active, CASE WHEN o THEN '2024-01-16' ELSE '2024-02-01' END AS first_seen, CASE WHEN n THEN '2024-02-01' ELSE '2024-01-16' END AS last_seen FROM f""")
def synced_postings(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot applied to the job table; companies with an id divisible by 3 were unreachable."""
    old, new = _snapshots(spark, d)
    at = lambda x: F.to_timestamp(F.lit(x))
    state = old.withColumns({"first_seen": at("2024-01-16"), "last_seen": at("2024-01-16"), "is_active": F.lit(True)})
    checked = table(spark, d, "events").where("user_id % 3 != 0").select(F.col("user_id").alias("company_id")).distinct()
    out = J.sync_jobs(state, new, checked, at("2024-02-01"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("fingerprint", "company_id", "is_active", day("first_seen"), day("last_seen"))


@query(SNAPSHOT_SQL + """ SELECT fingerprint, company_id, n OR company_id % 3 = 0 AS is_active, CASE WHEN o THEN '2024-01-16' ELSE '2024-02-01' END AS first_seen, CASE WHEN n THEN '2024-02-01' ELSE '2024-01-16' END AS last_seen FROM f""")
def bucketed_postings(spark: SparkSession, d: str) -> DataFrame:
    """The job table in buckets of companies; the snapshot arrives in three batches of companies, each of which rewrites their buckets only."""
    old, new = _snapshots(spark, d)
    at = lambda x: F.to_timestamp(F.lit(x))
    root = _folder(spark, "bucketed")
    bucketed.create(old.withColumns({"first_seen": at("2024-01-16"), "last_seen": at("2024-01-16"), "is_active": F.lit(True)}), root, "jobs", ["company_id"], 32)
    new = stored(new, "snapshot")
    checked = stored(table(spark, d, "events").select(F.col("user_id").alias("company_id")).distinct(), "checked")
    for version in (2, 3, 4):
        part = F.pmod("company_id", F.lit(3)) == version - 2
        # Unreachable boards list what is new and close nothing.
        reached = checked.where(part & (F.pmod("company_id", F.lit(3)) != 0))
        bucketed.merge(checked.where(part), root, "jobs", version, lambda state, _, part=part, reached=reached: J.sync_jobs(state, new.where(part), reached, at("2024-02-01")))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return bucketed.read(spark, root, "jobs").select("fingerprint", "company_id", "is_active", day("first_seen"), day("last_seen"))


@query("""WITH e AS (SELECT event_id, event_id % 8 AS p, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, 'T ' || event_type AS title FROM events)
SELECT event_id, (['greenhouse', 'lever', 'ashby', 'workable', 'recruitee', 'smartrecruiters', 'breezy', 'personio'])[p + 1] AS provider, k AS external_id, title,
  (['Izmir', 'Remote, TR', 'Ankara', 'Ankara, TR', 'L', 'Ankara, tr', 'Izmir', 'O'])[p + 1] AS location,
  CASE p WHEN 2 THEN 'a' WHEN 3 THEN 'https://apply.workable.com/s/j/' || k || '/' WHEN 4 THEN 'c' WHEN 5 THEN 'https://jobs.smartrecruiters.com/s/' || k WHEN 7 THEN 'https://s.jobs.personio.de/job/' || k ELSE 'h' END AS url,
  CASE p WHEN 1 THEN '2023-11-14 22:13:20' ELSE 'd' END AS posted_at, CASE p WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true END AS remote, true AS valid FROM e""")
def provider_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Events as payloads of the eight providers, each in its own shape, parsed to one table."""
    e = table(spark, d, "events").withColumns({"p": (F.col("event_id") % 8).cast("int"), "k": F.get_json_object("props", "$.k"), "t": F.concat(F.lit("T "), "event_type")})
    shapes = [
        '{"jobs":[{"id":%k,"title":" %t ","location":{"name":"Izmir"},"absolute_url":"h","updated_at":"d"}]}', '[{"id":"%k","text":"%t","categories":{"location":"Remote, TR"},"hostedUrl":"h","createdAt":1700000000000}]',
        '{"jobs":[{"id":"%k","title":"%t","location":"Ankara","jobUrl":"","applyUrl":"a","publishedAt":"d","isRemote":true}]}', '{"jobs":[{"shortcode":"%k","title":"%t","city":"Ankara","country":"TR","url":"","published_on":"d","telecommuting":true}]}',
        '{"offers":[{"id":%k,"title":"%t","location":"L","careers_url":"c","published_at":"d","remote":false}]}', '{"content":[{"id":"%k","name":"%t","location":{"city":"Ankara","country":"tr","remote":true},"releasedDate":"d"}]}',
        '[{"id":"%k","name":"%t","location":{"city":"Izmir"},"url":"h","published_date":"d"}]', "<workzag-jobs><position><id>%k</id><name>%t</name><office>O</office><createdAt>d</createdAt></position></workzag-jobs>",
    ]
    body = F.replace(F.replace(F.get(F.array(*map(F.lit, shapes)), F.col("p")), F.lit("%k"), F.col("k")), F.lit("%t"), F.col("t"))
    provider = F.get(F.array(*map(F.lit, J.PROVIDERS)), F.col("p"))
    payloads = e.select(F.col("event_id").alias("company_id"), provider.alias("provider"), F.lit("s").alias("slug"), body.alias("body"))
    return J.parse_all(payloads).select(F.col("company_id").alias("event_id"), "provider", "external_id", "title", "location", "url", "posted_at", "remote", "valid")


@query("""WITH k AS (SELECT min(p_partkey) AS id FROM part GROUP BY p_name, p_brand), w AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'https://u' || id || '.com' WHEN id % 2 = 0 THEN 'https://www.w' || id || '.com' END AS site FROM k)
SELECT id, site AS website, CASE WHEN id % 3 = 0 THEN 'p' || id || '.com' WHEN id % 5 = 0 THEN 'u' || id || '.com' WHEN id % 2 = 0 THEN 'w' || id || '.com' END AS domain FROM w""")
def enriched_websites(spark: SparkSession, d: str) -> DataFrame:
    """Sites from info payloads fill companies by normalised name; other shapes give none."""
    state, _ = _firms(spark, d)
    companies = state.withColumn("website", F.lit(None).cast("string"))
    id_ = F.col("id").cast("string")
    body = (
        F.when(F.col("id") % 5 == 0, F.concat(F.lit('{"company":{"title":"x","website":"https://no.com","website_url":"https://u'), id_, F.lit('.com"}}')))
        .when(F.col("id") % 2 == 0, F.concat(F.lit('{"company":{"website_url":"","website":"https://www.w'), id_, F.lit('.com"}}'))).otherwise("[1]")
    )
    rows = state.select(F.col("id").alias("row_id"), F.concat(F.upper("name"), F.lit(" A.Ş.")).alias("title"))
    return D.enrich_websites(companies, rows, state.select(F.col("id").alias("row_id"), body.alias("body"))).select("id", "website", "domain")


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS external_id, CASE WHEN event_id % 4 = 0 THEN 'Title ' || event_type WHEN event_id % 4 = 1 THEN 'T' END AS title, event_id % 4 <> 3 AS valid FROM events""")
def parsed_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A4: event props as board payloads: two postings' shapes, an empty board and a broken body."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    body = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"jobs":[{"id":'), k, F.lit(',"title":" Title '), "event_type", F.lit(' "}]}')))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"jobs":[{"id":'), k, F.lit(',"title":"T","location":{"name":"X"}}]}')))
        .when(F.col("event_id") % 4 == 2, '{"jobs": []}').otherwise("<html>")
    )
    p = e.select(F.col("event_id").alias("company_id"), F.lit("greenhouse").alias("provider"), F.lit("s").alias("slug"), body.alias("body"))
    return J.parse_job_payloads(p, "greenhouse").select(F.col("company_id").alias("event_id"), "external_id", "title", "valid")


# --- state transitions ------------------------------------------------------------------------------

AT = "2024-05-01"


def _at():
    return F.to_timestamp(F.lit(AT))


@query(f"""WITH p AS (SELECT *, {BARE} AS host FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS rn FROM p WHERE page_id * 40000 + 1700000000 >= 1702000000 - 86400)
SELECT host, page_id FROM r WHERE rn = 1""")
def latest_copies(spark: SparkSession, d: str) -> DataFrame:
    """F8: the newest page of each host within the time to live."""
    log = _log(spark, d).withColumn("url", T.url_host(F.col("url")))
    return R.latest_copies(log, F.timestamp_seconds(F.lit(1702000000)), 1).select(F.col("url").alias("host"), "page_id")


@query(r"""SELECT page_id FROM pages WHERE NOT (regexp_matches(url, '^[a-z]+://[^/?#]*/en/') AND url LIKE 'https://%')""")
def robots_open_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that no disallow rule of their origin begins."""
    p = table(spark, d, "pages")
    rules = p.where("url like 'https://%'").select(R.origin(F.col("url")).alias("origin"), F.lit("/en/").alias("path")).distinct()
    return R.robots_gate(p.select("page_id", "url"), rules).select("page_id")


@query(WITH + """, n AS (SELECT company_id, label FROM company_labels WHERE dimension = 'domain' AND company_id % 2 = 0), o AS (SELECT company_id, label FROM company_labels WHERE dimension = 'domain' AND company_id % 3 = 0)
SELECT COALESCE(n.company_id, o.company_id) AS company_id, COALESCE(n.label, o.label) AS label, CASE WHEN n.label IS NOT NULL THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence, CASE WHEN o.label IS NOT NULL THEN 'old' ELSE 'new' END AS model
FROM n FULL JOIN o ON n.company_id = o.company_id AND n.label = o.label""")
def upserted_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels inserted or refreshed; the first model stays."""
    rows = S.labels(spark, d).where("dimension = 'domain'")
    make = lambda df, c, m: df.select("*", F.lit(c).alias("confidence"), F.lit("u").alias("evidence_url"), F.lit(m).alias("model"))
    state = make(rows.where("company_id % 3 = 0"), 0.4, "old").withColumn("as_of", _at())
    return B.add_labels(state, make(rows.where("company_id % 2 = 0"), 0.7, "new"), _at()).select("company_id", "label", "confidence", "model")


@query(WITH + """SELECT id, CASE WHEN id % 2 = 0 THEN COALESCE(CASE WHEN id % 3 = 0 THEN 'mikro' END, 'orta') ELSE CASE WHEN id % 3 = 0 THEN 'mikro' END END AS size_bucket,
  CASE WHEN id % 2 = 0 THEN 'kamu' END AS sector, id % 2 = 0 AS checked FROM companies""")
def saved_classification(spark: SparkSession, d: str) -> DataFrame:
    """Sizes fill only where empty, and the checkpoint moves."""
    c = S.companies(spark, d).select("id", F.when(F.col("id") % 3 == 0, "mikro").alias("size_bucket"), F.lit(None).cast("string").alias("sector"), F.lit(None).cast("timestamp").alias("classify_checked_at"))
    r = c.where("id % 2 = 0").select(F.col("id").alias("company_id"), F.lit("orta").alias("size_bucket"), F.lit("kamu").alias("sector"))
    return B.save_classification(c, r, _at()).select("id", "size_bucket", "sector", F.col("classify_checked_at").isNotNull().alias("checked"))


@query(WITH + "SELECT key, CASE WHEN key IN ('s3', 's4') THEN 'new' ELSE kind END AS kind, enabled FROM sources UNION ALL SELECT 's9', 'new', false")
def upserted_sources(spark: SparkSession, d: str) -> DataFrame:
    """A source's fields are replaced; enabled only on insert."""
    s = S.sources(spark, d).select("key", "kind", "name", F.lit("u").alias("url"), F.lit("p").alias("parser"), "enabled")
    fresh = s.where("key in ('s3', 's4')").unionByName(s.where("key = 's0'").withColumn("key", F.lit("s9"))).withColumns({"kind": F.lit("new"), "enabled": F.lit(False)})
    return E.upsert_sources(s, fresh).select("key", "kind", "enabled")


@query(WITH + """SELECT id, name, domain, CASE WHEN id % 2 = 0 THEN city ELSE COALESCE(NULL, 'Ankara') END AS city, CASE WHEN id % 2 = 0 THEN '2024-01-01' ELSE '2024-05-01' END AS first_seen,
  CASE WHEN id % 4 < 2 OR id % 2 = 1 THEN '2024-05-01' ELSE '2024-01-01' END AS last_seen FROM companies WHERE domain IS NOT NULL""")
def upserted_companies(spark: SparkSession, d: str) -> DataFrame:
    """Known domains keep what they have, others are inserted."""
    c = S.companies(spark, d).where("domain is not null").select("id", "name", "name_norm", "domain", "city", "website")
    old = F.to_timestamp(F.lit("2024-01-01"))
    state = c.where("id % 2 = 0").withColumns({"first_seen": old, "last_seen": old})
    new = c.where("id % 4 < 2 or id % 2 = 1").withColumns({"city": F.lit("Ankara"), "id": F.when(F.col("id") % 2 == 0, -F.col("id")).otherwise(F.col("id"))})
    day = lambda n: F.date_format(n, "yyyy-MM-dd").alias(n)
    return E.upsert_companies(state, new, _at()).select("id", "name", "domain", "city", day("first_seen"), day("last_seen"))


@query(WITH + """SELECT company_id, source_key, min(CASE WHEN company_id % 2 = 0 THEN '2024-01-01' ELSE '2024-05-01' END) AS first_seen FROM links GROUP BY ALL""")
def linked_sources(spark: SparkSession, d: str) -> DataFrame:
    """Insert-ignore of source links."""
    rows = S.links(spark, d).select("company_id", "source_key", "listed_url")
    state = rows.where("company_id % 2 = 0").withColumn("first_seen", F.lit("2024-01-01"))
    return E.link_sources(state, rows.withColumn("first_seen", F.lit(AT))).select("company_id", "source_key", "first_seen")


@query(f"""WITH p AS (SELECT page_id, {BARE} AS h, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS source_key FROM pages), k AS (SELECT *, {DOMAIN} AS domain FROM p),
  e AS (SELECT source_key, domain, count(*) AS listed, bool_or(k.domain IN (SELECT domain FROM k WHERE page_id % 5 = 0)) AS known FROM k GROUP BY source_key, domain)
SELECT source_key, sum(listed)::BIGINT AS listed, count(*) FILTER (WHERE NOT known) AS new, count(*) FILTER (WHERE known) AS updated, count(*) AS with_site FROM e GROUP BY source_key""")
def source_counters(spark: SparkSession, d: str) -> DataFrame:
    """What each language section's listings add to the companies known from every fifth page."""
    site = T.registrable_domain(T.url_host(F.col("url")), SUFFIXES)
    p = table(spark, d, "pages").select(F.col("page_id").alias("seq"), site.alias("name"), F.col("url").alias("website"), F.lit(None).cast("string").alias("city"), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("source_key"), F.col("url").alias("listed_url"))
    resolved = E.resolve_entities(p, threshold=100, suffixes=SUFFIXES)
    return D.upsert_counters(resolved, resolved.where("seq % 5 = 0").select("domain", "name_norm"))


@query(f"""WITH e AS (SELECT {BARE} AS source_key, page_id, {CUTS} AS status FROM pages)
SELECT source_key, count(*) FILTER (WHERE page_id % 3 = 0) AS entries, count(*) FILTER (WHERE page_id % 6 = 0) AS with_site,
  CASE WHEN NOT bool_or(status = 200) THEN 'error' WHEN count(*) FILTER (WHERE page_id % 3 = 0) = 0 THEN 'empty' ELSE 'ok' END AS health FROM e GROUP BY source_key""")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    """Entries, sites and health per host."""
    log = _log(spark, d).withColumn("source_key", T.url_host(F.col("url")))
    entries = log.where("page_id % 3 = 0").select("source_key", F.when(F.col("page_id") % 6 == 0, F.col("url")).alias("website"))
    return D.run_summary(entries, log)


@query(f"""WITH {ANCHORS}, h AS (SELECT page_id, min(pos) AS pos, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS url FROM anchors WHERE page_id % 2 = 0 GROUP BY page_id, url, href)
SELECT page_id, url, pos FROM h UNION ALL SELECT page_id, url || '#sitemap', 0 FROM pages WHERE page_id NOT IN (SELECT page_id FROM h)""")
def links_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Pages without links of their own take the fallback's rows."""
    p = table(spark, d, "pages")
    a = L.anchors(p.where("page_id % 2 = 0"), "html").withColumn("link", T.resolve_url(F.col("url"), F.col("href")))
    hits = a.groupBy(F.col("page_id").alias("company_id"), F.col("link").alias("url")).agg(F.min("pos").alias("pos"))
    fallback = p.select(F.col("page_id").alias("company_id"), F.concat("url", F.lit("#sitemap")).alias("url"), F.lit(0).alias("pos"))
    return L.with_fallback(hits, fallback).withColumnRenamed("company_id", "page_id")
