"""Contacts: e-mails and phones of a company's own pages, and the contact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import text as T
from firmlens.operators import links as L
from firmlens.sources.shared import stored

CONTACT_COLUMNS = "company_id long, name string, role string, email string, phone string, contact_type string, source_url string, extraction_method string, confidence double"


def page_contacts(pages: DataFrame) -> DataFrame:
    """(company_id, email, phone, source_url, pos): addresses of each page (company_id, domain, url, body).

    mailto: links come first; only addresses of the company's own domain stay where a
    domain is known; the page's phone goes to its first address only.
    """
    kept = F.filter(T.page_emails(F.col("body")), lambda e: F.col("domain").isNull() | T.own_domain_email(e, F.col("domain")))
    rows = pages.select("*", F.posexplode(kept).alias("pos", "email"))
    return rows.select(*[c for c in rows.columns if c not in ("body", "url", "pos", "email")], "email", F.when(F.col("pos") == 0, T.phone(F.col("body"))).alias("phone"), F.col("url").alias("source_url"), "pos")


def first_per_email(found: DataFrame) -> DataFrame:
    """The first occurrence of each address of a company, by page rank `rn` and place."""
    rn = F.row_number().over(Window.partitionBy("company_id", "email").orderBy("rn", "pos"))
    return found.withColumn("_first", rn).where("_first = 1").drop("_first")


def harvest_contacts(companies: DataFrame, pages: DataFrame, sitemaps: DataFrame | None = None, limit: int = L.CONTACT_PAGES) -> DataFrame:
    """(company_id, email, phone, contact_type, source_url, extraction_method) of the candidate pages.

    companies: (company_id, domain, website, careers_url); pages: (url, status, body,
    blocked_by_robots), a row per url, or a page store. Candidates: home, known careers page, keyword links (else the
    sitemap's), two-hop links of hubs, fixed paths; the first `limit` are read.
    """
    home = stored(L.home_pages(companies, pages).where("outcome = 'ok'"), "homes")
    hits = stored(L.keyword_links(home.select("company_id", "domain", "url", "body"), L.CONTACT_KEYWORDS).select("company_id", "url", "pos"), "links")
    if sitemaps is not None:
        hits = L.with_fallback(hits, L.sitemap_urls(sitemaps, L.CONTACT_KEYWORDS))
    alive = home.select("company_id", "domain")
    deeper = L.two_hop_links(hits.join(alive.hint("shuffle_merge"), "company_id"), pages, L.CONTACT_KEYWORDS)
    zero = F.lit(0).alias("pos")
    known = companies.where("careers_url is not null").join(alive.select("company_id").hint("shuffle_merge"), "company_id", "left_semi").select("company_id", F.col("careers_url").alias("url"), zero)
    pages_of = L.ranked_candidates([home.select("company_id", "url", zero), known, hits, deeper, L.probe_paths(alive, L.CONTACT_PATHS)], limit)
    read = L.with_bodies(stored(pages_of.join(alive.hint("shuffle_merge"), "company_id"), "candidates"), pages)
    found = first_per_email(page_contacts(read.select("company_id", "domain", "rn", "url", "body")))
    return found.select("company_id", "email", "phone", T.email_class(F.col("email")).alias("contact_type"), "source_url", F.lit("regex").alias("extraction_method"))


def valid_contacts(records: DataFrame) -> DataFrame:
    """Records that may be saved: lower-cased, with an e-mail or a name; a missing source_url is an error.

    The type defaults to the e-mail's class, `personal` becoming executive with a name and
    generic without; a record without e-mail is an executive.
    """
    email, name = F.nullif(F.lower(F.trim("email")), F.lit("")), F.nullif(F.trim("name"), F.lit(""))
    df = records.withColumns({"email": email, "name": name}).where("email is not null or name is not null")
    kind = F.coalesce(F.nullif(F.col("contact_type"), F.lit("")), F.when(F.col("email").isNotNull(), T.email_class(F.col("email"))).otherwise("executive"))
    kind = F.when(kind == "personal", F.when(F.col("name").isNotNull(), "executive").otherwise("generic")).otherwise(kind)
    url = F.when(F.nullif(F.col("source_url"), F.lit("")).isNull(), F.raise_error(F.lit("contact without source_url")).cast("string")).otherwise(F.col("source_url"))
    return df.withColumns({"contact_type": kind, "source_url": url})


def save_contacts(state: DataFrame, records: DataFrame) -> DataFrame:
    """`state` and the new valid records: one row per (company, email, name), nulls equal, older rows win."""
    new = valid_contacts(records)
    all_ = state.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    rn = F.row_number().over(Window.partitionBy("company_id", "email", "name").orderBy("_age", "source_url"))
    return all_.withColumn("_rn", rn).where("_rn = 1").drop("_rn", "_age")
