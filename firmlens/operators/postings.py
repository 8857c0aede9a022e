"""Job boards: provider signatures, payload parsing, verification, snapshot diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlens.functions import text as T
from firmlens.operators import links as L
from firmlens.sources.shared import stored

#: Fixed values, provider by provider in order of precedence: signature patterns, API address, posting address.
PROVIDERS: dict[str, dict] = {
    "greenhouse": {
        "patterns": [r"boards\.greenhouse\.io/embed/job_board\?for=([A-Za-z0-9_-]+)", r"(?:job-)?boards\.greenhouse\.io/([A-Za-z0-9_-]+)", r"greenhouse\.io/v1/boards/([A-Za-z0-9_-]+)"],
        "api": "https://boards-api.greenhouse.io/v1/boards/{slug}/jobs", "job": None,
    },
    "lever": {
        "patterns": [r"jobs\.(?:eu\.)?lever\.co/([A-Za-z0-9_-]+)", r"api\.lever\.co/v0/postings/([A-Za-z0-9_-]+)"],
        "api": "https://api.lever.co/v0/postings/{slug}?mode=json", "job": None,
    },
    "ashby": {
        "patterns": [r"jobs\.ashbyhq\.com/([A-Za-z0-9_.-]+)", r"api\.ashbyhq\.com/posting-api/job-board/([A-Za-z0-9_.-]+)"],
        "api": "https://api.ashbyhq.com/posting-api/job-board/{slug}", "job": None,
    },
    "workable": {
        "patterns": [r"apply\.workable\.com/([A-Za-z0-9_-]+)", r"([A-Za-z0-9_-]+)\.workable\.com"],
        "api": "https://apply.workable.com/api/v1/widget/accounts/{slug}?details=true", "job": "https://apply.workable.com/{slug}/j/{id}/",
    },
    "recruitee": {"patterns": [r"([A-Za-z0-9_-]+)\.recruitee\.com"], "api": "https://{slug}.recruitee.com/api/offers/", "job": None},
    "smartrecruiters": {
        "patterns": [r"(?:careers|jobs)\.smartrecruiters\.com/([A-Za-z0-9_-]+)", r"api\.smartrecruiters\.com/v1/companies/([A-Za-z0-9_-]+)"],
        "api": "https://api.smartrecruiters.com/v1/companies/{slug}/postings?limit=100", "job": "https://jobs.smartrecruiters.com/{slug}/{id}",
    },
    "breezy": {"patterns": [r"([A-Za-z0-9_-]+)\.breezy\.hr"], "api": "https://{slug}.breezy.hr/json", "job": None},
    "personio": {
        "patterns": [r"([A-Za-z0-9_-]+)\.jobs\.personio\.(?:de|com)"],
        "api": "https://{slug}.jobs.personio.de/xml", "job": "https://{slug}.jobs.personio.de/job/{id}",
    },
}
#: Words of board addresses that name no company.
NO_SLUGS = ("embed", "job", "jobs", "board", "boards", "api", "www", "search", "widget", "company", "companies", "static", "assets", "images", "v1", "en", "tr")

_ID = "id string"
#: Payload schemas. A list payload is an array; the others hold one under a key.
SCHEMAS: dict[str, tuple[str | None, str]] = {
    "greenhouse": ("jobs", f"{_ID}, title string, location struct<name string>, absolute_url string, updated_at string"),
    "lever": (None, f"{_ID}, text string, categories struct<location string>, hostedUrl string, createdAt string"),
    "ashby": ("jobs", f"{_ID}, title string, location string, jobUrl string, applyUrl string, publishedAt string, isRemote boolean"),
    "workable": ("jobs", f"{_ID}, shortcode string, title string, city string, country string, url string, published_on string, telecommuting boolean"),
    "recruitee": ("offers", f"{_ID}, title string, location string, careers_url string, careers_apply_url string, published_at string, remote boolean"),
    "smartrecruiters": ("content", f"{_ID}, name string, location struct<city string, country string, remote boolean>, releasedDate string"),
    "breezy": (None, f"{_ID}, _id string, name string, location string, url string, published_date string"),
    "personio": ("position", f"{_ID}, name string, office string, createdAt string"),
}
#: Provider -> expressions over item `x`: external_id, title, location, url, posted_at, remote.
_PLACE = "nullif(array_join(filter(array(nullif(trim({0}), ''), nullif(trim({1}), '')), p -> p is not null), ', '), '')"
FIELDS: dict[str, tuple[str, ...]] = {
    "greenhouse": ("x.id", "x.title", "x.location.name", "x.absolute_url", "x.updated_at", "cast(null as boolean)"),
    "lever": ("x.id", "x.text", "x.categories.location", "x.hostedUrl", "cast(timestamp_millis(try_cast(x.createdAt as bigint)) as string)", "lower(coalesce(x.categories.location, '')) like '%remote%'"),
    "ashby": ("x.id", "x.title", "x.location", "coalesce(nullif(x.jobUrl, ''), x.applyUrl)", "x.publishedAt", "coalesce(x.isRemote, false)"),
    "workable": ("coalesce(x.shortcode, x.id, '')", "x.title", _PLACE.format("x.city", "x.country"), "x.url", "x.published_on", "coalesce(x.telecommuting, false)"),
    "recruitee": ("x.id", "x.title", "x.location", "coalesce(nullif(x.careers_url, ''), x.careers_apply_url)", "x.published_at", "coalesce(x.remote, false)"),
    "smartrecruiters": ("x.id", "x.name", _PLACE.format("x.location.city", "x.location.country"), "cast(null as string)", "x.releasedDate", "coalesce(x.location.remote, false)"),
    "breezy": ("coalesce(x.id, x._id, '')", "x.name", "coalesce(get_json_object(x.location, '$.city'), if(x.location like '{%', null, x.location))", "x.url", "x.published_date", "cast(null as boolean)"),
    "personio": ("x.id", "x.name", "x.office", "cast(null as string)", "x.createdAt", "cast(null as boolean)"),
}
POSTING = ("external_id", "title", "location", "url", "posted_at", "remote")


def template_df(spark: SparkSession) -> DataFrame:
    """(provider, api, job, precedence): eight rows."""
    return spark.createDataFrame([(k, p["api"], p["job"], i) for i, (k, p) in enumerate(PROVIDERS.items())], "provider string, api string, job string, precedence int")


def ats_job_url(provider: Column, slug: Column, external_id: Column | None = None) -> Column:
    """The provider's API address, or with an id its posting address where it has one."""
    out = F.lit(None).cast("string")
    for key, p in PROVIDERS.items():
        template = p["api"] if external_id is None else p["job"]
        if template:
            url = F.replace(F.lit(template), F.lit("{slug}"), slug)
            out = F.when(provider == key, url if external_id is None else F.replace(url, F.lit("{id}"), external_id)).otherwise(out)
    return out


def signatures(html: Column) -> Column:
    """The first (provider, slug) whose pattern is in the text and whose slug names a company; else null."""
    out = []
    for key, p in PROVIDERS.items():
        for pattern in p["patterns"]:
            slugs = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)" + pattern), 1), lambda s: F.lower(F.btrim(s, F.lit("/"))))
            good = F.filter(slugs, lambda s: (F.length(s) > 1) & ~s.isin(*NO_SLUGS))
            out.append(F.when(F.size(good) > 0, F.struct(F.lit(key).alias("provider"), F.get(good, F.lit(0)).alias("slug"))))
    return F.coalesce(*out)


def items(body: Column, provider: str) -> Column:
    """A payload's postings as an array; null where the body is missing, broken or of another shape."""
    key, fields = SCHEMAS[provider]
    if provider == "personio":
        x = F.from_xml(body, f"position array<struct<{_ddl(fields)}>>, _broken string", {"columnNameOfCorruptRecord": "_broken"})
        none = F.array().cast(f"array<struct<{_ddl(fields)}>>")
        return F.when(F.trim(body).startswith("<") & x["_broken"].isNull(), F.coalesce(x["position"], none))
    if key is None:
        return F.when(F.trim(body).startswith("["), F.from_json(body, f"array<struct<{_ddl(fields)}>>"))
    return F.when(F.trim(body).startswith("{"), F.from_json(body, f"struct<{key}: array<struct<{_ddl(fields)}>>>")[key])


def _ddl(fields: str) -> str:
    """Top-level `name type` pairs as `name: type`; nested types keep theirs."""
    out, depth = [], 0
    for part in fields.replace("struct<", "struct< ").split(","):
        words = part.strip().split(" ", 1)
        out.append(part if depth else f"{words[0]}: {words[1]}")
        depth += part.count("<") - part.count(">")
    return ", ".join(out).replace("struct< ", "struct<")


def parse_job_payloads(payloads: DataFrame, provider: str) -> DataFrame:
    """`payloads` (company_id, provider, slug, body) of one provider: a row per titled posting, with `valid`.

    A payload without postings gives one row with a null title: valid true is an empty
    board, false an unreachable or wrong one.
    """
    rows = payloads.where(F.col("provider") == provider).withColumn("items", items(F.col("body"), provider))
    rows = rows.withColumn("valid", F.col("items").isNotNull()).select("company_id", "provider", "slug", "valid", F.explode_outer("items").alias("x"))
    fields = [F.expr(e).cast("boolean" if n == "remote" else "string").alias(n) for n, e in zip(POSTING, FIELDS[provider], strict=True)]
    out = rows.select("company_id", "provider", "slug", "valid", *fields)
    out = out.withColumns({n: T.clean(F.col(n)) for n in ("external_id", "title", "location", "posted_at")})
    return out.withColumn("url", F.coalesce(F.nullif("url", F.lit("")), ats_job_url(F.col("provider"), F.col("slug"), F.coalesce("external_id", F.lit("")))))


def parse_all(payloads: DataFrame) -> DataFrame:
    """The union of all providers' postings."""
    out = None
    for provider in PROVIDERS:
        part = parse_job_payloads(payloads, provider)
        out = part if out is None else out.unionByName(part)
    return out


def snapshot(parsed: DataFrame) -> DataFrame:
    """Titled postings with fingerprint and is_internship, one row per fingerprint."""
    df = parsed.where("title is not null").withColumns({"fingerprint": T.job_fingerprint(F.col("company_id"), F.col("title"), F.col("location")), "is_internship": T.is_internship(F.col("title"))})
    rn = F.row_number().over(Window.partitionBy("fingerprint").orderBy("external_id", "url"))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn", "valid", "provider", "slug")


def verify_ats(found: DataFrame, parsed: DataFrame) -> DataFrame:
    """`found` (company_id, provider, slug) with n_jobs: null where the payload is missing or wrong, 0 for an empty board."""
    counts = parsed.groupBy("company_id", "provider", "slug").agg(F.max("valid").alias("_valid"), F.count("title").alias("_n"))
    joined = found.join(counts.hint("shuffle_merge"), ["company_id", "provider", "slug"], "left")
    return joined.withColumn("n_jobs", F.when(F.col("_valid"), F.col("_n"))).drop("_valid", "_n")


def job_diff(state: DataFrame, new: DataFrame) -> DataFrame:
    """(fingerprint, company_id, change): added, kept, closed, reopened or gone, by a full outer join."""
    s = state.select("fingerprint", F.col("company_id").alias("_c"), F.col("is_active").alias("_a"))
    n = new.select("fingerprint", "company_id")
    change = (
        F.when(F.col("_c").isNull(), "added").when(F.col("company_id").isNull() & F.col("_a"), "closed").when(F.col("company_id").isNull(), "gone")
        .when(F.col("_a"), "kept").otherwise("reopened")
    )
    return s.join(n, "fingerprint", "full").select("fingerprint", F.coalesce("company_id", "_c").alias("company_id"), change.alias("change"))


def sync_jobs(state: DataFrame, new: DataFrame, checked: DataFrame, run_ts: Column) -> DataFrame:
    """The job table after a snapshot: inserts, refreshes, and closes what companies of `checked` (company_id) no longer list.

    Companies whose board was unreachable are not in `checked`; their jobs stay as they are.
    """
    n = new.select("fingerprint", *(F.col(c).alias(f"_{c}") for c in ("company_id", "external_id", "title", "location", "remote", "is_internship", "url", "posted_at")))
    done = checked.select(F.col("company_id").alias("_checked")).distinct()
    j = state.join(n, "fingerprint", "full").join(done, F.col("company_id") == F.col("_checked"), "left")
    seen = F.col("_company_id").isNotNull()
    old = lambda c: F.coalesce(c, f"_{c}").alias(c)
    return j.select(
        "fingerprint", *(old(c) for c in ("company_id", "external_id", "title", "location", "remote", "is_internship", "posted_at")), F.coalesce("_url", "url").alias("url"),
        F.coalesce("first_seen", run_ts).alias("first_seen"), F.when(seen, run_ts).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(seen, True).when(F.col("_checked").isNotNull(), False).otherwise(F.col("is_active")).alias("is_active"),
    )


def detect_status() -> Column:
    """ats > blocked > protected > error > careers > none, over provider, outcome and careers_url."""
    c = F.col
    return (
        F.when(c("ats_provider").isNotNull(), "ats").when(c("outcome") == "blocked", "blocked").when(c("outcome") == "protected", "protected")
        .when(c("outcome") != "ok", "error").when(c("careers_url").isNotNull(), "careers").otherwise("none")
    )


def detect_careers(companies: DataFrame, pages: DataFrame, payloads: DataFrame, sitemaps: DataFrame | None = None, limit: int = L.CAREER_PAGES) -> DataFrame:
    """(company_id, careers_url, ats_provider, ats_slug, detect_status, detect_note, pages_ok), a row per company.

    Careers page: the first readable candidate. Signature: the home page's, else that of
    the first candidate with one; it counts only if its payload is valid.
    """
    home = stored(L.home_pages(companies, pages, careers=True), "homes")
    alive = home.where("outcome = 'ok'")
    external = L.known_career_host(F.col("link"), signatures(F.col("link")).isNotNull())
    hits = L.keyword_links(alive.select("company_id", "domain", "url", "body"), L.CAREER_KEYWORDS, external).select("company_id", "url", "pos")
    if sitemaps is not None:
        hits = L.with_fallback(hits, L.sitemap_urls(sitemaps, L.CAREER_KEYWORDS))
    ranked = L.ranked_candidates([hits, L.probe_paths(alive, L.CAREER_PATHS)], limit)
    read = L.with_bodies(stored(ranked, "candidates"), pages).select("company_id", "url", "rn", "body").unionByName(alive.select("company_id", "url", F.lit(0).alias("rn"), "body"))
    signed = stored(read.select("company_id", "url", "rn", signatures(F.col("body")).alias("s")), "signatures")
    facts = signed.groupBy("company_id").agg(
        F.min_by("url", F.when(F.col("rn") > 0, F.col("rn"))).alias("careers_url"), F.min_by("s", F.when(F.col("s").isNotNull(), F.col("rn"))).alias("s"), F.count("*").alias("pages_ok")
    )
    found = facts.where("s is not null").select("company_id", "s.provider", "s.slug")
    checked = verify_ats(found, parse_all(payloads))
    df = home.select("company_id", "outcome").join(facts.drop("s").hint("shuffle_merge"), "company_id", "left").join(checked.hint("shuffle_merge"), "company_id", "left")
    df = df.withColumns({"ats_provider": F.when(F.col("n_jobs").isNotNull(), F.col("provider")), "ats_slug": F.when(F.col("n_jobs").isNotNull(), F.col("slug"))})
    note = F.when(F.col("provider").isNotNull() & F.col("n_jobs").isNull(), F.concat("provider", F.lit(":"), "slug", F.lit(" doğrulanamadı"))).when(F.col("outcome") != "ok", F.col("outcome"))
    return df.select("company_id", "careers_url", "ats_provider", "ats_slug", detect_status().alias("detect_status"), note.alias("detect_note"), F.coalesce("pages_ok", F.lit(0)).alias("pages_ok"))


def save_detection(companies: DataFrame, found: DataFrame, run_ts: Column) -> DataFrame:
    """A new careers_url wins over an old one; provider, slug, status and note are replaced, with nulls too."""
    names = ("careers_url", "ats_provider", "ats_slug", "detect_status", "detect_note")
    f = found.select(F.col("company_id").alias("id"), *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_f"))
    j = companies.join(f, "id", "left")
    put = {c: F.when(F.col("_f"), F.col(f"_{c}")).otherwise(F.col(c)) for c in names[1:]}
    return j.withColumns(put | {"careers_url": F.coalesce("_careers_url", "careers_url"), "detect_checked_at": F.when(F.col("_f"), run_ts).otherwise(F.col("detect_checked_at"))}).select(*companies.columns)
