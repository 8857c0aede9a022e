"""Catalogue queries: filters, sorts, pages, facets, counters, nested details, export rows.

Tables: companies (one row per company), company_labels (company_id, dimension, label),
company_sources (company_id, source_key, ...), sources (key, name, ...), contacts, jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.text import fold
from firmlens.operators.paging import by, page_after
from firmlens.sources.shared import stored

USER_STATUSES = ("listemde", "yazdim", "cevap_geldi", "ilgilenmiyorum")
#: Sector facets shown.
TOP_SECTORS = 60
PAGE_SIZE, MAX_PAGE_SIZE = 50, 200



def flags() -> dict[str, Column]:
    c = F.col
    return {
        "has_domain": c("domain").isNotNull(),
        "has_careers": c("careers_url").isNotNull(),
        "has_jobs": c("open_jobs_count") > 0,
        "has_internship": c("has_internship"),
        "has_email": c("email_count") > 0,
        "has_hr_email": c("hr_email_count") > 0,
    }


def filter_companies(
    companies: DataFrame, labels: DataFrame | None = None, links: DataFrame | None = None, *, q: str | None = None, city: str | None = None,
    source: str | None = None, sector: str | None = None, category: Sequence[str] | None = None, status: str | None = None, **wanted: bool | None,
) -> DataFrame:
    """All conditions joined by AND; category is any of its list. A search text is matched literally, folded."""
    df = companies
    if q:
        df = df.where(F.col("name_norm").contains(fold(F.lit(q))))
    if city:
        df = df.where(F.col("city") == city)
    if status:
        df = df.where(F.col("user_status") == status)
    if source:
        df = df.join(links.where(F.col("source_key") == source).select(F.col("company_id").alias("id")), "id", "left_semi")
    if sector:
        df = df.join(labels.where((F.col("dimension") == "directory_sector") & (F.col("label") == sector)).select(F.col("company_id").alias("id")), "id", "left_semi")
    if category:
        df = df.join(labels.where((F.col("dimension") == "domain") & F.col("label").isin(*category)).select(F.col("company_id").alias("id")), "id", "left_semi")
    for name, value in wanted.items():
        if value is not None:
            df = df.where(flags()[name] if value else ~flags()[name])
    return df


#: Sorts of the list as (column, ascending); ties go by id.
SORTS = {
    "name": [("name_norm", True), ("id", True)],
    "jobs": [("open_jobs_count", False), ("name_norm", True), ("id", True)],
    "newest": [("first_seen", False), ("id", False)],
    "contacts": [("hr_email_count", False), ("email_count", False), ("name_norm", True), ("id", True)],
}


def page(df: DataFrame, order: str = "name", number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a sorted list by number; sizes are clipped to 1..MAX_PAGE_SIZE. The limit is the feature.

    The rows before it pass one task: deep pages are for `paging.page_after` and `paging.page_at`.
    """
    size = max(1, min(size, MAX_PAGE_SIZE))
    return df.orderBy(*by(SORTS[order])).offset((max(number, 1) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """(total, pages): one row."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def named_sources(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Links with the source's name, or its key where it has none."""
    names = sources.select(F.col("key").alias("source_key"), F.col("name").alias("_name"))
    return links.join(names, "source_key", "left").withColumn("source_name", F.coalesce("_name", "source_key")).drop("_name")


def label_arrays(labels: DataFrame, links: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, categories, sectors) and (id, sources): sorted arrays per company."""
    per = labels.groupBy(F.col("company_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("dimension") == "domain", F.col("label")))).alias("categories"),
        F.array_sort(F.collect_list(F.when(F.col("dimension") == "directory_sector", F.col("label")))).alias("sectors"),
    )
    named = named_sources(links, sources).groupBy(F.col("company_id").alias("id")).agg(F.array_sort(F.collect_list("source_name")).alias("sources"))
    return per, named


LIST_COLUMNS = (
    "id", "name", "domain", "city", "website", "careers_url", "summary", "size_bucket", "sector", "categories", "sectors", "sources",
    "open_jobs_count", "has_internship", "email_count", "hr_email_count", "detect_status", "user_status", "first_seen",
)


def with_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Additive schema: columns that an older snapshot lacks come as nulls."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def list_items(companies: DataFrame, labels: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """The list's 19 columns; companies without labels or sources have empty arrays."""
    per, named = label_arrays(labels, links, sources)
    df = companies.drop("categories", "sectors", "sources").join(per, "id", "left").join(named, "id", "left")
    empty = F.array().cast("array<string>")
    df = df.withColumns({c: F.coalesce(c, empty) for c in ("categories", "sectors", "sources")}).withColumn("has_internship", F.coalesce(F.col("has_internship").cast("boolean"), F.lit(False)))
    return with_columns(df, LIST_COLUMNS).select(*LIST_COLUMNS)


def catalog_list(companies: DataFrame, labels: DataFrame, links: DataFrame, sources: DataFrame, order: str = "name", number: int = 1, size: int = PAGE_SIZE, cursor: Sequence | None = None, **filters) -> DataFrame:
    """One page of filtered companies, by number or behind a cursor (values of the sort's columns), decorated after the page is cut."""
    found = filter_companies(companies, labels, links, **filters)
    cut = page(found, order, number, size) if cursor is None else page_after(found, SORTS[order], cursor, max(1, min(size, MAX_PAGE_SIZE)))
    cut = stored(cut, "page")
    ids = F.broadcast(cut.select(F.col("id").alias("company_id")))  # MAX_PAGE_SIZE rows at most
    return list_items(cut, labels.join(ids, "company_id", "left_semi"), links.join(ids, "company_id", "left_semi"), sources)


def contact_rank(kind: Column) -> Column:
    return F.when(kind == "hr", 0).when(kind == "executive", 1).otherwise(2)


def catalog_detail(ids: DataFrame, companies: DataFrame, labels: DataFrame, links: DataFrame, sources: DataFrame, contacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """List items of `ids` (id) with arrays source_refs, contacts and jobs; unknown ids give no row.

    Contacts go hr, executive, others, then by e-mail; active jobs go internships first, then by title.
    """
    some = lambda df: df.join(ids.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    refs = named_sources(some(links), sources).groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("source_name", "listed_url"))).alias("source_refs"))
    people = some(contacts).groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.struct(contact_rank(F.col("contact_type")).alias("rank"), "email", "name", "contact_type", "source_url"))).alias("contacts")
    )
    open_ = some(jobs).where("is_active").groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.struct((~F.col("is_internship")).cast("int").alias("rank"), "title", "location", "url"))).alias("jobs")
    )
    items = list_items(companies.join(ids.select("id"), "id", "left_semi"), some(labels), some(links), sources)
    for part in (refs, people, open_):
        items = items.join(part.withColumnRenamed("company_id", "id"), "id", "left")
    return items


def facets(companies: DataFrame, labels: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """(facet, value, label, count): cities, statuses, sources, categories, and the TOP_SECTORS sectors. Empty values don't show."""
    grain = companies.select(F.explode(F.array(F.struct(F.lit("city").alias("facet"), F.col("city").alias("value")), F.struct(F.lit("status").alias("facet"), F.col("user_status").alias("value")))).alias("x"))
    own = grain.select("x.*").groupBy("facet", "value").agg(F.count("*").alias("count")).withColumn("label", F.col("value"))
    by_source = named_sources(links, sources).groupBy(F.col("source_key").alias("value"), F.col("source_name").alias("label")).agg(F.count_distinct("company_id").alias("count")).withColumn("facet", F.lit("source"))
    by_label = labels.where(F.col("dimension").isin("domain", "directory_sector")).groupBy("dimension", F.col("label").alias("value")).agg(F.count("*").alias("count"))
    categories = by_label.where("dimension = 'domain'").withColumn("facet", F.lit("category")).withColumn("label", F.col("value"))
    sectors = by_label.where("dimension = 'directory_sector'").orderBy(F.desc("count"), "value").limit(TOP_SECTORS).withColumn("facet", F.lit("sector")).withColumn("label", F.col("value"))
    columns = ["facet", "value", "label", "count"]
    out = own.select(columns)
    for part in (by_source, categories, sectors):
        out = out.unionByName(part.select(columns))
    return out.where("value is not null and value != ''")


def catalog_stats(companies: DataFrame, contacts: DataFrame, jobs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of counters, one pass per table."""
    c = F.col
    a = companies.agg(
        F.count("*").alias("companies"), F.count("domain").alias("with_domain"), F.count("careers_url").alias("with_careers"), F.count("ats_provider").alias("with_ats"),
        F.count_if(c("open_jobs_count") > 0).alias("with_jobs"), F.count_if(c("has_internship")).alias("with_internship"),
        F.count_if(c("email_count") > 0).alias("with_email"), F.count_if(c("hr_email_count") > 0).alias("with_hr_email"),
    )
    b = contacts.agg(F.count("*").alias("contacts"))
    d = jobs.agg(F.count_if("is_active").alias("active_jobs"), F.count_if(c("is_active") & c("is_internship")).alias("internships"))
    e = labels.where("dimension = 'domain'").agg(F.count_distinct("company_id").alias("labelled"))
    return a.crossJoin(b).crossJoin(d).crossJoin(e)  # one row each


def share(value: Column, total: Column, rounded: bool = False) -> Column:
    """Integer percent of a total of at least 1, cut off or rounded."""
    x = value * 100 / F.greatest(total, F.lit(1))
    return (F.round(x) if rounded else F.floor(x)).cast("long")


def source_report(sources: DataFrame) -> DataFrame:
    """Sources by kind and key with health: `kapalı` where disabled, else the recorded one or `-`."""
    return sources.withColumn("status", source_health(F.col("enabled"), F.col("health"))).orderBy("kind", "key")


def source_health(enabled: Column, health: Column) -> Column:
    return F.when(~enabled, "kapalı").otherwise(F.coalesce(health, F.lit("-")))


def exclusive_to_sources(companies: DataFrame, links: DataFrame, keys: Sequence[str], city: str | None = None) -> DataFrame:
    """Companies that no source outside `keys` lists; those without any source too."""
    elsewhere = links.where(~F.col("source_key").isin(*keys)).select(F.col("company_id").alias("id"))
    out = companies.join(elsewhere, "id", "left_anti")
    return out if city is None else out.where(F.col("city") == city)


def prune(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Companies of `gone` (id) leave with their child rows: an anti join on each table."""
    return {n: df.join(gone.select(F.col("id").alias("id" if n == "companies" else "company_id")), "id" if n == "companies" else "company_id", "left_anti") for n, df in tables.items()}


def companies_needing(companies: DataFrame, stage: str, limit: int | None = None, only_with_domain: bool = True, recheck: bool = False) -> DataFrame:
    """Companies without the stage's checkpoint, by id; recheck takes all. A limit is the batch size asked for."""
    df = companies if recheck else companies.where(F.col(f"{stage}_checked_at").isNull())
    if only_with_domain or recheck:
        df = df.where("domain is not null")
    if stage == "jobs":
        df = df.where("ats_provider is not null")
    df = df.orderBy("id")
    return df.limit(limit) if limit else df


def job_counters(jobs: DataFrame) -> DataFrame:
    """(company_id, open_jobs_count, has_internship) of active jobs, a row per company with any job."""
    return jobs.groupBy("company_id").agg(F.count_if("is_active").alias("open_jobs_count"), F.coalesce(F.max(F.col("is_active") & F.col("is_internship")), F.lit(False)).alias("has_internship"))


def email_counters(contacts: DataFrame) -> DataFrame:
    """(company_id, email_count, hr_email_count): distinct addresses, and those of type hr."""
    return contacts.groupBy("company_id").agg(F.count_distinct("email").alias("email_count"), F.count_distinct(F.when(F.col("contact_type") == "hr", F.col("email"))).alias("hr_email_count"))


def annotate(companies: DataFrame, patches: DataFrame, run_ts: Column) -> DataFrame:
    """Apply user patches (id, user_status, user_note): null keeps, an empty string clears; unknown statuses are an error."""
    p = patches.select("id", F.col("user_status").alias("_s"), F.col("user_note").alias("_n"), F.lit(True).alias("_p"))
    bad = F.col("_s").isNotNull() & (F.col("_s") != "") & ~F.col("_s").isin(*USER_STATUSES)
    new = lambda old, x: F.when(x.isNull(), old).otherwise(F.nullif(x, F.lit("")))
    df = companies.join(p, "id", "left")
    return df.withColumns({
        "user_status": F.when(bad, F.raise_error(F.concat(F.lit("unknown status "), F.col("_s"))).cast("string")).otherwise(new(F.col("user_status"), F.col("_s"))),
        "user_note": new(F.col("user_note"), F.col("_n")),
        "user_updated_at": F.when(F.col("_p"), run_ts).otherwise(F.col("user_updated_at")),
    }).drop("_s", "_n", "_p")


def display_labels(categories: Column, sectors: Column) -> Column:
    """The first three categories, or where there are none the first two directory sectors."""
    return F.when(F.size(categories) > 0, F.slice(categories, 1, 3)).otherwise(F.slice(sectors, 1, 2))


def badges() -> Column:
    c = F.col
    found = F.array(
        F.when(c("hr_email_count") > 0, F.lit("hr-mail")).when(c("email_count") > 0, "mail"), F.when(c("has_internship"), F.lit("internship")), F.when(c("domain").isNull(), F.lit("no-domain"))
    )
    return F.filter(found, lambda x: x.isNotNull())


EXPORT_COLUMNS = ("name", "domain", "city", "website", "careers_url", "categories", "sectors", "sources", "open_jobs_count", "internship", "email_count", "hr_email_count")


def export_rows(items: DataFrame) -> DataFrame:
    """The export's 12 columns: arrays joined by a comma, the flag as `evet` or empty."""
    join = lambda c: F.array_join(F.col(c), ", ").alias(c)
    return items.select(
        "name", "domain", "city", "website", "careers_url", join("categories"), join("sectors"), join("sources"),
        "open_jobs_count", F.when(F.col("has_internship"), "evet").otherwise("").alias("internship"), "email_count", "hr_email_count",
    )
