"""Labels against a closed taxonomy, their inputs, and the second-tier rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The taxonomy.
TAXONOMY: dict[str, tuple[str, ...]] = {
    "domain": (
        "ai_ml", "quantum_derin_tek", "web_saas", "gomulu", "siber_guvenlik", "fintech", "savunma_havacilik",
        "robotik_otonom", "oyun", "veri_muhendisligi", "bulut_devops", "saglik_bio", "eticaret", "danismanlik",
    ),
    "size_bucket": ("mikro", "kucuk", "orta", "buyuk", "kurumsal"),
    "sector": ("urun", "b2b_saas", "danismanlik", "arastirma", "kamu", "savunma"),
}
MAX_HINT = 80
SECOND_TIER_BELOW = 0.6


def taxonomy_df(spark: SparkSession) -> DataFrame:
    """(dimension, label): a fixed handful of rows."""
    return spark.createDataFrame([(d, x) for d, labels in TAXONOMY.items() for x in labels], "dimension string, label string")


def clean_hint(c: Column) -> Column:
    return F.when(F.length(c).between(1, MAX_HINT), c)


def directory_hint(labels: DataFrame) -> DataFrame:
    """(company_id, hint): the shortest directory sector, ties by label."""
    own = labels.where("dimension = 'directory_sector'")
    return own.groupBy("company_id").agg(F.min_by("label", F.struct(F.length("label"), "label")).alias("hint"))


def validate_labels(df: DataFrame, taxonomy: dict[str, Iterable[str]] = TAXONOMY) -> DataFrame:
    """`df` (domain array, size_bucket, sector, stack array) with labels of the closed sets only.

    domain keeps order and repeats; stack is free; `rejected` lists what was dropped.
    """
    ok = {k: F.array(*map(F.lit, v)) for k, v in taxonomy.items()}
    inside = lambda k, c: F.array_contains(ok[k], c)
    domain = F.coalesce("domain", F.array().cast("array<string>"))
    single = lambda k: F.when(inside(k, F.col(k)), F.col(k))
    rejected = F.concat(F.filter(domain, lambda x: ~inside("domain", x)), F.filter(F.array(*(F.when(~inside(k, F.col(k)), F.col(k)) for k in ("size_bucket", "sector"))), lambda x: x.isNotNull()))
    return df.withColumns({"rejected": rejected, "domain": F.filter(domain, lambda x: inside("domain", x)), "size_bucket": single("size_bucket"), "sector": single("sector")})


def last_wins(results: DataFrame, by: str = "seq") -> DataFrame:
    """The latest line of each company."""
    rn = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc(by)))
    return results.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def needs_second_tier(first: DataFrame, below: float = SECOND_TIER_BELOW) -> DataFrame:
    return first.where(F.col("confidence") < below)


def merge_tiers(first: DataFrame, second: DataFrame, needs: DataFrame) -> DataFrame:
    """First-tier results, replaced by the second tier's where `needs` (company_id) asks and a result exists."""
    asked = second.join(needs.select("company_id").distinct(), "company_id", "left_semi")
    return first.join(asked.select("company_id"), "company_id", "left_anti").unionByName(asked, allowMissingColumns=True)


def label_rows(results: DataFrame) -> DataFrame:
    """(company_id, dimension, label, confidence, evidence_url, model): domain and stack labels exploded; blanks go."""
    parts = F.concat(F.transform("domain", lambda x: F.struct(F.lit("domain").alias("dimension"), x.alias("label"))), F.transform(F.coalesce("stack", F.array().cast("array<string>")), lambda x: F.struct(F.lit("stack").alias("dimension"), x.alias("label"))))
    seq = ["seq"] if "seq" in results.columns else []
    rows = results.select("company_id", F.explode(parts).alias("p"), "confidence", F.col("page_url").alias("evidence_url"), "model", *seq)
    return rows.select("company_id", "p.dimension", F.trim("p.label").alias("label"), "confidence", "evidence_url", "model", *seq).where("label != ''")


def add_labels(state: DataFrame, new: DataFrame, run_ts: Column) -> DataFrame:
    """Insert, or refresh confidence and as_of; evidence_url and model of the first write stay.

    Rows of one label come in the order of `seq` where `new` has it; ties go by their values, so no result depends on the shuffle.
    """
    keys = ["company_id", "dimension", "label"]
    order = F.struct(*(["seq"] if "seq" in new.columns else []), "confidence", "evidence_url", "model")
    n = new.groupBy(*keys).agg(
        F.max_by("confidence", order).alias("_confidence"), F.min_by("evidence_url", order).alias("_url"), F.min_by("model", order).alias("_model"), F.lit(True).alias("_new")
    )
    j = state.withColumn("_old", F.lit(True)).join(n, keys, "full")
    pick = lambda old, x: F.when(F.col("_old"), F.col(old)).otherwise(F.col(x)).alias(old)
    return j.select(
        *keys, F.when(F.col("_new"), F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"), pick("evidence_url", "_url"), pick("model", "_model"),
        F.when(F.col("_new"), run_ts).otherwise(F.col("as_of")).alias("as_of"),
    )


def save_classification(companies: DataFrame, results: DataFrame, run_ts: Column) -> DataFrame:
    """Size and sector fill only where empty; the checkpoint moves even without labels."""
    r = results.select(F.col("company_id").alias("id"), F.col("size_bucket").alias("_size"), F.col("sector").alias("_sector"), F.lit(True).alias("_r"))
    j = companies.join(r, "id", "left")
    return j.withColumns({"size_bucket": F.coalesce("size_bucket", "_size"), "sector": F.coalesce("sector", "_sector"), "classify_checked_at": F.when(F.col("_r"), run_ts).otherwise(F.col("classify_checked_at"))}).select(*companies.columns)


def checkpoint(companies: DataFrame, tried: DataFrame, stage: str, run_ts: Column) -> DataFrame:
    """Stamp the stage for every company of `tried` (company_id), found something or not."""
    t = tried.select(F.col("company_id").alias("id"), F.lit(True).alias("_t")).distinct()
    c = f"{stage}_checked_at"
    return companies.join(t, "id", "left").withColumn(c, F.when(F.col("_t"), run_ts).otherwise(F.col(c))).select(*companies.columns)


def assemble_pages(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(company_id, body): a company's page texts in order, each under its address; text-free pages and companies go."""
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    some = pages.where(F.trim("text") != "").select("company_id", F.struct("pos", F.concat(F.lit("=== "), "url", F.lit(" ===\n"), text).alias("part")).alias("p"))
    return some.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "\n\n").alias("body"))


def label_companies(results: DataFrame, state: DataFrame, companies: DataFrame, run_ts: Column, second: DataFrame | None = None, taxonomy: dict[str, Iterable[str]] = TAXONOMY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, companies, rejected): result lines validated, tiers merged, labels upserted, sizes and sectors filled.

    results and second: (company_id, seq, domain, size_bucket, sector, stack, confidence, page_url, model).
    """
    first = validate_labels(last_wins(results), taxonomy)
    best = first if second is None else merge_tiers(first, validate_labels(last_wins(second), taxonomy), needs_second_tier(first))
    rejected = best.where(F.size("rejected") > 0).select("company_id", F.explode("rejected").alias("label"))
    return add_labels(state, label_rows(best), run_ts), save_classification(companies, best, run_ts), rejected
