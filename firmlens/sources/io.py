"""Readers and writers: pages, seeds, results, batches, snapshots, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.operators.labels import assemble_pages

PAGES = "url string, status int, body string, from_cache boolean, blocked_by_robots boolean, insecure_tls boolean, error string, fetched_at timestamp"
SEEDS = "name string, website string, city string, listed_url string"
PEOPLE = (
    "company_id long, seq long, tier int, pages array<struct<url: string, text: string>>, "
    "people array<struct<name: string, role: string, email: string, contact_type: string, evidence_quote: string, confidence: double>>"
)
LABELS = (
    "company_id long, seq long, tier int, model string, page_url string, "
    "classification struct<domain: array<string>, size_bucket: string, sector: string, stack: array<string>, reasoning: string, confidence: double>"
)
SOURCES = (
    "key string, kind string, name string, list_url string, city string, mode string, item_selector string, name_selector string, name_attr string, "
    "website_selector string, sector_selector string, sector_attr string, detail_selector string, page_param string, max_pages int, enabled boolean, note string"
)
#: What a source's configuration leaves out.
SOURCE_DEFAULTS = {"mode": "structured", "website_selector": "a", "detail_selector": "a", "max_pages": 40, "enabled": True}
BOM = "﻿"


def source_config_df(spark: SparkSession, configs: list[dict]) -> DataFrame:
    """Directory configurations, one dict each, as a table; what they leave out takes its default."""
    names = [c.split()[0] for c in SOURCES.split(", ")]
    return spark.createDataFrame([tuple((SOURCE_DEFAULTS | c).get(n) for n in names) for c in configs], SOURCES)


def run_ts(spark: SparkSession):
    """One UTC time of second precision per run, as a literal."""
    return F.lit(spark.range(1).select(F.date_trunc("second", F.current_timestamp())).first()[0])


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(PAGES).format(format).load(path)


def read_seeds(spark: SparkSession, glob: str, format: str = "json") -> DataFrame:
    """Seed rows of all files that fit, JSON lines or CSV with a header; blank names go.

    A row's source key is its own where it has one, else its file's name without ending.
    Columns that a CSV file leaves out are null; files of one glob share their header.
    """
    columns = [c.split()[0] for c in SEEDS.split(", ")]
    if format == "csv":
        found = spark.read.option("header", True).csv(glob)
        found = found.select(*(F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in [*columns, "source_key"]), "_metadata.file_name")
    else:
        found = spark.read.schema(f"{SEEDS}, source_key string").json(glob).select(*columns, "source_key", "_metadata.file_name")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    rows = found.select(*columns, F.coalesce(F.nullif(F.trim("source_key"), F.lit("")), stem).alias("source_key"))
    return rows.withColumn("name", F.trim("name")).where("name != ''")


def _results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    name = "company_id"
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    bad = F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 200)))
    return parsed.select(F.when(F.col(f"r.{name}").isNull(), bad.cast(parsed.schema["r"].dataType)).otherwise(F.col("r")).alias("r")).select("r.*")


def read_people_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an explicit `seq`; blank lines are skipped, a malformed one is an error that shows it."""
    return _results(spark, path, PEOPLE)


def read_label_results(spark: SparkSession, path: str) -> DataFrame:
    df = _results(spark, path, LABELS)
    return df.select("company_id", "seq", "tier", "model", "page_url", "classification.*")


def write_batch(pages: DataFrame, names: DataFrame, path: str, instructions: str = "", max_chars: int | None = None) -> None:
    """One JSON line per company with any text: id, name, pages and prompt. pages: (company_id, pos, url, text)."""
    listed = pages.where(F.trim("text") != "").groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "text"))).alias("p"))
    rows = names.join(listed, "company_id").join(assemble_pages(pages, max_chars), "company_id")
    out = rows.select("company_id", "name", F.transform("p", lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"))).alias("pages"), F.concat(F.lit(instructions), "body").alias("prompt"))
    out.write.mode("overwrite").json(path)


def versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(version, folder): the versions that a table's pointer names; none for a new table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_versions")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "version long, folder string")
    return spark.read.schema("version long, folder string").json(str(path))


def save_table(df: DataFrame, root: str, name: str, version: int) -> str:
    """A new immutable version of a table; readers keep the old one until the pointer moves.

    Each attempt writes a folder of its own and the pointer comes last, so what a crash
    leaves behind is never read and a repeat of the version works. A version that the
    pointer has already is refused.
    """
    if not versions(df.sparkSession, root, name).where(F.col("version") == version).isEmpty():
        raise ValueError(f"{name} has version {version} already")
    folder = f"v{version:06d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}/{folder}")
    df.sparkSession.createDataFrame([(version, folder)], "version long, folder string").coalesce(1).write.mode("append").json(f"{root}/{name}/_versions")
    return f"{root}/{name}/{folder}"


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    folder = versions(spark, root, name).agg(F.max_by("folder", F.struct("version", "folder"))).first()[0]
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}/{folder}")


def export_csv(rows: DataFrame, path: str) -> None:
    """Semicolons, a header, and a byte order mark before it; one file, as the export is one download."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, BOM + first).coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
