"""Incremental jobs: new page files and new posting snapshots, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions import text as T
from firmlens.operators.links import fetched
from firmlens.operators.postings import sync_jobs
from firmlens.sources import bucketed
from firmlens.sources.io import PAGES, load_table, save_table, versions


def extracted(pages: DataFrame) -> DataFrame:
    """(url, emails, phone) of readable pages; stateless."""
    return pages.where(fetched(F.col("status"), F.col("body"))).select("url", T.page_emails(F.col("body")).alias("emails"), T.phone(F.col("body")).alias("phone"))


def extract_new_pages(spark: SparkSession, source: str, out: str, checkpoint: str, schema: str = PAGES) -> None:
    """Process the page files that no earlier run has seen, then stop."""
    stream = extracted(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def sync_new_postings(spark: SparkSession, source: str, root: str, checkpoint: str, schema: str) -> None:
    """Each new snapshot file updates the job table, once.

    A row without fingerprint says that a company's board was read and is empty, so its
    postings close; companies without any row were not read and keep theirs. The batch id
    names the version: a repeated batch whose version the pointer has changes nothing, and one
    that broke off before that is done again. Where the table is in buckets of company_id, only
    those of the batch's companies are read and written.
    """

    def synced(state: DataFrame, batch: DataFrame) -> DataFrame:
        at = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) if batch.isEmpty() else batch.agg(F.max("run_ts")).first()[0]
        return sync_jobs(state, batch.where("fingerprint is not null").drop("run_ts"), batch.select("company_id"), F.lit(at))

    def apply(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 2
        if not versions(spark, root, "jobs").where(F.col("version") == version).isEmpty():
            return
        if in_buckets:
            bucketed.merge(batch, root, "jobs", version, synced)
        else:
            save_table(synced(load_table(spark, root, "jobs"), batch), root, "jobs", version)

    in_buckets = bucketed.is_bucketed(spark, root, "jobs")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
