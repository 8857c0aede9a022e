"""Distinct counts kept up batch by batch: exact sets in buckets, and the counts of each bucket beside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.sources import bucketed
from firmlens.sources.shared import stored

#: Parts that a group's values are dealt to, so that a group of very many values is in as many buckets.
SPREAD = 16
PART = "_part"


def add_values(
    batch: DataFrame, root: str, name: str, version: int, group: str, value: str, flags: Sequence[str] = (), spread: int = SPREAD, buckets: int = bucketed.BUCKETS,
) -> None:
    """Add a batch (group, value, flags) to the sets of table `name`; the first version creates it.

    A value is once in its group's set, and a flag holds once any of its rows has it. Only the buckets of
    the batch's values are read and written, in the table of sets and in that of counts. A null value makes
    its group known and counts nothing. A repeated call with the same version changes nothing, and
    one that broke off between the two tables is completed.
    """
    spark = batch.sparkSession
    counts, keys = f"{name}_counts", [group, PART]
    new = _sets(batch.select(group, value, *flags), group, value, flags).withColumn(PART, F.pmod(F.xxhash64(value), F.lit(spread)).cast("int"))
    first = bucketed.versions(spark, root, name).isEmpty()
    if first:
        bucketed.create(new, root, name, keys, buckets, version)
    elif not bucketed.has_version(spark, root, name, version):
        bucketed.merge(stored(new, "distinct_batch"), root, name, version, lambda old, more: _sets(old.unionByName(more), group, value, flags, PART))
    if bucketed.has_version(spark, root, counts, version):
        return
    changed = bucketed.changed_in(bucketed.manifest(spark, root, name, version), version)
    seen = bucketed.read(spark, root, name, version, changed)
    flagged = (F.count_if(F.col(value).isNotNull() & F.col(f)).alias(f"n_{f}") for f in flags)
    fresh = seen.groupBy(*keys).agg(F.count(value).alias("n"), *flagged)
    if bucketed.versions(spark, root, counts).isEmpty():
        bucketed.create(fresh, root, counts, keys, buckets, version)
    else:
        bucketed.merge(fresh, root, counts, version, lambda _, now: now, changed)


def _sets(rows: DataFrame, group: str, value: str, flags: Sequence[str], *more: str) -> DataFrame:
    """A row per group and value; flags by any."""
    if not flags:
        return rows.select(group, value, *more).distinct()
    return rows.groupBy(group, value, *more).agg(*(F.coalesce(F.max(f), F.lit(False)).alias(f) for f in flags))


def value_counts(spark: SparkSession, root: str, name: str, group: str) -> DataFrame:
    """(group, n, n_flag...): distinct values of each group, and those with each flag, from the counts alone."""
    parts = bucketed.read(spark, root, f"{name}_counts")
    return parts.groupBy(group).agg(*(F.sum(c).alias(c) for c in parts.columns if c not in (group, PART)))
