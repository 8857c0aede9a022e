"""Shared pieces: table access, shared-folder tables, distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firmlens.operators.components import connected_components, extended
from firmlens.sources.shared import shared_dir, stored

__all__ = ["WORD_PATTERN", "connected_components", "extended", "shared_dir", "stored", "table"]

#: Word separators of every word rule here: space and U+0009..U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
