"""Pages of a sorted list at any depth: by cursor, and by number in a stored order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlens.sources.shared import stored

#: (column, ascending), first to last; together they are unique. Nulls go first ascending and last descending.
Keys = Sequence[tuple[str, bool]]
#: Rows of a stored order in a folder.
BLOCK_ROWS = 100_000
POSITION, BLOCK = "_position", "_block"


def by(keys: Keys) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in keys]


def after(keys: Keys, cursor: Sequence) -> Column:
    """Rows behind the row whose key values are `cursor`; nulls have their place in the order."""
    parts, same = [], F.lit(True)
    for (name, up), v in zip(keys, cursor, strict=True):
        c = F.col(name)
        if v is None:
            behind = c.isNotNull() if up else F.lit(False)
        else:
            behind = F.coalesce(c > F.lit(v), F.lit(False)) if up else F.coalesce(c < F.lit(v), F.lit(True))
        parts.append(same & behind)
        same &= c.eqNullSafe(F.lit(v))
    return reduce(lambda a, b: a | b, parts)


def page_after(df: DataFrame, keys: Keys, cursor: Sequence | None, size: int) -> DataFrame:
    """The page behind a cursor, or the first. No task keeps more than a page's rows, whatever its depth. The limit is the feature."""
    return (df if cursor is None else df.where(after(keys, cursor))).orderBy(*by(keys)).limit(size)


def cursor_of(page: DataFrame, keys: Keys) -> tuple | None:
    """The cursor behind a page of bounded size; none for an empty page."""
    last = page.orderBy(*by([(c, not up) for c, up in keys])).select(*(c for c, _ in keys)).first()
    return None if last is None else tuple(last)


def numbered(df: DataFrame, keys: Keys) -> DataFrame:
    """`df` with _position, from 0 in the order, in two phases: no task has all rows.

    Rows are dealt by ranges of the keys; a range's first number is the count of the rows of ranges before it.
    """
    dealt = stored(df.repartitionByRange(*by(keys)).withColumn("_range", F.spark_partition_id()), "page_ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = stored(dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "page_bases")
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*by(keys)))
    return dealt.withColumn("_local", local).join(base.hint("shuffle_merge"), "_range").withColumn(POSITION, F.col("_base") + F.col("_local") - 1).drop("_range", "_base", "_local")


def write_order(df: DataFrame, keys: Keys, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """A list in its order, in folders of block_rows positions each."""
    rows = numbered(df, keys).withColumn(BLOCK, F.floor(F.col(POSITION) / block_rows))
    rows.repartition(BLOCK).sortWithinPartitions(BLOCK, POSITION).write.mode("overwrite").option("compression", "zstd").partitionBy(BLOCK).parquet(path)


def read_order(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def page_at(ordered: DataFrame, number: int, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Page `number`, from 1, of a stored order: reads the folders that hold it, however deep it is."""
    start = (max(number, 1) - 1) * size
    inside = F.col(BLOCK).between(start // block_rows, (start + size - 1) // block_rows) & F.col(POSITION).between(start, start + size - 1)
    return ordered.where(inside).orderBy(POSITION).drop(BLOCK)
