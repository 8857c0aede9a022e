"""Versioned tables in hash buckets: a batch rewrites only the buckets that its keys fall in.

A version is a folder of the buckets it wrote and a manifest, which names the folder of each
bucket; untouched buckets stay where an earlier version put them. The manifest comes
after the data and the table's pointer after the manifest, so what a broken attempt leaves behind is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from firmlens.sources.io import versions

#: Choose it for buckets of some hundred megabytes; a manifest has so many rows at most, and only manifests reach the driver.
BUCKETS = 256
BUCKET = "_bucket"
MANIFEST = "keys array<string>, buckets int, schema string, bucket int, folder string"


class Manifest(NamedTuple):
    keys: list[str]
    buckets: int
    schema: StructType
    folders: dict[int, str]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


def manifest(spark: SparkSession, root: str, name: str, version: int | None = None) -> Manifest:
    """The manifest of a version, by default the newest."""
    folder = _newest(spark, root, name, version)
    if folder is None:
        raise ValueError(f"{name} has no version {'' if version is None else version}".strip())
    rows = spark.read.schema(MANIFEST).json(f"{root}/{name}/{folder}/_manifest").collect()
    return Manifest(rows[0].keys, rows[0].buckets, StructType.fromDDL(rows[0].schema), {r.bucket: r.folder for r in rows if r.bucket is not None})


def _newest(spark: SparkSession, root: str, name: str, version: int | None = None) -> str | None:
    known = versions(spark, root, name)
    known = known if version is None else known.where(F.col("version") == version)
    return known.agg(F.max_by("folder", F.struct("version", "folder"))).first()[0]


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def is_bucketed(spark: SparkSession, root: str, name: str) -> bool:
    return _exists(spark, f"{root}/{name}/{_newest(spark, root, name)}/_manifest")


def has_version(spark: SparkSession, root: str, name: str, version: int) -> bool:
    return not versions(spark, root, name).where(F.col("version") == version).isEmpty()


def _refuse(spark: SparkSession, root: str, name: str, version: int) -> None:
    if has_version(spark, root, name, version):
        raise ValueError(f"{name} has version {version} already")


def create(df: DataFrame, root: str, name: str, keys: Sequence[str], buckets: int = BUCKETS, version: int = 1) -> None:
    """A new table dealt by the hash of `keys`; their number and the keys stay for all versions."""
    _refuse(df.sparkSession, root, name, version)
    _write(df, root, name, version, Manifest(list(keys), buckets, df.schema, {}), range(buckets))


def read(spark: SparkSession, root: str, name: str, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
    """A version, or some of its buckets; columns that older buckets lack come as nulls."""
    m = manifest(spark, root, name, version)
    return _read(spark, root, name, m, m.folders if buckets is None else buckets)


def touched(m: Manifest, rows: DataFrame) -> list[int]:
    """The buckets that the keys of `rows` fall in."""
    return sorted(r[0] for r in rows.select(m.bucket()).distinct().collect())


def merge(batch: DataFrame, root: str, name: str, version: int, apply: Callable[[DataFrame, DataFrame], DataFrame], buckets: Sequence[int] | None = None) -> list[int]:
    """The next version: `apply(old rows, batch)` in place of the buckets that the batch touches, or that are named; returns these.

    `apply` sees whole buckets and must give all their rows and no row of others, which is an error.
    """
    spark = batch.sparkSession
    _refuse(spark, root, name, version)
    m = manifest(spark, root, name)
    changed = touched(m, batch) if buckets is None else sorted(buckets)
    new = apply(_read(spark, root, name, m, changed), batch)
    _write(new, root, name, version, m._replace(schema=new.schema), changed)
    return changed


def changed_in(m: Manifest, version: int) -> list[int]:
    """The buckets that a version wrote."""
    return sorted(b for b, folder in m.folders.items() if folder.startswith(f"v{version:06d}-"))


def _read(spark: SparkSession, root: str, name: str, m: Manifest, buckets: Sequence[int]) -> DataFrame:
    paths = [f"{root}/{name}/{m.folders[b]}/{BUCKET}={b}" for b in buckets if b in m.folders]
    return spark.read.schema(m.schema).parquet(*paths) if paths else spark.createDataFrame([], m.schema)


def _write(df: DataFrame, root: str, name: str, version: int, m: Manifest, changed: Sequence[int]) -> None:
    spark = df.sparkSession
    folder = f"v{version:06d}-{uuid.uuid4().hex}"
    # Rebalanced, not repartitioned: a bucket with a hot key is split over tasks.
    df.withColumn(BUCKET, m.bucket()).hint("rebalance", BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{root}/{name}/{folder}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{folder}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    written = {int(s.getPath().getName().partition("=")[2]) for s in found if s.getPath().getName().startswith(f"{BUCKET}=")}
    if not written <= set(changed):
        raise ValueError(f"{name}: rows of buckets that the batch does not touch: {sorted(written - set(changed))[:10]}")
    kept = {b: f for b, f in m.folders.items() if b not in set(changed)} | dict.fromkeys(written, folder)
    rows = [(m.keys, m.buckets, _ddl(df.schema), b, f) for b, f in sorted(kept.items())] or [(m.keys, m.buckets, _ddl(df.schema), None, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{root}/{name}/{folder}/_manifest")
    spark.createDataFrame([(version, folder)], "version long, folder string").coalesce(1).write.mode("append").json(f"{root}/{name}/_versions")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
