"""Stored results: immutable fact tables that are published whole, and caches with an identity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, checks: dict[str, list[str]] | None = None, skip: set[str] = frozenset()) -> None:
    """Write tables beside ``path``, verify them, and move them into place; a failed check publishes nothing.

    ``checks``: conditions that every row of a table meets. ``skip``: tables left out of a light artifact. An artifact
    is never changed: publishing over one is an error.
    """
    fs, target, path_of = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    part = f"{path}.{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            if name in skip:
                continue
            df.write.option("compression", "zstd").parquet(f"{part}/{name}")
            for condition in (checks or {}).get(name, []):
                if spark.read.parquet(f"{part}/{name}").where(~F.coalesce(F.expr(condition), F.lit(False))).limit(1).count():
                    raise ValueError(f"{name}: a row does not meet {condition}")
        if not fs.rename(path_of(part), target):
            raise OSError(f"cannot move {part} to {path}")
    except BaseException:
        fs.delete(path_of(part), True)
        raise


def open_cache(spark: SparkSession, path: str, identity: dict[str, str], profile: str) -> DataFrame | None:
    """The facts of a cache of the same identity. A different one is wiped, a different profile refused; None is empty."""
    fs, target, path_of = _fs(spark, path)
    if not fs.exists(target):
        return None
    meta = spark.read.json(f"{path}/meta").first().asDict()
    if meta["profile"] != profile:
        raise ValueError(f"the cache has the profile {meta['profile']}")
    if any(str(meta.get(k)) != str(v) for k, v in identity.items()):
        fs.delete(path_of(path), True)
        return None
    return spark.read.parquet(f"{path}/facts")


def write_cache(facts: DataFrame, path: str, identity: dict[str, str], profile: str) -> None:
    spark = facts.sparkSession
    facts.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/facts")
    spark.range(1).select(F.lit(profile).alias("profile"), *[F.lit(str(v)).alias(k) for k, v in identity.items()]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def frozen(facts: DataFrame, run_id: int, rows: int) -> DataFrame:
    """One run's facts, whose number must be what its manifest says."""
    own = facts.where(F.col("run_id") == run_id)
    if (n := own.count()) != rows:
        raise ValueError(f"run {run_id} has {n} facts, its manifest says {rows}")
    return own


def packed(spark: SparkSession, path: str, rows_a_file: int = 5_000_000) -> None:
    """A cache's facts at rest: sorted by their key, in few files, compressed harder. What it says of itself stays readable."""
    _again(spark, path, {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}, rows_a_file)


def unpacked(spark: SparkSession, path: str) -> None:
    """A packed cache for reading often: compressed lightly."""
    _again(spark, path, {"compression": "lz4_raw"}, 0)


def _again(spark: SparkSession, path: str, options: dict[str, str], rows_a_file: int) -> None:
    fs, target, path_of = _fs(spark, f"{path}/facts")
    part, old = path_of(f"{path}/facts.{uuid.uuid4().hex}"), path_of(f"{path}/old.{uuid.uuid4().hex}")
    facts = spark.read.parquet(f"{path}/facts")
    before = facts.count()
    if rows_a_file:
        facts = facts.repartitionByRange(max(1, -(-before // rows_a_file)), *facts.columns[:2]).sortWithinPartitions(*facts.columns[:2])
    facts.write.options(**options).parquet(str(part))
    if spark.read.parquet(str(part)).count() != before:
        fs.delete(part, True)
        raise OSError(f"{path} was not written whole")
    if not (fs.rename(target, old) and fs.rename(part, target)):
        raise OSError(f"cannot move {part} to {target}")
    fs.delete(old, True)
