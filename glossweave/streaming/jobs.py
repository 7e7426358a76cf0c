"""Streams: keyed upserts of measurements, and requests answered line by line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upserted(old: DataFrame | None, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key; a key's rows of an older state are replaced as a whole."""
    rows = new if old is None else old.unionByName(new)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def upsert_stream(source: DataFrame, path: str, checkpoint: str, key: list[str], order: str, every: int = 16) -> StreamingQuery:
    """Keeps the newest row of each key below ``path``.

    A batch writes only its own newest rows, as ``d<epoch>``; every ``every`` batches the rows since the last state are
    merged with it to ``v<epoch>``, and what that replaces is deleted. A batch that runs again after a failure writes
    the same folders again from the same older ones, so nothing counts twice.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        upserted(None, batch, key, order).write.mode("overwrite").parquet(f"{path}/d{epoch}")
        if (epoch + 1) % every == 0:
            since = [f"{path}/{k}{n}" for k, n in _parts(spark, path, before=epoch)]
            upserted(None, _read(spark, since), key, order).write.mode("overwrite").parquet(f"{path}/v{epoch}")
            kept = epoch - every  # the state before stays until the next one, for a batch that runs again
            for k, n in _names(spark, path):
                if n < kept or (n == kept and k == "d"):
                    _delete(spark, f"{path}/{k}{n}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    p, fs = _files(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return [(n[0], int(n[1:])) for n in names if n[0] in "dv" and n[1:].isdigit() and fs.exists(_files(spark, f"{path}/{n}/_SUCCESS")[0])]


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _files(spark, path)
    fs.delete(p, True)


def _parts(spark: SparkSession, path: str, before: int | None = None) -> list[tuple[str, int]]:
    """The last whole state and the batches after it; ``before``: a state of that epoch is being written again."""
    names = _names(spark, path)
    state = max((n for k, n in names if k == "v" and (before is None or n < before)), default=-1)
    return [("v", state)] * (state >= 0) + sorted((k, n) for k, n in names if k == "d" and n > state and (before is None or n <= before))


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*paths)


def latest_version(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """The newest row of each key: the last state with the batches after it."""
    return upserted(None, _read(spark, [f"{path}/{k}{n}" for k, n in _parts(spark, path)]), key, order)


def serve(spark: SparkSession, requests: str, responses: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """One JSON line in, one out: ``answer`` turns rows (id, word) into rows with an id. A line that is no request gets an error line."""
    lines = spark.readStream.text(requests)
    r = F.from_json("value", "id string, word string")
    rows = lines.select(r["id"].alias("id"), r["word"].alias("word"), "value")

    def step(batch: DataFrame, epoch: int) -> None:
        good, bad = batch.where("id IS NOT NULL AND word IS NOT NULL"), batch.where("id IS NULL OR word IS NULL")
        done = answer(good.select("id", "word"))
        out = done.select(F.to_json(F.struct(*done.columns)).alias("value")).unionByName(bad.select(F.to_json(F.struct("id", F.lit("bad request").alias("error"))).alias("value")))
        out.write.mode("overwrite").text(f"{responses}/batch={epoch}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
