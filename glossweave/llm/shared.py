"""The folder that driver and executors share, and files in it that workers map into memory."""

from __future__ import annotations

import atexit
import mmap
import os
import resource
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder in local mode only."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if given:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="glossweave-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir().rstrip("/")


_made: list[list[str]] = []


def folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder of the shared one, as a URI; ``keep``: not one that ``removing`` removes."""
    uri = f"{root(spark)}/glossweave-{name}-{uuid.uuid4().hex}"
    if _made and not keep:
        _made[-1].append(uri)
    return uri


@contextmanager
def removing(spark: SparkSession, really: bool = True):
    """Remove the folders that were made inside once what is computed from them is stored."""
    _made.append([])
    try:
        yield
    finally:
        for uri in _made.pop() if really else ():
            removed(spark, uri)


@contextmanager
def tidy(spark: SparkSession):
    """Inside, the files of a shuffle go when the job that they are for has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bounded(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Hand whole texts to Python workers in batches that end at ``rows`` rows or ``size`` bytes, one row at least.

    The session's defaults are for short rows; what its user has set otherwise stays.
    """
    for key, default, own in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", str((1 << 31) - 1), size)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(own))


#: What operators keep in a worker between tasks: the name of each one's cache and how to clear it.
caches: dict[str, Callable[[], None]] = {}


def lean(own: str = "") -> None:
    """In a worker, which lives on between tasks: drop what other operators keep, and give freed memory back."""
    import pyarrow as pa

    for name, clear in caches.items():
        if name != own:
            clear()
    pa.set_memory_pool(pa.system_memory_pool())
    _trim()


def _trim() -> None:
    """This process's freed memory back to the system."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def trimmed(spark: SparkSession) -> bool:
    """Give memory that the driver has freed back to the system: that of Python, and that of the JVM outside its heap,
    where compilers and codecs leave glibc some 250 MB after a few hundred jobs. False where the JVM has no such command
    (JDK 17.0.9 has it, on Linux) or can't be asked."""
    from py4j.protocol import Py4JError

    _trim()
    try:
        jvm = spark._jvm
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, and computes it once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, uri: str) -> None:
    """Delete a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, each: DataFrame, key: str, total: int, how: str = "inner", count: str = "n") -> DataFrame:
    """``rows`` joined by ``key`` with ``each``, which has one row for each key and in ``count`` its number of rows, ``total`` in all.

    No task gets a hot key whole: keys of more than ``total / 100,000`` rows (64 at least), of which there are fewer than
    100,000 by that bound, are broadcast to where the rows are; the others are joined by key.
    """
    most = max(64, total // 100_000)
    hot = F.broadcast(each.where(F.col(count) > most))
    cold = rows.join(hot.select(key), key, "left_anti").join(each.where(F.col(count) <= most), key, how)
    return rows.join(hot, key).unionByName(cold)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; sets counts of shards, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def doc_key(name: str = "doc_id") -> Column:
    """The id as text, as the folds hash it; a null id counts as empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else uri)


def save(uri: str, arrays: list[np.ndarray]) -> None:
    """Write arrays one behind another; a task that runs twice writes the same file, moved into place whole."""
    store, path = _filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).data if len(a) else b"")
    store.move(part, path)


_local: dict[str, str] = {}
#: A map keeps its file open before Python 3.13.
_UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}
#: How many files a table holds mapped at once. A process has 65,530 maps by Linux's default, which a few tables share, and
#: where maps keep files open, no more files than its limit.
MAPS = 10_000 if _UNTRACKED else max(16, min(10_000, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 8))


def mapped(uri: str, dtypes: list[str], sizes: list[int]) -> list[np.ndarray]:
    """The arrays of a file of ``save``, in one map. On a store that cannot be mapped the file is first copied to the worker's disk."""
    if not any(sizes):
        return [np.zeros(0, d) for d in dtypes]
    from pyarrow import fs

    store, path = _filesystem(uri)
    if not isinstance(store, fs.LocalFileSystem):
        if uri not in _local:
            own = tempfile.mkdtemp(prefix="glossweave-map-")
            atexit.register(shutil.rmtree, own, True)
            _local[uri] = os.path.join(own, "data")
            with store.open_input_stream(path) as src, open(_local[uri], "wb") as out:
                shutil.copyfileobj(src, out, 1 << 20)
        path = _local[uri]
    with open(path, "rb") as f:
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_UNTRACKED)
    found, at = [], 0
    for d, n in zip(dtypes, sizes, strict=True):
        found.append(np.frombuffer(whole, d, n, at))
        at += n * np.dtype(d).itemsize
    return found


def read_bytes(uri: str) -> bytes:
    store, path = _filesystem(uri)
    with store.open_input_stream(path) as src:
        return src.read()


def read_part(uri: str, start: int, size: int) -> bytes:
    """``size`` bytes of a file from ``start`` on."""
    store, path = _filesystem(uri)
    with store.open_input_file(path) as src:
        src.seek(start)
        return src.read(size)
