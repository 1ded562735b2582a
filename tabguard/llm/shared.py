"""Tables and files in the folder that the whole cluster shares, and tables found under a data folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished write are removed at once: its rows are in the shared folder.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_own: str | None = None


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where that is unset, a local master gets a temporary folder, and a cluster an error.
    """
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own = _own or tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage, and safe when executors are lost."""
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read again: what was made from them is stored itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    """The mounted path of a shared file that tasks open themselves (for memory mapping)."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared folder that is mounted as a path, not {path}")
    return parts.path


#: What this worker keeps from one task to the next, and under which key.
_held: tuple[Hashable, Any] | None = None


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What the worker keeps under ``key``. It keeps one thing at a time: what another operator left is freed first."""
    global _held
    if _held is None or _held[0] != key:
        freed()
        _held = (key, make())
    return _held[1]


def freed() -> None:
    """Frees what earlier operators left in this worker; for operators that need room and keep nothing."""
    global _held
    if _held is not None:
        _held = None
        gc.collect()  # memories refer to themselves through the functions that fill them
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library would keep what was freed
        if trim is not None:
            trim(0)


def lean(at_least: int = 1 << 20) -> None:
    """From now on this worker gives arrays of a megabyte or more back to the system as soon as they are freed.

    The C library would raise that bound by itself, and keep what was freed for later arrays.
    """
    options = getattr(ctypes.CDLL(None), "mallopt", None)
    if options is not None:
        options(-3, at_least)  # M_MMAP_THRESHOLD
        options(-1, at_least)  # M_TRIM_THRESHOLD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
