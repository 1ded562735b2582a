"""Sets of 64-bit hashes of any size, as sorted files in the shared folder that workers map into memory."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm.shared import folder, local_path


def _write(batches: Iterator[pa.RecordBatch], to: str) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    own, n = f"{to}/.{context.partitionId()}.{context.taskAttemptId()}", 0
    with open(own, "wb") as f:
        for batch in batches:
            f.write(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n += batch.num_rows
    os.replace(own, f"{to}/{context.partitionId()}")
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def written(keys: DataFrame, name: str) -> tuple[str, int]:
    """(folder, number of files) of the distinct hashes in the only column of ``keys``, dealt by their remainder."""
    spark = keys.sparkSession
    to = local_path(folder(spark, name))
    os.makedirs(to, exist_ok=True)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = keys.toDF("key")
    keys.repartitionById(parts, F.pmod("key", F.lit(parts)).cast("int")).sortWithinPartitions("key").mapInArrow(lambda b: _write(b, to), "n long").agg(F.sum("n")).collect()
    return to, parts


class Keys:
    """The mapped files of one set."""

    _open: dict[str, Keys] = {}

    def __init__(self, to: str, parts: int):
        self.parts = parts
        paths = [f"{to}/{p}" for p in range(parts)]
        self.files = [np.memmap(p, "<i8", "r") if os.path.exists(p) and os.path.getsize(p) else np.zeros(0, "<i8") for p in paths]

    @classmethod
    def of(cls, at: tuple[str, int]) -> Keys:
        """The worker's open set; it holds one at a time."""
        if at[0] not in cls._open:
            cls._open = {at[0]: cls(*at)}
        return cls._open[at[0]]

    def has(self, h: np.ndarray) -> np.ndarray:
        h = np.ascontiguousarray(h).view(np.int64)
        out = np.zeros(len(h), bool)
        part = np.mod(h, self.parts)
        for p in np.unique(part).tolist():
            mine, keys = np.flatnonzero(part == p), self.files[p]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h[mine]), len(keys) - 1)
                out[mine] = keys[at] == h[mine]
        return out
