"""Tables in the folder that all executors share, sums over partitions, and Arrow batches of bounded size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrymap.sources.storage import checkpoint_dir, release, stored

__all__ = ["checkpoint_dir", "mapped", "release", "stored", "summed"]

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that goes to Python; the session's own bound holds where it is smaller.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of a bounded number of bytes: 10,000 long texts in one are more than a worker should hold."""
    conf = df.sparkSession.conf
    now = int(re.sub(r"\D", "", conf.get(_BYTES)) or 0)
    if not 0 < now <= BATCH_BYTES:
        conf.set(_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def summed(parts: DataFrame, partial: type, total: type) -> dict[int, np.ndarray]:
    """The sum of the arrays ``w`` (bytes of type ``partial``) of each ``k``, in type ``total``.

    parts: (k, part, w). Summed by (k, part) and then by k, so with about the root of the number of rows as the number
    of parts no task holds more than that many arrays. What comes to the driver is one array a k.
    """

    def adder(kind: type) -> Callable[[pa.Table], pa.Table]:
        def add(table: pa.Table) -> pa.Table:
            out = None
            for b in table.column("w"):
                w = np.frombuffer(b.as_buffer(), kind)
                out = w.astype(total) if out is None else out + w
            return pa.table({"k": table.column("k").slice(0, 1), "w": pa.array([out.tobytes()], pa.binary())})

        return add

    once = parts.groupBy("k", "part").applyInArrow(adder(partial), "k long, w binary")
    return {r["k"]: np.frombuffer(r["w"], total) for r in once.groupBy(F.col("k")).applyInArrow(adder(total), "k long, w binary").collect()}
