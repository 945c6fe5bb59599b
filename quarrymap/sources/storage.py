"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set a new temporary one, which only a local master (as in tests) can share."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quarrymap-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_own[0])
    return _own[0]


def new_place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame written as Parquet in the shared folder and read again."""
    path = new_place(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._place = path
    return out


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch that goes to Python; the session's own bound holds where it is smaller."""
    now = int(re.sub(r"\D", "", spark.conf.get(_BYTES)) or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def release(*frames: DataFrame) -> None:
    """Deletes the files of frames that ``stored`` made and that nothing reads any more."""
    for df in frames:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._place)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
