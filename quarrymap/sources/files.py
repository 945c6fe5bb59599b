"""Reading source trees: contents, hashes and marks of files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.functions.scalars import content_hash, is_generated, relative_path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or directory is there, on whatever file system the path names; a failing file system is an error, not a no."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def names_below(spark: SparkSession, path: str) -> list[str]:
    """Names of what a directory holds; none where it isn't there."""
    if not exists(spark, path):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]


def delete(spark: SparkSession, path: str) -> None:
    """Recursively; nothing happens where nothing is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def contents_below(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (relative to root), content of the files below a directory."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    plain = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", ""), "^/+", "/")
    return rows.select(relative_path(plain, "/" + root.split(":")[-1].strip("/")).alias("path"), "content")


def texts_below(spark: SparkSession, root: str) -> DataFrame:
    """path, text; bytes that aren't UTF-8 are replaced."""
    return contents_below(spark, root).select("path", F.col("content").cast("string").alias("text"))


def file_marks(files: DataFrame) -> DataFrame:
    """path, hash, generated of (path, content)."""
    return files.select("path", content_hash(F.col("content")).alias("hash"), is_generated(F.col("content")).alias("generated"))


def detect(spark: SparkSession, root: str, marker: str = "go.mod") -> tuple[bool, float]:
    """(supported, confidence): certain if the marker file is at the root, else not at all."""
    found = exists(spark, f"{root.rstrip('/')}/{marker}")
    return found, 1.0 if found else 0.0
