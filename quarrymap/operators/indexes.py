"""Derived indexes: inverted maps as tables, from one snapshot and therefore never stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_by_file(files: DataFrame) -> DataFrame:
    """file_id, unit_id; of rows that repeat an id one (the largest unit id) counts."""
    return files.groupBy(F.col("id").alias("file_id")).agg(F.max("unit_id").alias("unit_id"))


def unit_by_path(units: DataFrame) -> DataFrame:
    return units.groupBy("path").agg(F.max("id").alias("unit_id"))


def symbol_by_name(symbols: DataFrame) -> DataFrame:
    """name, ids (sorted, as often as they are there)."""
    return symbols.groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def refs_by_symbol(refs: DataFrame) -> DataFrame:
    """to_symbol_id, refs: the rows as structs. For export; queries filter the table, which a hot symbol doesn't hurt."""
    return refs.groupBy("to_symbol_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in refs.columns if c != "to_symbol_id"]))).alias("refs"))


def ref_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("to_symbol_id").agg(F.count("*").alias("n"))
