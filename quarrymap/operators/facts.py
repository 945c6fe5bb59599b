"""Fact queries: lookups in the tables of one snapshot.

A snapshot is a mapping of table names to DataFrames. Lookups are plain filters, so they reach the Parquet scan as
pushed predicates; semi joins leave the choice of a broadcast to the optimizer, which knows the sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.functions.scalars import file_id, file_literal, language_of

Facts = Mapping[str, DataFrame]
#: What is looked up: a value, or a frame of one column that holds it (a plan then stays one plan).
Key = str | DataFrame


def having(rows: DataFrame, column: str, key: Key) -> DataFrame:
    if isinstance(key, str):
        return rows.filter(F.col(column) == key)
    return rows.join(key.toDF(column).distinct(), column, "left_semi").select(rows.columns)


def deps(facts: Facts, unit: Key) -> DataFrame:
    return having(facts["deps"], "from_unit_id", unit)


def rdeps(facts: Facts, unit: Key) -> DataFrame:
    return having(facts["deps"], "to_unit_id", unit)


def defs(facts: Facts, name: str | None = None, path: str | None = None, id: Key | None = None) -> DataFrame:
    """Symbols by exact name, exact id and a part of their file's path; absent and empty terms don't count."""
    out = facts["symbols"]
    if name:
        out = out.filter(F.col("name") == name)
    if isinstance(id, DataFrame) or id:
        out = having(out, "id", id)
    if path:
        files = facts["files"].filter(F.contains("path", F.lit(path))).select(F.col("id").alias("decl_file_id"))
        out = out.join(files, "decl_file_id", "left_semi").select(out.columns)
    return out


def defs_named(facts: Facts, name: str) -> DataFrame:
    """Symbols of exactly this name, which may be empty."""
    return facts["symbols"].filter(F.col("name") == name)


def refs(facts: Facts, symbol: Key) -> DataFrame:
    """Incoming references."""
    return having(facts["refs"], "to_symbol_id", symbol)


def diagnostics(facts: Facts, file: str | None = None, unit: Key | None = None) -> DataFrame:
    """All diagnostics, orphans too; or those of a file (id or path); or of the files of a unit."""
    rows = facts["diagnostics"]
    if file is not None:
        return rows.filter(F.col("file_id") == file_literal(file))
    if unit is not None:
        files = having(facts["files"], "unit_id", unit).select(F.col("id").alias("file_id"))
        return rows.join(files, "file_id", "left_semi").select(rows.columns)
    return rows


def changed_files(facts: Facts, paths: Sequence[str]) -> DataFrame:
    """id of each file named by a path or an id, known or not."""
    spark = facts["files"].sparkSession
    return spark.createDataFrame([(p,) for p in paths], "p string").select(file_id(F.col("p")).alias("id")).distinct()


def impact_units(facts: Facts, paths: Sequence[str]) -> DataFrame:
    """unit_id of the units that own one of the files."""
    return facts["files"].join(changed_files(facts, paths), "id", "left_semi").select("unit_id").distinct()


def touching(edges: DataFrame, ids: DataFrame, ends: tuple[str, str] = ("from_unit_id", "to_unit_id")) -> DataFrame:
    """Edges with an end among the ids (the one column of ``ids``, distinct), each as often as it is there: two equi joins, not one on OR."""
    named = ids.toDF("_id")
    a, b = (named.select(F.col("_id").alias(end), F.lit(True).alias(mark)) for end, mark in zip(ends, ("_from", "_to")))
    return edges.join(a, ends[0], "left").join(b, ends[1], "left").filter("_from OR _to").select(edges.columns)


def impact_deps(facts: Facts, paths: Sequence[str]) -> DataFrame:
    return touching(facts["deps"], impact_units(facts, paths))


def impls(facts: Facts, type_id: Key) -> DataFrame:
    return having(facts["type_relations"].filter(F.col("kind") == "implements"), "to_type_id", type_id)


def callers(facts: Facts, symbol: Key) -> DataFrame:
    return having(facts["call_edges"], "callee_id", symbol)


def callees(facts: Facts, symbol: Key) -> DataFrame:
    return having(facts["call_edges"], "caller_id", symbol)


def table_counts(facts: Facts) -> DataFrame:
    """table, n."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in facts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def units_by_language(units: DataFrame) -> DataFrame:
    return units.groupBy(language_of(F.col("id")).alias("lang")).agg(F.count("*").alias("n"))
