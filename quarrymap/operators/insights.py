"""Queries of the annotations (kept apart from facts) and the scope of files that they are made from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.operators.facts import Key, having

Insights = Mapping[str, DataFrame]


def _confident(rows: DataFrame, least: float) -> DataFrame:
    """Rows of a known confidence from ``least`` on; null is unknown."""
    column: Column = F.col("confidence") if "confidence" in rows.columns else F.col("meta.confidence")
    return rows.filter(column >= least)


def _only(rows: DataFrame, column: str, value: Key | None) -> DataFrame:
    return rows if value is None else having(rows, column, value)


def intents(insights: Insights, target: Key | None = None, least: float = 0) -> DataFrame:
    return _only(_confident(insights["intent_tags"], least), "target_id", target)


def summaries(insights: Insights, target: Key | None = None, least: float = 0) -> DataFrame:
    return _only(_confident(insights["summaries"], least), "target_id", target)


def smells(insights: Insights, file: str | None = None, severity: str | None = None, least: float = 0) -> DataFrame:
    """Here an empty filter counts as none."""
    return _only(_only(_confident(insights["bug_smells"], least), "file_id", file or None), "severity", severity or None)


def patterns(insights: Insights, pattern: str | None = None, least: float = 0) -> DataFrame:
    return _only(_confident(insights["pattern_tags"], least), "pattern", pattern)


def naming(insights: Insights, symbol: Key | None = None, least: float = 0) -> DataFrame:
    return _only(_confident(insights["naming_issues"], least), "symbol_id", symbol)


def of_model(rows: DataFrame, model: str) -> DataFrame:
    """What is still valid when ``model`` is the one in use."""
    return rows.filter(F.col("meta.model") == model)


def scope_files(facts: Mapping[str, DataFrame], files: Sequence[str] | None = None, units: Sequence[str] | None = None, symbols: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """file_id: the given files, those of the given units and those that declare the given symbols (ids, or a frame of one column).

    Without any argument all files; with an empty list of one kind none of that kind. Unknown file ids stay.
    """
    rows = facts["files"]
    if files is None and units is None and symbols is None:
        return rows.select(F.col("id").alias("file_id")).distinct()
    spark, parts = rows.sparkSession, []
    if files is not None:
        parts.append(spark.createDataFrame([(f,) for f in files], "file_id string"))
    if units is not None:
        parts.append(rows.filter(F.col("unit_id").isin(list(units))).select(F.col("id").alias("file_id")))
    if symbols is not None:
        named = having(facts["symbols"], "id", symbols) if isinstance(symbols, DataFrame) else facts["symbols"].filter(F.col("id").isin(list(symbols)))
        parts.append(named.select(F.col("decl_file_id").alias("file_id")))
    return reduce(DataFrame.union, parts).distinct()


def scoped_files(facts: Mapping[str, DataFrame], **scope: Sequence[str] | DataFrame | None) -> DataFrame:
    """Rows of files in the scope; ids without a file are dropped."""
    rows = facts["files"]
    return rows.join(scope_files(facts, **scope).withColumnRenamed("file_id", "id"), "id", "left_semi").select(rows.columns)


def context_sources(facts: Mapping[str, DataFrame], root: str, **scope: Sequence[str] | None) -> DataFrame:
    """file_id, text of the scoped files that can be read below ``root``; others are left out."""
    from quarrymap.sources.files import texts_below

    found = texts_below(facts["files"].sparkSession, root)
    wanted = scoped_files(facts, **scope).select(F.col("id").alias("file_id"), "path")
    return wanted.join(found, "path").select("file_id", "text")
