"""Applying a delta to a snapshot: removals with their cascade, pruning of what dangles, then appends.

Everything is semi, anti and union: bags stay bags, keys of several columns are real ones and not joined strings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]

#: Columns that name the rows to remove of each table.
REMOVAL_KEYS = {
    "units": ("id",),
    "files": ("id",),
    "symbols": ("id",),
    "deps": ("from_unit_id", "to_unit_id"),
    "refs": ("from_symbol_id", "to_symbol_id"),
    "type_relations": ("from_type_id", "to_type_id"),
    "call_edges": ("caller_id", "callee_id"),
    "diagnostics": ("file_id", "line", "col", "message"),
}
#: Edge tables between symbols, and their two ends.
EDGES = {"refs": ("from_symbol_id", "to_symbol_id"), "type_relations": ("from_type_id", "to_type_id"), "call_edges": ("caller_id", "callee_id")}


def without(rows: DataFrame, keys: DataFrame | None, columns: Mapping[str, str]) -> DataFrame:
    """rows whose columns (named by the keys of ``columns``) aren't in ``keys``; null is like null where there are several."""
    if keys is None:
        return rows
    named = keys.select(*[F.col(k).alias(f"_{r}") for r, k in columns.items()])
    on = [rows[r].eqNullSafe(named[f"_{r}"]) if len(columns) > 1 else rows[r] == named[f"_{r}"] for r in columns]
    return rows.join(named, on, "left_anti")


def _within(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    named = ids.select(F.col("id").alias("_id"))
    return rows.join(named, rows[column] == named["_id"], "left_semi")


def prune(edges: DataFrame, ends: tuple[str, str], symbols: DataFrame) -> DataFrame:
    """Edges with both ends among the symbols."""
    return _within(_within(edges, ends[0], symbols), ends[1], symbols)


def _but(edges: DataFrame, ends: tuple[str, str], keys: DataFrame | None) -> DataFrame:
    """Pruned edges without those of ``keys``. Pruning leaves no null end and the edges dealt out by the second one, as the keys are here: the edges don't move again."""
    if keys is None:
        return edges
    named = keys.select(*[F.col(c).alias(f"_{c}") for c in ends]).repartition(f"_{ends[1]}")
    return edges.join(named, [edges[c] == named[f"_{c}"] for c in ends], "left_anti")


def _digest(column: str) -> list[Column]:
    """128 bits of a value as two columns."""
    return [F.xxhash64(column).alias("_a"), F.xxhash64(F.lit("again"), column).alias("_b")]


def dangling(ends: Sequence[tuple[DataFrame, str]], names: DataFrame) -> DataFrame:
    """Digests (_a, _b) of what the columns of the frames hold, null too, and no ``id`` of names is. Only digests move, and each once a task."""
    found = reduce(DataFrame.union, [rows.select(*_digest(c)) for rows, c in ends]).distinct()
    return found.join(names.filter("id IS NOT NULL").select(*_digest("id")), ["_a", "_b"], "left_anti")


def attached(rows: DataFrame, columns: Sequence[str], gone: DataFrame) -> DataFrame:
    """rows none of whose columns has a digest in ``gone`` (of ``dangling``). Where that is stored and small the rows don't move."""
    for c in columns:
        a, b = _digest(c)
        rows = rows.join(gone, (a == gone["_a"]) & (b == gone["_b"]), "left_anti")
    return rows


def remove(facts: Tables, removed: Tables) -> dict[str, DataFrame]:
    """facts after the removals and pruning, which happens even if nothing is removed.

    removed: rows of REMOVAL_KEYS for any tables. A unit takes its files, symbols and deps along; a file takes no
    symbols. Edges lose what has lost an end, diagnostics what has lost its file.
    """
    out = dict(facts)
    units = removed.get("units")
    out["units"] = without(facts["units"], units, {"id": "id"})
    out["files"] = without(without(facts["files"], removed.get("files"), {"id": "id"}), units, {"unit_id": "id"})
    out["symbols"] = without(without(facts["symbols"], removed.get("symbols"), {"id": "id"}), units, {"unit_id": "id"})
    deps = without(without(facts["deps"], units, {"from_unit_id": "id"}), units, {"to_unit_id": "id"})
    out["deps"] = without(deps, removed.get("deps"), {c: c for c in REMOVAL_KEYS["deps"]})
    for table, ends in EDGES.items():
        out[table] = _but(prune(facts[table], ends, out["symbols"]), ends, removed.get(table))
    kept = _within(facts["diagnostics"], "file_id", out["files"])
    out["diagnostics"] = without(kept, removed.get("diagnostics"), {c: c for c in REMOVAL_KEYS["diagnostics"]})
    return out


def apply_delta(facts: Tables, added: Tables | None = None, removed: Tables | None = None) -> dict[str, DataFrame]:
    """The next snapshot's tables. Added rows are appended as they are."""
    out = remove(facts, removed or {})
    for table, rows in (added or {}).items():
        out[table] = out[table].unionByName(rows, allowMissingColumns=True)
    return out


def new_diagnostics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Diagnostics of ``after`` whose key ``before`` doesn't have."""
    return without(after, before, {c: c for c in REMOVAL_KEYS["diagnostics"]})
