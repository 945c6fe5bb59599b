"""The provided business tables seen as facts: suppliers are units, parts files, orders symbols, line items edges.

One SQL text serves both Spark and the oracle; only the names of the sources and of the SHA-256 function differ. For symbols
and the edges between them Spark has texts of its own that mean the same: the joins carry numbers, and the ids, which are several
times as wide, are written out after the last one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SOURCES = ("supplier", "part", "orders", "lineitem", "events")

_CTES = {
    "units": "SELECT s_suppkey AS k, concat('unit:', CASE s_nationkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'ts' ELSE 'py' END, ':pkg/s', s_suppkey) AS id, concat(CASE s_nationkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'ts' ELSE 'py' END, '_package') AS kind, s_name AS name, concat('pkg/s', s_suppkey) AS path FROM {supplier}",
    "p0": "SELECT p_partkey AS k, p_partkey % (SELECT count(*) FROM {supplier}) AS uk, p_size % 10 = 0 AS generated FROM {part}",
    "files": "SELECT p0.k, concat('file:', u.path, '/f', p0.k) AS id, concat(u.path, '/f', p0.k) AS path, u.id AS unit_id, concat('sha256:', {sha}(concat('f', p0.k){bits})) AS hash, generated FROM p0 JOIN units u ON u.k = p0.uk",
    "o0": "SELECT o_orderkey AS k, o_orderkey % (SELECT count(*) FROM {part}) AS fk, CASE WHEN o_orderkey % 5 = 0 THEN 'type' ELSE 'func' END AS kind, concat('Fn', o_custkey) AS name, o_orderstatus = 'F' AS exported, CAST(o_orderkey % 500 + 1 AS INT) AS line FROM {orders}",
    "symbols": "SELECT o0.k, concat('sym:', f.path, '#', o0.kind, '#', o0.name, '#sig:', o0.k) AS id, f.unit_id, o0.name, o0.kind, o0.exported, f.id AS decl_file_id, o0.line FROM o0 JOIN files f ON f.k = o0.fk",
    "l0": "SELECT l_orderkey AS ak, (l_orderkey * 7 + l_partkey) % (SELECT count(*) FROM {orders}) AS bk, (l_partkey * 5) % (SELECT count(*) FROM {orders}) AS tk, l_suppkey AS uk, l_partkey % (SELECT count(*) FROM {supplier}) AS vk, l_linenumber AS line, l_returnflag, l_linestatus, l_tax FROM {lineitem}",
    "call_edges": "SELECT a.id AS caller_id, b.id AS callee_id, a.decl_file_id AS site_file_id, l0.line, CASE l_returnflag WHEN 'A' THEN 'static' WHEN 'N' THEN 'dynamic' ELSE 'interface' END AS dispatch FROM l0 JOIN symbols a ON a.k = l0.ak JOIN symbols b ON b.k = l0.bk",
    "refs": "SELECT a.id AS from_symbol_id, b.id AS to_symbol_id, a.decl_file_id AS site_file_id, l0.line, 'call' AS kind, CASE WHEN l_tax = 0 THEN 'speculative' WHEN l_linestatus = 'F' THEN 'certain' ELSE 'probable' END AS confidence FROM l0 JOIN symbols a ON a.k = l0.ak JOIN symbols b ON b.k = l0.bk",
    "type_relations": "SELECT a.id AS from_type_id, b.id AS to_type_id, CASE l_returnflag WHEN 'A' THEN 'implements' WHEN 'N' THEN 'embeds' ELSE 'instantiates' END AS kind FROM l0 JOIN symbols a ON a.k = l0.ak JOIN symbols b ON b.k = l0.tk WHERE a.kind = 'type' AND b.kind = 'type'",
    "d0": "SELECT DISTINCT uk, vk FROM l0 WHERE uk <> vk",
    "deps": "SELECT a.id AS from_unit_id, b.id AS to_unit_id, 'import' AS kind FROM d0 JOIN units a ON a.k = d0.uk JOIN units b ON b.k = d0.vk",
    "e0": "SELECT e.*, event_id % (SELECT count(*) FROM {part}) AS fk FROM {events} e",
    "diagnostics": "SELECT f.id AS file_id, CAST(e0.event_id % 300 + 1 AS INT) AS line, CAST(e0.user_id % 80 + 1 AS INT) AS col, CASE e0.event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'hint' END AS severity, e0.props AS message, 'go_vet' AS tool FROM e0 JOIN files f ON f.k = e0.fk",
    "n0": "SELECT e.event_id AS k, event_id % (SELECT count(*) FROM {supplier}) AS uk, event_id % (SELECT count(*) FROM {part}) AS fk, event_id % (SELECT count(*) FROM {orders}) AS sk, event_type, user_id, CAST(event_id * 37 % 101 AS DOUBLE) / 100 AS confidence FROM {events} e",
    "intent_tags": "SELECT u.id AS target_id, 'unit' AS target_kind, CASE event_type WHEN 'signup' THEN 'auth-guard' WHEN 'error' THEN 'error-handler' WHEN 'purchase' THEN 'repository' ELSE 'entry-point' END AS intent, n0.confidence FROM n0 JOIN units u ON u.k = n0.uk",
    "summaries": "SELECT f.id AS target_id, 'file' AS target_kind, concat('summary ', n0.k) AS text, n0.confidence FROM n0 JOIN files f ON f.k = n0.fk",
    "bug_smells": "SELECT f.id AS file_id, CAST(n0.k % 300 + 1 AS INT) AS line, CASE event_type WHEN 'error' THEN 'swallowed_error' WHEN 'click' THEN 'nil_check_missing' WHEN 'view' THEN 'race_condition' WHEN 'signup' THEN 'resource_leak' ELSE 'logic_error' END AS smell, CASE n0.k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, n0.confidence FROM n0 JOIN files f ON f.k = n0.fk",
    "pattern_tags": "SELECT u.id AS target_id, 'unit' AS target_kind, CASE n0.k % 4 WHEN 0 THEN 'factory' WHEN 1 THEN 'observer' WHEN 2 THEN 'singleton' ELSE 'adapter' END AS pattern, n0.confidence FROM n0 JOIN units u ON u.k = n0.uk",
    "naming_issues": "SELECT s.id AS symbol_id, CASE n0.k % 5 WHEN 0 THEN 'misleading' WHEN 1 THEN 'too_abbreviated' WHEN 2 THEN 'inconsistent' WHEN 3 THEN 'too_generic' ELSE 'other' END AS issue, s.name AS current_name, n0.confidence FROM n0 JOIN symbols s ON s.k = n0.sk",
}


def _symbol(x: str) -> dict[str, str]:
    """The columns of a symbol in terms of a row of g0."""
    kind, unit = f"CASE WHEN {x}.k % 5 = 0 THEN 'type' ELSE 'func' END", f"CASE {x}.lang WHEN 0 THEN 'go' WHEN 1 THEN 'ts' ELSE 'py' END"
    return {
        "id": f"concat('sym:pkg/s', {x}.uk, '/f', {x}.fk, '#', {kind}, '#Fn', {x}.c, '#sig:', {x}.k)",
        "unit": f"concat('unit:', {unit}, ':pkg/s', {x}.uk)",
        "file": f"concat('file:pkg/s', {x}.uk, '/f', {x}.fk)",
        "kind": kind,
    }


_A, _B, _G = _symbol("a"), _symbol("b"), _symbol("g0")
#: What Spark reads instead: g0 has the numbers of each symbol.
_NARROW = _CTES | {
    "g0": "SELECT o.k, o.c, o.exported, f0.fk, f0.uk, f0.lang FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus = 'F' AS exported, o_orderkey % (SELECT count(*) FROM {part}) AS fk FROM {orders}) o JOIN (SELECT p0.k AS fk, p0.uk, s_nationkey % 3 AS lang FROM p0 JOIN {supplier} ON s_suppkey = p0.uk) f0 ON f0.fk = o.fk",
    "symbols": f"SELECT k, {_G['id']} AS id, {_G['unit']} AS unit_id, concat('Fn', c) AS name, {_G['kind']} AS kind, exported, {_G['file']} AS decl_file_id, CAST(k % 500 + 1 AS INT) AS line FROM g0",
    "call_edges": f"SELECT {_A['id']} AS caller_id, {_B['id']} AS callee_id, {_A['file']} AS site_file_id, l0.line, CASE l_returnflag WHEN 'A' THEN 'static' WHEN 'N' THEN 'dynamic' ELSE 'interface' END AS dispatch FROM l0 JOIN g0 a ON a.k = l0.ak JOIN g0 b ON b.k = l0.bk",
    "refs": f"SELECT {_A['id']} AS from_symbol_id, {_B['id']} AS to_symbol_id, {_A['file']} AS site_file_id, l0.line, 'call' AS kind, CASE WHEN l_tax = 0 THEN 'speculative' WHEN l_linestatus = 'F' THEN 'certain' ELSE 'probable' END AS confidence FROM l0 JOIN g0 a ON a.k = l0.ak JOIN g0 b ON b.k = l0.bk",
    "type_relations": f"SELECT {_A['id']} AS from_type_id, {_B['id']} AS to_type_id, CASE l_returnflag WHEN 'A' THEN 'implements' WHEN 'N' THEN 'embeds' ELSE 'instantiates' END AS kind FROM l0 JOIN g0 a ON a.k = l0.ak JOIN g0 b ON b.k = l0.tk WHERE a.k % 5 = 0 AND b.k % 5 = 0",
}
_HELPERS = ("p0", "o0", "l0", "e0", "n0")
FACTS = ("units", "files", "deps", "symbols", "refs", "type_relations", "call_edges", "diagnostics")
INSIGHTS = ("intent_tags", "summaries", "bug_smells", "pattern_tags", "naming_issues")


def _needed(query: str, texts: dict[str, str]) -> list[str]:
    """The CTEs that a text uses, directly or through others, such that each follows those it uses."""
    found: list[str] = []

    def add(text: str) -> None:
        for name in texts:
            if name not in found and re.search(rf"\b{name}\b(?!\.)", re.sub(r"\{\w+\}", "", text)):
                add(texts[name])
                found.append(name)

    add(query)
    return [n for n in texts if n in found] if texts is _CTES else found


def _with(query: str, recursive: bool, extra: str, texts: dict[str, str], **names: str) -> str:
    ctes = ", ".join(f"{n} AS ({texts[n].format(**names)})" for n in _needed(query + extra, texts))
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{', ' if ctes and extra else ''}{extra} {query}"


def oracle(query: str, extra: str = "", recursive: bool = False) -> str:
    """A DuckDB query over the projected tables; extra: further CTEs."""
    return _with(query, recursive, extra, _CTES, sha="sha256", bits="", **{s: s for s in _SOURCES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One projected table, lazily; scans read only the columns it needs."""
    places = {s: f"parquet.`{sf_dir}/{s}.parquet`" for s in _SOURCES}
    out = spark.sql(_with(f"SELECT * FROM {name}", False, "", _NARROW, sha="sha2", bits=", 256", **places))
    return out.drop("k")


class Projected(dict):
    """Projected tables, made when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, names: tuple[str, ...] = FACTS):
        super().__init__()
        self._make = lambda name: table(spark, sf_dir, name)
        self._names = names

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._make(name)
        return self[name]

    def all(self) -> dict[str, DataFrame]:
        return {n: self[n] for n in self._names}
