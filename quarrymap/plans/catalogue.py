"""Registered queries over the projected tables, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.functions import scalars as S
from quarrymap.operators import delta, facts, fingerprint, graph, indexes, insights
from quarrymap.plans import jobs
from quarrymap.plans.adapters import Registry, all_ok, ranked
from quarrymap.plans.projection import Projected, oracle
from quarrymap.schemas import INSIGHT_ROWS, json_schema
from quarrymap.sources import golist, store
from quarrymap.sources.storage import new_place

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

U1, U2 = "unit:go:pkg/s3", "unit:go:pkg/s7"
CHANGED = ["pkg/s3/f3", "file:pkg/s5/f5", "pkg/s7/f7", "no/such/file"]
CHANGED_SQL = "changed AS (SELECT unnest(['file:pkg/s3/f3', 'file:pkg/s5/f5', 'file:pkg/s7/f7']) AS id), affected AS (SELECT DISTINCT unit_id FROM files WHERE id IN (SELECT id FROM changed))"


def register(name: str, sql: str | None = None, extra: str = "", recursive: bool = False, plain: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if plain else oracle(sql, extra, recursive)
        return f

    return add


def _facts(name: str, f: Callable[[Projected], DataFrame], sql: str, **more: object) -> None:
    register(name, sql, **more)(lambda spark, d: f(Projected(spark, d)))


def _first(rows: DataFrame, column: str) -> DataFrame:
    """The hot id (none of no rows), chosen by count and then by name so that both engines choose the same; part of the query's plan."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1).select(column)


def _hot_sql(table: str, column: str) -> str:
    return f"(SELECT {column} FROM {table} GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"


_facts("deps_of_unit", lambda t: facts.deps(t, _first(t["deps"], "from_unit_id")), f"SELECT * FROM deps WHERE from_unit_id = {_hot_sql('deps', 'from_unit_id')}")
_facts("rdeps_of_unit", lambda t: facts.rdeps(t, _first(t["deps"], "to_unit_id")), f"SELECT * FROM deps WHERE to_unit_id = {_hot_sql('deps', 'to_unit_id')}")
_SYMBOL = "id, unit_id, name, kind, exported, decl_file_id, line"
_facts("defs_by_name", lambda t: facts.defs_named(t, "Fn7"), f"SELECT {_SYMBOL} FROM symbols WHERE name = 'Fn7'")
_facts("defs_by_id", lambda t: facts.defs(t, id=_first(t["refs"], "to_symbol_id")), f"SELECT {_SYMBOL} FROM symbols WHERE id = {_hot_sql('refs', 'to_symbol_id')}")
_facts("defs_name_and_path", lambda t: facts.defs(t, name="Fn7", path="/f1"), f"SELECT {_SYMBOL} FROM symbols WHERE name = 'Fn7' AND decl_file_id IN (SELECT id FROM files WHERE contains(path, '/f1'))")
_facts("defs_by_path", lambda t: facts.defs(t, path="s3/f"), f"SELECT {_SYMBOL} FROM symbols WHERE decl_file_id IN (SELECT id FROM files WHERE contains(path, 's3/f'))")
_facts("defs_all", lambda t: facts.defs(t, name="", path=""), f"SELECT {_SYMBOL} FROM symbols")
_facts("refs_to_symbol", lambda t: facts.refs(t, _first(t["refs"], "to_symbol_id")), f"SELECT * FROM refs WHERE to_symbol_id = {_hot_sql('refs', 'to_symbol_id')}")
_facts("diag_repo", lambda t: facts.diagnostics(t), "SELECT * FROM diagnostics")
_facts("diag_file", lambda t: facts.diagnostics(t, file="pkg/s3/f3"), "SELECT * FROM diagnostics WHERE file_id = 'file:pkg/s3/f3'")
_facts("diag_unit", lambda t: facts.diagnostics(t, unit=_first(t["files"], "unit_id")), f"SELECT * FROM diagnostics WHERE file_id IN (SELECT id FROM files WHERE unit_id = {_hot_sql('files', 'unit_id')})")
_facts("impact_units", lambda t: facts.impact_units(t, CHANGED), "SELECT unit_id FROM affected", extra=CHANGED_SQL)
_facts("impact_deps", lambda t: facts.impact_deps(t, CHANGED), "SELECT * FROM deps WHERE from_unit_id IN (SELECT unit_id FROM affected) OR to_unit_id IN (SELECT unit_id FROM affected)", extra=CHANGED_SQL)
_facts("impls_of_type", lambda t: facts.impls(t, _first(t["type_relations"].filter("kind = 'implements'"), "to_type_id")), "SELECT * FROM type_relations WHERE kind = 'implements' AND to_type_id = (SELECT to_type_id FROM type_relations WHERE kind = 'implements' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
_facts("callers", lambda t: facts.callers(t, _first(t["call_edges"], "callee_id")), f"SELECT * FROM call_edges WHERE callee_id = {_hot_sql('call_edges', 'callee_id')}")
_facts("callees", lambda t: facts.callees(t, _first(t["call_edges"], "caller_id")), f"SELECT * FROM call_edges WHERE caller_id = {_hot_sql('call_edges', 'caller_id')}")

_facts("intents_of_unit", lambda t: insights.intents(t, _first(t["intent_tags"], "target_id")), f"SELECT * FROM intent_tags WHERE confidence >= 0 AND target_id = {_hot_sql('intent_tags', 'target_id')}")
_facts("intents_confident", lambda t: insights.intents(t, least=0.8), "SELECT * FROM intent_tags WHERE confidence >= 0.8")
_facts("summaries_confident", lambda t: insights.summaries(t, least=0.9), "SELECT * FROM summaries WHERE confidence >= 0.9")
_facts("summaries_of_file", lambda t: insights.summaries(t, "file:pkg/s3/f3"), "SELECT * FROM summaries WHERE target_id = 'file:pkg/s3/f3' AND confidence >= 0")
_facts("smells_high", lambda t: insights.smells(t, "", "high", 0.5), "SELECT * FROM bug_smells WHERE severity = 'high' AND confidence >= 0.5")
_facts("smells_of_file", lambda t: insights.smells(t, "file:pkg/s3/f3"), "SELECT * FROM bug_smells WHERE file_id = 'file:pkg/s3/f3' AND confidence >= 0")
_facts("patterns_factory", lambda t: insights.patterns(t, "factory"), "SELECT * FROM pattern_tags WHERE pattern = 'factory' AND confidence >= 0")
_facts("naming_confident", lambda t: insights.naming(t, least=0.7), "SELECT * FROM naming_issues WHERE confidence >= 0.7")
_facts("naming_of_symbol", lambda t: insights.naming(t, _first(t["naming_issues"], "symbol_id")), f"SELECT * FROM naming_issues WHERE symbol_id = {_hot_sql('naming_issues', 'symbol_id')} AND confidence >= 0")
_facts(
    "insight_scope_files",
    lambda t: insights.scoped_files(t, files=["file:pkg/s3/f3", "file:gone"], units=[U1, "unit:py:pkg/s4", "unit:ts:pkg/s4"], symbols=_first(t["refs"], "to_symbol_id")),
    f"SELECT id, path, unit_id, hash, generated FROM files WHERE id = 'file:pkg/s3/f3' OR unit_id IN ('{U1}', 'unit:py:pkg/s4', 'unit:ts:pkg/s4') OR id IN (SELECT decl_file_id FROM symbols WHERE id = {_hot_sql('refs', 'to_symbol_id')})",
)

_facts("idx_unit_by_file", lambda t: indexes.unit_by_file(t["files"]), "SELECT id AS file_id, max(unit_id) AS unit_id FROM files GROUP BY id")
_facts("idx_unit_by_path", lambda t: indexes.unit_by_path(t["units"]), "SELECT path, max(id) AS unit_id FROM units GROUP BY path")
_facts("idx_symbol_by_name", lambda t: indexes.symbol_by_name(t["symbols"]).select("name", F.concat_ws(",", "ids").alias("ids")), "SELECT name, string_agg(id, ',' ORDER BY id) AS ids FROM symbols GROUP BY name")
_facts("idx_refs_by_symbol", lambda t: indexes.refs_by_symbol(t["refs"]).select("to_symbol_id", F.concat_ws(",", F.sort_array(F.transform("refs", lambda r: F.concat_ws("@", r["from_symbol_id"], r["line"].cast("string"))))).alias("refs")), "SELECT to_symbol_id, string_agg(from_symbol_id || '@' || line, ',' ORDER BY from_symbol_id || '@' || line) AS refs FROM refs GROUP BY 1")
_facts("idx_ref_counts", lambda t: indexes.ref_counts(t["refs"]), "SELECT to_symbol_id, count(*) AS n FROM refs GROUP BY 1")


def _removed(t: Projected) -> dict[str, DataFrame]:
    """A fixed removal of every kind."""
    spark = t["units"].sparkSession
    ids = lambda rows: spark.createDataFrame([(r,) for r in rows], "id string")
    return {
        "units": t["units"].filter(F.col("path").isin("pkg/s1", "pkg/s2")).select("id"),
        "files": ids(["file:pkg/s3/f3", "file:pkg/s4/f4"]),
        "symbols": t["symbols"].filter(F.col("name") == "Fn7").select("id"),
        "deps": t["deps"].filter(F.col("from_unit_id").endswith("s5")).select("from_unit_id", "to_unit_id"),
        "refs": t["refs"].filter("line = 1 AND confidence = 'certain'").select("from_symbol_id", "to_symbol_id").distinct(),
        "type_relations": t["type_relations"].filter("kind = 'embeds'").select("from_type_id", "to_type_id").distinct(),
        "call_edges": t["call_edges"].filter("dispatch = 'static' AND line = 2").select("caller_id", "callee_id").distinct(),
        "diagnostics": t["diagnostics"].filter("line = 8").select("file_id", "line", "col", "message"),
    }


_DELTA_SQL = """ru AS (SELECT id FROM units WHERE path IN ('pkg/s1', 'pkg/s2')),
ks AS (SELECT * FROM symbols s WHERE name <> 'Fn7' AND NOT EXISTS (SELECT 1 FROM ru WHERE ru.id = s.unit_id)),
kf AS (SELECT * FROM files f WHERE id NOT IN ('file:pkg/s3/f3', 'file:pkg/s4/f4') AND NOT EXISTS (SELECT 1 FROM ru WHERE ru.id = f.unit_id))"""
#: Rows that are added again, of each table: appended as they are, whatever was removed.
_ADDED = {
    "units": "kind = 'go_package'",
    "files": "generated",
    "symbols": "kind = 'type' AND exported",
    "refs": "line = 3 AND confidence = 'probable'",
    "type_relations": "kind = 'implements'",
    "call_edges": "line = 4 AND dispatch = 'interface'",
    "diagnostics": "severity = 'error'",
}


def _delta(name: str, sql: str, columns: str = "*") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = Projected(spark, d)
        added = {"deps": spark.createDataFrame([("unit:go:new", U1, "import")] * 2, "from_unit_id string, to_unit_id string, kind string")}
        return delta.apply_delta(t.all(), added | {n: t[n].filter(w) for n, w in _ADDED.items()}, _removed(t))[name]

    again = f" UNION ALL SELECT {columns} FROM {name} WHERE {_ADDED[name]}" if name in _ADDED else ""
    register(f"delta_{name}", sql + again, extra=_DELTA_SQL)(run)


_delta("units", "SELECT id, kind, name, path FROM units WHERE id NOT IN (SELECT id FROM ru)", "id, kind, name, path")
_delta("files", "SELECT id, path, unit_id, hash, generated FROM kf", "id, path, unit_id, hash, generated")
_delta("symbols", f"SELECT {_SYMBOL} FROM ks", _SYMBOL)
_delta("deps", f"SELECT * FROM deps WHERE from_unit_id NOT IN (SELECT id FROM ru) AND to_unit_id NOT IN (SELECT id FROM ru) AND NOT ends_with(from_unit_id, 's5') UNION ALL SELECT 'unit:go:new', '{U1}', 'import' UNION ALL SELECT 'unit:go:new', '{U1}', 'import'")
_ENDS = "EXISTS (SELECT 1 FROM ks WHERE ks.id = e.{0}) AND EXISTS (SELECT 1 FROM ks WHERE ks.id = e.{1}) AND NOT EXISTS (SELECT 1 FROM {2} x WHERE x.{0} = e.{0} AND x.{1} = e.{1} AND {3})"
_delta("refs", "SELECT * FROM refs e WHERE " + _ENDS.format("from_symbol_id", "to_symbol_id", "refs", "x.line = 1 AND x.confidence = 'certain'"))
_delta("type_relations", "SELECT * FROM type_relations e WHERE " + _ENDS.format("from_type_id", "to_type_id", "type_relations", "x.kind = 'embeds'"))
_delta("call_edges", "SELECT * FROM call_edges e WHERE " + _ENDS.format("caller_id", "callee_id", "call_edges", "x.dispatch = 'static' AND x.line = 2"))
_delta("diagnostics", "SELECT * FROM diagnostics WHERE file_id IN (SELECT id FROM kf) AND line <> 8")
_facts("prune_dangling_edges", lambda t: delta.prune(t["call_edges"], ("caller_id", "callee_id"), t["symbols"].filter("exported")), "SELECT * FROM call_edges WHERE caller_id IN (SELECT id FROM symbols WHERE exported) AND callee_id IN (SELECT id FROM symbols WHERE exported)")
_facts("new_diagnostics", lambda t: delta.new_diagnostics(t["diagnostics"].filter("severity <> 'error'"), t["diagnostics"]), "SELECT * FROM diagnostics d WHERE NOT EXISTS (SELECT 1 FROM diagnostics b WHERE b.severity <> 'error' AND b.file_id = d.file_id AND b.line = d.line AND b.col = d.col AND b.message = d.message)")

_facts("units_by_language", lambda t: facts.units_by_language(t["units"]), "SELECT split_part(id, ':', 2) AS lang, count(*) AS n FROM units GROUP BY 1")
_facts("units_of_language", lambda t: golist.of_go(t["units"]), "SELECT id, kind, name, path FROM units WHERE starts_with(id, 'unit:go:')")
_facts("table_counts", lambda t: facts.table_counts(t.all()), " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {n}" for n in ("units", "files", "deps", "symbols", "refs", "type_relations", "call_edges", "diagnostics")))
_facts("interface_dispatch_expanded", lambda t: graph.expanded_calls(t), "SELECT caller_id, callee_id FROM call_edges UNION SELECT c.caller_id, r.from_type_id FROM call_edges c JOIN type_relations r ON r.to_type_id = c.callee_id WHERE c.dispatch = 'interface' AND r.kind = 'implements'")
_facts("dep_closure", lambda t: graph.closure(t["deps"].select(F.col("from_unit_id").alias("src"), F.col("to_unit_id").alias("dst"))), "SELECT src, dst FROM reach", extra="reach AS (SELECT from_unit_id AS src, to_unit_id AS dst FROM deps UNION SELECT reach.src, d.to_unit_id FROM reach JOIN deps d ON d.from_unit_id = reach.dst)", recursive=True)
_UP = CHANGED_SQL + ", up AS (SELECT unit_id FROM affected UNION SELECT d.from_unit_id FROM up JOIN deps d ON d.to_unit_id = up.unit_id)"
_facts("impact_transitive", lambda t: graph.impact_transitive(t, CHANGED), "SELECT unit_id FROM up", extra=_UP, recursive=True)
_facts("impact_symbols", lambda t: graph.impact_symbols(t, CHANGED), "SELECT id AS symbol_id FROM reach", extra=CHANGED_SQL + ", edges AS (SELECT callee_id AS src, caller_id AS dst FROM call_edges UNION SELECT to_type_id, from_type_id FROM type_relations), reach AS (SELECT s.id FROM symbols s JOIN affected a ON a.unit_id = s.unit_id UNION SELECT e.dst FROM reach JOIN edges e ON e.src = reach.id)", recursive=True)
_facts("intent_filtered_impact", lambda t: graph.impact_with_intent(t, t["intent_tags"], CHANGED, "auth-guard"), "SELECT DISTINCT unit_id, intent FROM up JOIN intent_tags i ON i.target_id = up.unit_id AND i.intent = 'auth-guard'", extra=_UP, recursive=True)


@register("internal_imports", "SELECT 'unit:go:.' AS from_unit_id, concat('unit:go:', path) AS to_unit_id, 'import' AS kind FROM units WHERE starts_with(id, 'unit:go:')")
def _internal_imports(spark: SparkSession, d: str) -> DataFrame:
    t = Projected(spark, d)
    pkgs = t["units"].select(F.concat(F.lit("example.com/m/"), "path").alias("ImportPath"), "name", F.concat(F.lit("/repo/"), "path").alias("Dir"), F.lit(False).alias("Standard"))
    imports = pkgs.select(F.lit("unit:go:.").alias("from_unit_id"), F.col("ImportPath").alias("import_path")).unionByName(pkgs.select(F.lit("unit:go:.").alias("from_unit_id"), F.lit("fmt").alias("import_path")))
    return golist.internal_deps(imports, pkgs, golist.of_go(t["units"]), "example.com/m", "/repo")


@register("vet_parse", "SELECT concat('file:', path) AS file_id, CAST(k % 97 + 1 AS INT) AS line, CAST(CASE WHEN k % 2 = 0 THEN k % 13 + 1 ELSE 1 END AS INT) AS col, 'warning' AS severity, concat('result of call ', k, ' not used') AS message, 'go_vet' AS tool FROM files")
def _vet(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("path", r"f(\d+)$", 1).cast("long")
    column = F.when(k % 2 == 0, F.concat(F.lit(":"), (k % 13 + 1).cast("string"))).otherwise("")
    text = F.concat(F.lit("# pkg\n./"), "path", F.lit(":"), (k % 97 + 1).cast("string"), column, F.lit(": result of call "), k.cast("string"), F.lit(" not used\n\nexit status 1"))
    return golist.vet_diagnostics(Projected(spark, d)["files"].select(text.alias("text")))


@register("file_hashes", "SELECT page_id AS id, concat('sha256:', sha256(html)) AS hash, contains(substr(html, 1, 1024), '// Code generated') AS generated FROM pages", plain=True)
def _hashes(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html").cast("binary")
    return spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), S.content_hash(html).alias("hash"), S.is_generated(html).alias("generated"))


@register("languages_ranked", "SELECT n_name AS lang, CAST(n_nationkey % 4 AS DOUBLE) / 4 AS confidence, row_number() OVER (ORDER BY n_nationkey % 4 DESC, n_nationkey) AS rank FROM nation WHERE n_regionkey <> 3", plain=True)
def _ranked(spark: SparkSession, d: str) -> DataFrame:
    found = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("lang"), (F.col("n_regionkey") != 3).alias("supported"), ((F.col("n_nationkey") % 4).cast("double") / 4).alias("confidence"), F.col("n_nationkey").alias("place"))
    return ranked(found).withColumn("rank", F.col("rank").cast("long"))


@register("actions_ok", "SELECT o_orderpriority AS action, coalesce(bool_and(o_orderstatus <> 'P'), true) AS ok FROM orders GROUP BY 1", plain=True)
def _actions(spark: SparkSession, d: str) -> DataFrame:
    return all_ok(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("action"), (F.col("o_orderstatus") != "P").alias("ok")), "action")


@register("fingerprint_diff", "SELECT 'tools' AS section, n_name AS key, CASE WHEN n_nationkey >= 5 THEN CAST(n_regionkey AS VARCHAR) END AS old, CASE WHEN n_nationkey < 20 THEN CAST(n_regionkey + CASE WHEN n_nationkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS new FROM nation WHERE n_nationkey < 5 OR n_nationkey >= 20 OR n_nationkey % 7 = 0", plain=True)
def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    nation = spark.read.parquet(f"{d}/nation.parquet")

    def made(rows: DataFrame, value: object) -> DataFrame:
        tools = rows.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_name"), value.cast("string").alias("v")))).alias("tools"))
        return tools.select(F.lit(1).alias("schema_version"), "tools", F.create_map(F.lit("os"), F.lit("linux")).alias("build_profile"))

    now = made(nation.filter("n_nationkey < 20"), F.col("n_regionkey") + F.when(F.col("n_nationkey") % 7 == 0, 1).otherwise(0))
    return fingerprint.differences(now, made(nation.filter("n_nationkey >= 5"), F.col("n_regionkey")))


@register("scalar_functions", "SELECT id, concat('file:', path) AS of_path, id AS of_id, path AS relative, substr(sha256(path), 1, 8) AS signature, concat(path, '|', unit_id) AS joined, split_part(unit_id, ':', 2) AS lang, CAST(regexp_extract(path, 'f(\\d+)$', 1) AS INT) AS number, 7 AS fallback FROM files")
def _scalars(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return Projected(spark, d)["files"].select(
        "id",
        S.file_id(path).alias("of_path"),
        S.file_id(F.col("id")).alias("of_id"),
        S.relative_path(F.concat(F.lit("/repo/./"), path), "/repo").alias("relative"),
        S.symbol_signature(path).alias("signature"),
        S.join_present([path, F.lit(""), F.lit(None).cast("string"), F.col("unit_id")], "|").alias("joined"),
        S.language_of(F.col("unit_id")).alias("lang"),
        S.int_or(F.regexp_extract(path, r"f(\d+)$", 1), 0).alias("number"),
        S.int_or(F.regexp_extract(path, "none(x)?", 1), 7).alias("fallback"),
    )


@register("jsonl_roundtrip", f"SELECT {_SYMBOL} FROM symbols")
def _jsonl(spark: SparkSession, d: str) -> DataFrame:
    """All tables written as JSON lines to the shared folder and read again; the symbols of what was read."""
    root = new_place(spark, "jsonl")
    store.write_facts_jsonl(spark, root, {"symbols": Projected(spark, d)["symbols"]})
    return store.read_facts_jsonl(spark, root)["symbols"].select(*_SYMBOL.split(", "))


@register("snapshot_roundtrip", "SELECT from_symbol_id, to_symbol_id, site_file_id, line, kind, confidence FROM refs")
def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots, of which the second is the current one; its refs."""
    root, t = new_place(spark, "snapshots"), Projected(spark, d)
    store.write_snapshot(spark, root, {"refs": t["refs"].filter("line = 1")})
    store.write_snapshot(spark, root, {"refs": t["refs"]})
    return store.load_facts(spark, root)["refs"]


#: Listings of the units as packages: pretty JSON values one after the other, with braces in strings and a library package.
_MODULE, _REPO = "example.com/m", "/repo"
LISTED = 16


def _listing(t: Projected) -> DataFrame:
    """text: listings of about LISTED packages, each of one language. A package has its unit's files and imports what its unit depends on, and fmt; each language lists fmt once."""
    name = F.substring_index("path", "/", -1)
    own = t["files"].groupBy("unit_id").agg(F.sort_array(F.collect_list(name)).alias("GoFiles"))
    place = F.concat(F.lit(_MODULE + "/"), F.split("to_unit_id", ":")[2])
    used = t["deps"].groupBy("from_unit_id").agg(F.sort_array(F.collect_list(place)).alias("used"))
    rows = t["units"].join(own, F.col("id") == F.col("unit_id"), "left").join(used, F.col("id") == F.col("from_unit_id"), "left")
    package = F.struct(
        F.concat(F.lit(_MODULE + "/"), "path").alias("ImportPath"), F.lit("a}{b").alias("Name"), F.concat(F.lit(_REPO + "/"), "path").alias("Dir"), "GoFiles",
        F.concat(F.array(F.lit("fmt")), F.coalesce("used", F.array().cast("array<string>"))).alias("Imports"), F.lit(False).alias("Standard"), F.struct(F.lit(_MODULE).alias("Path")).alias("Module"),
    )
    one = F.concat(F.to_json(package, {"pretty": "true"}), F.lit("\n"))
    library = F.lit('{"ImportPath": "fmt", "Name": "fmt", "Dir": "/go/fmt", "GoFiles": ["f.go"], "Imports": [], "Standard": true}')
    parts = t["units"].agg(F.ceil(F.count("*") / LISTED).alias("parts"))
    listed = rows.crossJoin(parts).select(S.language_of(F.col("id")).alias("lang"), F.pmod(F.xxhash64("id"), "parts").alias("part"), one.alias("one"))
    listed = listed.unionByName(t["units"].select(S.language_of(F.col("id")).alias("lang")).distinct().select("lang", F.lit(0).cast("long").alias("part"), library.alias("one")))
    return listed.groupBy("lang", "part").agg(F.array_join(F.sort_array(F.collect_list("one")), "").alias("text"))


def _packages(spark: SparkSession, d: str) -> tuple[Projected, DataFrame, DataFrame]:
    t = Projected(spark, d)
    pkgs = golist.parse_packages(_listing(t))
    return t, pkgs, golist.units(pkgs, _REPO)


@register("concat_json", "SELECT concat('example.com/m/', path) AS ImportPath, 'a}{b' AS Name, false AS Standard FROM units UNION ALL SELECT 'fmt', 'fmt', true FROM (SELECT DISTINCT split_part(id, ':', 2) FROM units)")
def _concat_json(spark: SparkSession, d: str) -> DataFrame:
    return golist.parse_packages(_listing(Projected(spark, d))).select("ImportPath", "Name", "Standard")


@register("listing_units", "SELECT concat('unit:go:', path) AS id, 'go_package' AS kind, 'a}{b' AS name, path, concat('example.com/m/', path) AS import_path FROM units")
def _listing_units(spark: SparkSession, d: str) -> DataFrame:
    _, _, units = _packages(spark, d)
    return units.select("id", "kind", "name", "path", F.col("metadata")["import_path"].alias("import_path"))


@register("listing_files", "SELECT f.id, f.path, concat('unit:go:', u.path) AS unit_id, f.hash, f.generated FROM files f JOIN units u ON u.id = f.unit_id")
def _listing_files(spark: SparkSession, d: str) -> DataFrame:
    t, pkgs, units = _packages(spark, d)
    return golist.files(pkgs, units, _REPO, t["files"].select("path", "hash", "generated"))


@register("listing_deps", "SELECT concat('unit:go:', split_part(from_unit_id, ':', 3)) AS from_unit_id, concat('unit:go:', split_part(to_unit_id, ':', 3)) AS to_unit_id, kind FROM deps")
def _listing_deps(spark: SparkSession, d: str) -> DataFrame:
    _, pkgs, units = _packages(spark, d)
    return golist.deps(pkgs, units, _MODULE, _REPO)


class ProjectedAdapter:
    """The projected tables as what an adapter lists; ``old`` lacks some symbols of one unit and the edges at them."""

    lang = "go"

    def __init__(self, t: Projected, old: bool):
        self.t, self.old = t, old

    def detect(self, spark: SparkSession, root: str) -> tuple[bool, float]:
        return True, 1.0

    def doctor(self) -> tuple[bool, list[str], list[str]]:
        return True, [], []

    def enumerate_units(self, spark: SparkSession, root: str) -> DataFrame:
        return self.t["units"]

    def index_units(self, spark: SparkSession, root: str, units: DataFrame) -> dict[str, DataFrame]:
        made = {n: self.t[n] for n in ("files", "deps", "symbols", "refs", "type_relations", "call_edges")} | {"units": units}
        if self.old:
            made["symbols"] = made["symbols"].filter(f"unit_id <> '{U1}' OR kind = 'type'")
            made["deps"] = made["deps"].filter(f"from_unit_id <> '{U1}' AND to_unit_id <> '{U1}'")
        return made

    def diagnose(self, spark: SparkSession, root: str) -> DataFrame:
        return self.t["diagnostics"]


def _updated(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A build of the old listing brought up to date with the new one, for a changed file of U1 and one that nobody knows."""
    root, t = new_place(spark, "facts"), Projected(spark, d)
    for step in (True, False):
        registry = Registry()
        registry.register(ProjectedAdapter(t, step))
        if step:
            jobs.index_facts(spark, registry, root, root)
        else:
            jobs.update_facts(spark, registry, root, root, [f"{U1.split(':')[2]}/f{U1.rsplit('s', 1)[1]}", "no/such/file"])
    return store.load_facts(spark, root)


# A unit's replacement takes edges along, of both directions; afterwards all is what a build of the new listing gives.
for _table, _columns in {"symbols": _SYMBOL, "call_edges": "caller_id, callee_id, site_file_id, line, dispatch", "refs": "from_symbol_id, to_symbol_id, site_file_id, line, kind, confidence", "deps": "from_unit_id, to_unit_id, kind"}.items():
    register(f"update_{_table}", f"SELECT {_columns} FROM {_table}")(lambda spark, d, n=_table, c=_columns: _updated(spark, d)[n].select(*c.split(", ")))


@register("snapshot_lookup", f"SELECT caller_id, callee_id, line, dispatch FROM call_edges WHERE caller_id = {_hot_sql('call_edges', 'caller_id')}")
def _lookup(spark: SparkSession, d: str) -> DataFrame:
    """Calls of a symbol by the index of a stored snapshot, whose scan gets the filter."""
    root, t = new_place(spark, "snapshots"), Projected(spark, d)
    store.write_snapshot(spark, root, {"call_edges": t["call_edges"]})
    calls = store.load_index(spark, root, "calls_by_caller")
    hot = _first(calls, "caller_id").first()
    return facts.callees({"call_edges": calls}, hot[0] if hot else "").select("caller_id", "callee_id", "line", "dispatch")


@register("index_roundtrip", "SELECT 'unit_by_file' AS index, id AS key, unit_id AS value FROM files UNION ALL SELECT 'symbol_by_name', name, id FROM symbols UNION ALL SELECT 'symbol_by_id', id, name FROM symbols")
def _indexes(spark: SparkSession, d: str) -> DataFrame:
    root, t = new_place(spark, "snapshots"), Projected(spark, d)
    store.write_snapshot(spark, root, {n: t[n] for n in ("files", "symbols")})
    load = lambda name, key, value: store.load_index(spark, root, name).select(F.lit(name).alias("index"), F.col(key).alias("key"), F.col(value).alias("value"))
    return load("unit_by_file", "file_id", "unit_id").union(load("symbol_by_name", "name", "id")).union(load("symbol_by_id", "id", "name"))


@register("json_roundtrip", "SELECT id, path, unit_id, hash, generated FROM files")
def _json(spark: SparkSession, d: str) -> DataFrame:
    """facts.json, the export for small stores, written and read again."""
    root = new_place(spark, "json")
    store.write_facts(spark, root, {"files": Projected(spark, d)["files"]})
    return store.load_facts(spark, root)["files"].select("id", "path", "unit_id", "hash", "generated")


def _with_model(rows: DataFrame) -> DataFrame:
    """Annotations as they are stored; two models made them."""
    meta = F.struct(F.when(F.col("confidence") < 0.5, "a").otherwise("b").alias("model"), "confidence", F.lit("t").alias("generated_at"))
    return rows.select("target_id", "target_kind", "intent", F.lit("r").alias("reasoning"), meta.alias("meta"))


@register("insights_roundtrip", "SELECT target_id, intent, confidence FROM intent_tags WHERE confidence >= 0.3")
def _annotations(spark: SparkSession, d: str) -> DataFrame:
    """All annotations written and read again; the intents of some confidence."""
    root = new_place(spark, "insights")
    made = {n: spark.createDataFrame([], json_schema(n)) for n in INSIGHT_ROWS} | {"intent_tags": _with_model(Projected(spark, d)["intent_tags"])}
    store.write_insights(root, made)
    return insights.intents(store.load_insights(spark, root), least=0.3).select("target_id", "intent", "meta.confidence")


_facts("insights_of_model", lambda t: insights.of_model(_with_model(t["intent_tags"]), "b").select("target_id", "intent"), "SELECT target_id, intent FROM intent_tags WHERE confidence >= 0.5")


@register("map_override", "SELECT r_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS value, n_name AS key FROM nation JOIN region ON r_regionkey = n_regionkey", plain=True)
def _override(spark: SparkSession, d: str) -> DataFrame:
    """A map of each region's nations, overridden by one of those with even keys."""
    nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    entry = lambda v: F.struct(F.col("n_name"), F.lit(v))
    maps = nation.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(entry("old"))).alias("base"), F.map_from_entries(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, entry("new")))).alias("by"))
    out = maps.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), F.explode(S.overridden(F.col("base"), F.col("by"))).alias("key", "value"))
    return out.select("name", "value", "key")


@register("iso_now", "SELECT n_nationkey AS id, true AS is_iso, true AS is_recent FROM nation", plain=True)
def _now(spark: SparkSession, d: str) -> DataFrame:
    now = S.now_iso()
    recent = F.abs(F.unix_timestamp(F.to_timestamp(now)) - F.unix_timestamp(F.current_timestamp())) < 5
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), now.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$").alias("is_iso"), recent.alias("is_recent"))


@register("paths_relative", "SELECT id, path AS below, concat('../other/', path) AS beside, '' AS root, path AS trimmed FROM files")
def _paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    at = lambda prefix: S.relative_path(F.concat(F.lit(prefix), path), "/repo/x")
    return Projected(spark, d)["files"].select("id", at("/repo/./y/../x//").alias("below"), at("/repo/other/").alias("beside"), S.relative_path(F.lit("/repo/x/"), "/repo/x").alias("root"), S.trimmed(F.concat(F.lit("\t \u00a0\n"), path, F.lit("\r\n"))).alias("trimmed"))
