"""Literal fixtures of the fact queries, indexes and deltas."""

import pytest

from quarrymap.operators import delta, facts, graph, indexes

SCHEMAS = {
    "units": "id string, kind string, name string, path string",
    "files": "id string, path string, unit_id string, hash string, generated boolean",
    "deps": "from_unit_id string, to_unit_id string, kind string",
    "symbols": "id string, unit_id string, name string, kind string, exported boolean, decl_file_id string, line int",
    "refs": "from_symbol_id string, to_symbol_id string, site_file_id string, line int, kind string, confidence string",
    "type_relations": "from_type_id string, to_type_id string, kind string",
    "call_edges": "caller_id string, callee_id string, site_file_id string, line int, dispatch string",
    "diagnostics": "file_id string, line int, col int, severity string, message string, tool string",
}
ROWS = {
    "units": [("unit:go:a", "go_package", "a", "a"), ("unit:go:b", "go_package", "b", "b")],
    "files": [("file:a/x%.go", "a/x%.go", "unit:go:a", "h", False), ("file:a/y.go", "a/y.go", "unit:go:a", "h", True), ("file:b/z_1.go", "b/z_1.go", "unit:go:b", "h", False)],
    "deps": [("unit:go:a", "unit:go:b", "import"), ("unit:go:a", "unit:go:b", "import"), ("unit:go:b", "unit:go:a", "import"), ("unit:go:a", "unit:go:c", "import")],
    "symbols": [("s1", "unit:go:a", "Lib", "func", True, "file:a/x%.go", 1), ("s2", "unit:go:a", "Lib", "func", True, "file:a/y.go", 2), ("s3", "unit:go:b", "constructor", "type", False, "file:b/z_1.go", 3), ("s4", "unit:go:b", "", "type", False, "file:gone", 3)],
    "refs": [("s1", "s3", "file:a/x%.go", 1, "call", "certain"), ("s1", "s3", "file:a/x%.go", 1, "call", "certain"), ("s2", "gone", "file:a/y.go", 5, "call", "probable")],
    "type_relations": [("s3", "s4", "implements"), ("s3", "s4", "embeds")],
    "call_edges": [("s1", "s2", "file:a/x%.go", 7, "static"), ("s2", "s4", "file:a/y.go", 8, "interface")],
    "diagnostics": [("file:a/x%.go", 5, 1, "warning", "m", "t"), ("file:a/x%.go", 5, 2, "warning", "m", "t"), ("file:orphan", 1, 1, "error", "o", "t")],
}


@pytest.fixture(scope="module")
def store(spark):
    return {t: spark.createDataFrame(ROWS[t], s).cache() for t, s in SCHEMAS.items()}


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_deps_are_a_bag_both_ways(store):
    assert facts.deps(store, "unit:go:a").count() == 3
    assert facts.rdeps(store, "unit:go:b").count() == 2
    assert facts.deps(store, "none").count() == 0


def test_defs(store):
    assert ids(facts.defs(store, name="Lib")) == ["s1", "s2"]
    assert ids(facts.defs(store, name="constructor")) == ["s3"]
    assert ids(facts.defs(store)) == ["s1", "s2", "s3", "s4"]
    assert ids(facts.defs(store, name="", path="", id="")) == ["s1", "s2", "s3", "s4"]
    assert ids(facts.defs(store, path="%")) == ["s1"]
    assert ids(facts.defs(store, path="z_1")) == ["s3"]
    assert ids(facts.defs(store, name="Lib", path="y.go", id="s2")) == ["s2"]
    assert ids(facts.defs_named(store, "")) == ["s4"]


def test_diagnostics(store):
    assert facts.diagnostics(store).count() == 3
    assert facts.diagnostics(store, file="a/x%.go").count() == facts.diagnostics(store, file="file:a/x%.go").count() == 2
    assert facts.diagnostics(store, unit="unit:go:a").count() == 2
    assert facts.diagnostics(store, unit="unit:go:b").count() == 0


def test_impact_is_one_hop_and_keeps_duplicates(store):
    assert ids(facts.impact_units(store, ["b/z_1.go", "file:b/z_1.go", "nope"]), "unit_id") == ["unit:go:b"]
    assert facts.impact_deps(store, ["b/z_1.go"]).count() == 3
    assert facts.impact_deps(store, []).count() == 0


def test_calls_types_refs(store):
    assert facts.refs(store, "s3").count() == 2
    assert facts.impls(store, "s4").count() == 1
    assert ids(facts.callers(store, "s2"), "caller_id") == ["s1"]
    assert ids(facts.callees(store, "s2"), "callee_id") == ["s4"]


def test_indexes_answer_like_scans(store):
    by_name = {r["name"]: r["ids"] for r in indexes.symbol_by_name(store["symbols"]).collect()}
    assert by_name["Lib"] == ["s1", "s2"] and by_name["constructor"] == ["s3"]
    by_symbol = {r["to_symbol_id"]: len(r["refs"]) for r in indexes.refs_by_symbol(store["refs"]).collect()}
    assert by_symbol == {"s3": 2, "gone": 1}
    assert {r["file_id"]: r["unit_id"] for r in indexes.unit_by_file(store["files"]).collect()}["file:a/y.go"] == "unit:go:a"


def test_empty_delta_prunes_what_dangles(store):
    once = delta.apply_delta(store)
    assert once["refs"].count() == 2 and once["diagnostics"].count() == 2
    twice = delta.apply_delta(once)
    assert {t: df.count() for t, df in twice.items()} == {t: df.count() for t, df in once.items()}


def test_removing_a_unit_cascades(spark, store):
    out = delta.apply_delta(store, removed={"units": spark.createDataFrame([("unit:go:b",)], "id string")})
    counts = {t: df.count() for t, df in out.items()}
    assert counts == {"units": 1, "files": 2, "deps": 1, "symbols": 2, "refs": 0, "type_relations": 0, "call_edges": 1, "diagnostics": 2}


def test_removal_by_keys_of_several_columns(spark, store):
    removed = {
        "deps": spark.createDataFrame([("unit:go:a", "unit:go:b")], "from_unit_id string, to_unit_id string"),
        "diagnostics": spark.createDataFrame([("file:a/x%.go", 5, 1, "m")], "file_id string, line int, col int, message string"),
        "files": spark.createDataFrame([("file:a/y.go",)], "id string"),
    }
    out = delta.apply_delta(store, {"deps": store["deps"].limit(1)}, removed)
    assert out["deps"].count() == 3 and out["diagnostics"].count() == 1
    assert out["symbols"].count() == 4, "a removed file takes no symbols"


def test_closure_and_reach_on_cycles(spark, store):
    edges = store["deps"].selectExpr("from_unit_id AS src", "to_unit_id AS dst")
    pairs = {(r.src[-1], r.dst[-1]) for r in graph.closure(edges).collect()}
    assert pairs == {("a", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c")}
    assert ids(graph.impact_transitive(store, ["b/z_1.go"]), "unit_id") == ["unit:go:a", "unit:go:b"]
    assert graph.closure(edges.limit(0)).count() == 0


def test_interface_calls_reach_implementations(store):
    assert {(r.caller_id, r.callee_id) for r in graph.expanded_calls(store).collect()} == {("s1", "s2"), ("s2", "s4"), ("s2", "s3")}


def test_lookup_reaches_the_scan(spark, tmp_path, store):
    store["call_edges"].write.parquet(str(tmp_path / "c"))
    plan = facts.callers({"call_edges": spark.read.parquet(str(tmp_path / "c"))}, "s2").select("caller_id")._jdf.queryExecution().toString()
    assert "EqualTo(callee_id,s2)" in plan and "dispatch" not in plan.split("ReadSchema")[-1]
