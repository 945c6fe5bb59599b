"""What keeps queries within their limits on large tables: rows that don't move, texts and documents in pieces, knots as one node."""

import itertools
import json

import pytest
from test_sources import EMITTED, SCHEMAS, Emitting, rows

from quarrymap.operators import delta, graph
from quarrymap.plans import adapters, catalogue, jobs, projection
from quarrymap.sources import golist, store


@pytest.mark.parametrize("most", [10, 0])
def test_an_update_leaves_stored_rows_where_they_are(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(store, "MOST_APPENDS", most)
    root, one = str(tmp_path), str(tmp_path / "one")
    for step, without in (("build", ["b1"]), ("update", [])):
        reg = adapters.Registry()
        reg.register(Emitting(spark, without))
        assert jobs.index_facts(spark, reg, root, one)["ok"] if step == "build" else jobs.update_facts(spark, reg, root, one, ["b/x"])["ok"]
    appends = store.manifest(spark, one)["appends"]
    assert {appends[t] for t in ("call_edges", "refs", "deps", "calls_by_caller", "symbol_by_id")} == {1 if most else 0}
    for name, table in {"calls_by_caller": "call_edges", "symbol_by_id": "symbols"}.items():
        assert rows(store.load_index(spark, one, name), *SCHEMAS[table].replace(",", "").split()[::2]) == sorted(EMITTED[table])


def test_what_dangles_is_found_by_digests(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "gone"), (None, "b"), ("b", None), ("b", "a"), ("b", "a")], "x string, y string")
    names = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    gone = delta.dangling([(edges, "x"), (edges, "y")], names)
    assert gone.count() == 2 and rows(delta.attached(edges, ["x", "y"], gone), "x", "y") == rows(delta.prune(edges, ("x", "y"), names), "x", "y")


def test_knots_are_one_node(spark):
    ring = [(f"n{k:02}", f"n{(k + s) % 20:02}") for k in range(20) for s in (1, 3, 7, 12)]
    tail = [("n00", "t1"), ("t1", "t2"), ("h", "n05"), ("t2", None), (None, "h"), ("p", "q"), ("q", "p")]
    known = set(ring + tail)
    while more := {(a, d) for (a, b), (c, d) in itertools.product(known, set(ring + tail)) if b == c and b is not None} - known:
        known |= more
    edges = spark.createDataFrame(ring + tail, "src string, dst string")
    assert graph._knots(edges).count() == 20
    got = [tuple(r) for r in graph.closure(edges).collect()]
    assert len(got) == len(set(got)) and set(got) == known


def test_rounds_move_ids_only(spark, monkeypatch):
    kept = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, *a: (_ for _ in ()).throw(AssertionError(df.columns)) if df.columns != ["id"] else kept(df, *a))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e")], "src string, dst string")
    assert rows(graph.reachable(edges, spark.createDataFrame([("a",)], "id string")), "id") == [("a",), ("b",), ("c",), ("e",)]
    assert rows(graph.reachable(edges, spark.createDataFrame([("a",)], "id string"), 1), "id") == [("a",), ("b",)]


def test_removal_of_edges_has_plain_keys(spark):
    tables = {t: spark.createDataFrame(EMITTED[t], s) for t, s in SCHEMAS.items()}
    out = delta.remove(tables, {"refs": spark.createDataFrame([("a1", "b1"), ("x", None)], "from_symbol_id string, to_symbol_id string")})["refs"]
    assert rows(out, "from_symbol_id", "to_symbol_id") == [("a1", "a2"), ("b1", "a1"), ("b1", "c1"), ("c1", "c2")]
    assert "coalesce(from_symbol_id" not in out._jdf.queryExecution().toString()


def test_listings_come_in_pieces(spark):
    units = [(f"unit:go:u{k}", f"u{k}") for k in range(100)]
    tables = {
        "units": spark.createDataFrame(units, "id string, path string"),
        "files": spark.createDataFrame([(u, f"{p}/f") for u, p in units], "unit_id string, path string"),
        "deps": spark.createDataFrame([(units[0][0], units[1][0])], "from_unit_id string, to_unit_id string"),
    }
    texts = catalogue._listing(tables)
    assert texts.count() > 3
    assert rows(golist.parse_packages(texts), "ImportPath") == sorted([*((f"example.com/m/{p}",) for _, p in units), ("fmt",)])


def test_a_json_document_has_a_row_a_line(spark, tmp_path):
    made = [("file:a", 'x"},\n\t{', "unit:go:a", "h", False), ("file: b", "],", None, None, None), ("file:c", "é", "u", "h", True)]
    tables = {"files": spark.createDataFrame(made, SCHEMAS["files"]).repartition(3), "units": spark.createDataFrame([], SCHEMAS["units"])}
    store.write_facts(spark, str(tmp_path), tables, "c1", "now")
    text = (tmp_path / "facts.json").read_text()
    assert sum(line.startswith('  {"id"') for line in text.split("\n")) == 3 and len(json.loads(text)["files"]) == 3
    assert json.loads(text)["snapshot"] == {"commit": "c1", "created_at": "now"} and json.loads(text)["refs"] == []
    got = store.load_facts(spark, str(tmp_path))
    assert {t: df.count() for t, df in got.items()} == {t: 3 * (t == "files") for t in SCHEMAS}
    assert set(map(tuple, got["files"].collect())) == set(made)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["facts.json"]


@pytest.mark.parametrize("name", ["symbols", "call_edges", "refs", "type_relations"])
def test_joins_of_symbols_carry_numbers(spark, small, name):
    places = {s: f"parquet.`{small}/{s}.parquet`" for s in projection._SOURCES}
    wide = spark.sql(projection._with(f"SELECT * FROM {name}", False, "", projection._CTES, sha="sha2", bits=", 256", **places))
    narrow = projection.table(spark, small, name)
    assert narrow.schema == wide.drop("k").schema and rows(narrow, *narrow.columns) == rows(wide, *narrow.columns)
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "concat" in plan.split("Join")[0] and "concat" not in plan.split("Join", 1)[1]
