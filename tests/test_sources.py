"""Ingestion, storage, fingerprints, adapters and jobs."""

import json

import pytest

from quarrymap.operators import fingerprint, insights
from quarrymap.plans import adapters, catalogue, jobs
from quarrymap.schemas import INSIGHT_ROWS, json_schema
from quarrymap.sources import files, golist, store
from quarrymap.streaming.deltas import follow


def packages(root):
    base = {"Module": {"Path": "example.com/testproject"}, "Standard": False}
    return "".join(
        json.dumps(base | p, indent=2) + "\n"
        for p in (
            {"ImportPath": "example.com/testproject", "Name": "main", "Dir": root, "GoFiles": ["main.go"], "Imports": ["fmt", "example.com/testproject/pkg"]},
            {"ImportPath": "example.com/testproject/pkg", "Name": "pkg", "Dir": f"{root}/pkg", "GoFiles": ["service.go", "generated.go"], "Imports": ["example.com/testproject/internal/db", "example.com/testproject"]},
            {"ImportPath": "example.com/testproject/internal/db", "Name": "d{b}", "Dir": f"{root}/internal/db", "GoFiles": ["db.go"], "Imports": []},
            {"ImportPath": "fmt", "Name": "fmt", "Dir": "/go/fmt", "GoFiles": ["f.go"], "Imports": [], "Standard": True},
        )
    )


@pytest.fixture
def module(tmp_path):
    root = tmp_path / "module"
    for name, text in {"go.mod": "module example.com/testproject\n", "main.go": "package main\n", "pkg/service.go": "package pkg\n", "pkg/generated.go": "// Code generated by x. DO NOT EDIT.\npackage pkg\n", "internal/db/db.go": "package db\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def registry(root, vet="# pkg\npkg/service.go:42:12: bad call\nmain.go:50: other"):
    def run(command, cwd):
        return (0, packages(root), "") if command[1] == "list" else (0, "", vet) if command[1] == "vet" else (0, "ok", "")

    out = adapters.Registry()
    out.register(adapters.GoAdapter(run), adapters.GoActions(run))
    return out


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_concatenated_json_with_braces_in_strings():
    assert [o["a"] for o in golist.objects('{"a": "}{"}\n{\n "a": 2}  ')] == ["}{", 2]
    assert list(golist.objects("  ")) == []
    with pytest.raises(ValueError):
        list(golist.objects("{"))


def test_vet_lines(spark):
    text = "# pkg\n\tpkg/a.go:42:12: msg: x \npkg/b.go:50: other\n\nnonsense\n./c.go:1:2: y"
    got = rows(golist.vet_diagnostics(spark.createDataFrame([(text,), ("",), (None,)], "text string")), "file_id", "line", "col", "message", "severity")
    assert got == [("file:c.go", 1, 2, "y", "warning"), ("file:pkg/a.go", 42, 12, "msg: x", "warning"), ("file:pkg/b.go", 50, 1, "other", "warning")]


def test_module_to_facts(spark, module):
    go = registry(module).language("go")
    units = go.enumerate_units(spark, module)
    assert rows(units, "id") == [("unit:go:.",), ("unit:go:internal/db",), ("unit:go:pkg",)]
    got = go.index_units(spark, module, units)
    assert rows(got["files"], "path", "unit_id", "generated") == [("internal/db/db.go", "unit:go:internal/db", False), ("main.go", "unit:go:.", False), ("pkg/generated.go", "unit:go:pkg", True), ("pkg/service.go", "unit:go:pkg", False)]
    assert all(len(r[0]) == 71 for r in rows(got["files"], "hash"))
    assert rows(got["deps"], "from_unit_id", "to_unit_id") == [("unit:go:.", "unit:go:pkg"), ("unit:go:pkg", "unit:go:."), ("unit:go:pkg", "unit:go:internal/db")]


def test_listings_name_the_files_of_their_units(spark):
    tables = {
        "units": spark.createDataFrame([("unit:go:a", "a"), ("unit:go:b", "b")], "id string, path string"),
        "files": spark.createDataFrame([("unit:go:a", "a/f12"), ("unit:go:a", "a/f3")], "unit_id string, path string"),
        "deps": spark.createDataFrame([], "from_unit_id string, to_unit_id string"),
    }
    got = golist.parse_packages(catalogue._listing(tables))
    assert rows(got, "ImportPath", "GoFiles") == [("example.com/m/a", ["f12", "f3"]), ("example.com/m/b", None), ("fmt", ["f.go"])]


def snapshot(spark, cache):
    return {t: sorted(map(str, df.drop("metadata").collect())) for t, df in store.load_facts(spark, cache).items()}


def test_update_gives_what_a_rebuild_gives(spark, module, tmp_path):
    reg, one, two = registry(module), str(tmp_path / "one"), str(tmp_path / "two")
    assert jobs.index_facts(spark, reg, module, one)["ok"]
    assert store.load_facts(spark, one)["diagnostics"].count() == 2
    with open(f"{module}/pkg/service.go", "a") as f:
        f.write("// more\n")
    done = jobs.update_facts(spark, reg, module, one, ["pkg/service.go"])
    assert done["ok"] and done["affected"] == ["unit:go:pkg"] and not done["fallback"]
    jobs.index_facts(spark, reg, module, two)
    assert snapshot(spark, one) == snapshot(spark, two)
    none = jobs.update_facts(spark, reg, module, one, ["new.go"])
    assert none["ok"] and none["affected"] == [] and not none["fallback"]
    first = jobs.update_facts(spark, reg, module, str(tmp_path / "none"), ["main.go"])
    assert first["fallback"] and first["affected"] == ["unit:go:.", "unit:go:internal/db", "unit:go:pkg"]
    with open(f"{module}/pkg/new.go", "w") as f:
        f.write("package pkg\n")
    assert jobs.update_facts(spark, reg, module, one, ["pkg/new.go"])["affected"] == ["unit:go:pkg"]


def test_update_keeps_the_profile(spark, module, tmp_path):
    cache, reg = str(tmp_path / "c"), registry(module)
    jobs.index_facts(spark, reg, module, cache, profile={"GOOS": "plan9"})
    done = jobs.update_facts(spark, reg, module, cache, ["main.go"], profile={"GOOS": "plan9"})
    assert not done["fallback"] and store.manifest(spark, cache)["fingerprint"]["build_profile"]["GOOS"] == "plan9"
    assert jobs.update_facts(spark, reg, module, cache, ["main.go"])["fallback"]
    assert store.manifest(spark, cache)["created_at"].endswith("Z")


EMITTED = {
    "units": [("unit:go:a", "go_package", "a", "a"), ("unit:go:b", "go_package", "b", "b"), ("unit:go:c", "go_package", "c", "c")],
    "files": [(f"file:{u}/x", f"{u}/x", f"unit:go:{u}", "h", False) for u in "abc"],
    "deps": [("unit:go:a", "unit:go:b", "import"), ("unit:go:b", "unit:go:a", "import"), ("unit:go:b", "unit:go:c", "import")],
    "symbols": [(f"{u}{k}", f"unit:go:{u}", f"n{k}", "func", True, f"file:{u}/x", k) for u in "abc" for k in (1, 2)],
    "refs": [(f, t, "file:b/x", 1, "call", "certain") for f, t in (("a1", "a2"), ("a1", "b1"), ("a1", "b1"), ("b1", "a1"), ("b1", "c1"), ("c1", "c2"))],
    "type_relations": [("a1", "b1", "implements"), ("c1", "a1", "embeds"), ("c1", "c1", "embeds")],
    "call_edges": [(f, t, "file:b/x", 1, "static") for f, t in (("a1", "b2"), ("b2", "a1"), ("b2", "a1"), ("c1", "b1"), ("c2", "c1"))],
    "diagnostics": [(f"file:{u}/x", 1, 1, "warning", "m", "t") for u in "abc"],
}
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


class Emitting:
    """An adapter of all tables; ``without`` names symbols that aren't there, with their edges."""

    lang = "go"

    def __init__(self, spark, without=()):
        gone = set(without)
        rows = {t: [r for r in rs if not gone & set(map(str, r[:2]))] for t, rs in EMITTED.items()}
        self.tables = {t: spark.createDataFrame(rows[t], SCHEMAS[t]) for t in EMITTED}

    def detect(self, spark, root):
        return True, 1.0

    def doctor(self):
        return True, [], []

    def enumerate_units(self, spark, root):
        return self.tables["units"]

    def index_units(self, spark, root, units):
        return {t: rows for t, rows in self.tables.items() if t != "diagnostics"}

    def diagnose(self, spark, root):
        return self.tables["diagnostics"]


@pytest.mark.parametrize("before, after, changed", [(["a2", "b1"], ["a1"], ["a/x", "b/x"]), ([], [], ["b/x"]), (["c2"], [], ["c/x"])])
def test_update_of_all_tables_gives_what_a_rebuild_gives(spark, tmp_path, before, after, changed):
    root, one, two = str(tmp_path), str(tmp_path / "one"), str(tmp_path / "two")

    def registered(without):
        reg = adapters.Registry()
        reg.register(Emitting(spark, without))
        return reg

    assert jobs.index_facts(spark, registered(before), root, one)["ok"]
    done = jobs.update_facts(spark, registered(after), root, one, changed)
    assert done["ok"] and not done["fallback"] and done["affected"] == sorted(f"unit:go:{c[0]}" for c in changed)
    jobs.index_facts(spark, registered(after), root, two)
    a, b = ({t: rows(df, *SCHEMAS[t].replace(",", "").split()[::2]) for t, df in store.load_facts(spark, x).items()} for x in (one, two))
    assert a == b and len(b["refs"]) >= 2


def test_snapshots_survive_a_writer_that_dies(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    table = lambda n: {"deps": spark.createDataFrame([("a", str(n), "k")], SCHEMAS["deps"])}
    assert store.write_snapshot(spark, root, table(1)) == 1
    with monkeypatch.context() as m:  # dies before the manifest is there
        m.setattr(store, "_put", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.write_snapshot(spark, root, table(2))
    assert rows(store.load_facts(spark, root)["deps"], "to_unit_id") == [("1",)]
    (tmp_path / "s" / "manifest-3.json").write_text('{"snapshot": 3, "tab')  # half a manifest
    assert rows(store.load_facts(spark, root)["deps"], "to_unit_id") == [("1",)]
    assert store.write_snapshot(spark, root, table(4)) == 4
    for n in (5, 6):
        store.write_snapshot(spark, root, table(n))
    assert rows(store.load_facts(spark, root)["deps"], "to_unit_id") == [("6",)]
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("snapshot=")]) == 2
    with pytest.raises(Exception):
        store._put(spark, f"{root}/manifest-6.json", "{}", replace=False)
    assert rows(store.load_facts(spark, root)["deps"], "to_unit_id") == [("6",)]


def test_unchanged_tables_are_taken_over(spark, tmp_path):
    root = str(tmp_path / "s")
    tables = {t: spark.createDataFrame(EMITTED[t], SCHEMAS[t]) for t in ("files", "call_edges", "deps")}
    for _ in range(4):
        store.write_snapshot(spark, root, tables, same=["files", "call_edges"])
    now = store.manifest(spark, root)
    assert now["tables"]["files"].startswith("snapshot=1-") and now["indexes"]["calls_by_caller"].startswith("snapshot=1-") and now["tables"]["deps"].startswith("snapshot=4-")
    assert store.load_facts(spark, root)["files"].count() == 3
    found = store.load_index(spark, root, "calls_by_caller").filter("caller_id = 'b2'")
    assert found.count() == 2 and "EqualTo(caller_id,b2)" in found._jdf.queryExecution().toString()
    assert rows(store.load_index(spark, root, "unit_by_file"), "file_id")[0] == ("file:a/x",)
    assert store.load_index(spark, root, "symbol_by_name") is None and store.load_index(spark, str(tmp_path / "none"), "unit_by_file") is None


def test_a_failing_file_system_is_an_error(spark):
    with pytest.raises(Exception):
        files.exists(spark, "nosuchscheme://x/y")


def test_go_environment(module):
    def run(command, cwd):
        return 0, {"GOOS": "plan9", "GOARCH": "mips"}.get(command[2], ""), ""

    assert adapters.GoAdapter(run).profile(module) == {"GOOS": "plan9", "GOARCH": "mips", "GOTAGS": ""}


def test_failure_keeps_the_old_snapshot(spark, module, tmp_path):
    cache = str(tmp_path / "c")
    jobs.index_facts(spark, registry(module), module, cache)
    broken = adapters.Registry()
    broken.register(adapters.GoAdapter(lambda c, d: (0, "", "") if c[1] == "version" else (1, "", "boom")))
    assert not jobs.update_facts(spark, broken, module, cache, ["main.go"])["ok"]
    assert store.load_facts(spark, cache)["units"].count() == 3


def test_json_round_trips(spark, module, tmp_path):
    go = registry(module).language("go")
    tables = jobs.empty(spark) | go.index_units(spark, module, go.enumerate_units(spark, module))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    store.write_facts(spark, a, tables, "c1")
    store.write_facts_jsonl(spark, b, tables, "c1")
    for got in (store.read_facts(spark, a), store.read_facts(spark, b)):
        assert {t: df.count() for t, df in got.items()} == {"units": 3, "files": 4, "deps": 3, "symbols": 0, "refs": 0, "type_relations": 0, "call_edges": 0, "diagnostics": 0}
        assert {"decl_file_id", "line", "col"} <= set(got["symbols"].columns)
    assert store.read_facts(spark, str(tmp_path / "none")) is None
    with pytest.raises(store.NotStored):
        store.load_facts(spark, str(tmp_path / "none"))


def test_documents_without_some_arrays(spark, tmp_path):
    (tmp_path / "facts.json").write_text(json.dumps({"schema_version": 1, "units": [{"id": "u", "kind": "k", "name": "n", "path": "p"}]}))
    got = store.read_facts(spark, str(tmp_path))
    assert got["units"].count() == 1 and got["call_edges"].count() == 0


def test_json_lines(spark, tmp_path):
    assert store.read_jsonl(spark, str(tmp_path / "no.jsonl"), "deps").count() == 0
    (tmp_path / "d.jsonl").write_text('{"from_unit_id": "a", "to_unit_id": "b", "kind": "k"}\n\n')
    assert store.read_jsonl(spark, str(tmp_path / "d.jsonl"), "deps").count() == 1
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        store.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "deps").collect()


def test_fingerprints(spark, tmp_path):
    base = fingerprint.generate(str(tmp_path), tools={"go": "1"}, probes={"echo": ("echo", "v 3"), "gone": ("no-such-tool",)})
    assert base["tools"]["echo"] == "v 3" and "gone" not in base["tools"] and base["created_at"].endswith("Z")
    same = fingerprint.as_frame(spark, base)
    assert fingerprint.differences(same, same).isEmpty() and base["repo_state"]["commit"] == "unknown"
    other = fingerprint.as_frame(spark, base | {"tools": {"go": "2", "new": "x"}, "repo_state": {"commit": "c"}})
    assert ("tools", "go", "1", "2") in rows(fingerprint.differences(other, same), "section", "key", "old", "new")
    assert fingerprint.differences(other, same).count() == 5
    assert fingerprint.differences(other, same, commit=True).count() == 6
    store.wipe(spark, str(tmp_path / "absent"))


META = {"model": "m", "confidence": 0.9, "generated_at": "t"}


def test_insights(spark, tmp_path):
    at = {"line": 1, "column": 1, "byte_offset": None}
    made = {
        "intent_tags": [("s1", "symbol", "a", "r", META), ("s2", "symbol", "b", "r", META | {"confidence": 0.5}), ("s3", "symbol", "c", "r", META | {"confidence": None})],
        "summaries": [("f1", "file", "x", META)],
        "bug_smells": [("f1", at, "race_condition", "m", "high", META | {"confidence": 0.8}), ("f1", at, "logic_error", "m", "medium", META | {"confidence": 0.4})],
        "pattern_tags": [("u", "unit", "factory", ["s1"], META)],
        "naming_issues": [("s1", "misleading", "x", None, "m", META)],
    }
    with pytest.raises(store.NotStored):
        store.load_insights(spark, str(tmp_path))
    store.write_insights(str(tmp_path), {t: spark.createDataFrame(made[t], json_schema(t)) for t in INSIGHT_ROWS})
    got = store.load_insights(spark, str(tmp_path))
    assert insights.intents(got).count() == 2 and insights.intents(got, "s1").count() == 1 and insights.intents(got, least=0.8).count() == 1
    assert insights.intents(got, "").count() == 0
    assert insights.smells(got).count() == 2 and insights.smells(got, "", "high").count() == 1 and insights.smells(got, least=0.5).count() == 1
    assert insights.patterns(got, "factory").count() == 1 and insights.patterns(got, "singleton").count() == 0
    assert insights.naming(got, "s1").count() == 1 and insights.summaries(got).count() == 1
    assert insights.of_model(got["summaries"], "other").count() == 0


def test_scope(spark, module):
    go = registry(module).language("go")
    tables = go.index_units(spark, module, go.enumerate_units(spark, module))
    assert insights.scope_files(tables).count() == 4
    assert insights.scope_files(tables, files=[]).count() == 0
    assert insights.scoped_files(tables, files=["file:gone"], units=["unit:go:pkg"]).count() == 2
    got = {r["file_id"]: r["text"] for r in insights.context_sources(tables, module, files=["file:main.go", "file:gone"]).collect()}
    assert got == {"file:main.go": "package main\n"}


def test_registry_and_actions(spark, module, tmp_path):
    class Fixed:
        def __init__(self, lang, ok, sure):
            self.lang, self.answer = lang, (ok, sure)

        def detect(self, spark, root):
            return self.answer

    reg = adapters.Registry()
    for a in (Fixed("python", True, 0.5), Fixed("go", True, 0.9), Fixed("ruby", False, 1.0), Fixed("typescript", True, 0.7), Fixed("late", True, 0.9)):
        reg.register(a)
    assert [a.lang for a, _ in reg.detect_all(spark, "x")] == ["go", "late", "typescript", "python"]
    assert reg.language("none") is None
    assert adapters.run_action(registry(module), spark, module, "check")["ok"]
    assert not adapters.run_action(registry(module), spark, module, "dance")["ok"]
    assert adapters.go_targets(adapters.Scope("unit", ("unit:go:pkg",))) == ["./pkg/..."] and adapters.go_targets(adapters.Scope()) == ["./..."]
    assert files.detect(spark, str(tmp_path)) == (False, 0.0)


def test_stream_of_removals(spark, module, tmp_path):
    cache, feed = str(tmp_path / "cache"), tmp_path / "feed"
    jobs.index_facts(spark, registry(module), module, cache)
    spark.createDataFrame([("unit:go:pkg",)], "id string").write.json(str(feed))
    follow(spark, spark.readStream.schema("id string").json(str(feed)), cache, str(tmp_path / "check")).awaitTermination()
    assert store.load_facts(spark, cache)["units"].count() == 2
    assert store.manifest(spark, cache)["fingerprint"]["tools"]["spark"]
