"""Building a snapshot and bringing one up to date, so that an update gives what a rebuild would."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.operators import delta, facts, fingerprint
from quarrymap.plans.adapters import Registry
from quarrymap.schemas import TABLES, json_schema
from quarrymap.sources import store
from quarrymap.sources.files import exists
from quarrymap.sources.storage import stored


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {t: store.flat(t, spark.createDataFrame([], json_schema(t))) for t in TABLES}


def _match(spark: SparkSession, now: dict, before: dict | None, commit: bool) -> bool:
    if before is None:
        return False
    return fingerprint.differences(fingerprint.as_frame(spark, now), fingerprint.as_frame(spark, before), commit).isEmpty()


def index_facts(spark: SparkSession, registry: Registry, root: str, cache: str, created_at: str | None = None, profile: dict | None = None, by_commit: bool = False) -> dict:
    """Full build: {ok, errors, warnings, fingerprint}. A changed environment wipes what was stored."""
    now = fingerprint.generate(root, created_at, profile)
    before = store.manifest(spark, cache)
    if before and not _match(spark, now, before.get("fingerprint"), by_commit):
        store.wipe(spark, cache)
    errors: list[str] = []
    warnings: list[str] = []
    tables = empty(spark)
    found = registry.detect_all(spark, root)
    if not found:
        errors.append("no supported language was found")
    diagnostics = []
    for adapter, _ in found:
        ok, missing, notes = adapter.doctor()
        warnings += notes
        if not ok:
            warnings.append(f"{adapter.lang}: {', '.join(missing)} is missing")
            continue
        try:
            tables = delta.apply_delta(tables, adapter.index_units(spark, root, adapter.enumerate_units(spark, root)))
            diagnostics.append(adapter.diagnose(spark, root))
        except (RuntimeError, OSError) as e:
            errors.append(f"{adapter.lang}: {e}")
    for rows in diagnostics:
        tables["diagnostics"] = tables["diagnostics"].unionByName(rows, allowMissingColumns=True)
    if not errors:
        store.write_snapshot(spark, cache, tables, now["repo_state"]["commit"], now["created_at"], now)
    return {"ok": not errors, "errors": errors, "warnings": warnings, "fingerprint": now}


def changes(old: dict[str, DataFrame], fresh: dict[str, DataFrame], units: DataFrame) -> dict[str, store.Change]:
    """What replaces the rows of the given units (unit_id) by those of ``fresh``, a full listing: for each table what stays and what is added.

    Deps, refs, type relations and calls with one end in a replaced unit are taken from the listing, whichever end it is;
    those between other units stay, without what dangles. What belongs to the units is stored, so its size is known and
    where it is small the tables don't move to be joined with it.
    """
    units = stored(units.select("unit_id").distinct())
    ids = units.select(F.col("unit_id").alias("id"))

    def without(*columns: str) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: reduce(lambda out, c: delta.without(out, ids, {c: "id"}), columns, rows)

    keep = {"units": without("id"), "files": without("unit_id"), "symbols": without("unit_id"), "deps": without("from_unit_id", "to_unit_id")}
    kept = {t: keep[t](old[t]) for t in ("files", "symbols")}
    gone = stored(delta.dangling([(old[t], c) for t, ends in delta.EDGES.items() for c in ends], kept["symbols"]))
    for table, ends in delta.EDGES.items():
        keep[table] = lambda rows, ends=ends: delta.attached(rows, ends, gone)
    lost = stored(delta.dangling([(old["diagnostics"], "file_id")], kept["files"]))
    keep["diagnostics"] = lambda rows: delta.attached(rows, ["file_id"], lost)

    aligned = lambda table, rows: old[table].filter("false").unionByName(rows, allowMissingColumns=True)
    added: dict[str, list[DataFrame]] = {t: [] for t in keep}
    for table, key in {"units": "id", "files": "unit_id", "symbols": "unit_id"}.items():
        if table in fresh:
            added[table] = [stored(aligned(table, fresh[table].join(units.withColumnRenamed("unit_id", "_u"), F.col(key) == F.col("_u"), "left_semi")))]
    if "deps" in fresh:
        added["deps"] = [aligned("deps", facts.touching(fresh["deps"], units))]
    if "symbols" in fresh:
        own = stored(added["symbols"][0].select("id").distinct())
        symbols = kept["symbols"].select("id").union(added["symbols"][0].select("id"))
        for table, ends in delta.EDGES.items():
            if table in fresh:
                touched = stored(aligned(table, facts.touching(fresh[table], own, ends)))
                named = stored(touched.select(F.col(ends[0]).alias("_id")).union(touched.select(ends[1])).distinct())
                added[table] = [delta.prune(touched, ends, symbols.join(named, F.col("id") == F.col("_id"), "left_semi"))]
    if "diagnostics" in fresh and "files" in fresh:
        files = added["files"][0].select(F.col("id").alias("file_id"))
        added["diagnostics"] = [aligned("diagnostics", fresh["diagnostics"].join(files, "file_id", "left_semi"))]
    return {t: (keep[t], added[t]) for t in keep}


def _then(first: store.Change | None, second: store.Change) -> store.Change:
    """Both changes of a table, one after the other."""
    if first is None:
        return second
    return lambda rows: second[0](first[0](rows)), [*(second[0](rows) for rows in first[1]), *second[1]]


def owners(spark: SparkSession, units: DataFrame, paths: Sequence[str]) -> DataFrame:
    """unit_id of the unit in whose directory each path lies, or the nearest above that has a unit ('.' is the root)."""
    above = [(p, d, len(d)) for p in paths for d in _directories(p.removeprefix("file:"))]
    places = spark.createDataFrame(above, "changed string, path string, depth int")
    found = places.join(units.select(F.col("id").alias("unit_id"), "path"), "path")
    return found.groupBy("changed").agg(F.max_by("unit_id", F.when(F.col("path") == ".", 0).otherwise(F.col("depth"))).alias("unit_id")).select("unit_id").distinct()


def _directories(path: str) -> list[str]:
    parts = path.split("/")[:-1]
    return [*("/".join(parts[:k]) for k in range(len(parts), 0, -1)), "."]


def update_facts(spark: SparkSession, registry: Registry, root: str, cache: str, changed: Sequence[str], created_at: str | None = None, profile: dict | None = None, by_commit: bool = False) -> dict:
    """{ok, affected, fallback, errors, warnings}: only units that own changed files are indexed again.

    A changed file that isn't stored but is there now belongs to the unit of its directory, new or not; one that is
    neither stored nor there changes nothing. Falls back to a full build, with the same profile, without a stored
    snapshot and in a changed environment. Tables of edges stay by reference where no symbol is replaced.
    """
    now = fingerprint.generate(root, created_at, profile)
    before, old = store.manifest(spark, cache), store.read_snapshot(spark, cache)
    if old is None or not _match(spark, now, before.get("fingerprint"), by_commit):
        done = index_facts(spark, registry, root, cache, created_at, profile, by_commit)
        units = store.read_snapshot(spark, cache) if done["ok"] else None
        return done | {"affected": sorted(r[0] for r in units["units"].select("id").distinct().collect()) if units else [], "fallback": True, "warnings": [*done["warnings"], "no snapshot of this environment: all was built"]}
    unknown = facts.changed_files(old, changed).join(old["files"].select("id"), "id", "left_anti")
    new = [p for r in unknown.collect() if exists(spark, f"{root.rstrip('/')}/{(p := r[0].removeprefix('file:'))}")]
    units, warnings, errors = facts.impact_units(old, changed), [], []
    found = [(a, a.index_units(spark, root, a.enumerate_units(spark, root))) for a, _ in registry.detect_all(spark, root)] if new else None
    for _, fresh in found or []:
        units = units.union(owners(spark, fresh["units"], new))
    units = units.distinct()
    affected = sorted(r[0] for r in units.collect())
    if not affected:
        return {"ok": True, "affected": [], "fallback": False, "errors": [], "warnings": ["no unit owns a changed file"]}
    units = spark.createDataFrame([(u,) for u in affected], "unit_id string")
    tables, touched, done = old, set(), {}
    for adapter, _ in registry.detect_all(spark, root) if found is None else [(a, 1.0) for a, _ in found]:
        try:
            fresh = next((f for a, f in found or [] if a is adapter), None) or adapter.index_units(spark, root, adapter.enumerate_units(spark, root))
            fresh["diagnostics"] = adapter.diagnose(spark, root)
            touched |= {t for t in delta.EDGES if t in fresh} if "symbols" in fresh else set()
            made = changes(tables, fresh, units.filter(F.startswith("unit_id", F.lit(f"unit:{adapter.lang}:"))))
            tables, done = tables | {t: store.changed(tables[t], c) for t, c in made.items()}, done | {t: _then(done.get(t), c) for t, c in made.items()}
        except (RuntimeError, OSError) as e:
            errors.append(f"{adapter.lang}: {e}")
    if not errors:
        idle = old["symbols"].join(units, "unit_id", "left_semi").isEmpty()
        same = [t for t in ("symbols", *delta.EDGES) if idle and not touched]
        store.write_snapshot(spark, cache, tables, now["repo_state"]["commit"], now["created_at"], now, same=same, changes=done)
    return {"ok": not errors, "affected": affected, "fallback": False, "errors": errors, "warnings": warnings}
