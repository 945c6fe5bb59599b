"""Snapshots: versioned Parquet tables behind numbered manifests, and import and export of JSON and JSON lines.

A write makes a new ``snapshot=N-...`` directory and then a new manifest ``manifest-N.json``, by one rename to a name that
isn't taken; the highest readable manifest is the current one. So readers see the old or the new snapshot, a write that
fails at any point leaves the old one, and of two writers of one number the second fails. Tables that a write doesn't
change are taken over by reference. Facts and annotations have roots of their own.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Collection, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.operators.fingerprint import now_iso
from quarrymap.schemas import INSIGHT_ROWS, JSON_ROWS, PLACES, SCHEMA_VERSION, TABLES, json_schema
from quarrymap.operators import indexes
from quarrymap.sources.files import delete, exists, names_below


class NotStored(LookupError):
    """There is nothing to read yet."""


def _put(spark: SparkSession, path: str, text: str | Callable[[object], None], replace: bool = True) -> None:
    """Writes a file (a small text, or what a function writes to the stream) beside its place and renames it; what is there is replaced, or else an error."""
    jvm = spark._jvm
    where, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    conf = spark._jsc.hadoopConfiguration()
    fs = where.getFileSystem(conf)
    out = fs.create(beside, True)
    if isinstance(text, str):
        out.write(bytearray(text.encode()))
    else:
        text(out)
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE" if replace else "NONE")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(where), options)
    finally:
        fs.delete(beside, False)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file; None where there is none."""
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect()))


def write_json(spark: SparkSession, path: str, value: object) -> None:
    _put(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def flat(table: str, rows: DataFrame) -> DataFrame:
    """Rows as JSON holds them with their place in columns of their own."""
    if table in PLACES:
        at = PLACES[table]
        place = [F.col(f"{at}.file_id").alias(f"{at}_file_id"), F.col(f"{at}.position.line").alias("line"), F.col(f"{at}.position.column").alias("col"), F.col(f"{at}.position.byte_offset").alias("byte_offset")]
        return rows.select(*[c for c in rows.columns if c != at], *place)
    if "position" in rows.columns:
        return rows.select(*[c for c in rows.columns if c != "position"], F.col("position.line").alias("line"), F.col("position.column").alias("col"), F.col("position.byte_offset").alias("byte_offset"))
    return rows


def nested(table: str, rows: DataFrame) -> DataFrame:
    """The inverse of flat; missing optional columns become null."""
    for name in ("line", "col", "byte_offset", "signature", "metadata"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None))
    position = F.struct(F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("column"), F.col("byte_offset").cast("bigint").alias("byte_offset"))
    schema = json_schema(table)
    if table in PLACES:
        rows = rows.withColumn(PLACES[table], F.struct(F.col(f"{PLACES[table]}_file_id").alias("file_id"), position.alias("position")))
    elif "position" in schema.names:
        rows = rows.withColumn("position", position)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_jsonl(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of JSON lines: none where the file is missing; blank lines don't count; a malformed line is an error."""
    schema = json_schema(table)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_facts_jsonl(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """None without meta.json, even if there is another format."""
    if read_json(spark, f"{root}/facts/meta.json") is None:
        return None
    return {t: flat(t, read_jsonl(spark, f"{root}/facts/{t}.jsonl", t)) for t in TABLES}


def write_facts_jsonl(spark: SparkSession, root: str, facts: Mapping[str, DataFrame], commit: str = "unknown", created_at: str | None = None) -> None:
    for table, rows in facts.items():
        write_jsonl(nested(table, rows), f"{root}/facts/{table}.jsonl")
    write_json(spark, f"{root}/facts/meta.json", {"schema_version": SCHEMA_VERSION, "snapshot": {"commit": commit, "created_at": created_at or now_iso()}})


#: How a document begins that has a row a line, and white space before each row that tells its table; so it can be read in pieces.
_FIRST = '{\t"schema_version": '


def _margin(table: int) -> str:
    return " " * (table + 1)


def _lines(spark: SparkSession, head: Mapping[str, object], tables: Mapping[str, DataFrame | None], beside: str) -> Callable[[object], None]:
    """What writes a JSON document of some values and of tables, whose rows are written in parts by the executors and put together as bytes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    copy = jvm.org.apache.commons.io.IOUtils.copyLarge

    def write(out: object) -> None:
        say = lambda text: out.write(bytearray(text.encode()))
        say("{\t" + ",\n".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in head.items()))
        for k, (table, rows) in enumerate(tables.items()):
            say(f",\n{json.dumps(table)}: [")
            if rows is not None:
                rows.select(F.concat(F.lit(_margin(k)), F.to_json(F.struct("*")))).write.option("lineSep", ",\n").text(f"{beside}/{table}")
                where, end = jvm.org.apache.hadoop.fs.Path(f"{beside}/{table}"), "\n"
                fs = where.getFileSystem(conf)
                for part in sorted((p for p in fs.listStatus(where) if p.getPath().getName().startswith("part-")), key=lambda p: p.getPath().getName()):
                    if part.getLen():
                        say(end)
                        part_in = fs.open(part.getPath())
                        copy(part_in, out, 0, part.getLen() - 2)  # without the last comma and line end
                        part_in.close()
                        end = ",\n"
            say("\n]")
        say("\n}\n")

    return write


def _arrays(spark: SparkSession, path: str, rows: Mapping[str, str]) -> dict[str, DataFrame]:
    """The arrays of one JSON document as tables; a missing one is empty. A document that isn't of _lines is one row, so it has to fit in a task's memory."""
    first = spark.read.text(path).first()
    if first and first[0].startswith(_FIRST):
        lines, places = spark.read.text(path), list(rows)
        parsed = lambda t: F.from_json(F.rtrim("value", F.lit(",")), json_schema(t), {"mode": "FAILFAST"}).alias("r")
        return {t: lines.filter(F.startswith("value", F.lit(_margin(places.index(t)) + "{"))).select(parsed(t)).select("r.*") for t in rows}
    fields = ", ".join(f"{t} array<struct<{', '.join(_field(c) for c in json_schema(t).fields)}>>" for t in rows)
    whole = spark.read.schema(fields).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return {t: whole.select(F.inline(F.coalesce(t, F.array().cast(whole.schema[t].dataType)))) for t in rows}


def _field(field: object) -> str:
    return f"{field.name}: {field.dataType.simpleString()}"


def read_facts(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """The current snapshot; else JSON lines if there is a directory ``facts``, else ``facts.json``; else None."""
    if (stored := read_snapshot(spark, root)) is not None:
        return stored
    if exists(spark, f"{root}/facts"):
        return read_facts_jsonl(spark, root)
    if exists(spark, f"{root}/facts.json"):
        return {t: flat(t, rows) for t, rows in _arrays(spark, f"{root}/facts.json", JSON_ROWS).items()}
    return None


def load_facts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    found = read_facts(spark, root)
    if found is None:
        raise NotStored(f"no facts are stored at {root}; build them first")
    return found


def write_facts(spark: SparkSession, root: str, facts: Mapping[str, DataFrame], commit: str = "unknown", created_at: str | None = None) -> None:
    """facts.json, one document with a row a line, so it can be read in pieces; neither the driver nor a task holds a table."""
    head = {"schema_version": SCHEMA_VERSION, "snapshot": {"commit": commit, "created_at": created_at or now_iso()}}
    beside = f"{root}/facts.json.{uuid.uuid4().hex}.rows"
    try:
        _put(spark, f"{root}/facts.json", _lines(spark, head, {t: nested(t, facts[t]) if t in facts else None for t in TABLES}, beside))
    finally:
        delete(spark, beside)


#: How the large tables are laid out for the look-ups they serve: sorted within files, so row groups prune.
_ORDER = {"refs": "to_symbol_id", "symbols": "name", "call_edges": "callee_id", "deps": "to_unit_id", "type_relations": "to_type_id", "files": "id", "diagnostics": "file_id"}


def _all(rows: DataFrame) -> DataFrame:
    return rows


#: Further tables that a snapshot holds, made of one of its tables and sorted by the key they are looked up by. Look-ups by
#: the keys of _ORDER, such as refs_by_symbol, are served by the tables themselves.
_INDEXES = {
    "unit_by_file": ("files", "file_id", indexes.unit_by_file),
    "symbol_by_id": ("symbols", "id", _all),
    "calls_by_caller": ("call_edges", "caller_id", _all),
    "deps_by_source": ("deps", "from_unit_id", _all),
}
_SERVED = {"symbol_by_name": "symbols", "refs_by_symbol": "refs", "calls_by_callee": "call_edges", "deps_by_target": "deps"}


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The highest manifest that can be read; None where there is none."""
    found = sorted((int(m[1]) for name in names_below(spark, root) if (m := re.fullmatch(r"manifest-(\d+)\.json", name))), reverse=True)
    for number in found:
        try:
            return read_json(spark, f"{root}/manifest-{number}.json")
        except ValueError:  # half a file: not one of a file system that renames atomically
            continue
    return None


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    now = manifest(spark, root)
    return None if now is None else {t: spark.read.parquet(f"{root}/{place}") for t, place in now["tables"].items()}


def load_index(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """unit_by_file, symbol_by_id, calls_by_caller, deps_by_source, symbol_by_name, refs_by_symbol, calls_by_callee or deps_by_target of the current snapshot.

    Rows sorted by the key: a filter on it reads only the row groups that can have it. None where nothing is stored or
    the snapshot doesn't have the table.
    """
    now = manifest(spark, root)
    place = None if now is None else now["tables"].get(_SERVED[name]) if name in _SERVED else now["indexes"].get(name)
    return None if place is None else spark.read.parquet(f"{root}/{place}")


#: What becomes of a table: the rows of it that stay, as a function of a frame of its rows, and frames of rows that are added.
Change = tuple[Callable[[DataFrame], DataFrame], list[DataFrame]]
#: How often a table's added rows go to files of their own before the whole table is dealt out and sorted again.
MOST_APPENDS = 10


def changed(rows: DataFrame, change: Change) -> DataFrame:
    return reduce(lambda out, more: out.unionByName(more, allowMissingColumns=True), change[1], change[0](rows))


def _rewrite(rows: DataFrame, change: Change, key: str | None, path: str, appends: int) -> int:
    """Writes what a change makes of a stored table, whose files are sorted by the key. The new number of appends.

    The rows that stay keep their places, and those that are added go to further files: neither deals out the table again.
    """
    kept, whole = change[0](rows), changed(rows, change)
    if appends >= MOST_APPENDS or [(f.name, f.dataType) for f in whole.schema] != [(f.name, f.dataType) for f in kept.schema]:
        _sorted(whole, key).write.parquet(path)
        return 0
    (kept.sortWithinPartitions(key) if key in kept.columns else kept).write.parquet(path)
    if change[1]:
        _sorted(changed(rows.filter("false"), (lambda none: none, change[1])), key).write.mode("append").parquet(path)
    return appends + 1


def _sorted(rows: DataFrame, key: str | None) -> DataFrame:
    return rows.repartitionByRange(F.col(key)).sortWithinPartitions(key) if key in rows.columns else rows


def write_snapshot(spark: SparkSession, root: str, facts: Mapping[str, DataFrame], commit: str = "unknown", created_at: str | None = None, fingerprint: dict | None = None, keep: int = 2, same: Collection[str] = (), changes: Mapping[str, Change] | None = None) -> int:
    """Writes the next snapshot and makes it the current one; older ones than ``keep`` go. Its number.

    same: tables that are as in the current snapshot; they, and their indexes, are neither read nor written.
    changes: what makes tables of ``facts`` of those in the current snapshot; other tables are written whole.
    """
    now = manifest(spark, root)
    names = names_below(spark, root)
    number = 1 + max([0, *(int(m[1]) for name in names if (m := re.match(r"(?:manifest-|snapshot=)(\d+)", name)))])
    place = f"snapshot={number}-{uuid.uuid4().hex[:8]}"
    tables, made = {}, {}
    before, appends = (now or {}).get("appends", {}), {}
    for table, rows in facts.items():
        if table in same and now and table in now["tables"]:
            tables[table] = now["tables"][table]
            appends[table] = before.get(table, 0)
        elif table in (changes or {}) and now and table in now["tables"]:
            tables[table] = f"{place}/{table}"
            appends[table] = _rewrite(spark.read.parquet(f"{root}/{now['tables'][table]}"), changes[table], _ORDER.get(table), f"{root}/{tables[table]}", before.get(table, 0))
        else:
            tables[table] = f"{place}/{table}"
            _sorted(rows, _ORDER.get(table)).write.parquet(f"{root}/{place}/{table}")
    for name, (table, key, derived) in _INDEXES.items():
        if table in facts:
            if now and tables[table] == now["tables"].get(table) and name in now["indexes"]:
                made[name] = now["indexes"][name]
                appends[name] = before.get(name, 0)
            elif derived is _all and table in (changes or {}) and now and name in now["indexes"]:
                made[name] = f"{place}/{name}"
                appends[name] = _rewrite(spark.read.parquet(f"{root}/{now['indexes'][name]}"), changes[table], key, f"{root}/{made[name]}", before.get(name, 0))
            else:
                made[name] = f"{place}/{name}"
                _sorted(derived(spark.read.parquet(f"{root}/{tables[table]}")), key).write.parquet(f"{root}/{place}/{name}")
    value = {"snapshot": number, "tables": tables, "indexes": made, "appends": appends, "commit": commit, "created_at": created_at or now_iso(), "schema_version": SCHEMA_VERSION, "fingerprint": fingerprint}
    _put(spark, f"{root}/manifest-{number}.json", json.dumps(value, indent=2) + "\n", replace=False)
    _clean(spark, root, number, keep)
    return number


def _clean(spark: SparkSession, root: str, number: int, keep: int) -> None:
    """Deletes older manifests than the last ``keep``, then the directories of earlier numbers that none of those left names."""
    names = names_below(spark, root)
    numbers = sorted((int(m[1]) for name in names if (m := re.fullmatch(r"manifest-(\d+)\.json", name))), reverse=True)
    for old in numbers[keep:]:
        delete(spark, f"{root}/manifest-{old}.json")
    used: set[str] = set()
    for left in numbers[:keep]:
        try:
            value = read_json(spark, f"{root}/manifest-{left}.json") or {}
        except ValueError:
            continue
        used |= {p.split("/")[0] for p in [*value.get("tables", {}).values(), *value.get("indexes", {}).values()]}
    for name in names:
        if (m := re.match(r"snapshot=(\d+)", name)) and int(m[1]) < number and name not in used:
            delete(spark, f"{root}/{name}")


def read_insights(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """Annotations: Parquet tables if they were written here, else insights.json; else None."""
    if exists(spark, f"{root}/insights"):
        return {t: spark.read.schema(json_schema(t)).parquet(f"{root}/insights/{t}") for t in INSIGHT_ROWS}
    if exists(spark, f"{root}/insights.json"):
        return _arrays(spark, f"{root}/insights.json", INSIGHT_ROWS)
    return None


def load_insights(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    found = read_insights(spark, root)
    if found is None:
        raise NotStored(f"no insights are stored at {root}; write them first")
    return found


def write_insights(root: str, insights: Mapping[str, DataFrame]) -> None:
    for table in INSIGHT_ROWS:
        insights[table].select(json_schema(table).names).write.mode("overwrite").parquet(f"{root}/insights/{table}")


def wipe(spark: SparkSession, root: str) -> None:
    delete(spark, root)
