"""Table schemas. Facts and annotations are flat tables; positions are nested only in JSON files."""

from __future__ import annotations

from pyspark.sql import types as T

_POSITION = "position struct<line:int,column:int,byte_offset:bigint>"
#: JSON rows of each facts table, as files hold them.
JSON_ROWS = {
    "units": "id string, kind string, name string, path string, metadata map<string,string>",
    "files": "id string, path string, unit_id string, hash string, generated boolean",
    "deps": "from_unit_id string, to_unit_id string, kind string",
    "symbols": f"id string, unit_id string, name string, kind string, signature string, exported boolean, decl struct<file_id:string,{_POSITION.replace(' ', ':', 1)}>, metadata map<string,string>",
    "refs": f"from_symbol_id string, to_symbol_id string, site struct<file_id:string,{_POSITION.replace(' ', ':', 1)}>, kind string, confidence string",
    "type_relations": "from_type_id string, to_type_id string, kind string",
    "call_edges": f"caller_id string, callee_id string, site struct<file_id:string,{_POSITION.replace(' ', ':', 1)}>, dispatch string",
    "diagnostics": f"file_id string, {_POSITION}, severity string, message string, tool string",
}
#: The struct that each nested table carries its place in, and the prefix of the flat columns.
PLACES = {"symbols": "decl", "refs": "site", "call_edges": "site"}
TABLES = tuple(JSON_ROWS)

_META = "meta struct<model:string,confidence:double,generated_at:string>"
INSIGHT_ROWS = {
    "intent_tags": f"target_id string, target_kind string, intent string, reasoning string, {_META}",
    "summaries": f"target_id string, target_kind string, text string, {_META}",
    "bug_smells": f"file_id string, {_POSITION}, smell string, message string, severity string, {_META}",
    "pattern_tags": f"target_id string, target_kind string, pattern string, participants array<string>, {_META}",
    "naming_issues": f"symbol_id string, issue string, current_name string, suggestion string, message string, {_META}",
}
FINGERPRINT = "schema_version int, tools map<string,string>, build_profile map<string,string>, repo_state struct<commit:string,working_tree_hash:string>, created_at string"
SCHEMA_VERSION = 1


def json_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL({**JSON_ROWS, **INSIGHT_ROWS}[table])
