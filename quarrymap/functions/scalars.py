"""Column expressions of the code-facts model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE = "file:"


def file_id(path: Column) -> Column:
    """The id of a file given its path or its id."""
    return F.when(F.startswith(path, F.lit(FILE)), path).otherwise(F.concat(F.lit(FILE), path))


def file_literal(path: str) -> str:
    return path if path.startswith(FILE) else FILE + path


def language_of(unit_id: Column) -> Column:
    """The second part of unit:<language>:<path>."""
    return F.split(unit_id, ":")[1]


def of_language(unit_id: Column, language: str) -> Column:
    return F.startswith(unit_id, F.lit(f"unit:{language}:"))


def unit_id(language: str, path: Column) -> Column:
    """The root of a repository is the unit '.'."""
    return F.concat(F.lit(f"unit:{language}:"), F.when(path == "", F.lit(".")).otherwise(path))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


def segments(path: Column) -> Column:
    """The parts of a path, with '.' and '..' resolved as far as there is something above."""
    up = lambda done: (F.size(done) > 0) & (F.element_at(done, -1) != "..")
    fold = lambda done, part: F.when((part == "") | (part == "."), done).when((part == "..") & up(done), F.slice(done, 1, F.size(done) - 1)).otherwise(F.array_append(done, part))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold)


def relative_path(path: Column, root: str) -> Column:
    """An absolute path as seen from root ('' for root itself, with '..' for what is elsewhere); a relative one is taken as below root. Both are normalised."""
    base = [p for p in root.split("/") if p not in ("", ".")]
    parts = segments(path)
    shared = F.lit(0)
    for k in range(len(base), 0, -1):
        shared = F.when(F.get(parts, F.lit(k - 1)) == base[k - 1], shared + 1).otherwise(F.lit(0))
    below = F.concat(F.array_repeat(F.lit(".."), F.lit(len(base)) - shared), F.slice(parts, shared + 1, F.size(parts)))
    return F.array_join(F.when(F.startswith(path, F.lit("/")), below).otherwise(parts), "/")


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def symbol_signature(signature: Column) -> Column:
    return F.substring(F.sha2(signature, 256), 1, 8)


def is_generated(content: Column) -> Column:
    """Whether the first 1024 bytes hold the mark of generated code."""
    return F.contains(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), F.lit("// Code generated"))


def int_or(text: Column, default: int) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("int"), F.lit(default))


def join_present(parts: list[Column], separator: str = "\n") -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), separator)


def overridden(base: Column, by: Column) -> Column:
    """Map union in which the right side wins, whatever the session's policy on repeated keys."""
    left = F.map_filter(base, lambda k, v: ~F.map_contains_key(by, k))
    return F.map_concat(left, by)


def now_iso() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
