"""Facts of a Go module from the output of its tools: package listings and vet diagnostics.

The tools themselves run on the driver (``run_tool``); what they print is parsed and joined as DataFrames.
"""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.functions.scalars import file_id, int_or, of_language, relative_path, trimmed, unit_id
from quarrymap.sources.storage import bound_batches

PACKAGES = "ImportPath string, Name string, Dir string, GoFiles array<string>, Imports array<string>, Standard boolean, Module struct<Path:string>"
LANGUAGE = "go"
PARSED = 64


def run_tool(command: list[str], cwd: str, environment: dict[str, str] | None = None) -> tuple[int, str, str]:
    """(exit code, stdout, stderr), both trimmed; the environment is added to the driver's."""
    done = subprocess.run(command, cwd=cwd, env=os.environ | (environment or {}), capture_output=True, text=True, check=False)
    return done.returncode, done.stdout.strip(), done.stderr.strip()


def objects(text: str) -> Iterator[dict]:
    """JSON values that follow one another, whatever white space is between them; braces in strings don't matter."""
    reader, at = json.JSONDecoder(), 0
    while (at := next((i for i in range(at, len(text)) if not text[i].isspace()), len(text))) < len(text):
        value, at = reader.raw_decode(text, at)
        yield value


def parse_packages(listings: DataFrame) -> DataFrame:
    """Packages of each row's text (column ``text``), parsed on the executors, of which no worker holds more than a batch of texts and PARSED packages."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = (json.dumps(o) for text in frame["text"] for o in objects(text or ""))
            while some := list(islice(found, PARSED)):
                yield pd.DataFrame({"value": pd.Series(some, dtype="object")})

    bound_batches(listings.sparkSession)
    raw = listings.select("text").mapInPandas(parse, "value string")
    return raw.select(F.from_json("value", PACKAGES).alias("p")).select("p.*")


def build_profile(run: Callable[[list[str], str], tuple[int, str, str]], root: str) -> dict[str, str]:
    """GOOS, GOARCH and GOTAGS as the toolchain sees them; what it doesn't tell is empty, and without a toolchain there is none."""
    out = {}
    for key in ("GOOS", "GOARCH", "GOTAGS"):
        try:
            code, value, _ = run(["go", "env", key], root)
        except OSError:
            return {}
        out[key] = value if code == 0 else ""
    return out


def units(pkgs: DataFrame, root: str) -> DataFrame:
    """One unit a package that isn't of the standard library; the root package is '.'."""
    own = pkgs.filter(~F.coalesce("Standard", F.lit(False)))
    path = relative_path(F.col("Dir"), root)
    path = F.when(path == "", F.lit(".")).otherwise(path)
    meta = F.create_map(F.lit("import_path"), F.col("ImportPath"), F.lit("module_path"), F.col("Module.Path"), F.lit("repo_root"), F.lit(root))
    return own.select(unit_id(LANGUAGE, path).alias("id"), F.lit("go_package").alias("kind"), F.col("Name").alias("name"), path.alias("path"), meta.alias("metadata"))


def files(pkgs: DataFrame, units_: DataFrame, root: str, marks: DataFrame) -> DataFrame:
    """Files of the units' packages. marks: path, hash, generated of ``sources.files.file_marks``."""
    listed = units_.select(F.col("id").alias("unit_id"), F.col("metadata")["import_path"].alias("ImportPath")).join(pkgs, "ImportPath")
    listed = listed.select("unit_id", F.explode("GoFiles").alias("name"), relative_path(F.col("Dir"), root).alias("dir"))
    listed = listed.select("unit_id", F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name")).alias("path"))
    return listed.join(marks, "path").select(file_id(F.col("path")).alias("id"), "path", "unit_id", "hash", "generated")


def internal_deps(imports: DataFrame, pkgs: DataFrame, units_: DataFrame, module: str, root: str) -> DataFrame:
    """Imports (from_unit_id, import_path) of packages of this module that are units, as deps.

    The root package as a target is the unit '.' like anywhere else.
    """
    inner = imports.filter(F.startswith("import_path", F.lit(module)))
    own = pkgs.filter(~F.coalesce("Standard", F.lit(False))).select(F.col("ImportPath").alias("import_path"), unit_id(LANGUAGE, relative_path(F.col("Dir"), root)).alias("to_unit_id"))
    return inner.join(own, "import_path").join(units_.select(F.col("id").alias("to_unit_id")).distinct(), "to_unit_id", "left_semi").select("from_unit_id", "to_unit_id", F.lit("import").alias("kind"))


def deps(pkgs: DataFrame, units_: DataFrame, module: str, root: str) -> DataFrame:
    own = units_.select(F.col("id").alias("from_unit_id"), F.col("metadata")["import_path"].alias("ImportPath"))
    imports = own.join(pkgs, "ImportPath").select("from_unit_id", F.explode("Imports").alias("import_path"))
    return internal_deps(imports, pkgs, units_, module, root)


#: A place is a path, a line and perhaps a column, each ended by a colon; what follows is the message.
_PATH, _NUMBER, _MESSAGE = "(.+?)", ":([0-9]+)", r":\s*(\S.*)"
VET_LINE = "^" + _PATH + _NUMBER + "(?:" + _NUMBER + ")?" + _MESSAGE + "$"


def vet_diagnostics(output: DataFrame, root: str = "") -> DataFrame:
    """file_id, line, col, severity, message, tool of vet output (column ``text``: whole outputs or lines of them).

    Headings (#) and other lines are skipped; a missing column is 1. The pattern runs in the JVM.
    """
    line = output.select(F.explode(F.split("text", "\n")).alias("raw")).select(trimmed(F.col("raw")).alias("line"))
    hit = line.filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & F.col("line").rlike(VET_LINE))
    part = [F.regexp_extract("line", VET_LINE, k) for k in range(5)]
    return hit.select(
        file_id(relative_path(part[1], root)).alias("file_id"),
        int_or(part[2], 0).alias("line"),
        int_or(part[3], 1).alias("col"),
        F.lit("warning").alias("severity"),
        part[4].alias("message"),
        F.lit("go_vet").alias("tool"),
    )


def of_go(units_: DataFrame) -> DataFrame:
    return units_.filter(of_language(F.col("id"), LANGUAGE))
