"""Fingerprints of the environment that facts were made in: probing, comparing."""

from __future__ import annotations

import platform
import subprocess
import sys
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.schemas import FINGERPRINT, SCHEMA_VERSION


#: What tells the version of each tool; one that isn't there has no entry.
PROBES = {"go": ("go", "version"), "node": ("node", "--version"), "bun": ("bun", "--version")}


def now_iso() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def printed(command: Sequence[str], cwd: str | None = None) -> str | None:
    """What a command prints, trimmed; None where it can't be run, fails or prints nothing."""
    try:
        done = subprocess.run(list(command), cwd=cwd, capture_output=True, text=True, check=False, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def generate(root: str, created_at: str | None = None, profile: Mapping[str, str] | None = None, tools: Mapping[str, str] | None = None, probes: Mapping[str, Sequence[str]] | None = None) -> dict:
    """The present environment; entries of profile and tools win over what is probed (PROBES, if ``probes`` is None)."""
    found = {name: version for name, command in (PROBES if probes is None else probes).items() if (version := printed(command))}
    known = {"spark": pyspark.__version__, "python": platform.python_version()}
    machine = {"os": sys.platform, "arch": platform.machine()}
    commit = printed(["git", "rev-parse", "HEAD"], root) or "unknown"
    return {"schema_version": SCHEMA_VERSION, "tools": known | found | dict(tools or {}), "build_profile": machine | dict(profile or {}), "repo_state": {"commit": commit}, "created_at": created_at or now_iso()}


def as_frame(spark: SparkSession, fingerprint: Mapping) -> DataFrame:
    return spark.createDataFrame([dict(fingerprint)], FINGERPRINT)


def entries(fingerprints: DataFrame, commit: bool = False) -> DataFrame:
    """section, key, value of every entry that is compared; the commit only on demand."""
    version = fingerprints.select(F.lit("schema_version").alias("section"), F.lit("").alias("key"), F.col("schema_version").cast("string").alias("value"))
    out = version
    for name in ("tools", "build_profile"):
        out = out.unionByName(fingerprints.select(F.lit(name).alias("section"), F.explode(name).alias("key", "value")))
    if commit:
        out = out.unionByName(fingerprints.select(F.lit("repo_state").alias("section"), F.lit("commit").alias("key"), F.col("repo_state.commit").alias("value")))
    return out


def differences(now: DataFrame, before: DataFrame, commit: bool = False) -> DataFrame:
    """section, key, old, new of what changed, appeared or went; none: the fingerprints match."""
    a, b = entries(before, commit).withColumnRenamed("value", "old"), entries(now, commit).withColumnRenamed("value", "new")
    return a.join(b, ["section", "key"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
