"""Adapters of languages and tools: what an adapter offers, their registry, and actions on a repository."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymap.sources import files as source_files
from quarrymap.sources import golist


@dataclass(frozen=True)
class Scope:
    """kind: repo, unit, files or paths."""

    kind: str = "repo"
    values: tuple[str, ...] = ()


class LanguageAdapter(Protocol):
    lang: str

    def detect(self, spark: SparkSession, root: str) -> tuple[bool, float]: ...
    def enumerate_units(self, spark: SparkSession, root: str) -> DataFrame: ...
    def index_units(self, spark: SparkSession, root: str, units: DataFrame) -> dict[str, DataFrame]: ...
    def diagnose(self, spark: SparkSession, root: str) -> DataFrame: ...
    def doctor(self) -> tuple[bool, list[str], list[str]]: ...


class ActionAdapter(Protocol):
    def format(self, root: str, scope: Scope) -> dict: ...
    def check(self, root: str, scope: Scope) -> dict: ...
    def test(self, root: str, scope: Scope) -> dict: ...


class InsightAdapter(Protocol):
    """Makes annotations; none is part of the library. Its tables go to ``sources.store.write_insights``."""

    def intents(self, context: DataFrame) -> DataFrame: ...
    def summaries(self, context: DataFrame) -> DataFrame: ...
    def smells(self, context: DataFrame) -> DataFrame: ...
    def patterns(self, context: DataFrame) -> DataFrame: ...
    def naming(self, context: DataFrame) -> DataFrame: ...


def ranked(found: DataFrame) -> DataFrame:
    """lang, confidence, rank of the supported ones of (lang, supported, confidence, place): surest first, then by place."""
    order = Window.orderBy(F.desc("confidence"), "place")  # a handful of rows
    return found.filter("supported").select("lang", "confidence", F.row_number().over(order).alias("rank"))


def all_ok(results: DataFrame, *by: str) -> DataFrame:
    """ok: whether all results are; true of none."""
    return results.groupBy(*by).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))


@dataclass
class Registry:
    languages: dict[str, LanguageAdapter] = field(default_factory=dict)
    actions: dict[str, ActionAdapter] = field(default_factory=dict)

    def register(self, adapter: LanguageAdapter, action: ActionAdapter | None = None) -> None:
        self.languages[adapter.lang] = adapter
        if action is not None:
            self.actions[adapter.lang] = action

    def detect_all(self, spark: SparkSession, root: str) -> list[tuple[LanguageAdapter, float]]:
        """Adapters that support a repository, surest first, ties in order of registration."""
        found = [(a, *a.detect(spark, root)) for a in self.languages.values()]
        return sorted(((a, c) for a, ok, c in found if ok), key=lambda x: -x[1])

    def language(self, lang: str) -> LanguageAdapter | None:
        return self.languages.get(lang)

    def action(self, lang: str) -> ActionAdapter | None:
        return self.actions.get(lang)

    def all(self) -> list[LanguageAdapter]:
        return list(self.languages.values())


Runner = Callable[[list[str], str], tuple[int, str, str]]


@dataclass
class GoAdapter:
    """Facts of Go modules; ``run`` runs the tools."""

    run: Runner = golist.run_tool
    lang: str = golist.LANGUAGE
    _listed: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def profile(self, root: str) -> dict[str, str]:
        """What to pass as ``profile`` to builds and updates, so that another target platform means another fingerprint."""
        return golist.build_profile(self.run, root)

    def detect(self, spark: SparkSession, root: str) -> tuple[bool, float]:
        return source_files.detect(spark, root)

    def doctor(self) -> tuple[bool, list[str], list[str]]:
        """(ok, missing tools, notes): go is needed, gopls only noted."""
        there = {}
        for name in ("go", "gopls"):
            try:
                there[name] = self.run([name, "version"], ".")[0] == 0
            except OSError:
                there[name] = False
        return there["go"], [] if there["go"] else ["go"], [] if there["gopls"] else ["gopls is missing: no symbols"]

    def packages(self, spark: SparkSession, root: str) -> DataFrame:
        code, out, err = self.run(["go", "list", "-json", "./..."], root)
        if code:
            raise RuntimeError(f"go list failed: {err}")
        return golist.parse_packages(spark.createDataFrame([(out,)], "text string"))

    def enumerate_units(self, spark: SparkSession, root: str) -> DataFrame:
        """Units of a new listing, which the next index_units of the same root uses as well."""
        self._listed[root] = self.packages(spark, root)
        return golist.units(self._listed[root], root)

    def index_units(self, spark: SparkSession, root: str, units: DataFrame) -> dict[str, DataFrame]:
        pkgs = self._listed.pop(root, None) or self.packages(spark, root)
        first = pkgs.filter("Module.Path IS NOT NULL").select("Module.Path").first()
        module = first[0] if first else ""
        marks = source_files.file_marks(source_files.contents_below(spark, root, "*.go"))
        return {"units": units, "files": golist.files(pkgs, units, root, marks), "deps": golist.deps(pkgs, units, module, root)}

    def diagnose(self, spark: SparkSession, root: str) -> DataFrame:
        _, _, err = self.run(["go", "vet", "./..."], root)
        return golist.vet_diagnostics(spark.createDataFrame([(err,)], "text string"), root)


def go_targets(scope: Scope) -> list[str]:
    """What the Go tools are pointed at."""
    if scope.kind == "repo":
        return ["./..."]
    if scope.kind == "unit":
        return [f"./{v.rsplit(':', 1)[-1]}/..." if v.rsplit(":", 1)[-1] != "." else "./..." for v in scope.values]
    return list(scope.values)


@dataclass
class GoActions:
    run: Runner = golist.run_tool

    def _result(self, action: str, command: list[str], root: str) -> dict:
        code, out, err = self.run(command, root)
        return {"action": action, "ok": code == 0, "output": "\n".join(x for x in (out, err) if x)}

    def format(self, root: str, scope: Scope) -> dict:
        return self._result("format", ["gofmt", "-w", *([v for v in scope.values] or ["."])], root)

    def check(self, root: str, scope: Scope) -> dict:
        """Builds, and only if that succeeds vets."""
        built = self._result("check", ["go", "build", *go_targets(scope)], root)
        return self._result("check", ["go", "vet", *go_targets(scope)], root) if built["ok"] else built

    def test(self, root: str, scope: Scope) -> dict:
        return self._result("test", ["go", "test", *go_targets(scope)], root)


def default_registry() -> Registry:
    out = Registry()
    out.register(GoAdapter(), GoActions())
    return out


def run_action(registry: Registry, spark: SparkSession, root: str, action: str, scope: Scope | None = None) -> dict:
    """{ok, results, errors}: the action of every detected language."""
    results, errors = [], []
    for adapter, _ in registry.detect_all(spark, root):
        acting = registry.action(adapter.lang)
        if acting is None:
            errors.append(f"{adapter.lang}: no actions")
            continue
        try:
            results.append(getattr(acting, action)(root, scope or Scope()))
        except (OSError, AttributeError) as e:
            errors.append(f"{adapter.lang}: {e}")
    return {"ok": not errors and all(r["ok"] for r in results), "results": results, "errors": errors}
