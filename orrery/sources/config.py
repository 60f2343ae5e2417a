"""Settings in layers, registries of repositories, and the choice of tools: plain Python on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    preset: str = "full"
    max_tool_count: int | None = None
    disabled_tools: tuple[str, ...] = ()
    enabled_tools: tuple[str, ...] = ()
    max_file_bytes: int = 2 * 1024 * 1024
    token_budget: int = 8000
    #: Path prefixes and what stands below them.
    contexts: dict[str, str] = field(default_factory=dict)


def _yaml(path: str | Path | None) -> dict:
    import yaml

    if path is None or not Path(path).is_file():
        return {}
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def _typed(name: str, value):
    kind = {f.name: f.default for f in fields(Settings)}[name]
    if name == "contexts":
        return dict(value)
    if isinstance(kind, tuple):
        return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
    if name in ("max_tool_count", "max_file_bytes", "token_budget"):
        return None if value in (None, "") else int(value)
    return str(value)


def load_settings(user: str | None = None, project: str | None = None, environment: dict[str, str] | None = None, given: dict | None = None, prefix: str = "ORRERY_") -> Settings:
    """Defaults, then the user's file, the project's file, the environment and what the caller gives: each wins over those before.

    Unknown names raise; contexts are merged by path, all else is replaced.
    """
    environment = dict(os.environ) if environment is None else environment
    known = {f.name for f in fields(Settings)}
    layers = [_yaml(user), _yaml(project), {k[len(prefix) :].lower(): v for k, v in environment.items() if k.startswith(prefix) and k[len(prefix) :].lower() in known}, given or {}]
    out = Settings()
    for layer in layers:
        if set(layer) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(set(layer) - known))}")
        new = {k: _typed(k, v) for k, v in layer.items()}
        if "contexts" in new:
            new["contexts"] = {**out.contexts, **new["contexts"]}
        out = replace(out, **new)
    return out


class Workspace:
    """A registry of repositories in a YAML file: names and roots, in the order they were added."""

    def __init__(self, path: str):
        self.path = path
        self.repos: dict[str, str] = {r["name"]: r["root"] for r in _yaml(path).get("repos", [])}

    def save(self) -> None:
        import yaml

        Path(self.path).write_text(yaml.safe_dump({"repos": [{"name": n, "root": r} for n, r in self.repos.items()]}, sort_keys=False), encoding="utf-8")

    def add(self, name: str, root: str) -> None:
        if name in self.repos:
            raise ValueError(f"{name} is there already")
        if not Path(root).is_dir():
            raise ValueError(f"{root} is no folder")
        self.repos[name] = str(Path(root).resolve())
        self.save()

    def remove(self, name: str) -> bool:
        found = self.repos.pop(name, None) is not None
        if found:
            self.save()
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        """(repo, root): the dimension that partitions the tables of symbols."""
        return spark.createDataFrame(list(self.repos.items()) or [], "repo string, root string")

    def scan(self, spark: SparkSession) -> DataFrame:
        """Sources of all repositories, with `repo` before their columns."""
        from orrery.sources.tree import scan_tree

        out = None
        for name, root in self.repos.items():
            part = scan_tree(spark, root).select(F.lit(name).alias("repo"), "*")
            out = part if out is None else out.unionByName(part)
        if out is None:
            return spark.createDataFrame([], "repo string, file_path string, language string, size_bytes long, content string, content_hash string")
        return out


#: What each preset offers, as categories.
PRESETS = {"minimal": ["core"], "balanced": ["core", "graph", "search"], "full": ["core", "graph", "search", "analysis", "security", "git"], "security": ["core", "security"]}


def filter_tools(tools: list[tuple[str, str]], settings: Settings) -> list[str]:
    """Names of the tools (name, category) of the preset, with those enabled, without those disabled, at most max_tool_count."""
    kept = [n for n, c in tools if (c in PRESETS[settings.preset] or n in settings.enabled_tools) and n not in settings.disabled_tools]
    return kept if settings.max_tool_count is None else kept[: settings.max_tool_count]


def validate_path(root: str, path: str) -> Path:
    """The path below root, links resolved; one that leads out raises."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if full != base and base not in full.parents:
        raise ValueError(f"{path} leads out of {root}")
    return full
