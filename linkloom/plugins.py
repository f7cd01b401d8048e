"""Plugins: named transforms at hook points, in order of priority."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame

HOOKS = (
    "on_load", "pre_validation", "post_validation", "validation_filter", "pre_content", "post_content", "content_enhance", "pre_ai", "post_ai", "ai_process",
    "pre_tags", "post_tags", "tag_generate", "pre_folders", "post_folders", "pre_export", "post_export",
)

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Plugin:
    """A name, and a transform of a DataFrame for each hook it serves."""

    name: str
    hooks: dict[str, Transform]
    priority: int = 100
    version: str = "1"
    check: Callable[[dict], list[str]] = field(default=lambda config: [])


class Registry:
    def __init__(self):
        self.plugins: dict[str, Plugin] = {}
        self.loaded: dict[str, list[str]] = {}

    def register(self, plugin: Plugin, config: dict | None = None) -> None:
        if unknown := set(plugin.hooks) - set(HOOKS):
            raise ValueError(f"unknown hooks: {sorted(unknown)}")
        if errors := plugin.check(config or {}):
            raise ValueError("; ".join(errors))
        self.plugins[plugin.name] = plugin

    def unregister(self, name: str) -> None:
        self.plugins.pop(name, None)

    def at(self, hook: str) -> list[Plugin]:
        """Plugins of a hook by priority, then name."""
        return sorted((p for p in self.plugins.values() if hook in p.hooks), key=lambda p: (p.priority, p.name))

    def each(self, hook: str, df: DataFrame) -> list[DataFrame]:
        """Every plugin's result on the same rows."""
        return [p.hooks[hook](df) for p in self.at(hook)]

    def chain(self, hook: str, df: DataFrame) -> DataFrame:
        """The rows passed from plugin to plugin."""
        return reduce(lambda rows, p: rows.transform(p.hooks[hook]), self.at(hook), df)

    def load(self, directory: str) -> list[str]:
        """Registers ``plugin`` of every Python file of a directory, and again as the files are now if called again; returns the names."""
        found = []
        for path in sorted(Path(directory).glob("*.py")):
            spec = importlib.util.spec_from_file_location(path.stem, path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            if isinstance(plugin := getattr(module, "plugin", None), Plugin):
                self.register(plugin)
                found.append(plugin.name)
        for name in set(self.loaded.get(directory, ())) - set(found):  # its file is gone
            self.unregister(name)
        self.loaded[directory] = found
        return found


def paywall_plugin() -> Plugin:
    """Adds ``paywall`` (confidence) where rows have a url and a body."""
    from pyspark.sql import functions as F

    from .operators.validation import paywall

    return Plugin("paywall", {"post_validation": lambda df: df.withColumn("paywall", paywall(F.col("url"), F.col("body") if "body" in df.columns else F.lit("")))})
