"""Settings with their ranges, from a dictionary, a JSON or a TOML file."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import asdict, dataclass, fields

#: Least and greatest value of the numeric settings.
RANGES = {
    "timeout": (1, 300), "max_retries": (0, 10), "max_concurrent": (1, 100), "batch_size": (10, 500), "target_tags": (10, 1000), "tags_per_row": (1, 20),
    "folder_limit": (5, 200), "max_description": (50, 500), "budget_usd": (0, 10_000), "checkpoint_every": (1, 10_000),
}


@dataclass(frozen=True)
class Settings:
    timeout: float = 30.0
    max_retries: int = 3
    max_concurrent: int = 20
    batch_size: int = 100
    target_tags: int = 150
    tags_per_row: int = 5
    folder_limit: int = 20
    max_description: int = 150
    budget_usd: float = 10.0
    checkpoint_every: int = 50
    strategy: str = "highest_quality"
    engine: str = "local"

    def problems(self) -> list[str]:
        found = [f"{name} is outside {low}..{high}" for name, (low, high) in RANGES.items() if not low <= getattr(self, name) <= high]
        found += ["unknown engine"] if self.engine not in ("local", "cloud", "hybrid") else []
        return found + (["unknown strategy"] if self.strategy not in ("newest", "oldest", "most_complete", "highest_quality") else [])

    def digest(self) -> str:
        """Sixteen hexadecimal digits that change with any setting."""
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def from_dict(given: dict) -> Settings:
    flat = {k: v for part in given.values() if isinstance(part, dict) for k, v in part.items()} | {k: v for k, v in given.items() if not isinstance(v, dict)}
    if unknown := set(flat) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    settings = Settings(**flat)
    if problems := settings.problems():
        raise ValueError("; ".join(problems))
    return settings


def load(path: str) -> Settings:
    with open(path, "rb") as f:
        return from_dict(tomllib.load(f) if path.endswith(".toml") else json.load(f))


def template() -> str:
    """A TOML file with all settings at their defaults."""
    return "".join(f"{k} = {json.dumps(v)}\n" for k, v in asdict(Settings()).items())
