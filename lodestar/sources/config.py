"""Settings with defaults; a repository's own settings win over the user's."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from lodestar.functions.text import TTL_DAYS


@dataclass
class Config:
    store_dir: str = ".lodestar"
    index_depth: int = 12
    max_file_bytes: int = 1_000_000
    memory_hard_cap: int = 50_000
    compression_budget_tokens: int = 8000
    languages: str | list[str] = "auto"
    respect_gitignore: bool = True
    include_hidden: bool = False
    ignore_patterns: list[str] = field(default_factory=list)
    autocategorize: bool = True
    shared: bool = True
    web_host: str = "127.0.0.1"
    web_port: int = 8765
    ttl_days: dict[str, int] = field(default_factory=lambda: dict(TTL_DAYS))

    @classmethod
    def load(cls, *paths: str) -> Config:
        """Merge JSON files, later ones over earlier ones, nested objects key by key; unknown keys are errors."""
        merged: dict = {}
        for p in paths:
            if Path(p).exists():
                merge(merged, json.loads(Path(p).read_text()))
        unknown = set(merged) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out = cls()
        for k, v in merged.items():
            setattr(out, k, {**getattr(out, k), **v} if isinstance(v, dict) else v)
        return out


def merge(into: dict, new: dict) -> dict:
    for k, v in new.items():
        into[k] = merge(dict(into.get(k, {})), v) if isinstance(v, dict) and isinstance(into.get(k, {}), dict) else v
    return into
