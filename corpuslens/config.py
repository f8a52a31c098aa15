"""Defaults of the engine (fixed values that results depend on)."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    threshold: float = 0.7
    redundant: float = 0.9
    shingle: int = 3
    slots: int = 128
    bands: int = 25
    rows: int = 5
    min_chars: int = 100
    min_capability_chars: int = 50
    scaffold_size: int = 5
    scaffold_similarity: float = 0.98
    lookup_parts: int = 64
    official_prefixes: tuple[str, ...] = field(default=("anthropic", "claude-plugins-official"))


DEFAULT = Config()
