"""Settings of ingestion and retrieval, with environment overrides."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

#: Characters a token stands for when sizes in tokens become sizes in characters.
CHARS_PER_TOKEN = 4


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    api_key: str = ""
    temperature: float = 0.3
    chunk_size: int = 625
    chunk_overlap: int = 125
    parent_size: int | None = None
    top_k: int = 5
    rrf_k: int = 60
    overfetch: int = 3
    expand_query: bool | None = None
    enable_query_expansion: bool = True
    min_similarity: float = 0.5
    quota: int = 5
    quota_seconds: int = 900

    @property
    def chunk_chars(self) -> int:
        return self.chunk_size * CHARS_PER_TOKEN

    @property
    def overlap_chars(self) -> int:
        return self.chunk_overlap * CHARS_PER_TOKEN

    @property
    def parent_chars(self) -> int:
        """Twice a chunk unless it is set."""
        return (self.parent_size or 2 * self.chunk_size) * CHARS_PER_TOKEN

    def expands(self) -> bool:
        """An explicit choice wins over the switch."""
        return self.enable_query_expansion if self.expand_query is None else self.expand_query

    def problems(self) -> list[str]:
        """What is wrong with the settings; empty if nothing is."""
        checks = [
            (placeholder_key(self.api_key), "api_key is missing or a placeholder"),
            (not os.path.isdir(self.data_dir), f"data_dir {self.data_dir} does not exist"),
            (not 0 <= self.temperature <= 2, "temperature is not within 0 and 2"),
            (self.chunk_size < 100, "chunk_size is below 100"),
            (self.chunk_overlap >= self.chunk_size, "chunk_overlap is not below chunk_size"),
        ]
        return [text for bad, text in checks if bad]

    def __repr__(self) -> str:
        shown = ", ".join(f"{f.name}={'***' if f.name == 'api_key' and self.api_key else getattr(self, f.name)!r}" for f in fields(self))
        return f"Config({shown})"


def placeholder_key(key: str | None) -> bool:
    return not key or "YOUR_" in key or len(key) < 20


def from_env(env: Mapping[str, str] | None = None, prefix: str = "LECTERN_") -> Config:
    """Defaults, overridden by LECTERN_<FIELD> where it is set; a value that doesn't parse is an error."""
    env = os.environ if env is None else env
    config, found = Config(), {}
    for f in fields(Config):
        raw = env.get(prefix + f.name.upper())
        if raw is None:
            continue
        if "bool" in str(f.type):
            found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
        elif "int" in str(f.type):
            found[f.name] = int(raw)
        elif "float" in str(f.type):
            found[f.name] = float(raw)
        else:
            found[f.name] = raw
    return replace(config, **found)
