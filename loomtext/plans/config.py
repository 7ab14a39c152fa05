"""Settings: frozen, validated, with profiles, overrides and differences."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field, replace

PREFIX = "LOOMTEXT_"
STRATEGIES = ("sentence", "paragraph", "token", "semantic")
FORMS = ("NFC", "NFD", "NFKC", "NFKD", "none")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in [{low}, {high}]")


@dataclass(frozen=True)
class Processing:
    batch_size: int = 10
    max_file_size_mb: int = 100
    timeout_seconds: int = 300


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 512
    chunk_overlap: int = 50
    min_chunk_size: int = 100
    strategy: str = "sentence"
    min_sentence_length: int = 5
    fix_order: bool = False

    def __post_init__(self):
        _within("chunk_size", self.chunk_size, 100, 2048)
        _within("chunk_overlap", self.chunk_overlap, 0, 500)
        _within("min_chunk_size", self.min_chunk_size, 50, 1000)
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be below chunk_size")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")


@dataclass(frozen=True)
class Cleaning:
    normalize_unicode: str = "NFC"
    normalize_whitespace: bool = True
    standardize_punctuation: bool = True
    remove_boilerplate: bool = True
    remove_stopwords: bool = True
    strip_html_tags: bool = False
    mask_personal_data: bool = False
    min_text_length: int = 10
    stopwords: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.normalize_unicode not in FORMS:
            raise ValueError(f"normalize_unicode must be one of {FORMS}")


@dataclass(frozen=True)
class Dedup:
    enable_exact_dedup: bool = True
    enable_fuzzy_dedup: bool = True
    similarity_threshold: float = 0.85
    sentence_dedup: bool = True
    chunk_dedup: bool = True
    min_sentence_length: int = 5
    hash_algorithm: str = "xxhash"

    def __post_init__(self):
        _within("similarity_threshold", self.similarity_threshold, 0, 1)


@dataclass(frozen=True)
class Embedding:
    model_name: str = "none"
    device: str = "auto"
    size: int = 64


@dataclass(frozen=True)
class Output:
    format: str = "jsonl"
    include_text: bool = True
    include_embeddings: bool = True
    include_metadata: bool = True
    include_stats: bool = True
    compression: str | None = None


@dataclass(frozen=True)
class Config:
    processing: Processing = field(default_factory=Processing)
    chunking: Chunking = field(default_factory=Chunking)
    cleaning: Cleaning = field(default_factory=Cleaning)
    dedup: Dedup = field(default_factory=Dedup)
    embedding: Embedding = field(default_factory=Embedding)
    output: Output = field(default_factory=Output)

    def override(self, changes: dict[str, object], allowed: set[str] | None = None) -> Config:
        """A copy with dotted settings changed; those that aren't allowed are left out."""
        out = self
        for name, value in changes.items():
            if allowed is None or name in allowed:
                section, key = name.split(".")
                out = replace(out, **{section: replace(getattr(out, section), **{key: value})})
        return out

    def flat(self) -> dict[tuple[str, str], str]:
        return {(s, k): str(v) for s, part in dataclasses.asdict(self).items() for k, v in part.items()}


PROFILES: dict[str, dict[str, object]] = {
    "development": {"processing.batch_size": 5},
    "staging": {},
    "production": {"processing.batch_size": 50},
    "testing": {"processing.batch_size": 2, "embedding.model_name": "none"},
    "minimal": {"cleaning.remove_stopwords": False, "dedup.enable_fuzzy_dedup": False, "embedding.model_name": "none"},
}


def from_dict(data: dict) -> Config:
    known = {f.name for f in dataclasses.fields(Config)}
    if set(data) - known:
        raise ValueError(f"unknown sections: {sorted(set(data) - known)}")
    return Config().override({f"{s}.{k}": v for s, part in data.items() for k, v in part.items()})


def from_environment(base: Config = Config(), environ=None) -> Config:
    """``LOOMTEXT_<SECTION>__<KEY>`` overrides, read as the type of the default."""
    out = base
    for name, raw in (environ or os.environ).items():
        section, mark, key = name.removeprefix(PREFIX).lower().partition("__")
        part = getattr(out, section, None) if name.startswith(PREFIX) and mark else None
        if part is not None and hasattr(part, key):
            old = getattr(part, key)
            value = raw.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(raw) if old is not None else raw
            out = out.override({f"{section}.{key}": value})
    return out


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {})


def profile(name: str, base: Config = Config()) -> Config:
    return base.override(PROFILES[name])


def warnings(config: Config) -> list[str]:
    """Settings that are allowed but seldom meant."""
    out = []
    if config.chunking.chunk_overlap > config.chunking.chunk_size // 2:
        out.append("the overlap is more than half of a chunk")
    if config.dedup.similarity_threshold < 0.5:
        out.append("a similarity below 0.5 removes texts that differ")
    return out


def difference(old: Config, new: Config) -> dict[tuple[str, str], tuple[str | None, str]]:
    """Changed settings, as (old, new)."""
    a, b = old.flat(), new.flat()
    return {k: (a.get(k), v) for k, v in b.items() if a.get(k) != v}
