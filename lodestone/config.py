"""Settings of all stages; numbers are cast, as YAML reads 1e-4 as text."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class Chunking:
    method: str = "token"
    size: int = 512
    overlap: int = 12
    #: A tokenizer file for token windows and counts; blank-separated words without one.
    tokenizer: str = ""


@dataclass
class Augmentation:
    enabled: bool = True
    threshold: float = 0.8
    batch: int = 128


@dataclass
class PageRank:
    alpha: float = 0.85
    tolerance: float = 1e-4
    most_rounds: int = 100
    large: tuple[int, int] = (20, 50)
    small: tuple[int, int] = (3, 10)


@dataclass
class Alignment:
    forward: float = 1.0
    backward: float = 0.3
    parameter: float = 1.0
    short_tokens: int = 10
    top_k: int = 10
    #: Tokens of a prompt and its target; 0 for no limit.
    most_tokens: int = 0


@dataclass
class Queries:
    number: int = 5
    top_k: int = 10


@dataclass
class Training:
    positives: int = 10
    negatives: int = 20
    seed: int = 0


@dataclass
class Retrieval:
    kind: str = "dense"
    top_k: int = 5
    weights: tuple[float, float, float] = (1.0, 0.3, 1.0)


@dataclass
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    augmentation: Augmentation = field(default_factory=Augmentation)
    pagerank: PageRank = field(default_factory=PageRank)
    alignment: Alignment = field(default_factory=Alignment)
    queries: Queries = field(default_factory=Queries)
    training: Training = field(default_factory=Training)
    retrieval: Retrieval = field(default_factory=Retrieval)


def _filled(into, values: dict):
    for f in fields(into):
        if f.name not in values:
            continue
        now, new = getattr(into, f.name), values[f.name]
        if is_dataclass(now):
            _filled(now, new or {})
        elif isinstance(now, tuple):
            setattr(into, f.name, tuple(type(a)(b) for a, b in zip(now, new)))
        elif isinstance(now, bool):
            setattr(into, f.name, new if isinstance(new, bool) else str(new).lower() in ("1", "true", "yes"))
        else:
            setattr(into, f.name, type(now)(new))
    unknown = set(values) - {f.name for f in fields(into)}
    if unknown:
        raise KeyError(f"unknown settings: {sorted(unknown)}")
    return into


def load(text_or_dict: str | dict | None = None, *more: dict) -> Config:
    """Defaults, overlaid by YAML text or a dictionary, then by further dictionaries."""
    values = text_or_dict or {}
    if isinstance(values, str):
        import yaml

        values = yaml.safe_load(values) or {}
    out = _filled(Config(), values)
    for extra in more:
        _filled(out, extra)
    return out
