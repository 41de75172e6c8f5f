"""Settings as frozen records, with a loader that follows nested sections."""

from __future__ import annotations

import dataclasses
import typing
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    overlap_tokens: int = 32
    #: Grains of table chunks that are indexed.
    enabled_chunk_types: tuple[str, ...] = ("full_table", "table_row")

    @property
    def stride(self) -> int:
        stride = self.max_tokens - self.overlap_tokens
        if stride <= 0:
            raise ValueError("overlap_tokens must be smaller than max_tokens")
        return stride


@dataclass(frozen=True)
class Stage:
    """One index stage: how many numbers of a vector it sees, how many candidates it gives, what they weigh."""

    name: str
    dimension: int
    top_k: int
    weight: float
    normalize: bool = True
    metric: str = "dot"
    model_name: str | None = None
    #: exact, or cells: search only the cells nearest to a query (`probes` of them).
    search: str = "exact"
    probes: int = 12


@dataclass(frozen=True)
class Retrieval:
    stages: tuple[Stage, ...] = (Stage("coarse", 384, 200, 1.0),)
    lambda_similarity: float = 0.80
    alpha_reliability: float = 0.0
    beta_temporal: float = 0.0
    gamma_domain: float = 0.0
    zeta_structural_similarity: float = 0.20
    epsilon_bm25: float = 0.0
    enable_structural_similarity: bool = True

    @property
    def total_weight(self) -> float:
        total = self.lambda_similarity + self.alpha_reliability + self.beta_temporal + self.gamma_domain + self.zeta_structural_similarity + self.epsilon_bm25
        if total == 0:
            raise ZeroDivisionError("all fusion weights are zero")
        return total


@dataclass(frozen=True)
class Embedding:
    model_name: str = "hash"
    batch_size: int = 64
    normalize: bool = True


@dataclass(frozen=True)
class Generation:
    model_name: str = "none"
    temperature: float = 0.1
    top_p: float = 0.9
    max_new_tokens: int = 512
    #: Fixed value.
    system_prompt: str = "You are a grounded assistant. Use only the provided context.\nCite evidence by chunk id when possible."


@dataclass(frozen=True)
class CrossEncoder:
    model_name: str = "overlap"
    batch_size: int = 32
    top_n: int = 10


@dataclass(frozen=True)
class PdfIngestion:
    chunk_size: int = 2000
    chunk_overlap: int = 500
    #: Fixed values that synthetic metadata is drawn from.
    document_types: tuple[str, ...] = ("HR Policy", "Financial Report", "Technical Manual", "Internal Memo")
    departments: tuple[str, ...] = ("HR", "Finance", "Engineering", "Operations")
    confidentiality_levels: tuple[str, ...] = ("Public", "Internal", "Confidential")
    authors: tuple[str, ...] = tuple(f"Author_{i}" for i in range(1, 11))


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    embedding: Embedding = field(default_factory=Embedding)
    generation: Generation = field(default_factory=Generation)
    storage_dir: str = "storage"
    run_name: str = "default"
    use_graph_rerank: bool = False
    cross_encoder: CrossEncoder | None = None


def _value(kind: Any, value: Any) -> Any:
    """A JSON value as the annotated kind: records from objects, tuples from lists."""
    options = [a for a in typing.get_args(kind) if a is not type(None)] if typing.get_origin(kind) is not tuple else []
    if options and value is not None and not dataclasses.is_dataclass(kind):
        return _value(options[0], value)
    if dataclasses.is_dataclass(kind) and isinstance(value, dict):
        return from_dict(value, kind)
    if typing.get_origin(kind) is tuple and isinstance(value, (list, tuple)):
        return tuple(_value(typing.get_args(kind)[0], v) for v in value)
    return value


def from_dict(payload: dict[str, Any], kind: type = Settings):
    """A record from a dict; keys that the record lacks are left out, nulls keep the default."""
    hints = typing.get_type_hints(kind)
    names = {f.name for f in dataclasses.fields(kind)}
    return kind(**{k: _value(hints[k], v) for k, v in payload.items() if k in names and v is not None})
