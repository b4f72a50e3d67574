"""Contracts of an index and parameters of retrieval, checked when they are made."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

NAME = re.compile(r"[A-Za-z0-9_-]+")
VERSION = re.compile(r"[0-9a-f]{64}")


class ConfigError(ValueError):
    """A setting that no run can start with."""


class DataError(RuntimeError):
    """Stored data that break their contract; results are withheld, not degraded."""


def _whole(name: str, value: object, least: int = 1) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or value < least:
        raise ConfigError(f"{name} must be a whole number of at least {least}")


@dataclass(frozen=True)
class IndexContract:
    """Everything that an index version depends on besides its records."""

    collection_prefix: str = "docs"
    embedding_model: str = "table-v1"
    embedding_dimensions: int = 64
    tokenizer_encoding: str = "chars-v1"
    soft_limit_tokens: int = 800
    hard_limit_tokens: int = 1200
    bm25_tokenizer_version: str = "nfkc-bigram-identifier-v1"
    chunker_version: str = "markdown-structure-v1"
    point_namespace: str = "tessera:chunks"

    def __post_init__(self):
        for name in ("embedding_dimensions", "soft_limit_tokens", "hard_limit_tokens"):
            _whole(name, getattr(self, name))
        if self.hard_limit_tokens < self.soft_limit_tokens:
            raise ConfigError("hard_limit_tokens must not be below soft_limit_tokens")
        if not self.point_namespace.strip():
            raise ConfigError("point_namespace must not be blank")
        if not NAME.fullmatch(self.collection_prefix):
            raise ConfigError("collection_prefix may hold ASCII letters, digits, _ and - only")

    def collection(self, version: str) -> str:
        if not VERSION.fullmatch(version):
            raise ConfigError("an index version is 64 lower-case hexadecimal digits; there is no 'latest'")
        return f"{self.collection_prefix}_{version}"


@dataclass(frozen=True)
class RetrievalParams:
    """Candidates, fusion, diversity and context budget of a search."""

    candidate_top_k: int = 15
    rank_constant: int = 20
    dense_weight: float = 1.0
    bm25_weight: float = 0.005
    mmr_lambda: float = 0.7
    top_k: int = 3
    top_k_max: int = 10
    no_expand_tokens: int = 800
    context_tokens: int = 1200

    def __post_init__(self):
        for name in ("candidate_top_k", "rank_constant", "top_k", "top_k_max", "no_expand_tokens", "context_tokens"):
            _whole(name, getattr(self, name))
        for name in ("dense_weight", "bm25_weight"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not value > 0:
                raise ConfigError(f"{name} must be positive")
        if isinstance(self.mmr_lambda, bool) or not isinstance(self.mmr_lambda, (int, float)) or not 0 < self.mmr_lambda <= 1:
            raise ConfigError("mmr lambda must be above 0 and at most 1")
        if not self.top_k <= self.top_k_max <= self.candidate_top_k:
            raise ConfigError("top_k <= top_k_max <= candidate_top_k must hold")
        if self.context_tokens < self.no_expand_tokens:
            raise ConfigError("the context budget must not be below the expansion threshold")

    def asked(self, top_k: int) -> RetrievalParams:
        """The same with a request's own number of results, which is 1 to ``top_k_max``."""
        if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= self.top_k_max:
            raise ConfigError(f"top_k must be 1 to {self.top_k_max}")
        return replace(self, top_k=top_k)


#: Where each parameter stands in a configuration file.
PLACES = {
    "candidate_top_k": ("bm25", "candidate_top_k"),
    "rank_constant": ("rrf", "rank_constant"),
    "dense_weight": ("rrf", "dense_weight"),
    "bm25_weight": ("rrf", "bm25_weight"),
    "mmr_lambda": ("mmr", "lambda"),
}


def load_yaml(path: str) -> tuple[IndexContract, RetrievalParams]:
    """Read a YAML file with collection_prefix and the sections bm25, rrf and mmr."""
    import yaml

    with open(path, encoding="utf-8") as f:
        given = yaml.safe_load(f)
    if not isinstance(given, dict) or not all(isinstance(given.get(s), dict) for s in ("bm25", "rrf", "mmr")):
        raise ConfigError("the file must be a mapping with the sections bm25, rrf and mmr")
    missing = [f"{s}.{k}" for s, k in PLACES.values() if k not in given[s]]
    version = given["bm25"].get("tokenizer_version")
    if missing or not isinstance(given.get("collection_prefix"), str) or not isinstance(version, str) or not version.strip():
        raise ConfigError(f"missing or not text: {', '.join(missing) or 'collection_prefix, bm25.tokenizer_version'}")
    params = RetrievalParams(**{name: given[s][k] for name, (s, k) in PLACES.items()})
    return IndexContract(collection_prefix=given["collection_prefix"], bm25_tokenizer_version=version.strip()), params


def as_dict(x: object) -> dict:
    return {f.name: getattr(x, f.name) for f in fields(x)}
