"""Options and configuration, checked as they are made; unknown keys are refused."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

EMBED_ONLY, RERANK_ONLY = ("pooling", "normalize", "long-input"), ("activation",)
DEVICES = ("cpu", "cuda")


def _at_least(what: str, value: int, least: int) -> None:
    if value < least:
        raise ValueError(f"{what} must be at least {least}, is {value}")


@dataclass(frozen=True)
class EngineOptions:
    """Defaults are fixed values of the engine."""

    max_batch_size: int = 1024
    token_budget: int = 16384
    max_input_tokens: int = 0
    max_queued_inputs: int = 8192
    device: str = "cpu"
    tf32: bool = True

    def __post_init__(self):
        for name in ("max_batch_size", "token_budget", "max_queued_inputs"):
            _at_least(name.replace("_", "-"), getattr(self, name), 1)
        _at_least("max-input-tokens", self.max_input_tokens, 0)
        kind, _, number = self.device.strip().lower().partition(":")
        if kind not in DEVICES or (number and (kind == "cpu" or not number.isdigit())) or self.device.strip().endswith(":"):
            raise ValueError(f"unknown device {self.device!r}, expected cpu, cuda or cuda:N")


@dataclass(frozen=True)
class EmbeddingOptions:
    pooling: str | None = None
    long_input: str = "TRUNCATE"
    normalize: bool = True

    def __post_init__(self):
        if self.pooling not in (None, "CLS", "MEAN", "LAST_TOKEN") or self.long_input not in ("TRUNCATE", "CHUNK"):
            raise ValueError(f"unknown pooling or handling of long inputs: {self.pooling}, {self.long_input}")


@dataclass(frozen=True)
class RerankOptions:
    activation: str = "SIGMOID"

    def __post_init__(self):
        if self.activation not in ("SIGMOID", "NONE"):
            raise ValueError(f"unknown activation {self.activation}")


def token_limit(requested: int, model: int) -> int:
    """0 asks for the model's own limit, more than it is refused."""
    if requested > model:
        raise ValueError(f"max-input-tokens {requested} is above the model's limit of {model}")
    return requested or model


@dataclass(frozen=True)
class ModelConfig:
    name: str
    task: str
    path: str
    engine: EngineOptions = EngineOptions()
    embedding: EmbeddingOptions | None = None
    rerank: RerankOptions | None = None


@dataclass(frozen=True)
class ServerConfig:
    host: str = "0.0.0.0"
    port: int = 8080
    max_body_bytes: int = 32 << 20
    timeout_seconds: float = 60.0
    api_keys: tuple[str, ...] = ()

    def __post_init__(self):
        if not 0 <= self.port <= 65535:
            raise ValueError(f"port must be 0 to 65535, is {self.port}")
        _at_least("max-body-bytes", self.max_body_bytes, 1)
        if self.timeout_seconds < 0:
            raise ValueError("timeout-seconds must not be negative")
        if any(not k.strip() for k in self.api_keys):
            raise ValueError("api-keys must not be blank")


@dataclass(frozen=True)
class Config:
    server: ServerConfig = ServerConfig()
    models: tuple[ModelConfig, ...] = field(default=())

    def __post_init__(self):
        names = [m.name for m in self.models]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"models of one name: {twice}")


def _take(values: dict, kind: type, where: str) -> dict:
    """Keyword arguments of a dataclass from kebab-case keys; takes what it knows out of `values`."""
    out = {}
    for f in fields(kind):
        key = f.name.replace("_", "-")
        if key in values:
            v = values.pop(key)
            out[f.name] = tuple(v) if isinstance(v, list) else v
    if where and values:
        raise ValueError(f"unknown keys in {where}: {sorted(values)}")
    return out


def _model(values: dict, base: str) -> ModelConfig:
    values = dict(values)
    for key in ("name", "task", "path"):
        if not str(values.get(key) or "").strip():
            raise ValueError(f"{key} is required of every model")
    name, task, path = values.pop("name"), str(values.pop("task")).strip().upper(), values.pop("path")
    if task not in ("EMBED", "RERANK"):
        raise ValueError(f"unknown task {task}")
    for key in RERANK_ONLY if task == "EMBED" else EMBED_ONLY:
        if key in values:
            raise ValueError(f"{key} does not apply to task {task.lower()}")
    for key in ("pooling", "long-input", "activation"):
        if isinstance(values.get(key), str):
            values[key] = values[key].strip().upper().replace("-", "_")
    engine = EngineOptions(**_take(values, EngineOptions, ""))
    own = EmbeddingOptions if task == "EMBED" else RerankOptions
    options = own(**_take(values, own, f"model {name}"))
    return ModelConfig(name, task, os.path.normpath(os.path.join(base, path)), engine, *((options, None) if task == "EMBED" else (None, options)))


def load(path: str) -> Config:
    """From a YAML file; an empty one gives the defaults, relative model paths start from the file's folder."""
    import yaml

    with open(path, encoding="utf-8") as f:
        values = yaml.safe_load(f) or {}
    if not isinstance(values, dict):
        raise ValueError("a configuration is a mapping")
    server = ServerConfig(**_take(dict(values.pop("server", None) or {}), ServerConfig, "server"))
    models = tuple(_model(m, os.path.dirname(os.path.abspath(path))) for m in values.pop("models", None) or ())
    if values:
        raise ValueError(f"unknown keys: {sorted(values)}")
    return Config(server, models)
