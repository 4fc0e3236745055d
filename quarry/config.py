"""One configuration for all parts; nothing in it is ignored."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from quarry.operators.align import AlignConfig
from quarry.operators.chunks import ChunkConfig
from quarry.operators.validate import ValidationConfig
from quarry.schema import ConfigurationError, parse_format
from quarry.sources.models import InferenceConfig, Model, ProviderConfig


@dataclass(frozen=True)
class MultiPassConfig:
    """decay multiplies the temperature in each later pass. retry_empty goes on after a pass that found nothing."""

    passes: int = 2
    min_extractions: int = 1
    targeted: bool = True
    refinement: bool = True
    quality: float = 0.3
    max_reprocess: int = 10
    decay: float = 0.9
    retry_empty: bool = False


@dataclass(frozen=True)
class ExtractConfig:
    """answers: a folder where answers are kept, from which a later run with the same prompts and settings takes them."""

    model: Model | ProviderConfig | None = None
    format: str = "json"
    max_char_buffer: int = 8000
    partitions: int | None = None
    batch: int = 16
    workers: int = 6
    context: str | None = None
    unwrap: bool = False
    dedupe: bool = True
    inference: InferenceConfig = field(default_factory=lambda: InferenceConfig(0.3))
    chunking: ChunkConfig = field(default_factory=ChunkConfig)
    alignment: AlignConfig = field(default_factory=AlignConfig)
    validation: ValidationConfig = field(default_factory=ValidationConfig)
    multipass: MultiPassConfig | None = None
    answers: str | None = None

    def with_(self, **changes) -> ExtractConfig:
        return replace(self, **changes)

    @classmethod
    def for_openai(cls, model: str, api_key: str | None = None) -> ExtractConfig:
        return cls(ProviderConfig.openai(model, api_key))

    @classmethod
    def for_ollama(cls, model: str, base_url: str = "http://localhost:11434") -> ExtractConfig:
        return cls(ProviderConfig.ollama(model, base_url))

    @classmethod
    def high_performance(cls, model: Model | ProviderConfig) -> ExtractConfig:
        return cls(model, batch=64, workers=32, max_char_buffer=12_000)

    @classmethod
    def memory_efficient(cls, model: Model | ProviderConfig) -> ExtractConfig:
        return cls(model, batch=4, workers=2, max_char_buffer=4000)


def from_settings(settings: Mapping[str, Any], base: ExtractConfig) -> ExtractConfig:
    """base with the settings of a pipeline file: names are those of the file format, unknown ones an error, nulls mean unset."""
    s = {k: v for k, v in settings.items() if v is not None}
    unknown = s.keys() - _SETTINGS
    if unknown:
        raise ConfigurationError(f"Unknown settings: {', '.join(sorted(unknown))}")
    plain = {"max_char_buffer": "max_char_buffer", "batch_length": "batch", "max_workers": "workers", "additional_context": "context"}
    out = replace(base, **{to: s[name] for name, to in plain.items() if name in s})
    if "format_type" in s:
        out = replace(out, format=parse_format(s["format_type"]))
    if "temperature" in s or s.get("language_model_params"):
        i = out.inference
        out = replace(out, inference=replace(i, temperature=s.get("temperature", i.temperature), extra={**i.extra, **s.get("language_model_params", {})}))
    if isinstance(out.model, ProviderConfig):
        names = {"model_id": "model", "api_key": "api_key", "model_url": "base_url"}
        m = replace(out.model, **{to: s[name] for name, to in names.items() if name in s})
        out = replace(out, model=replace(m, constrained=s.get("use_schema_constraints", m.constrained), fenced=s.get("fence_output", m.fenced)))
    if s.get("resolver_params", {}).get("unwrap_extractions"):
        out = replace(out, unwrap=True)
    if "enable_multipass" in s:
        m = out.multipass or MultiPassConfig()
        m = replace(m, passes=s.get("multipass_max_passes", m.passes), min_extractions=s.get("multipass_min_extractions", m.min_extractions), quality=s.get("multipass_quality_threshold", m.quality))
        out = replace(out, multipass=m if s["enable_multipass"] else None)
    return out


#: Fixed names of a pipeline file's settings. debug has no effect.
_SETTINGS = {
    "model_id", "api_key", "format_type", "max_char_buffer", "temperature", "fence_output", "use_schema_constraints", "batch_length", "max_workers", "additional_context", "resolver_params",
    "language_model_params", "debug", "model_url", "enable_multipass", "multipass_max_passes", "multipass_min_extractions", "multipass_quality_threshold",
}
