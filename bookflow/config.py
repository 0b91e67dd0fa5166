"""Job configuration. It never carries a key: keys belong to the translator callable."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from bookflow import constants as C


@dataclass(frozen=True)
class Preset:
    id: str = ""
    name: str = ""
    temperature: float = C.DEFAULT_TEMPERATURE
    prompt: str = ""


BUILTIN_PRESETS = {row[0]: Preset(*row) for row in C.PRESETS}


@dataclass(frozen=True)
class JobConfig:
    provider: str = "demo"
    model: str = "demo-translator"
    base_url: str = ""
    source_language: str = ""
    target_language: str = ""
    temperature: float | None = None
    max_tokens: int = 0
    preset: Preset | None = None
    context: str = ""
    glossary_limit: int = 80
    retrieval_count: int = 5
    summary_tokens: int = 350
    retrieval_tokens: int = 320
    preserve_paragraphs: bool = True
    use_cache: bool = True
    max_retries: int = 2
    chunk_size: int = C.DEFAULT_CHUNK_CHARS

    @property
    def max_chars(self) -> int:
        return max(C.MIN_CHUNK_CHARS, self.chunk_size or C.DEFAULT_CHUNK_CHARS)

    @property
    def retries(self) -> int:
        return max(0, min(8, self.max_retries))

    @property
    def effective_temperature(self) -> float:
        if self.temperature is not None:
            return float(self.temperature)
        return float(self.preset.temperature) if self.preset else C.DEFAULT_TEMPERATURE

    @property
    def prompt(self) -> str:
        return (self.preset.prompt if self.preset else "") or C.DEFAULT_PROMPT

    def key_fields(self) -> dict:
        """The settings that decide whether two requests may share a cached result."""
        return {
            "version": C.CACHE_VERSION,
            "provider": self.provider,
            "model": self.model,
            "base_url": self.base_url,
            "source_language": self.source_language,
            "target_language": self.target_language,
            "temperature": self.effective_temperature,
            "max_tokens": self.max_tokens,
            "preset": None if self.preset is None else vars(self.preset),
            "prompt_options": [
                self.glossary_limit,
                self.retrieval_count,
                self.summary_tokens,
                self.retrieval_tokens,
            ],
            "context": self.context,
        }

    def digest(self) -> str:
        canonical = json.dumps(self.key_fields(), sort_keys=True, ensure_ascii=False)
        return hashlib.sha256(canonical.encode("utf-8")).hexdigest()
