"""Settings, each with a default and an environment variable QUIRE_<NAME> that overrides it."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    # The defaults.
    model: str = "mock"
    ocr_confidence_threshold: float = 0.75
    verification_threshold: float = 0.85
    max_translation_retries: int = 2
    chunk_target_chars: int = 1200
    translation_concurrency: int = 3
    log_level: str = "INFO"
    cors_origins: str = "http://localhost:5173"

    def origins(self) -> list[str]:
        """A list of origins, given with commas between."""
        return [x.strip() for x in self.cors_origins.split(",") if x.strip()]


def load(environ: dict[str, str] | None = None) -> Settings:
    """Settings from the environment; a value of the wrong type raises ValueError."""
    found = os.environ if environ is None else environ
    given = {f.name: type(f.default)(found[f"QUIRE_{f.name.upper()}"]) for f in fields(Settings) if f"QUIRE_{f.name.upper()}" in found}
    return Settings(**given)
