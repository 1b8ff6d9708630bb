"""One error type; ``code`` is stable and dotted, e.g. ``transform.parameter_error``."""

from __future__ import annotations

from typing import Any


class EngineError(Exception):
    def __init__(self, code: str, message: str, step: str | None = None, details: dict[str, Any] | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.step, self.details = code, message, step, details or {}
