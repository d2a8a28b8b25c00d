"""Kinds of failure, kept apart so that callers can tell what to do."""

from __future__ import annotations

import enum


class Kind(enum.Enum):
    INVALID = "invalid"
    NOT_FOUND = "not_found"
    TOO_LARGE = "too_large"
    BUDGET_EXCEEDED = "budget_exceeded"
    MODEL_FAILED = "model_failed"
    STALE = "stale"


class EngineError(Exception):
    def __init__(self, kind: Kind, message: str):
        super().__init__(message)
        self.kind = kind
