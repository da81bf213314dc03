"""Verdicts: every result says whether it is an answer, and a refusal says why and what to do.

A missing check is never reported as a passed one: unknown stays apart from fine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The verdicts a result can carry.
VERDICTS = (
    "ok", "invalid_request", "not_permitted", "not_configured", "wrong_capability", "context_exceeded", "context_unknown",
    "index_not_found", "index_unreadable", "unsupported_index", "stale_id", "index_error", "ollama_unreachable", "timeout",
    "ollama_timeout", "model_not_found", "ollama_error", "empty_response", "endpoint_unavailable", "truncated",
    "completion_unverified", "empty_generation", "incomplete", "bad_response", "no_models_installed", "internal_error",
)


class Refused(Exception):
    """An argument or state that an operation refuses before doing any work."""

    def __init__(self, verdict: str, error: str, remedy: str = ""):
        assert verdict in VERDICTS, verdict
        super().__init__(error)
        self.verdict, self.error, self.remedy = verdict, error, remedy

    def row(self) -> dict[str, str]:
        return {"verdict": self.verdict, "error": self.error, "remedy": self.remedy}


def first_of(*cases: tuple[Column, str], otherwise: str = "ok") -> Column:
    """The verdict of the first case that holds; a null condition does not hold."""
    out = F.lit(otherwise)
    for condition, verdict in reversed(cases):
        out = F.when(condition, F.lit(verdict)).otherwise(out)
    return out
