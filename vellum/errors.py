"""Errors of the screening stages. Row-level failures are columns of results; these are for callers' mistakes."""

from __future__ import annotations


class ScreeningError(Exception):
    """Base of all errors: a message, the stage and, where known, the candidate and file."""

    def __init__(self, message: str, stage: str | None = None, candidate_id: str | None = None, filepath: str | None = None) -> None:
        super().__init__(message)
        self.message, self.stage, self.candidate_id, self.filepath = message, stage, candidate_id, filepath

    def __str__(self) -> str:
        parts = [("stage", self.stage), ("candidate", self.candidate_id), ("file", self.filepath)]
        told = ", ".join(f"{k}={v}" for k, v in parts if v)
        return f"{self.message} ({told})" if told else self.message


class ReadError(ScreeningError):
    """A file can't be read."""


class UnsupportedFormatError(ReadError):
    """A file has an extension that no reader takes."""


class AnonymizationError(ScreeningError):
    """Redaction failed."""


class LeakError(AnonymizationError):
    """Redacted text still holds personal data."""

    def __init__(self, message: str, leaks: list | None = None, confidence: float = 0.0, **more: str) -> None:
        super().__init__(message, **more)
        self.leaks, self.confidence = leaks or [], confidence


class ParsingError(ScreeningError):
    """A text can't be parsed."""


class RankingError(ScreeningError):
    """Candidates can't be ranked."""


class EmptyQueryError(RankingError):
    """The job description is empty."""


class ExplanationError(ScreeningError):
    """An explanation can't be made."""


class AuditError(ScreeningError):
    """The audit log can't be made."""


class FairnessError(ScreeningError):
    """A fairness check failed."""


class StoreError(ScreeningError):
    """A table operation failed."""

    def __init__(self, message: str, operation: str | None = None, **more: str) -> None:
        super().__init__(message, **more)
        self.operation = operation


class ConfigurationError(ScreeningError):
    """A setting is wrong."""
