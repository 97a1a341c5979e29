"""Failures that callers can tell apart, each with its exit code."""

from __future__ import annotations


class CorpusError(Exception):
    code = 70


class UsageError(CorpusError):
    code = 64


class BadData(CorpusError):
    """What was read isn't as it should be."""

    code = 65


class RecordTooLong(BadData):
    pass


class InputMissing(CorpusError):
    code = 66


class ModeUnavailable(CorpusError):
    code = 69


class OutputFailed(CorpusError):
    code = 73


class PermissionRefused(CorpusError):
    code = 77


class UnsafeOrder(CorpusError):
    """A corpus whose order is unsafe, where that was to be an error."""

    code = 3
