"""Typed failures; the text is ``<kind>: <message>``."""

from __future__ import annotations


class EngineError(Exception):
    kind = "unknown"
    retryable = False

    def __init__(self, message: str = ""):
        self.message = message
        super().__init__(f"{self.kind}: {message}" if message else self.kind)


class NotFound(EngineError):
    kind = "not found"


class InvalidArgument(EngineError):
    kind = "invalid argument"


class Corruption(EngineError):
    kind = "corruption"


class StorageError(EngineError):
    kind = "io error"


class Aborted(EngineError):
    kind = "aborted"


class Timeout(EngineError):
    kind = "timeout"
    retryable = True


class Conflict(EngineError):
    kind = "conflict"
    retryable = True
