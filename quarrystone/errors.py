"""Errors with the codes that the API promises."""


class EngineError(Exception):
    code = "INTERNAL"

    def __init__(self, message: str, *, reason: str | None = None):
        super().__init__(message)
        self.reason = reason


class InvalidArgument(EngineError):
    code = "INVALID_ARGUMENT"


class NotFound(EngineError):
    code = "NOT_FOUND"


class Conflict(EngineError):
    code = "CONFLICT"


class StoreUnavailable(EngineError):
    code = "STORE_UNAVAILABLE"
