"""Typed errors, raised on the driver while a conversion is being built."""

from __future__ import annotations


class ScriptError(Exception):
    """Base of all errors of this package."""

    def __init__(self, message: str, cause: BaseException | None = None):
        super().__init__(message)
        self.cause = cause
        self.name = type(self).__name__


class MapNotFoundError(ScriptError):
    def __init__(self, system_code: str):
        super().__init__(f"Map not found: {system_code}")
        self.system_code = system_code


class DependencyMissingError(ScriptError):
    def __init__(self, dependency: str):
        super().__init__(f"Map dependency missing: {dependency}")
        self.dependency = dependency


class MapLogicError(ScriptError):
    """A map's rules can't be executed."""


class SystemConversionError(ScriptError):
    """Anything else that went wrong while a conversion was built."""
