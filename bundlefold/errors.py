"""Errors of the engine, each with the exit code and the kind that the command line reports."""

from __future__ import annotations


class EngineError(Exception):
    kind, exit_code = "internal", 1


class UsageError(EngineError):
    """An argument or option that can't be used."""

    kind, exit_code = "usage", 2


class ConfigError(EngineError):
    kind, exit_code = "config", 10


class Unavailable(EngineError):
    """A part of the engine, or a tool, that this machine lacks."""

    kind, exit_code = "backend_unavailable", 70


class FormatError(EngineError):
    """Bytes that are not a container of this format: magic, lengths, checksums, unknown codes, invariants."""

    kind, exit_code = "parse", 30


class UnsupportedValue(FormatError):
    """A code of an enumeration that this version doesn't know."""


class TruncatedError(FormatError):
    """Bytes that end too early."""


class IntegrityError(EngineError):
    """A hash that differs: manifest, frame or trailer."""

    kind, exit_code = "integrity", 40


class UnsafePath(EngineError):
    """A path that would leave the output tree, or pass through a link."""

    kind, exit_code = "safety", 50


class FileSystemError(EngineError):
    kind, exit_code = "io", 20


def describe(error: BaseException) -> dict[str, object]:
    """kind, exit_code and message of any error; what the engine didn't raise itself is internal, or io."""
    if isinstance(error, EngineError):
        return {"kind": error.kind, "exit_code": error.exit_code, "message": str(error)}
    if isinstance(error, OSError):
        return {"kind": "io", "exit_code": 20, "message": str(error)}
    return {"kind": "internal", "exit_code": 1, "message": str(error)}
