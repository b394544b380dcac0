"""What packing and unpacking can be told, checked when it is made."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from .errors import ConfigError

CODECS = ("none", "lz4", "zstd")
INTEGRITY = ("off", "fast", "strong")
OWNER = ("auto", "preserve", "never")


def _cores() -> int:
    return os.cpu_count() or 1


@dataclass(frozen=True)
class PackConfig:
    codec: str = "zstd"
    level: int = -3
    threads: int = field(default_factory=_cores)
    bundle_target_bytes: int = 4 << 20
    small_file_threshold: int = 256 << 10
    integrity: str = "fast"
    preserve_owner: bool = False

    def __post_init__(self):
        if self.codec not in CODECS:
            raise ConfigError(f"codec {self.codec!r} is none of {CODECS}")
        if self.integrity not in INTEGRITY:
            raise ConfigError(f"integrity {self.integrity!r} is none of {INTEGRITY}")
        if not 0 < self.bundle_target_bytes < 1 << 32:
            raise ConfigError("bundle_target_bytes must lie between 1 and 2**32 - 1")
        if not 0 <= self.small_file_threshold < 1 << 32:
            raise ConfigError("small_file_threshold must lie between 0 and 2**32 - 1")
        if not 0 < self.threads < 1 << 16:
            raise ConfigError("threads must lie between 1 and 65535")


@dataclass(frozen=True)
class UnpackConfig:
    overwrite: bool = False
    integrity: str = "fast"
    restore_owner: str = "auto"
    threads: int | None = None
    #: Check the trailer before anything is written; else after, leaving a marker if it is wrong.
    trailer_first: bool = True

    def __post_init__(self):
        if self.integrity not in INTEGRITY:
            raise ConfigError(f"integrity {self.integrity!r} is none of {INTEGRITY}")
        if self.restore_owner not in OWNER:
            raise ConfigError(f"restore_owner {self.restore_owner!r} is none of {OWNER}")
        if self.threads is not None and self.threads < 1:
            raise ConfigError("threads must be 1 or more")
