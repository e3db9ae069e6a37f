"""One exception with a hint, and the exit codes of the command line."""

from __future__ import annotations

EXIT_OK, EXIT_FAILED, EXIT_USAGE, EXIT_CANCELLED = 0, 1, 2, 130


class SigtokError(Exception):
    """A failure that the user can act on."""

    exit_code = EXIT_FAILED

    def __init__(self, message: str, hint: str = "") -> None:
        super().__init__(message)
        self.hint = hint


class UsageError(SigtokError):
    exit_code = EXIT_USAGE


class Cancelled(SigtokError):
    exit_code = EXIT_CANCELLED
