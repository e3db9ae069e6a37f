"""Atomic files: a result appears under its name when it is whole, or not at all."""

from __future__ import annotations

import os
import uuid
from pathlib import Path
from typing import BinaryIO

from sigtok.errors import UsageError


def check_target(target: str, force: bool = False, inputs: tuple[str, ...] = ()) -> Path:
    """The target's path, if it may be written."""
    path = Path(target)
    if path.is_dir():
        raise UsageError(f"{target} is a directory")
    if not path.parent.is_dir():
        raise UsageError(f"the directory {path.parent} does not exist")
    if path.exists():
        if any(os.path.samefile(path, i) for i in inputs if os.path.exists(i)):
            raise UsageError(f"{target} is also the input")
        if not force:
            raise UsageError(f"{target} exists", "give --force to replace it")
    return path


class AtomicFile:
    """A context with an open file that takes the target's name on a clean exit."""

    def __init__(self, target: str, force: bool = False, inputs: tuple[str, ...] = ()) -> None:
        self.target = check_target(target, force, inputs)
        self.temporary = self.target.with_name(f".{self.target.name}.{uuid.uuid4().hex}.part")
        self.handle: BinaryIO | None = None

    def __enter__(self) -> BinaryIO:
        self.handle = open(self.temporary, "xb")
        return self.handle

    def __exit__(self, kind, value, trace) -> None:
        assert self.handle is not None
        try:
            if kind is None:
                self.handle.flush()
                os.fsync(self.handle.fileno())
        finally:
            self.handle.close()
        if kind is None:
            os.replace(self.temporary, self.target)
        else:
            self.temporary.unlink(missing_ok=True)
