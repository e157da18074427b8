"""What goes wrong, by kind. Names that are unknown are KeyErrors, shapes ValueErrors, types TypeErrors."""

from __future__ import annotations


class ContainerError(Exception):
    """A file that can't be read as a container; says where."""

    def __init__(self, reason: str, path: str = "", offset: int | None = None):
        self.reason, self.path, self.offset = reason, path, offset
        super().__init__(f"{reason}" + (f" in {path}" if path else "") + (f" at byte {offset}" if offset is not None else ""))

    def __reduce__(self):
        return type(self), (self.reason, self.path, self.offset)


class CorruptFileError(ContainerError):
    """Bytes that contradict the format."""


class SchemaConflict(ValueError):
    """Files of one chain that name different layouts alike, or one id differently."""
