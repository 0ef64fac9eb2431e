"""Errors of the engine; each carries what its message names."""

from __future__ import annotations


class VectideError(Exception):
    """Base of all errors."""


class DimensionMismatch(VectideError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"vector dimension mismatch: expected {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class DuplicateId(VectideError):
    def __init__(self, id: int):
        super().__init__(f"a record with id {id} already exists")
        self.id = id


class InvalidVector(VectideError):
    def __init__(self, why: str):
        super().__init__(f"invalid vector: {why}")
        self.why = why


class InvalidId(VectideError):
    """An id outside 0 .. 2^63 - 1, or a null one."""


class NotFound(VectideError):
    def __init__(self, id: int):
        super().__init__(f"no record with id {id}")
        self.id = id


class StorageError(VectideError):
    """Reading or writing failed."""


class SerializationError(VectideError):
    """A document is not of the expected form."""


class Corrupt(VectideError):
    def __init__(self, why: str):
        super().__init__(f"corrupt collection: {why}")


class UnsupportedVersion(VectideError):
    def __init__(self, version: str):
        super().__init__(f"unsupported format version {version}")
