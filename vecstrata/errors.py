"""Typed errors; each has a stable ``code``."""

from __future__ import annotations


class VectorIndexError(Exception):
    code = "ERROR"


class DimensionMismatchError(VectorIndexError):
    code = "DIMENSION_MISMATCH"


class InvalidVectorError(VectorIndexError):
    code = "INVALID_VECTOR"


class BudgetExceededError(VectorIndexError):
    code = "BUDGET_EXCEEDED"


class ManifestConflictError(VectorIndexError):
    code = "MANIFEST_CONFLICT"


class InvalidArgumentError(VectorIndexError, ValueError):
    code = "INVALID_ARGUMENT"


class SnapshotExpiredError(VectorIndexError):
    code = "SNAPSHOT_EXPIRED"


class StorageError(VectorIndexError):
    code = "STORAGE"


class IndexNotFoundError(VectorIndexError):
    code = "INDEX_NOT_FOUND"


class IndexExistsError(VectorIndexError):
    code = "INDEX_EXISTS"


class ConfigMismatchError(VectorIndexError):
    code = "CONFIG_MISMATCH"


class IndexClosedError(VectorIndexError):
    code = "INDEX_CLOSED"


#: What a message from a worker may carry; see ``raise_typed``.
BY_CODE = {c.code: c for c in VectorIndexError.__subclasses__()}


def raise_typed(error: Exception) -> None:
    """Raise the typed error whose code a worker put in its message, or else ``error`` itself."""
    said = str(error)
    for code, kind in BY_CODE.items():
        at = said.find(f"[{code}]")
        if at >= 0:
            raise kind(said[at + len(code) + 2 :].split("\n")[0].strip()) from error
    raise error
