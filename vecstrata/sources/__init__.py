"""Where an index keeps its tables and manifests."""

from .storage import FileStorage, MemoryStorage, Storage, open_uri, parse_uri

__all__ = ["FileStorage", "MemoryStorage", "Storage", "open_uri", "parse_uri"]
