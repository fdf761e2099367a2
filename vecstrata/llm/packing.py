"""Arrays of whole numbers as compressed binary values, and runs of rows in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, as many as the largest needs, compressed."""
    x = x.astype("<u8")
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], n).T
    return out.reshape(-1).view("<u8")


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """The rows of each value of a column, of rows that stand together by it."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0][column] != r[column]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held
